"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one last token of its BPE encoding: among the tokens that end there
(found by an automaton over the vocabulary with suffix links) the longest that is compatible with the last token of
the prefix before it. Back-pointers from the whole word give the exact ids without replaying merges.

Two neighbouring tokens are compatible if no merge would have joined pieces across their border. The pieces that
ever lie at the border are the right edge of the first token and the left edge of the second; each lives from the
merge that makes it to the merge that absorbs it, so two short lists of lifetimes decide.

Texts are cut into words by the tokenizer's pattern; words that a worker has met are remembered in a bounded store.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers, in each of two generations.
REMEMBERED = 200_000
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """A byte-level vocabulary file, with encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.ids: dict[str, int] = told["model"]["vocab"]
        letters = byte_letters()
        self._letter = {b: letter for b, letter in enumerate(letters)}
        value = {letter: b for b, letter in enumerate(letters)}
        self.bytes_of = {i: bytes(value[c] for c in t) for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._words = regex.compile(public_tokenizers.PATTERN)
        self._rank: dict[tuple[int, int], int] = {}
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[left], self.ids[right]
            self._rank[a, b] = rank
            self._made.setdefault(self.ids[left + right], (rank, a, b))
        self._ends = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i not in self.special.values():
                self._ends.add_word(token, (len(token), i))
        self._ends.make_automaton()
        self._edges: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}
        self._young: dict[str, tuple[str, int, bytes, list[int]]] = {}
        self._old: dict[str, tuple[str, int, bytes, list[int]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(piece, made at, absorbed at) of the pieces on a token's left (0) or right (1) edge, largest first."""
        known = self._edges[side].get(token)
        if known is None:
            known, until, piece = [], _NEVER, token
            while piece in self._made:
                rank, *parts = self._made[piece]
                known.append((piece, rank, until))
                until, piece = rank, parts[side]
            known.append((piece, -1, until))
            self._edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            known = True
            rank = self._rank
            for x, x_made, x_gone in self._edge(a, 1):
                for y, y_made, y_gone in self._edge(b, 0):
                    if x_made < y_gone and y_made < x_gone:  # there is a time when both lie at the border
                        at = rank.get((x, y))
                        # equal ranks: the same merge, which goes from left to right
                        if at is not None and at < x_gone and at <= y_gone:
                            known = False
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word: the last token of every prefix, then back from the end."""
        text = "".join(map(self._letter.__getitem__, word))
        last: list[tuple[int, int]] = [(-1, 0)] * (len(text) + 1)  # (token, its length) that ends each prefix
        done = -1
        for end, (length, token) in self._ends.iter(text):
            if end == done:
                continue  # a longer match was taken already; at most one is valid
            start = end + 1 - length
            if start == 0 or self.compatible(last[start][0], token):
                last[end + 1] = (token, length)
                done = end
        out, at = [], len(text)
        while at:
            token, length = last[at]
            out.append(token)
            at -= length
        return out[::-1]

    def word(self, word: str) -> tuple[str, int, bytes, list[int]]:
        """(ids as text, each with a comma behind, number of ids, decoded bytes, ids) of a word."""
        known = self._young.get(word)
        if known is None:
            known = self._old.get(word)
            if known is None:
                ids = self.word_ids(word.encode())
                known = ("".join(f"{i}," for i in ids), len(ids), b"".join(map(self.bytes_of.__getitem__, ids)), ids)
            if len(word) <= 64:
                if len(self._young) >= REMEMBERED:
                    self._old, self._young = self._young, {}
                self._young[word] = known
        return known

    def parts(self, text: str) -> list[tuple[str, int, bytes, list[int]]]:
        """The words of a text in order, encoded; special tokens stand for themselves."""
        pieces = self._special_split.split(text) if self._special_split else [text]
        out, get, slow = [], self._young.get, self.word
        for piece in pieces:
            if piece in self.special:
                i = self.special[piece]
                out.append((f"{i},", 1, piece.encode(), [i]))
            elif piece:
                out += [get(w) or slow(w) for w in self._words.findall(piece)]
                get = self._young.get
        return out

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in part[3]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row of docs, or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no ids and decode to the empty text; null keys and repeated rows stay. Other columns of
    docs are not read. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(vocabulary)
        for batch in batches:
            counts, first, second = [], [], []
            for cell in batch.column(1):
                parts = codes.parts(cell.as_py() or "")
                texts, sizes, raw, ids = zip(*parts) if parts else ((), (), (), ())
                counts.append(sum(sizes))
                back = b"".join(raw).decode("utf-8", "replace")
                if digests:
                    first.append(hashlib.sha256("".join(texts)[:-1].encode()).hexdigest())
                    second.append(hashlib.sha256(back.encode()).hexdigest())
                else:
                    first.append([i for part in ids for i in part])
                    second.append(back)
            kind = pa.string() if digests else pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[2]} {'string' if digests else 'array<int>'}, {names[3]} string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, public_tokenizers.path(VOCABULARY), digests=True)
