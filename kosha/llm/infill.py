"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (code points, words or lines). Two cuts drawn from a hash of the row's key part them into
prefix, middle and suffix, and the text is written anew with the middle last, each piece behind its sentinel.

Inside a task whole columns are handled at once: bytes that begin a unit give the offsets of a list array of units, the
flattened units carry their parent's index and their ordinal, the ordinals against the parent's cuts give every unit its
role, filtering by role and rebuilding the lists gives the pieces, and binary_join puts them together. No row is looped
over. Rows go through in runs of at most BLOCK bytes and a longer text in segments of that size whose pieces are joined
afterwards, so memory is bounded by BLOCK and the longest text, whatever a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
BLOCK = 1 << 20
#: Per cent of texts that are transformed, and of these, that begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _begins(data: pa.Array, before: int, unit: str) -> np.ndarray:
    """Whether each byte of data begins a unit; before: the byte ahead of data (any, where a row begins)."""
    if unit == "char":
        return pc.not_equal(pc.bit_wise_and(data, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8())).to_numpy(zero_copy_only=False)
    if unit == "line":
        ends = pc.equal(data, pa.scalar(10, pa.uint8())).to_numpy(zero_copy_only=False)
        return np.concatenate([[before == 10], ends[:-1]])
    blank = pc.is_in(data, value_set=pa.array([9, 10, 11, 12, 13, 32], pa.uint8())).to_numpy(zero_copy_only=False)
    ahead = np.concatenate([[before in (9, 10, 11, 12, 13, 32)], blank[:-1]])
    return ahead & ~blank


def _mod(x: pa.Array, m: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, m), m))


def _totals(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32))


class Run:
    """Some texts of a batch: their bytes, and the segments of at most `block` bytes that they are handled in."""

    def __init__(self, texts: pa.Array, unit: str, block: int):
        self.unit, self.rows = unit, len(texts)
        _, offsets, data = texts.buffers()
        self.at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + self.rows + 1].astype(np.int64)
        self.data = data if data is not None else pa.py_buffer(b"")
        raw = np.frombuffer(self.data, np.uint8)
        self.segments: list[tuple[np.ndarray, np.ndarray]] = []  # (rows, byte offsets), each list one group
        if self.at[-1] - self.at[0] <= block or self.rows > 1:
            self.segments.append((np.arange(self.rows), self.at))
            return
        low, high = int(self.at[0]), int(self.at[1])
        while low < high:
            cut = min(high, low + block)
            while cut < high and raw[cut] & 0xC0 == 0x80:  # at most three steps: never inside a code point
                cut -= 1
            self.segments.append((np.zeros(1, np.int64), np.array([low, cut])))
            low = cut

    def _marks(self, at: np.ndarray) -> np.ndarray:
        low, high = int(at[0]), int(at[-1])
        if low == high:
            return np.zeros(0, bool)
        before = np.frombuffer(self.data, np.uint8)[low - 1] if low > self.at[0] else 0
        marks = _begins(pa.Array.from_buffers(pa.uint8(), high - low, [None, self.data], offset=low), int(before), self.unit).copy()
        first = self.at[:-1][self.at[:-1] < self.at[1:]]  # a row's first byte begins a unit
        first = first[(first >= low) & (first < high)]
        marks[first - low] = True
        return marks

    def counts(self) -> np.ndarray:
        """Units of each row."""
        n = np.zeros(self.rows, np.int64)
        for rows, at in self.segments:
            seen = np.concatenate([[0], np.cumsum(self._marks(at))])
            n[rows] += np.diff(seen[at - at[0]])
        return n

    def pieces(self, cuts: tuple[pa.Array, pa.Array]) -> list[pa.Array]:
        """Prefix, middle and suffix of every row, whose units are cut before the given ordinals."""
        parts: list[list[pa.Array]] = [[], [], []]
        owners, base = [], np.zeros(self.rows, np.int64)
        for rows, at in self.segments:
            low = int(at[0])
            marks = self._marks(at)
            filled = at[:-1] < at[1:]
            opens = np.zeros(len(rows), bool)
            opens[filled] = marks[at[:-1][filled] - low]
            seen = np.concatenate([[0], np.cumsum(marks)])
            marks[at[:-1][filled] - low] = True  # a unit that a segment goes on with is an element of its list
            held = np.diff(np.concatenate([[0], np.cumsum(marks)])[at - low])
            begin = pc.indices_nonzero(pa.array(marks)).to_numpy()
            offsets = pa.array(np.append(begin, at[-1] - low).astype(np.int32))
            units = pa.StringArray.from_buffers(len(begin), offsets.buffers()[1], self.data.slice(low, int(at[-1]) - low))
            lists = pa.ListArray.from_arrays(_totals(held), units)
            parents = pc.list_parent_indices(lists)
            first = base[rows] - (filled & ~opens) - lists.offsets.to_numpy()[:-1]
            ordinals = pc.add(pa.array(np.arange(len(begin))), pc.take(pa.array(first), parents))
            own = [pc.take(pc.take(c, pa.array(rows)), parents) for c in cuts]
            late = [pc.greater_equal(ordinals, c) for c in own]
            for i, role in enumerate((pc.invert(late[0]), pc.and_not(late[0], late[1]), late[1])):
                number = pc.value_counts(pc.filter(parents, role))
                size = np.zeros(len(rows), np.int64)
                size[number.field("values").to_numpy()] = number.field("counts").to_numpy()
                parts[i].append(pc.binary_join(pa.ListArray.from_arrays(_totals(size), pc.filter(lists.flatten(), role)), ""))
            owners.append(rows)
            base[rows] += np.diff(seen[at - low])
        if len(self.segments) == 1:
            return [p[0] for p in parts]
        of_row = _totals(np.bincount(np.concatenate(owners) if owners else np.zeros(0, int), minlength=self.rows))
        return [pc.binary_join(pa.ListArray.from_arrays(of_row, pa.concat_arrays(p) if p else pa.array([], pa.string())), "") for p in parts]


def _transform(texts: pa.Array, draws: list[pa.Array], unit: str, block: int, share: tuple[int, int]) -> list[pa.Array]:
    """n, form, prefix and middle units, output of texts without nulls."""
    run = Run(texts, unit, block)
    n = pa.array(run.counts())
    sides = [_mod(h, pc.add(n, 1)) for h in draws[:2]]
    low, high = pc.min_element_wise(*sides), pc.max_element_wise(*sides)
    hundred = pa.array(np.full(len(texts), 100, np.int64))
    plain = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.greater_equal(_mod(draws[2], hundred), share[0]))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(_mod(draws[3], hundred), share[1])
    prefix, middle, suffix = run.pieces((low, high))
    joined = pc.if_else(
        spm,
        pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
        pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
    )
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    return [n, form, pc.if_else(plain, none, low), pc.if_else(plain, none, pc.subtract(high, low)), pc.if_else(plain, texts, joined)]


def fill_in_middle(
    docs: DataFrame, unit: str = "char", key: str = "doc_id", text: str = "text", seed: int = 1,
    transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row of docs.

    unit: char (code points), word (a run of other characters with the ASCII white space behind it; white space ahead
    of the first word is a unit) or line (with its line feed). Prefix ends after the smaller and middle after the
    larger of two draws from 0 to n. form is plain (output is the text) for empty texts, texts that hold a sentinel and
    100 - transformed per cent of the others; of the rest suffix_first per cent are spm and the others psm.
    Null texts count as empty. Null keys stay and draw as an empty key; equal keys draw alike, so repeated rows have
    equal results. An empty table gives an empty one. Columns other than key and text are not read. Every text is
    handled whole, whatever its length; Arrow holds an output of up to 2 GB.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            low = 0
            while low < len(batch):
                done = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + block, side="right")))
                part = batch.slice(low, high - low)
                made = _transform(part.column(1), part.columns[2:], unit, block, (transformed, suffix_first))
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])
                low = high

    narrow = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *_draws(F.col(key), seed))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. No piece holds a sentinel, so the first of each kind is the true one."""

    def behind(whole: Column, head: Column) -> Column:
        return F.substr(whole, F.length(head) + 4)

    def split(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(4))
        one = F.substring_index(body, second, 1)
        rest = behind(body, one)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, behind(rest, two)

    prefix, suffix, middle = split(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = split(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the transformed text and of the text rebuilt from it, of every document, by code points.

    Nulls, repeated rows, empty and very long texts and extra columns: see fill_in_middle.
    """
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
      n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS plain,
      ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS spm FROM d),
p AS (SELECT *, substring(t, 1, least(x, y)) AS a, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS b, substring(t, greatest(x, y) + 1) AS s FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN least(x, y) END AS prefix_chars, CASE WHEN NOT plain THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || s || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
