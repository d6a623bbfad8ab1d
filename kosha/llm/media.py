"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded to whole rows of 576 samples, become an 8-bit grey image (PNG, lossless). Each task packs the
images of its rows into tar shards in the shared folder, one member per distinct digest, and emits where each row's
image lies: shard, offset, length. A row never carries the payload. Metadata columns come from range reads of the
image header alone; the payload is read back by its range for checks and features.

A shard's name is new for each attempt of a task, so a repeated task never overwrites what another one refers to.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 576
#: Samples of an image row: one block, so that a row's filter byte costs little.
WIDTH = BLOCK
FILL = b"\xff"
#: A shard is closed when it holds so many bytes.
SHARD_BYTES = 64 << 20
#: Bytes of a PNG that hold its signature and header chunk.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, filled up to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return raw + FILL * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, every row unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER bytes alone."""
    if len(head) < HEADER or head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not the head of a PNG")
    return struct.unpack(">II", head[16:24])


def from_png(image: bytes) -> bytes:
    width, height = png_size(image[:HEADER])
    at, body = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, mean, deviation and a 16-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x >> 4, minlength=16)
    return f"h={len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};hist=" + "-".join(map(str, hist))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every row's image into tar shards below folder: (doc_id, n_bytes, digest, shard, offset, length).

    digest is the SHA-256 of the payload. Writing happens when the result is computed, so keep it in a table before
    reading it twice. Null texts are empty payloads; repeated texts share one member of a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out = tar = None
        where: dict[bytes, tuple[str, int, int]] = {}
        name = ""

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()

        try:
            for batch in batches:
                rows = []
                for cell in batch.column(1):
                    body = cell.as_py()
                    samples = payload(body)
                    digest = hashlib.sha256(samples).digest()
                    if digest not in where:
                        if tar is None or tar.offset >= SHARD_BYTES:
                            close()
                            where.clear()
                            name = f"{uuid.uuid4().hex}.tar"
                            out = store.open_output_stream(f"{root}/{name}")
                            tar = tarfile.open(fileobj=_Sink(out), mode="w", format=tarfile.USTAR_FORMAT)  # noqa: SIM115
                        image = to_png(samples)
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(image)
                        at = tar.offset + 512  # a member's data follow its one block of header
                        tar.addfile(info, io.BytesIO(image))
                        tar.members.clear()  # the index is in the rows
                        where[digest] = (name, at, len(image))
                    rows.append((len(body.encode()) if body else 0, digest.hex(), *where[digest]))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names)
        finally:
            close()

    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long")


class _Sink(io.RawIOBase):
    """What tarfile needs of a stream that only grows."""

    def __init__(self, out):
        self._out, self._at = out, 0

    def write(self, data) -> int:
        self._out.write(bytes(data))
        self._at += len(data)
        return len(data)

    def tell(self) -> int:
        return self._at

    def writable(self) -> bool:
        return True


def read_members(members: DataFrame, folder: str, whole: bool = True) -> DataFrame:
    """members (digest, shard, offset, length) with width and height from header-only range reads.

    With whole, also payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature from the full range.
    """
    more = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"] if whole else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for digest, shard, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{root}/{shard}")
                width, height = png_size(file.read_at(HEADER, at))
                row = [width, height]
                if whole:
                    image = file.read_at(n, at)
                    samples = from_png(image)
                    found = hashlib.sha256(samples).hexdigest()
                    if found != digest:
                        raise ValueError(f"{shard} at {at}: payload {found} where {digest} was stored")
                    row += [len(samples), found, zlib.crc32(samples[-32:]), hashlib.sha256(image).hexdigest(), feature(samples)]
                rows.append(row)
            columns = list(zip(*rows)) or [()] * (2 + len(more))
            kinds = [pa.int32(), pa.int32()] + ([pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if whole else [])
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if file is not None:
            file.close()

    names = ["digest", "shard", "offset", "length", "width", "height", *more]
    schema = "digest string, shard string, offset long, length long, width int, height int"
    if whole:
        schema += ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    return members.select("digest", "shard", "offset", "length").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs with the columns of its stored image; equal texts have equal values.

    Null and empty texts are one block of filling. Null keys and repeated rows stay; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "media")
    folder = f"{scratch.root}/shards"
    index = scratch.keep(write_shards(docs, folder, key, text))
    # tasks that met the same text each stored it: the first by name is the one that counts
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.keep(read_members(first.repartition(parts, "shard", "offset"), folder))
    rows = index.select("doc_id", "n_bytes", "digest")
    return rows.join(found, "digest").withColumn("media_bytes", F.col("length"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images in tar shards and read back."""
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "shard", "offset", "length", "width", "height",
    )
