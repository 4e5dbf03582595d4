"""Media columns in archives: a Spark data source over archive directories.

Payloads are stored as 8-bit grey PNG images, 64 samples a row, without loss. Many members go into one archive
file: their bytes one after another, then a directory (offset, length, checksum, id of each member), then a
footer with the directory's place. The source plans partitions as byte ranges of archives; a task reads the
directory, streams the members that begin in its range through Arrow in bounded batches, and retries each
member by its own offset, with the file opened anew, when reading fails or the checksum is wrong. A member that
stays unreadable fails the task; none is dropped.

Archives are named by task attempt; the commit message of each successful attempt goes into the folder's
list, so what lost or repeated tasks wrote is never read.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomgraph.llm import sharedfs
from loomgraph.llm.common import small_batches, work_dir

WIDTH = 64
MAGIC = b"LOOMARC1"
ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("crc", "<u4"), ("known", "<u4"), ("id", "<i8")])
#: Bytes of an archive, of a planned range, and of a batch. Members are never split.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20, 4 << 20
TRIES, WAIT_S = 4, 0.2
PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def to_png(data: bytes) -> bytes:
    """The payload of ``data`` as a PNG image; a private chunk keeps the unpadded length. Equal data, equal bytes."""
    payload = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(payload), WIDTH + 1), np.uint8)  # filter 0 before each row
    rows[:, 1:] = payload
    head = WIDTH.to_bytes(4, "big") + len(payload).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return PNG + _chunk(b"IHDR", head) + _chunk(b"nbYt", len(data).to_bytes(8, "big")) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image that to_png made."""
    assert image[:8] == PNG, "not a PNG image"
    at, found, idat = 8, {}, []
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + data) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big"), "a damaged chunk"
        idat.append(data) if kind == b"IDAT" else found.__setitem__(kind, data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes(), int.from_bytes(found[b"nbYt"], "big")


def feature(payload: bytes) -> str:
    """Integer statistics of the samples: share of each sixteenth of the range in permille, mean and mean step times 100."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) * 100 // max(1, len(x) - 1)
    return f"{'.'.join(map(str, shares.tolist()))};mean={int(x.sum(dtype=np.int64)) * 100 // len(x)};step={step}"


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list


def directory(f) -> np.ndarray:
    """The directory of an open archive."""
    size = f.size()
    f.seek(size - 24)
    at, n = np.frombuffer(f.read(16), "<i8").tolist()
    assert f.read(8) == MAGIC, "not an archive"
    f.seek(at)
    return np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        made, out, path, entries, at = [], None, "", [], 0

        def close() -> None:
            table = np.array(entries, ENTRY)
            out.write(table.tobytes())
            out.write(np.array([at, len(entries)], "<i8").tobytes() + MAGIC)
            out.close()
            made.append([path, at])

        for b in iterator:
            for key, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    path = f"{self.folder}/{uuid.uuid4().hex}.arc"
                    f, local = sharedfs.at(path)
                    f.create_dir(local.rpartition("/")[0], recursive=True)
                    out, entries, at = f.open_output_stream(local), [], 0
                image = image or b""
                out.write(image)
                entries.append((at, len(image), zlib.crc32(image), key is not None, key or 0))
                at += len(image)
                if at >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(made)

    def commit(self, messages: list) -> None:
        listed = [a for m in messages if m for a in m.archives]
        sharedfs.write(f"{self.folder}/list-{uuid.uuid4().hex}.json", [json.dumps(listed).encode()])

    def abort(self, messages: list) -> None:
        """Nothing was listed, so nothing is read."""


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        f, local = sharedfs.at(self.folder)
        found = []
        for info in f.get_file_info(fs.FileSelector(local, allow_not_found=True)):
            if info.base_name.startswith("list-"):
                with f.open_input_file(info.path) as x:
                    found += json.loads(x.read())
        # a member belongs to the range in which it begins; an empty one may begin at the end
        return [ByteRange(p, a, min(a + RANGE_BYTES, n) + (a + RANGE_BYTES >= n)) for p, n in sorted(found) for a in range(0, max(n, 1), RANGE_BYTES)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files: list = []

        def once(entry) -> bytes:
            if not files:
                files.append(sharedfs.opened(part.path))
            files[0].seek(int(entry["offset"]))
            data = files[0].read(int(entry["length"]))
            if len(data) != entry["length"] or zlib.crc32(data) != entry["crc"]:
                raise OSError(f"member at {entry['offset']} of {part.path} is damaged")
            return data

        def member(entry) -> bytes:
            for k in range(TRIES):
                try:
                    return once(entry)
                except (OSError, pa.ArrowException):
                    if k == TRIES - 1:
                        raise
                    for f in files:
                        f.close()
                    files.clear()
                    time.sleep(WAIT_S * 2**k)
            raise AssertionError

        with sharedfs.opened(part.path) as f:
            entries = directory(f)
        entries = entries[(entries["offset"] >= part.start) & (entries["offset"] < part.end)]
        ids, images, size = [], [], 0
        for e in entries:
            ids.append(int(e["id"]) if e["known"] else None)
            images.append(member(e))
            size += len(images[-1])
            if size >= BATCH_BYTES or len(ids) >= 4096:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "media": pa.array(images, pa.binary())})
                ids, images, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "media": pa.array(images, pa.binary())})
        for f in files:
            f.close()


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: doc_id bigint, media binary; writable alike."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id bigint, media binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_media(docs: DataFrame, folder: str) -> None:
    """Store every text of ``docs`` (doc_id, text) as an image in archives under ``folder``.

    A null text is empty; a null doc_id and repeated rows are kept; other columns are ignored; an empty table
    gives archives without members.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spark.dataSource.register(MediaArchives)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_png(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    d.mapInArrow(work, "doc_id bigint, media binary").write.format("media_archives").mode("append").save(folder)


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, media, payload, n_bytes, feature of stored images."""
    small_batches(media.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [from_png(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64()), pa.array([feature(x) for x, _ in found], pa.string())],
                names=["doc_id", "media", "payload", "n_bytes", "feature"],
            )

    return media.select("doc_id", "media").mapInArrow(work, "doc_id bigint, media binary, payload binary, n_bytes bigint, feature string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store the documents' payloads in the shared folder and read the archives back."""
    folder = work_dir(spark, "media")
    write_media(docs, folder)
    return decode_media(read_media(spark, folder))
