"""Readers and writers of single-file formats: block files and write-ahead logs.

Block file: header, blocks, index, footer, little-endian. Its codec version tells
how a block's doubles are coded. A file whose checksum is set is checked.
Write-ahead log: 24-byte records, each with a CRC-32; replay takes records up to
the first that is short, of a wrong length or of a wrong checksum.

``write_block_files`` and ``Log`` write real files, and readers with a range read only the headers,
indexes and blocks they need, through ``pyarrow.fs`` where it knows the path's scheme
(``file``, ``hdfs``, ``s3``, ``gs``); other stores are read file by file, whole, by Spark.
"""

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from tidemill.functions import codecs
from tidemill.schema import BLOCK_POINTS

# Fixed values of the formats.
MAGIC, FLAGS = b"TSDB", 3
HEADER, FOOTER, ENTRY = "<4sHHIqqI", "<QIQI", "<qQII"
RECORD, PAYLOAD = "<II", "<qd"
NO_POINTS = (2**63 - 1, -(2**63))
LOG = "wal.bin"
#: Points of a block file, unless asked otherwise.
FILE_POINTS = 1 << 20
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")


def block_file(timestamps, values, version: int = codecs.VERSION) -> bytes:
    """A file of sorted points."""
    t, v = np.asarray(timestamps, np.int64), np.asarray(values, np.float64)
    body, entries = [], []
    at = struct.calcsize(HEADER)
    for k in range(0, len(t), BLOCK_POINTS):
        parts = codecs.encode_timestamps(t[k : k + BLOCK_POINTS]), codecs.encode_values(v[k : k + BLOCK_POINTS])
        block = b"".join(struct.pack("<I", len(p)) + p for p in parts)
        entries.append(struct.pack(ENTRY, int(t[k]), at, len(block), len(t[k : k + BLOCK_POINTS])))
        body.append(block)
        at += len(block)
    low, high = (int(t[0]), int(t[-1])) if len(t) else NO_POINTS
    head = struct.pack(HEADER, MAGIC, version, FLAGS, len(entries), low, high, 0)
    whole = head + b"".join(body) + b"".join(entries) + struct.pack("<QIQ", at, struct.calcsize(ENTRY) * len(entries), len(t))
    return whole + struct.pack("<I", zlib.crc32(whole))


def block_index(data: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Codec version and (first timestamp, offset, size, points) of each block."""
    if len(data) < struct.calcsize(HEADER) + struct.calcsize(FOOTER):
        raise ValueError("file too short")
    magic, version, *_ = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("invalid magic")
    at, size, _, crc = struct.unpack_from(FOOTER, data, len(data) - struct.calcsize(FOOTER))
    if crc and crc != zlib.crc32(data[:-4]):
        raise ValueError("wrong checksum")
    return version, list(struct.iter_unpack(ENTRY, data[at : at + size]))


def _touched(entries: list, start: int | None, end: int | None):
    """The index entries of blocks that may hold points of the range."""
    for k, entry in enumerate(entries):
        later = entries[k + 1][0] if k + 1 < len(entries) else None
        if not ((end is not None and entry[0] > end) or (start is not None and later is not None and later <= start and later != entry[0])):
            yield entry


def _points_of(blocks: list[tuple[bytes, int]], version: int, start: int | None, end: int | None):
    """(timestamps, values) of (bytes, points) blocks, within the range."""
    found = []
    for data, count in blocks:
        (n,) = struct.unpack_from("<I", data)
        (m,) = struct.unpack_from("<I", data, 4 + n)
        found.append((codecs.decode_timestamps(data[4 : 4 + n], count), codecs.decode_values(data[8 + n : 8 + n + m], count, version)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    t, v = map(np.concatenate, zip(*found, strict=True))
    keep = np.ones(len(t), bool)
    if start is not None:
        keep &= t >= start
    if end is not None:
        keep &= t <= end
    return t[keep], v[keep]


def read_block_file(data: bytes, start: int | None = None, end: int | None = None):
    """(timestamps, values) of a whole file's points in the range."""
    version, entries = block_index(data)
    return _points_of([(data[at : at + size], count) for _, at, size, count in _touched(entries, start, end)], version, start, end)


def read_block_file_range(file, size: int, start: int | None, end: int | None):
    """As ``read_block_file`` of an open file, of which only what the range needs is read; the checksum of
    the whole is not checked."""
    head, foot = struct.calcsize(HEADER), struct.calcsize(FOOTER)
    if size < head + foot:
        raise ValueError("file too short")
    magic, version, _, _, low, high, _ = struct.unpack(HEADER, file.read_at(head, 0))
    if magic != MAGIC:
        raise ValueError("invalid magic")
    if (end is not None and low > end) or (start is not None and high < start):
        return np.zeros(0, np.int64), np.zeros(0)
    at, length, _, _ = struct.unpack(FOOTER, file.read_at(foot, size - foot))
    entries = list(struct.iter_unpack(ENTRY, file.read_at(length, at)))
    return _points_of([(file.read_at(n, at), count) for _, at, n, count in _touched(entries, start, end)], version, start, end)


def log_record(timestamp: int, value: float) -> bytes:
    payload = struct.pack(PAYLOAD, timestamp, value)
    return struct.pack(RECORD, len(payload) + 4, zlib.crc32(payload)) + payload


def replay(data: bytes) -> list[tuple[int, float]]:
    """Points of the valid records at the start of a log."""
    found, size = [], struct.calcsize(RECORD) + struct.calcsize(PAYLOAD)
    for at in range(0, len(data) - size + 1, size):
        length, crc = struct.unpack_from(RECORD, data, at)
        payload = data[at + struct.calcsize(RECORD) : at + size]
        if length != struct.calcsize(PAYLOAD) + 4 or crc != zlib.crc32(payload):
            break
        found.append(struct.unpack(PAYLOAD, payload))
    return found


def opened(path: str):
    """(file system, its path) of a URI or local path."""
    return pyarrow.fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/").replace("s3a://", "s3://"))


class Log:
    """The write-ahead log of one writer: a file ``wal.bin`` in a folder. A point is safe once ``sync`` has returned."""

    def __init__(self, folder: str):
        self.fs, folder = opened(folder)
        self.fs.create_dir(folder, recursive=True)
        self.path = f"{folder}/{LOG}"
        self.local = isinstance(self.fs, pyarrow.fs.LocalFileSystem)
        self.file = open(self.path, "ab") if self.local else self.fs.open_append_stream(self.path)  # noqa: SIM115

    def append(self, timestamp: int, value: float) -> None:
        self.file.write(log_record(timestamp, value))

    def sync(self) -> None:
        self.file.flush()
        if self.local:
            os.fsync(self.file.fileno())

    def close(self) -> None:
        self.sync()
        self.file.close()

    def discard(self) -> None:
        self.file.close()
        self.fs.delete_file(self.path)


def write_block_files(points: DataFrame, folder: str, per_file: int = FILE_POINTS) -> int:
    """Writes points (unique timestamps) as ``000001.sst`` and so on, in the order of their timestamps; returns
    how many files. Tasks write files under other names, which get their numbers when all are there."""
    draft = f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}"

    def written(batches):
        fs, path = opened(draft)
        fs.create_dir(path, recursive=True)
        held, rows = [], []

        def put(batch):
            t, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            name = f"{uuid.uuid4().hex}.sst"
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(block_file(t, v))
            rows.append((name, int(t[0]), len(t)))

        def joined():
            return pa.Table.from_batches(held).combine_chunks()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= per_file:
                whole = joined()
                put(whole.slice(0, per_file))
                held[:] = whole.slice(per_file).to_batches()
        if held:
            put(joined())
        names, firsts, counts = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], names=["name", "first", "points"])

    ordered = points.select("timestamp", "value").repartitionByRange("timestamp").sortWithinPartitions("timestamp")
    done = ordered.mapInArrow(written, "name string, first long, points long").orderBy("first").collect()  # a row per file
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    for k, row in enumerate(done, 1):
        fs.move(f"{opened(draft)[1]}/{row['name']}", f"{path}/{k:06}.sst")
    if fs.get_file_info(opened(draft)[1]).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(opened(draft)[1])  # with files of tasks that ran twice
    return len(done)


def read_block_files(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, numbered: bool = False) -> DataFrame:
    """Points of every block file under ``path``, each file by one task; with ``numbered`` also the number
    (``generation``) that the file's name is. With a range, only headers, indexes and touched blocks are read, where
    the scheme is known."""
    ranged = start is not None or end is not None
    listed = spark.read.format("binaryFile").load(path)

    def points(batches):
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, name in enumerate(names):
                if batch.num_columns == 2:
                    fs, own = opened(name)
                    with fs.open_input_file(own) as file:
                        t, v = read_block_file_range(file, sizes[k], start, end)
                else:
                    t, v = read_block_file(batch.column(2)[k].as_py(), start, end)
                stem = name.rsplit("/", 1)[-1].removesuffix(".sst")
                arrays = [pa.array(t), pa.array(v), pa.array(np.full(len(t), int(stem) if stem.isdecimal() else 0))]
                yield pa.RecordBatch.from_arrays(arrays, names=["timestamp", "value", "generation"])

    schemes = path.split("://", 1)[0].split(":/", 1)[0] if ":/" in path else "file"
    columns = ["path", "length"] if ranged and schemes in SCHEMES else ["path", "length", "content"]
    found = listed.select(*columns).mapInArrow(points, "timestamp long, value double, generation long")
    return found if numbered else found.drop("generation")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, value, seq) of the valid records of every log under ``path``."""

    def points(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = replay(data.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.float64()), pa.array(range(len(rows)), pa.int64())],
                    names=["timestamp", "value", "seq"],
                )

    logs = spark.read.format("binaryFile").load(path).select("path", "content")
    return logs.mapInArrow(points, "timestamp long, value double, seq long")
