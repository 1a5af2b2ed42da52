"""Record files as a data source: framed records with masked CRC-32C sums, gzipped, and coordinates in the public wire format of examples.

A record is its length (8 bytes), the length's masked sum, the data and the data's masked sum, all little endian.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lamina.sources import store
from lamina.sources.volume import expand_shards

FORMAT = "record_files"
BATCH = 4096  # records that are checked and handed on together
#: Fixed values of the framing: the reversed polynomial of CRC-32C and the constant that sums are masked with.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _table()


def masked_sums(items: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each item; items of one length are summed side by side, byte by byte."""
    out = np.zeros(len(items), np.uint32)
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        columns = np.frombuffer(b"".join(items[k] for k in at), np.uint8).reshape(len(at), size).T
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for byte in columns:
            crc = TABLE[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))
        crc = ~crc
        out[at] = ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)
    return out


@lru_cache(1 << 16)
def _sum_of_length(head: bytes) -> int:
    return int(masked_sums([head])[0])


def framed(items: list[bytes]) -> bytes:
    lengths = [struct.pack("<Q", len(i)) for i in items]
    head, body = masked_sums(lengths), masked_sums(items)
    return b"".join(part for n, h, i, b in zip(lengths, head, items, body) for part in (n, struct.pack("<I", h), i, struct.pack("<I", b)))


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Staged(WriterCommitMessage):
    waiting: str
    rows: int


class RecordReader(DataSourceReader):
    """A file is a partition: a gzipped one can't be cut. Damage ends a task with the file's name and the record's number, or is a row."""

    def __init__(self, options: dict):
        self.patterns, self.mode = expand_shards(options["path"]), options.get("mode", "FAILFAST").upper()
        if self.mode not in ("FAILFAST", "PERMISSIVE"):
            raise ValueError("modes are FAILFAST and PERMISSIVE")

    def partitions(self) -> list[File]:
        from pyarrow import fs as pafs

        out = []
        for p in self.patterns:
            system, inner = store.opened(p)
            info = system.get_file_info(inner)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(p)
            prefix = p.rstrip("/")
            if info.type == pafs.FileType.Directory:
                names = sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File)
                out += [File(f"{prefix}/{n}") for n in names if n[0] not in "._"]
            else:
                out.append(File(prefix))
        return out

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a set without files
            return
        system, inner = store.opened(partition.path)
        with system.open_input_stream(inner, compression=None) as raw:
            magic = raw.read(2)
        with system.open_input_stream(inner, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else raw
            number = 0
            for items, wrong in _records(stream):
                if wrong and self.mode == "FAILFAST":
                    k = min(wrong)
                    raise ValueError(f"{partition.path}, record {number + k}: {wrong[k]}")
                n = len(items)
                yield pa.RecordBatch.from_pydict(
                    {"file": [partition.path] * n, "record": list(range(number, number + n)), "data": [None if k in wrong else i for k, i in enumerate(items)], "damage": [wrong.get(k) for k in range(n)]},
                    schema=pa.schema([("file", pa.string()), ("record", pa.int64()), ("data", pa.binary()), ("damage", pa.string())]),
                )
                number += n


def _records(stream) -> Iterator[tuple[list[bytes], dict[int, str]]]:
    """Batches of (data, damage by place). After a length that is wrong nothing more of the file can be told apart."""
    items: list[bytes] = []
    sums: list[int] = []

    def checked(extra: str | None = None):
        wrong = {int(k): "data differs from its sum" for k in np.flatnonzero(masked_sums(items) != np.array(sums, np.uint32))}
        if extra:
            wrong[len(items)] = extra
        return items + [b""] * bool(extra), wrong

    def exactly(n: int) -> bytes:
        got = b""
        while len(got) < n and (more := stream.read(n - len(got))):
            got += more
        return got

    damage = None
    while damage is None:
        try:
            head = exactly(12)
            if not head:
                break
            if len(head) < 12:
                damage = "file ends within a length"
                break
            size, crc = struct.unpack("<QI", head)
            if _sum_of_length(head[:8]) != crc:
                damage = "length differs from its sum"
                break
            data = exactly(size + 4)
        except (EOFError, gzip.BadGzipFile, zlib.error, OSError) as e:
            damage = f"stream is damaged: {e}"
            break
        if len(data) < size + 4:
            damage = "file ends within a record"
            break
        items.append(data[:-4])
        sums.append(struct.unpack("<I", data[-4:])[0])
        if len(items) == BATCH:
            yield checked()
            items, sums = [], []
    if items or damage:
        yield checked(damage)


class RecordWriter(DataSourceArrowWriter):
    """A task writes one file aside; files get their names name-00000-of-0000N when all are written. Nothing is left of a write that fails."""

    def __init__(self, options: dict, overwrite: bool):
        if not overwrite:
            raise ValueError("sets of record files are written whole: use mode overwrite")
        self.path, self.name, self.job = options["path"].rstrip("/"), options.get("name", "part"), uuid.uuid4().hex

    def _aside(self, root: str) -> str:
        return f"{root}/_waiting-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged | None:
        system, root = store.opened(self.path)
        system.create_dir(self._aside(root), recursive=True)
        waiting, rows = f"{self._aside(root)}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(waiting, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
            for batch in iterator:
                items = batch.column("data").to_pylist()
                if None in items:
                    raise ValueError("a record's data is null")
                for k in range(0, len(items), BATCH):
                    out.write(framed(items[k : k + BATCH]))
                rows += len(items)
        return Staged(waiting, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs as pafs

        system, root = store.opened(self.path)
        system.create_dir(self._aside(root), recursive=True)
        staged = [m for m in messages if m is not None and m.rows]
        for old in system.get_file_info(pafs.FileSelector(root)):
            if old.type == pafs.FileType.File:
                system.delete_file(old.path)
        for k, m in enumerate(staged):
            store.moved(system, m.waiting, f"{root}/{self.name}-{k:05d}-of-{len(staged):05d}")
        system.delete_dir(self._aside(root))

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = store.opened(self.path)
        store.removed(system, self._aside(root))


class RecordFiles(DataSource):
    """Options: path (files, folders, name@N, comma-separated), mode (FAILFAST or PERMISSIVE); to write: path (a folder), name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, record long, data binary, damage string"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(dict(self.options), overwrite)


def read_records(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """(file, record, data, damage): damaged records have null data and say why; with FAILFAST the first one ends the job and is named."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format(FORMAT).option("mode", mode).load(path)


def write_records(rows: DataFrame, path: str, name: str = "part", column: str = "data") -> None:
    """Write a binary column as a set of record files, one a partition that has rows."""
    rows.sparkSession.dataSource.register(RecordFiles)
    rows.selectExpr(f"CAST({column} AS BINARY) AS data").write.format(FORMAT).mode("overwrite").option("name", name).save(path)


def varint(n: int) -> bytes:
    """Base-128 digits of a number, two's complement in 64 bits below zero."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def example(features: dict[str, bytes | list[int]]) -> bytes:
    """An example's bytes: a map from names to a list of bytes (feature 1) or of whole numbers (feature 3, packed)."""
    entries = b""
    for name, v in features.items():
        value = _field(1, _field(1, v)) if isinstance(v, bytes) else _field(3, _field(1, b"".join(map(varint, v))))
        entries += _field(1, _field(1, name.encode()) + _field(2, value))
    return _field(1, entries)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: numbers as they are, the rest as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            n |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return n

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise ValueError("a field is longer than its message")
        yield tag >> 3, data[at : at + size]
        at += size


def _numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(n - (1 << 64) if n >> 63 else n)
            n = shift = 0
    return out


def features_of(data: bytes) -> dict[str, list]:
    """Names and lists of an example's features (bytes and whole numbers; others are left out). Of a name given twice the last counts."""
    out = {}
    for k, features in _fields(data):
        for k2, entry in _fields(features) if k == 1 else ():
            if k2 != 1:
                continue
            parts = dict(_fields(entry))
            for kind, listed in _fields(parts.get(2, b"")):
                values = [v for k3, v in _fields(listed) if k3 == 1]
                if kind == 1:
                    out[parts[1].decode()] = values
                elif kind == 3:
                    out[parts[1].decode()] = [n for v in values for n in (_numbers(v) if isinstance(v, bytes) else [v - (1 << 64) if v >> 63 else v])]
    return out


def write_coordinate_records(coords: DataFrame, path: str, name: str = "part") -> None:
    """(volume, z, y, x) as examples with `center` (x, y, z) and `label_volume_name`, in the order of the rows' partitions.

    A null coordinate is an error; a null volume is the empty name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["volume"], b["x"], b["y"], b["z"])
            yield pd.DataFrame({"data": [example({"center": [int(x), int(y), int(z)], "label_volume_name": (v or "").encode()}) for v, x, y, z in rows]})

    write_records(coords.select("volume", "z", "y", "x").mapInPandas(run, "data binary"), path, name)


def read_coordinate_records(spark: SparkSession, path: str) -> DataFrame:
    """(volume, z, y, x, file, record) of such files; `epoch` of `lamina.operators.sampling` shuffles them anew each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, record, data in zip(b["file"], b["record"], b["data"]):
                f = features_of(data)
                if len(f.get("center", ())) != 3 or len(f.get("label_volume_name", ())) != 1:
                    raise ValueError(f"{file}, record {record}: no coordinate")
                x, y, z = f["center"]
                rows.append((f["label_volume_name"][0].decode(), z, y, x, file, record))
            yield pd.DataFrame(rows, columns=["volume", "z", "y", "x", "file", "record"])

    return read_records(spark, path).select("file", "record", "data").mapInPandas(run, "volume string, z long, y long, x long, file string, record long")
