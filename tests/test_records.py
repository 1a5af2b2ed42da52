"""Record files: sums, framing, the wire format of examples, whole sets of files, damage by name."""

import glob
import gzip
import os
import struct

import pytest
from pyspark.sql import functions as F

from lamina.sources import records


def test_sums_equal_a_plain_version():
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        crc ^= 0xFFFFFFFF
        return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF

    check = 0xE3069283  # the published check value of CRC-32C for these nine digits
    assert plain(b"123456789") == ((check >> 15 | check << 17) + 0xA282EAD8) & 0xFFFFFFFF
    items = [b"", b"a", b"123456789", bytes(range(256)) * 3, b"b", b"987654321", b""]
    assert records.masked_sums(items).tolist() == [plain(i) for i in items]
    assert records.framed([b"xy"]) == struct.pack("<QI2sI", 2, plain(struct.pack("<Q", 2)), b"xy", plain(b"xy"))


def test_wire_format():
    """Bytes by hand from the public description: an example of one map, packed numbers, negatives in ten bytes."""
    center = b"\x0a\x06center\x12\x08\x1a\x06\x0a\x04\x01\xac\x02\x00"
    volume = b"\x0a\x11label_volume_name\x12\x05\x0a\x03\x0a\x01v"
    whole = b"\x0a" + bytes([4 + len(center) + len(volume)]) + b"\x0a" + bytes([len(center)]) + center + b"\x0a" + bytes([len(volume)]) + volume
    assert records.example({"center": [1, 300, 0], "label_volume_name": b"v"}) == whole
    assert records.features_of(whole) == {"center": [1, 300, 0], "label_volume_name": [b"v"]}
    for f in ({"n": [-1, -(1 << 63), (1 << 63) - 1]}, {"n": []}, {"b": b"\xff" * 300}, {}):
        assert records.features_of(records.example(f)) == {k: v if isinstance(v, list) else [v] for k, v in f.items()}
    unpacked = b"\x0a\x0b\x0a\x09\x0a\x01n\x12\x04\x1a\x02\x08\x05"  # a number outside a packed list
    assert records.features_of(unpacked) == {"n": [5]}
    with pytest.raises(ValueError, match="longer than its message"):
        records.features_of(whole[:-1])


def test_sets_of_files(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    rows = spark.range(20_000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("data")).repartition(3)
    records.write_records(rows, path, "coords")
    assert sorted(os.listdir(tmp_path / "set")) == [f"coords-{k:05d}-of-00003" for k in range(3)]
    for source in (path, f"{path}/coords@3", ",".join(f"{path}/coords-{k:05d}-of-00003" for k in range(3))):
        got = records.read_records(spark, source)
        assert sorted(bytes(r["data"]) for r in got.select("data").collect()) == sorted(b"r%d" % k for k in range(20_000))
    numbers = got.groupBy("file").agg(F.min("record").alias("a"), F.max("record").alias("b"), F.count("*").alias("n"), F.countDistinct("record").alias("m")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["n"] == r["m"] for r in numbers)
    # a smaller set replaces the larger one; a set without rows has no files
    records.write_records(rows.limit(5).coalesce(1), path, "coords")
    assert records.read_records(spark, path).count() == 5 and len(os.listdir(tmp_path / "set")) == 1
    # a write that fails leaves the set that was there
    with pytest.raises(Exception, match="null"):
        records.write_records(rows.select(F.when(F.col("data") != "r77", F.col("data")).alias("data")), path, "coords")
    assert records.read_records(spark, path).count() == 5 and len(os.listdir(tmp_path / "set")) == 1
    records.write_records(rows.limit(0), path, "coords")
    assert records.read_records(spark, path).count() == 0
    with pytest.raises(Exception, match="nothing-here"):
        records.read_records(spark, f"file://{tmp_path}/nothing-here").count()


def test_damaged_records_are_named(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    items = [b"record %d" % k for k in range(20)]
    whole = bytearray(records.framed(items))
    at = len(records.framed(items[:7]))
    body, length, short = bytearray(whole), bytearray(whole), whole[:-3]
    body[at + 12] ^= 1
    length[at] ^= 4
    cut = gzip.compress(bytes(whole))[:-12]
    os.makedirs(tmp_path / "set")
    for name, data in {"body": gzip.compress(bytes(body)), "length": gzip.compress(bytes(length)), "short": gzip.compress(bytes(short)), "plain": bytes(whole), "empty": b"", "cut": cut}.items():
        (tmp_path / "set" / name).write_bytes(data)
    found = {}
    for r in records.read_records(spark, path, "PERMISSIVE").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["record"], r["data"] and bytes(r["data"]), r["damage"]))
    found = {k: sorted(v, key=lambda r: r[0]) for k, v in found.items()}
    assert found["plain"] == [(k, i, None) for k, i in enumerate(items)] and "empty" not in found
    assert found["body"] == [(k, None if k == 7 else i, "data differs from its sum" if k == 7 else None) for k, i in enumerate(items)]
    assert found["length"] == [(k, i, None) for k, i in enumerate(items[:7])] + [(7, None, "length differs from its sum")]
    assert found["short"][:19] == [(k, i, None) for k, i in enumerate(items[:19])] and found["short"][19][1:] == (None, "file ends within a record")
    assert found["cut"][-1][1] is None and found["cut"][-1][2]
    with pytest.raises(Exception, match="set/body, record 7: data differs"):
        records.read_records(spark, f"{path}/body").count()


def test_coordinates(spark, tmp_path):
    path = f"file://{tmp_path}/coords"
    rows = [("a", 1, 2, 3), ("é", 0, -5, 1 << 40), (None, 7, 7, 7), ("a", 1, 2, 3)]
    records.write_coordinate_records(spark.createDataFrame(rows, "volume string, z long, y long, x long"), path)
    got = records.read_coordinate_records(spark, path).select("volume", "z", "y", "x").collect()
    assert sorted(map(tuple, got)) == sorted((v or "", z, y, x) for v, z, y, x in rows)
    part = glob.glob(f"{tmp_path}/coords/part-*")[0]
    with gzip.open(part) as f:
        assert b"center" in f.read()
    records.write_records(spark.createDataFrame([(b"",)], "data binary"), path)
    with pytest.raises(Exception, match="no coordinate"):
        records.read_coordinate_records(spark, path).count()
