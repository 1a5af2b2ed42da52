"""The shuffle buffer: a plain version, restarts, epochs, bounds, odd rows."""

import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.streaming import shuffle

SCHEMA = "n long, name string"


def plain(rows_by_batch, lane, size, seed):
    """The rows of one lane, micro-batch by micro-batch; None ends the epoch."""
    buffer, out = [], []
    for rows in rows_by_batch:
        for r in sorted(r for r in rows if r is not None):
            if len(buffer) == size:
                j = shuffle.draw(seed, lane, len(out)) % size
                out.append(buffer[j])
                buffer[j] = r
            else:
                buffer.append(r)
        while None in rows and buffer:
            j = shuffle.draw(seed, lane, len(out)) % len(buffer)
            out.append(buffer[j])
            buffer[j] = buffer[-1]
            buffer.pop()
    return out


def part(spark, lo, hi):
    return spark.range(lo, hi).coalesce(1).select(F.col("id").alias("n"), F.format_string("row %d", "id").alias("name"))


def lanes_of(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("lane", "position").collect():
        assert r["position"] == len(got[r["lane"]]) and r["batch"] == r["position"] // 5 and r["name"] == f"row {r['n']}"
        got[r["lane"]].append(r["n"])
    return dict(got)


def epoch_of(spark, folder, stops, **kw):
    """Files one after another, the stream worked through after those in `stops` and at the end."""
    rows = lambda: shuffle.buffered(shuffle.read_rows(spark, f"{folder}/in", SCHEMA, 1), ["n"], kw.get("size", 12), 5, kw.get("seed", 3), 3)
    for k in range(4):
        shuffle.write_rows(part(spark, 50 * k, 50 * k + 50), f"{folder}/in")
        if k in stops:
            shuffle.work_through(rows(), f"{folder}/out", f"{folder}/state")
    shuffle.end_epoch(spark, f"{folder}/in", SCHEMA, 3)
    return shuffle.work_through(rows(), f"{folder}/out", f"{folder}/state")


def test_same_order_after_restarts(spark, tmp_path):
    whole = lanes_of(epoch_of(spark, f"file://{tmp_path}/a", ()))
    stopped = lanes_of(epoch_of(spark, f"file://{tmp_path}/b", (0, 2)))
    assert whole == stopped
    lane = {r["id"]: r["lane"] for r in spark.range(200).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("lane")).collect()}
    for k, got in whole.items():
        batches = [[n for n in range(50 * b, 50 * b + 50) if lane[n] == k] for b in range(4)] + [[None]]
        assert got == plain(batches, k, 12, 3)
        taken = sorted(n for n in lane if lane[n] == k)
        assert sorted(got) == taken and got != taken
        # no row comes out before the buffer had to make room for it
        assert all(taken.index(n) < p + 12 + 1 for p, n in enumerate(got))
    assert len(whole) == 3
    # a second epoch goes on in the same lanes: every row once more
    folder = f"file://{tmp_path}/b"
    again = lanes_of(epoch_of(spark, folder, ()))
    assert {k: v[: len(stopped[k])] for k, v in again.items()} == stopped
    assert all(sorted(v[len(stopped[k]) :]) == sorted(stopped[k]) and v[len(stopped[k]) :] != stopped[k] for k, v in again.items())


def test_before_the_end_a_full_buffer_stays(spark, tmp_path):
    folder = f"file://{tmp_path}"
    shuffle.write_rows(part(spark, 0, 100), f"{folder}/in")
    out = shuffle.buffered(shuffle.read_rows(spark, f"{folder}/in", SCHEMA), ["n"], 30, 5, 1, 1)
    assert shuffle.work_through(out, f"{folder}/out", f"{folder}/state").count() == 70
    shuffle.end_epoch(spark, f"{folder}/in", SCHEMA, 1)
    assert sorted(lanes_of(shuffle.work_through(out, f"{folder}/out", f"{folder}/state"))[0]) == list(range(100))


def test_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(1 << 60 | 1, "a"), (None, "b"), (5, None), (None, None), (5, None), (5, None), (1 << 60 | 3, "c")]
    shuffle.write_rows(spark.createDataFrame(rows, SCHEMA), f"{folder}/in")
    shuffle.write_rows(spark.createDataFrame([], SCHEMA), f"{folder}/in")
    shuffle.end_epoch(spark, f"{folder}/in", SCHEMA, 2)
    out = shuffle.buffered(shuffle.read_rows(spark, f"{folder}/in", SCHEMA), ["n", "name"], 2, 5, 1, 2)
    got = shuffle.work_through(out, f"{folder}/out", f"{folder}/state").collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(((r["n"], r["name"]) for r in got), key=key) == sorted(rows, key=key)
    with pytest.raises(ValueError, match="lane"):
        shuffle.write_rows(spark.createDataFrame(pd.DataFrame({"lane": [1]})), f"{folder}/in")
