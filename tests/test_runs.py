"""Runs by corner: a run that is killed half-way, the run after it, corners without rows, tasks that run again."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.operators import runs
from lamina.sources import corners

SCHEMA = "z int, label long"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/run"


def inputs_of(spark, n=12, rows=20):
    rng = np.random.default_rng(4)
    at = np.repeat(np.arange(n), rows)
    return spark.createDataFrame(pd.DataFrame({"cz": at * 8, "cy": 0, "cx": at % 3, "z": np.arange(len(at)) % rows, "label": rng.integers(0, 99, len(at))}))


def wanted_of(spark, n=13):
    return spark.range(n).selectExpr("id * 8 AS cz", "0 AS cy", "id % 3 AS cx")


def doubled(stop_at=None, log=None):
    def work(corner, rows):
        if log:
            open(f"{log}/{corner[0]}-{os.urandom(4).hex()}", "w").close()
        if stop_at is not None and corner[0] == stop_at:
            raise RuntimeError("killed here")
        return rows[["z", "label"]].assign(label=rows["label"] * 2)

    return work


def test_second_run_does_the_rest(spark, root, tmp_path):
    inputs, wanted = inputs_of(spark), wanted_of(spark)
    (tmp_path / "log").mkdir()
    with pytest.raises(Exception, match="killed here"):
        runs.run(wanted, inputs.repartition(1), doubled(stop_at=40), SCHEMA, root, "first")
    first = {r["cz"] for r in corners.finished(spark, root).collect()}
    assert 40 not in first
    runs.run(wanted.where("cz < 48 AND cz <> 40"), inputs, doubled(), SCHEMA, root, "early")
    early = {r["cz"] for r in corners.finished(spark, root).collect()}
    assert early >= {0, 8, 16, 24, 32} and 40 not in early
    runs.run(wanted, inputs, doubled(log=str(tmp_path / "log")), SCHEMA, root, "second")
    worked = {int(f.split("-")[0]) for f in os.listdir(tmp_path / "log")}
    assert worked == {8 * k for k in range(13)} - early
    got = runs.results(spark, root, SCHEMA)
    want = inputs.select("cz", "cy", "cx", "z", (F.col("label") * 2).alias("label"))
    assert sorted(map(tuple, got.select("cz", "cy", "cx", "z", "label").collect())) == sorted(map(tuple, want.collect()))
    made = {r["cz"]: r["run"] for r in got.select("cz", "run").distinct().collect()}
    assert {k for k, v in made.items() if v == "second"} == worked - {96}
    assert {(r["cz"], r["rows"]) for r in corners.finished(spark, root).where("rows = 0").collect()} == {(96, 0)}
    runs.run(wanted, inputs, doubled(stop_at=0), SCHEMA, root)  # nothing is left to do
    one = got.where("cz = 40")
    assert one.count() == 20 and "PartitionFilters: [isnotnull(cz" in one._jdf.queryExecution().toString()


def test_corners_of_a_killed_task_stay(spark, root):
    """All corners in one task, the last of them fails: what it ended before is finished, and the files agree with the markers."""
    inputs = inputs_of(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        with pytest.raises(Exception, match="killed here"):
            runs.run(wanted_of(spark, 12), inputs, doubled(stop_at=88), SCHEMA, root)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    done = corners.finished(spark, root).collect()
    assert 0 < len(done) < 12
    for r in done:
        assert os.path.exists(f"{root.removeprefix('file://')}/rows/cz={r['cz']}/cy={r['cy']}/cx={r['cx']}/{r['file']}")
    assert runs.results(spark, root, SCHEMA).count() == 20 * len(done)


def test_a_task_that_runs_again(spark, root):
    """A file that no marker names, as a lost attempt leaves it, is not read."""
    inputs = inputs_of(spark, 2)
    runs.run(wanted_of(spark, 2), inputs, doubled(), SCHEMA, root)
    for folder, _, files in list(os.walk(f"{root.removeprefix('file://')}/rows")):
        for f in files:
            with open(f"{folder}/{f}", "rb") as a, open(f"{folder}/lost.parquet", "wb") as b:
                b.write(a.read())
    assert runs.results(spark, root, SCHEMA).count() == 40


def test_empty_and_odd_inputs(spark, root):
    none = inputs_of(spark).limit(0)
    assert runs.results(spark, root, SCHEMA).count() == 0 and corners.finished(spark, root).count() == 0
    runs.run(none, none, doubled(), SCHEMA, root)
    assert corners.finished(spark, root).count() == 0
    odd = spark.createDataFrame([(0, 0, 0, None, None), (None, 0, 0, 1, 1), (5, 5, 5, 2, 2)], "cz int, cy int, cx int, z int, label long")
    twice = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (None, 0, 0), (-8, 0, 0)], "cz int, cy int, cx int")
    runs.run(twice, odd, lambda c, rows: rows[["z", "label"]], SCHEMA, root)
    got = runs.results(spark, root, SCHEMA).select("cz", "z", "label").collect()
    assert [tuple(r) for r in got] == [(0, None, None)]
    assert {r["cz"] for r in corners.finished(spark, root).collect()} == {0, -8}
