"""Pairs of overlapping boxes against a plain search; the query's work is dealt over tasks."""

import random

import pytest

from lamina.operators import masks
from lamina.plans import registry


@pytest.mark.parametrize("cell", [2, 16])
def test_overlapping_pairs(spark, cell):
    """Long, flat, empty and equal boxes, on both sides of 0, two of them under one id: each pair once, the smaller id first."""
    rng = random.Random(4)
    rows = [(rng.randrange(1000), *(at := [rng.randrange(-9, 12) for _ in range(3)]), *(a + rng.choice((0, 1, 1, 2, 3, 9)) for a in at)) for _ in range(150)]
    rows += [(2000, *rows[0][1:]), (2001, *rows[0][1:]), (2001, *rows[1][1:])]
    names = "box_id long, sz long, sy long, sx long, ez long, ey long, ex long"
    want = []
    for i, a, b in ((i, a, b) for i, a in enumerate(rows) for b in rows[:i]):
        low, high = [max(p, q) for p, q in zip(a[1:4], b[1:4])], [min(p, q) for p, q in zip(a[4:], b[4:])]
        if a[0] != b[0] and all(p < q for p, q in zip(low, high)):
            want.append((min(a[0], b[0]), max(a[0], b[0]), *low, *high))
    got = masks.overlapping_pairs(spark.createDataFrame(rows, names), cell)
    assert got.columns == ["box_a", "box_b", "sz", "sy", "sx", "ez", "ey", "ex"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert masks.overlapping_pairs(spark.createDataFrame([], names), cell).count() == 0


def test_pairs_are_dealt_over_tasks(spark, sf_dir):
    """A small file of boxes makes many pairs: the join is neither one task nor a broadcast of all cells."""
    df = registry.queries()["box_intersections"](spark, sf_dir)
    df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 1
