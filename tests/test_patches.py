"""Patches around centres against arrays, for any block, with edges, repeated and odd centres."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.operators import patches

SHAPE, RADIUS = (9, 8, 11), (1, 2, 3)


@pytest.fixture(scope="module")
def volume(spark):
    rng = np.random.default_rng(2)
    value, label = rng.random(SHAPE), rng.integers(0, 3, SHAPE) + (1 << 60) * rng.integers(0, 2, SHAPE)
    z, y, x = np.indices(SHAPE).reshape(3, -1)
    return value, label, spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "value": value.ravel(), "label": label.ravel()})).cache()


def centres_of(spark, at):
    return spark.createDataFrame(at, "cz int, cy int, cx int")


def inside(c):
    for d in np.ndindex(*[2 * r + 1 for r in RADIUS]):
        at = tuple(int(k) + int(o) - r for k, o, r in zip(c, d, RADIUS))
        if all(0 <= a < n for a, n in zip(at, SHAPE)):
            yield d, at


@pytest.mark.parametrize("block", [(32, 32, 32), (4, 3, 5), (1, 1, 1)])
def test_patches_equal_arrays(spark, volume, block):
    value, label, vox = volume
    rng = np.random.default_rng(7)
    at = [tuple(map(int, rng.integers(-2, np.array(SHAPE) + 2))) for _ in range(30)] + [(0, 0, 0), (8, 7, 10), (-1, -2, -3), (-50, 0, 0)]
    got = patches.patches(centres_of(spark, at + at[:9] + [(None, 1, 1)]), vox, RADIUS, ["value", "label"], block).collect()
    want = {(*c, *d): (value[p], label[p]) for c in set(at) for d, p in inside(c)}
    assert len(got) == len(want)
    assert {tuple(r[:6]): (r["value"], r["label"]) for r in got} == want


def test_shell_and_examples(spark, volume):
    value, label, vox = volume
    at = [(4, 4, 5), (0, 0, 0), (8, 7, 10), (9, 4, 4)]
    moves = patches.shell_any(centres_of(spark, at), vox, RADIUS, F.col("value") > 0.985, ["value"]).collect()
    face = lambda d: any(k in (0, 2 * r) for k, r in zip(d, RADIUS))
    assert {tuple(r[:3]): r["move"] for r in moves} == {c: any(value[p] > 0.985 for d, p in inside(c) if face(d)) for c in at}
    got = patches.examples(centres_of(spark, at), vox, RADIUS, 0.5, 0.25, (True, False, True)).collect()
    want = {}
    for c in at:
        own = label[c] if all(0 <= a < n for a, n in zip(c, SHAPE)) else 0
        for d, p in inside(c):
            want[(*c, 2 - d[0], d[1], 6 - d[2])] = ((value[p] - 0.5) / 0.25, 0.95 if own and label[p] == own else 0.05)
    assert {tuple(r[:6]): (r["image"], r["target"]) for r in got} == want


def test_many_centres_and_none(spark, volume, monkeypatch):
    value, _, vox = volume
    every = [tuple(map(int, c)) for c in np.ndindex(*SHAPE)]
    monkeypatch.setattr(patches, "AT_ONCE", 200)
    got = patches.patches(centres_of(spark, every), vox, (1, 1, 1), ["value"])
    sums = got.agg(F.count("*").alias("n"), F.sum("value").alias("s")).first()
    weight = np.ones(SHAPE)
    for axis, n in enumerate(SHAPE):
        w = np.full(n, 3.0)
        w[0] = w[-1] = 2
        weight *= np.moveaxis(w[:, None, None], 0, axis)
    assert sums["n"] == weight.sum() and abs(sums["s"] - (value * weight).sum()) < 1e-6
    assert patches.patches(centres_of(spark, []), vox, RADIUS, ["value"]).count() == 0
    assert patches.patches(centres_of(spark, every), vox.limit(0), RADIUS, ["value"]).count() == 0
