"""Whole-volume distances, filters and peaks by line passes: the same as on one array, for any tile."""

import numpy as np
import pandas as pd
import pytest

from lamina.operators import kernels, lines, seeds, spacing, spatial


def frame(spark, a, **more):
    z, y, x = (c.ravel() for c in np.indices(a.shape))
    kind = {"f": float, "i": int, "b": bool}
    data = {"z": z.astype("int32"), "y": y.astype("int32"), "x": x.astype("int32"), **{n: v.ravel().astype(kind[v.dtype.kind]) for n, v in more.items()}}
    return spark.createDataFrame(pd.DataFrame(data))


def plain_nearest(labels, step):
    f = np.argwhere(labels > 0)
    dist, near = np.full(labels.shape, np.inf), np.zeros(labels.shape, int)
    for p in np.ndindex(*labels.shape):
        if len(f):
            d = (((f - np.array(p)) * step) ** 2).sum(1)
            dist[p] = np.sqrt(d.min())
            near[p] = min(labels[tuple(q)] for q in f[d == d.min()])
    return dist, near


@pytest.mark.parametrize("step", [(1, 1, 1), (2, 1, 1)])
def test_envelope(step):
    rng = np.random.default_rng(0)
    for k in range(60):
        a = np.where(rng.random(tuple(rng.integers(1, 8, 3))) < (0, 0.05, 0.3, 1)[k % 4], rng.integers(1, 5), 0) * 1
        a = np.where(a > 0, rng.integers(1, 5, a.shape), 0)
        for got, want in zip(kernels.nearest(a, step), plain_nearest(a, np.array(step))):
            assert (np.isinf(got) & np.isinf(want) | (np.abs(got - np.where(np.isinf(want), 0, want)) < 1e-9)).all()


@pytest.mark.parametrize("tile", [(3, 4, 5), (16, 16, 16)])
def test_nearest_in_volume(spark, tile):
    """Two volumes, one of them away from the origin and with holes where no voxel is, one without a label."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    a = np.where(rng.random((7, 9, 11)) < 0.02, rng.integers(1, 4, (7, 9, 11)), 0)
    there = rng.random(a.shape) < 0.6
    there[:, 3:7, :] = False  # whole tiles are missing
    there[a > 0] = True
    there[0, 0, 0] = there[-1, -1, -1] = True
    rows = frame(spark, a, label=a, there=there).where("there")
    one = rows.select(F.lit("a").alias("volume"), (F.col("z") - 5).alias("z"), "y", (F.col("x") + 40).alias("x"), "label")
    two = rows.select(F.lit("b").alias("volume"), "z", "y", "x", F.lit(0).cast("long").alias("label"))
    got = spatial.nearest_in_volume(one.unionByName(two), (1, 1, 2), tile).collect()
    dist, near = plain_nearest(a, np.array([2, 1, 1]))
    want = {("a", z - 5, y, x + 40): (near[z, y, x], round(dist[z, y, x], 9)) for z, y, x in np.argwhere(there).tolist()}
    want |= {("b", z, y, x): (0, float("inf")) for z, y, x in np.argwhere(there).tolist()}
    assert {(r["volume"], r["z"], r["y"], r["x"]): (r["nearest"], round(r["dist"], 9)) for r in got} == want
    assert len(got) == len(want)
    assert spatial.nearest_in_volume(one.limit(0), (1, 1, 2), tile).count() == 0


def test_unbounded_candidates_are_those_of_a_wide_bound(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    a = np.where(rng.random((6, 8, 10)) < 0.03, rng.integers(1, 5, (6, 8, 10)), 0)
    seg = frame(spark, a, label=a).select(F.lit("v").alias("volume"), "z", "y", "x", "label")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spatial.expanded_candidates(seg, (1, 1, 1), None, (4, 4, 4))) == rows(spatial.expanded_candidates(seg, (1, 1, 1), 30.0, (64, 64, 64)))


def greedy(points, reach):
    kept = []
    for v, *p in sorted(points, key=lambda q: (-q[0], q[1:])):
        if not any(all(abs(a - b) <= r for a, b, r in zip(p, q, reach)) for q in kept):
            kept.append(tuple(p))
    return sorted(kept)


@pytest.mark.parametrize("block", [(2, 3, 4), (64, 64, 64)])
@pytest.mark.parametrize("values", [1, 3, 1000])
def test_spaced(spark, block, values):
    """Plateaus (few values) make long chains of points that wait for each other, across blocks."""
    rng = np.random.default_rng(values)
    points = sorted({(float(rng.integers(0, values)), *map(int, rng.integers(-6, 14, 3))) for _ in range(300)})
    points = list({p[1:]: p for p in points}.values())
    df = spark.createDataFrame(points, "value double, z int, y int, x int")
    for reach in ((1, 2, 0),) if block[0] == 2 else ((1, 2, 0), (2, 2, 2)):
        got = spacing.spaced(df, reach, (), block).collect()
        assert sorted((r["z"], r["y"], r["x"]) for r in got) == greedy(points, reach)
    assert spacing.spaced(df.limit(0), (1, 1, 1)).count() == 0


def test_spaced_ties_along_many_blocks(spark, monkeypatch):
    """Points of one strength in a row of 20 blocks: rounds don't grow with the blocks, and the choice is that of the whole volume."""
    rng = np.random.default_rng(9)
    there = rng.random((160, 6, 6)) < 0.2
    rows = frame(spark, there, value=np.ones(there.shape), there=there).where("there").drop("there")
    written, kept = [], spacing.kept
    monkeypatch.setattr(spacing, "kept", lambda df, name: written.append(name) or kept(df, name))
    got = {(r["z"], r["y"], r["x"]) for r in spacing.spaced(rows, (2, 2, 2), (), (8, 8, 8)).collect()}
    want = set(map(tuple, kernels.peaks(there.astype(float), 2, 0.5).tolist()))
    assert got == want and len(written) < 12


def test_envelope_far_and_near():
    """Lines with and without values near each place, long ones, and values below 0: as over all places."""
    rng = np.random.default_rng(2)
    for k in range(40):
        n, step = int(rng.integers(1, 90)), (1.0, 2.0, 0.5)[k % 3]
        f, own = rng.integers(-3 if k % 5 == 0 else 0, 60, (4, n)).astype(float), rng.integers(1, 4, (4, n))
        f[rng.random((4, n)) < (0.1, 0.9, 0.99, 1)[k % 4]] = np.inf
        place = step * np.arange(n)
        v = f[:, None, :] + (place[:, None] - place[None, :]) ** 2
        least = v.min(-1)
        label = np.where(np.isinf(least), 0, np.where(v == least[..., None], own[:, None, :], 9).min(-1))
        best, near = kernels.envelope(f, own, step)
        assert (best == least).all() and (near == label).all()


def plain_edges(value, off, sigma):
    edge = kernels.sobel(value)
    edge = edge > kernels.gaussian(edge, sigma)
    d = kernels.distance(~(edge | off))
    return np.where(off | ~np.isfinite(d), -1, d)


@pytest.mark.parametrize("tile", [(4, 5, 6), (32, 32, 32)])
def test_seed_policies(spark, tile):
    rng = np.random.default_rng(3)
    value = kernels.gaussian(rng.random((10, 13, 15)), 1.0).round(6)
    off = rng.random(value.shape) < 0.02
    label = np.where(value > np.quantile(value, 0.97), 1, 0)
    df = frame(spark, value, value=value, excluded=off, label=label)
    at = lambda s: [(r["z"], r["y"], r["x"]) for r in s.orderBy("ord").collect()]
    want = [tuple(p) for p in kernels.peaks(plain_edges(value, off, 2.0), 2, 0.0).tolist()]
    assert at(seeds.peaks(df, (), 2, 2.0, tile=tile)) == want and len(want) > 5
    flat = [(z, *p) for z in range(10) for p in kernels.peaks(plain_edges(value[z], off[z], 2.0), 2, 0.5).tolist()]
    assert at(seeds.peaks_2d(df, 2, 0.5, 2.0, tile=tile)) == flat and len(flat) > 20
    d = kernels.distance((label == 0) & ~off)
    assert at(seeds.fill_empty(df, (), 2, 0.5, tile=tile)) == [tuple(p) for p in kernels.peaks(d, 2, 0.5).tolist()]
    bright = np.where(off, -np.inf, value)
    both = kernels.peaks(bright, 3, 0.0).tolist() + [[z, *p] for z in range(10) for p in kernels.peaks(bright[z], 1, 0.0).tolist()]
    assert at(seeds.peaks_3d_2d(df, (), 3, 1, tile=tile)) == [tuple(p) for p in both]
    # the noise belongs to the coordinates, whatever the tiles are
    assert at(seeds.peaks(df, (), 2, 2.0, noise=42, tile=tile)) == at(seeds.peaks(df, (), 2, 2.0, noise=42, tile=(7, 7, 7)))
    # sub-volumes named by a key are filtered by themselves
    halves = df.withColumn("half", (df["x"] >= 8).cast("int"))
    two = [p for a, b in ((0, 8), (8, 15)) for p in (kernels.peaks(bright[:, :, a:b], 3, 0.0) + [0, 0, a]).tolist()]
    assert sorted(at(seeds.intensity_peaks(halves, ("half",), 3, tile=tile))) == sorted(map(tuple, two))
    assert seeds.intensity_peaks(df.limit(0), (), 3, tile=tile).count() == 0


def test_tiles_round_trip(spark):
    from pyspark.sql import functions as F

    a = np.arange(60.0).reshape(3, 4, 5)
    df = frame(spark, a, value=a).select(F.lit("v").alias("volume"), "z", "y", "x", "value")
    packed = lines.tiles(df, {"value": (F.col("value"), "f8", 0.0)}, (2, 3, 2))
    back = lines.along(packed, "y", (2, 3, 2), {"value": "f8"}, lambda x: {"value": x["value"][..., ::-1]}, {"value": "f8"})
    got = lines.voxels(back, (2, 3, 2), {"value": "f8"}, lambda x: x["value"] >= 0, {"value": "double"})
    assert sorted((r["z"], r["y"], r["x"], r["value"]) for r in got.collect()) == [(z, y, x, a[z, 3 - y, x]) for z, y, x in np.ndindex(3, 4, 5)]
