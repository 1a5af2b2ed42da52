"""Kernels against brute force, fixed cases, properties, sources and streams."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import augment, boxes, kernels, labels, masks, sampling, seeds, shared, spatial, traverse
from lamina.sources import segmentation, volume
from lamina.streaming import counters

AXES = ("z", "y", "x")


def frame(spark, a, name="label", kind="long", keep_zero=True):
    at = np.indices(a.shape).reshape(3, -1)
    pdf = pd.DataFrame({"z": at[0], "y": at[1], "x": at[2], name: a.ravel()})
    return spark.createDataFrame(pdf if keep_zero else pdf[pdf[name] != 0], f"z int, y int, x int, {name} {kind}")


# ---------------------------------------------------------------- kernels


@pytest.mark.parametrize("step", [(1.0, 1.0, 1.0), (3.0, 1.0, 2.0)])
def test_distance(step):
    rng = np.random.default_rng(1)
    mask = rng.random((4, 7, 6)) > 0.3
    zero = np.argwhere(~mask)
    want = np.array([[[np.sqrt((((zero - (i, j, k)) * step) ** 2).sum(1).min()) for k in range(6)] for j in range(7)] for i in range(4)])
    assert np.allclose(kernels.distance(mask, step), want)
    assert np.isinf(kernels.distance(np.ones((2, 2), bool))).all()


def test_nearest():
    a = np.zeros((1, 1, 7), np.int64)
    a[0, 0, 0], a[0, 0, 6] = 4, 9
    d, near = kernels.nearest(a)
    assert d[0, 0].tolist() == [0, 1, 2, 3, 2, 1, 0] and near[0, 0, :3].tolist() == [4, 4, 4] and near[0, 0, 4:].tolist() == [9, 9, 9]


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_components(connectivity):
    rng = np.random.default_rng(connectivity)
    a = rng.integers(0, 3, (3, 6, 5))
    got = kernels.components(a, connectivity)
    comp = {tuple(p): tuple(p) for p in np.argwhere(a > 0)}

    def find(p):
        while comp[p] != p:
            p = comp[p]
        return p

    for p in list(comp):
        for o in itertools.product((-1, 0, 1), repeat=3):
            q = tuple(np.add(p, o).tolist())
            if 0 < sum(map(abs, o)) <= connectivity and q in comp and a[p] == a[q]:
                comp[find(p)] = find(q)
    pairs = {(got[p], find(p)) for p in comp}
    assert len(pairs) == len({g for g, _ in pairs}) == len({r for _, r in pairs}) and (got[a == 0] == 0).all()


def test_smoothing_and_edges():
    a = np.zeros((9, 9))
    a[:, 5:] = 1
    assert kernels.sobel(a)[4].argmax() in (4, 5) and kernels.sobel(np.ones((5, 5))).max() == 0
    g = kernels.gaussian(np.eye(9), 1.0)
    assert abs(g.sum() - 9) < 1e-9 and np.allclose(g, g.T)
    eq = kernels.clahe(np.arange(64.0).reshape(8, 8))
    assert 0 <= eq.min() <= eq.max() <= 1


def test_peaks():
    a = np.zeros((1, 9, 9))
    a[0, 2, 2], a[0, 2, 4], a[0, 7, 7], a[0, 0, 8] = 5, 4, 3, 5
    assert kernels.peaks(a, 2, 0).tolist() == [[0, 0, 8], [0, 2, 2], [0, 7, 7]]
    assert len(kernels.peaks(a, 1, 3.5)) == 3


# ---------------------------------------------------------------- decision points: fixed cases


def points(spark, a, **kw):
    seg = frame(spark, a).withColumn("volume", F.lit("v"))
    got = spatial.decision_points(spatial.expanded_candidates(seg, **kw)).collect()
    return {(r["id_a"], r["id_b"]): r for r in got}


def squares():
    a = np.zeros((1, 100, 100), np.int64)
    a[0, :20, :20], a[0, :20, -20:], a[0, -20:, 40:60] = 1, 2, 3
    return a


def test_slabs(spark):
    zyx = scalar.unravel(F.col("id"), (100, 80, 60))
    label = F.when(zyx[0] < 40, 1).when(zyx[0] >= 60, 2).otherwise(0).cast("long")
    seg = spark.range(100 * 80 * 60).select(F.lit("v").alias("volume"), *[c.alias(a) for c, a in zip(zyx, AXES)], label.alias("label"))
    for kw in ({}, {"max_distance": 12.0, "block": (50, 40, 60)}):
        got = spatial.decision_points(spatial.expanded_candidates(seg, **kw)).collect()
        assert [(r["id_a"], r["id_b"], r["dist"], [r["x"], r["y"], r["z"]]) for r in got] == [(1, 2, 10.0, [29, 39, 49])]


def test_squares(spark):
    got = points(spark, squares())
    assert {k: [r["x"], r["y"], r["z"]] for k, r in got.items()} == {(1, 2): [49, 9, 0], (1, 3): [29, 49, 0], (2, 3): [69, 49, 0]}
    for block in ((64, 64, 64), (1, 30, 17)):
        near = points(spark, squares(), max_distance=30.0, block=block)
        assert {k: [r["x"], r["y"], r["z"]] for k, r in near.items()} == {(1, 2): [49, 9, 0]}


# ---------------------------------------------------------------- labels and traversal


def test_components_across_blocks(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, (5, 9, 8))
    want = kernels.components(a, 1)
    got = labels.split_components(frame(spark, a), (2, 3, 4)).toPandas()
    pairs = {(c, want[z, y, x]) for z, y, x, c in got[["z", "y", "x", "component"]].itertuples(index=False)}
    assert len(got) == (a > 0).sum() and len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
    clean, ids = labels.cleaned(frame(spark, a), (2, 3, 4), 3)
    sizes = {r["new_id"]: r["n"] for r in ids.collect()}
    assert sorted(sizes) == list(range(1, len(sizes) + 1)) and min(sizes.values()) >= 3
    assert clean.count() == sum(sizes.values())
    left = labels.surviving_origins(spark.createDataFrame([(1, 5), (99, 6)], "segment_id long, z int"), ids)
    assert {r["z"] for r in left.collect()} == {5}


def test_segment_all(spark):
    """Two bright bars become two objects, on one canvas as in Spark."""
    a = np.zeros((9, 12, 20))
    a[2:7, 2:5, 2:18], a[2:7, 8:11, 2:18] = 1, 1
    predict, config = traverse.threshold_predictor(0.5, 20.0), traverse.Config(fov=(3, 3, 3), min_size=10)
    canvas = traverse.Canvas(a, predict, config)
    at = np.argwhere(a > 0.6)
    canvas.segment_all([tuple(p) for p in at.tolist()])
    assert canvas.counters["segments"] == 2 and canvas.labels.max() == 2
    assert (canvas.labels[a > 0] > 0).mean() > 0.9 and (canvas.labels[a == 0] <= 0).all()
    vox = frame(spark, a, "value", "double").withColumn("volume", F.lit("v"))
    got = traverse.segment(vox, ["volume"], predict, config, 0.6).toPandas()
    assert {(z, y, x, s) for z, y, x, s in got[["z", "y", "x", "segment_id"]].itertuples(index=False)} == {(*p, canvas.labels[p]) for p in map(tuple, np.argwhere(canvas.labels > 0))}


def test_merge_rule():
    old, new = np.array([np.nan, -1.0, -3.0, 2.0]), np.array([3.0, 4.0, -4.0, 3.0])
    assert traverse.merge(old, new, 2.0, 0.0).tolist() == [3.0, -1.0, -4.0, 3.0]
    assert traverse.merge(old, new, 2.0, -1.0).tolist() == new.tolist()
    assert traverse.moves(np.full((3, 3, 3), np.nan), (1, 1, 1), 0.5) == []
    assert traverse.training_moves((1, 1, 1), 1)[0] == (0, 0, 0) and len(traverse.training_moves((8, 8, 8), 1)) == 27


# ---------------------------------------------------------------- boxes, sampling, augmentation


def test_tiling_covers(spark):
    for kw in ({}, {"shift_back": True}, {"keep_small": True}):
        seen = np.zeros((20, 70, 100), bool)
        for r in masks.tiling(spark, (0, 0, 0), (100, 70, 20), (32, 32, 16), (8, 8, 4), **kw).collect():
            seen[r["sz"] : r["ez"], r["sy"] : r["ey"], r["sx"] : r["ex"]] = True
        assert seen.all()


def test_mask_expressions():
    for bad in ("__import__('os')", "z > (select 1)", "z; x", "value > 1"):
        with pytest.raises(ValueError):
            masks.coordinate_expression(bad)


def test_balanced(spark):
    df = spark.createDataFrame([(c, i, 0, 0) for c, n in ((0, 3), (1, 10), (255, 50)) for i in range(n)], "cls int, z int, y int, x int")
    got = sampling.balanced(df, "cls", seed=2)
    assert sorted((r["cls"], r["count"]) for r in got.groupBy("cls").count().collect()) == [(0, 10), (1, 10)]
    times = [r["count"] for r in got.where("cls = 0").groupBy("z").count().collect()]
    assert sorted(times) == [3, 3, 4]
    assert sampling.balanced(df, "cls", target=2).count() == 4


def test_rotation():
    m = augment.rotation((0.3, 0.6, 0.9))
    assert np.allclose(m @ m.T, np.eye(3)) and abs(np.linalg.det(m) - 1) < 1e-9
    assert augment.rotated_input_size((10, 10), (1.0, 1.0), (1.0, 1.0)) == (15, 15)


def test_reflection_twice(spark):
    v = frame(spark, np.arange(24).reshape(2, 3, 4))
    twice = augment.reflect(augment.reflect(v, (2, 3, 4), (True, True, True)), (2, 3, 4), (True, True, True))
    assert sorted(map(tuple, twice.select("z", "y", "x", "label").collect())) == sorted(map(tuple, v.collect()))
    chosen = augment.some_slices(v, 0.5, 3).where("chosen").select("z").distinct().count()
    assert chosen == 1


def test_policies():
    assert seeds.policy("dense") is seeds.dense
    with pytest.raises(KeyError):
        seeds.policy("none")


def test_quantize(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (float("nan"),), (None,)], "p double")
    assert [r[0] for r in df.select(scalar.quantize(F.col("p"))).collect()] == [1, 255, 128, 0, 0]


# ---------------------------------------------------------------- sources, sinks, streams


def test_blocks_round_trip(spark, tmp_path):
    a = np.arange(1, 5 * 6 * 7 + 1).reshape(5, 6, 7)
    v = frame(spark, a)
    assert sorted(map(tuple, volume.unpack_blocks(volume.pack_blocks(v, (2, 4, 4))).select("z", "y", "x", "label").collect())) == sorted(map(tuple, v.collect()))
    path = str(tmp_path / "seg")
    for _ in range(2):
        volume.save_subvolumes(v, (4, 4, 4), path)
    one = volume.load_subvolume(spark, path, (4, 0, 4))
    assert one.count() == 1 * 4 * 3 and volume.existing_corners(spark, path).count() == 8
    halo = volume.with_halo(v, (2, 4, 4), (1, 1, 1))
    assert halo.where("is_core").count() == v.count() and halo.count() > v.count()


def test_coordinates(spark, tmp_path):
    assert volume.expand_shards("a@2, b") == ["a-00000-of-00002", "a-00001-of-00002", "b"]
    assert volume.volume_map("v1:p1:d,v2:p2") == {"v1": "p1:d", "v2": "p2"}
    path = str(tmp_path / "c")
    volume.write_coordinates(spark.createDataFrame([("v", 1, 2, 3)], "volume string, z int, y int, x int"), path)
    r = volume.read_coordinates(spark, path).first()
    assert (r["segment_id"], r["radius"]) == (0, 0.0)


def test_npy_source(spark, tmp_path):
    a = np.random.default_rng(0).random((5, 3, 2))
    np.save(tmp_path / "v.npy", a)
    volume.registered_npy(spark)
    got = spark.read.format("npy_volume").option("path", str(tmp_path / "v.npy")).option("slices", 2).load()
    assert got.rdd.getNumPartitions() == 3
    assert all(abs(a[r["z"], r["y"], r["x"]] - r["value"]) < 1e-12 for r in got.collect()) and got.count() == 30


def test_streams(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "name string, delta long")
    rows.coalesce(1).write.parquet(folder)
    src = counters.read_events(spark, folder, rows.schema)
    counters.run_once(counters.counter_totals(src), "totals", check)
    assert sorted(map(tuple, spark.sql("SELECT * FROM totals").collect())) == [("a", 4, 2), ("b", 2, 1)]
    # new files are added to what the checkpoint holds
    rows.coalesce(1).write.mode("append").parquet(folder)
    counters.run_once(counters.counter_totals(counters.read_events(spark, folder, rows.schema)), "totals2", check)
    assert sorted(map(tuple, spark.sql("SELECT * FROM totals2").collect())) == [("a", 8, 4), ("b", 4, 2)]
    assert {r["name"]: round(r["rate"], 3) for r in counters.class_rates(rows).collect()} == {"a": 0.667, "b": 0.333}


def test_progress_state(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = spark.createDataFrame([("c0", 1), ("c0", 5), ("c1", 2)], "corner string, step long")
    rows.coalesce(1).write.parquet(folder)
    out = counters.progress(counters.read_events(spark, folder, rows.schema))
    counters.run_once(out, "progress1", check, "update")
    assert sorted(map(tuple, spark.sql("SELECT * FROM progress1").collect())) == [("c0", 5, 2), ("c1", 2, 1)]


def test_growth_has_no_cap():
    """An object of more than 10,000 positions is grown to its end."""
    image = np.random.default_rng(0).uniform(0.8, 1, (40, 40, 40))
    canvas = traverse.Canvas(image, traverse.threshold_predictor(0.5), traverse.Config(fov=(3, 3, 3)))
    assert canvas.segment_at((20, 20, 20)) > 10_000


def test_shortest_path_beyond_64_steps(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(66)], "src long, dst long").coalesce(1)
    got = sorted(tuple(r) for r in labels.shortest_path(edges, 0, 66).collect())
    assert got == [(k, k) for k in range(67)]


def test_number(spark):
    rows = spark.range(1000).selectExpr("id", "cast(pmod(hash(id), 97) as int) AS k").repartition(7)
    got = sorted((r["n"], r["k"]) for r in shared.number(rows, "n", "k", "id").collect())
    assert [n for n, _ in got] == list(range(1, 1001)) and [k for _, k in got] == sorted(k for _, k in got)
    assert shared.number(rows.limit(0), "n", "k").count() == 0


def test_epochs(spark):
    rows = spark.range(50).withColumnRenamed("id", "x")
    order = lambda e: [r["x"] for r in sampling.epoch(rows, e, 3, "x").collect()]
    assert order(0) == order(0) != order(1) and sorted(order(0)) == sorted(order(1)) == list(range(50))


def test_uniform_over_boxes(spark):
    """Draws fall on boxes by their volume."""
    b = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 10), (2, 50, 50, 50, 60, 60, 80), (3, 0, 90, 0, 1, 91, 1)], "box_id long, sz long, sy long, sx long, ez long, ey long, ex long")
    n = {r["box_id"]: r["count"] for r in sampling.points_in_boxes(b, 8000, 1).groupBy("box_id").count().collect()}
    assert abs(n[1] - 2000) < 200 and abs(n[2] - 6000) < 200 and n.get(3, 0) < 20


def test_box_rules(spark):
    b = spark.createDataFrame([(0, 0, 0, 5, 5, 5)], "sz long, sy long, sx long, ez long, ey long, ex long")
    with pytest.raises(ValueError):
        boxes.box(b, start=(0, 0, 0))
    with pytest.raises(ValueError):
        boxes.sub(b, size=(1, 1, 1))
    with pytest.raises(ValueError):
        boxes.sub(b, start=(1, 1, 1), end=(2, 2, 2), size=(1, 1, 1))


def test_int_vectors(spark):
    from pyspark.errors import PySparkException

    ok = spark.createDataFrame([("1, -2,3.0",), (None,)], "t string").select(scalar.int_vector(F.col("t")).alias("v")).collect()
    assert tuple(ok[0]["v"]) == (1, -2, 3) and ok[1]["v"] is None
    for bad in ("1,2", "1,2,3.5", "a,b,c"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "t string").select(scalar.int_vector(F.col("t")).alias("v")).collect()


def test_expression_is_boolean(spark):
    from pyspark.errors import PySparkException

    v = spark.createDataFrame([(1, 2, 3)], "z int, y int, x int")
    assert v.select(masks.coordinate_expression("z + y = x").alias("m")).first()["m"]
    with pytest.raises(PySparkException):
        v.select(masks.coordinate_expression("z + y")).collect()


def test_coordinates_out_of_range(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        labels.split_components(spark.createDataFrame([(1 << 21, 0, 0, 1)], "z int, y int, x int, label long"), (4, 4, 4)).collect()


def test_page_sizes():
    assert labels.resized(10, 3, True) == (20, 1) and labels.resized(10, 3, False) == (5, 6) and labels.resized(1, 3, False) == (1, 3)


def test_missing_segmentation(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        segmentation.load_segmentation(spark, str(tmp_path))
    v = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 5)], "cz int, cy int, cx int, z int, y int, x int, label long")
    segmentation.save_segmentation(v, str(tmp_path), "checkpoint")
    with pytest.raises(FileNotFoundError):
        segmentation.load_segmentation(spark, str(tmp_path))
    rows, ids = segmentation.load_segmentation(spark, str(tmp_path), allow_checkpoint=True, split=True, min_size=1)
    assert [tuple(r) for r in ids.collect()] == [(1, 5, 1)] and rows.count() == 1
    with pytest.raises(ValueError):
        segmentation.load_segmentation(spark, str(tmp_path), allow_checkpoint=True, threshold=0.5)


def test_png_stack(spark, tmp_path):
    import struct
    import zlib

    a = np.random.default_rng(1).integers(0, 256, (3, 4, 5), dtype=np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    for k, s in enumerate(a):
        raw = b"".join(b"\0" + row.tobytes() for row in s)
        (tmp_path / f"s{k}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in segmentation.read_png_stack(spark, str(tmp_path)).collect()}
    assert got == {tuple(p): float(a[tuple(p)]) for p in np.argwhere(a >= 0).tolist()}


def test_seed_noise():
    """Equal values: noise leaves one peak, always the same; without it the first in raster order."""
    a = np.ones((1, 7, 7))
    assert kernels.peaks(a, 3, 0).tolist() == [[0, 0, 0], [0, 0, 4], [0, 4, 0], [0, 4, 4]]
    assert kernels.peaks(a, 3, 0, noise=42).tolist() == kernels.peaks(a, 3, 0, noise=42).tolist()
