"""Spatial joins: contacts between segments, decision points, mask and distance filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.window import BLOCK, pairs_at
from lamina.sources.volume import with_halo

AXES = ("z", "y", "x")
#: The voxel itself and its neighbours towards larger coordinates (z, y, x).
FORWARD = [(0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]


def contacts(vox: DataFrame, label: str = "label", block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(id_a, id_b, z, y, x, offset_no): voxel pairs of different segments at the seven forward offsets, found in blocks with one more voxel; background never enters."""
    got = pairs_at(vox.where(F.col(label) > 0).select(*AXES, F.col(label).alias("label")), FORWARD, block).where("label <> other")
    return got.select(F.least("label", "other").alias("id_a"), F.greatest("label", "other").alias("id_b"), *AXES, "offset_no")


def decision_points(candidates: DataFrame) -> DataFrame:
    """From (volume if there is one, id_a, id_b, dist, z, y, x, offset_no): per pair the smallest distance, and of its points the one nearest to their centroid; ties by offset and raster order."""
    keys = [*(["volume"] if "volume" in candidates.columns else []), "id_a", "id_b"]
    pair = Window.partitionBy(*keys)
    best = candidates.withColumn("_least", F.min("dist").over(pair)).where("dist = _least")
    far = [F.pow(F.col(a) - F.avg(a).over(pair), 2) for a in AXES]
    best = best.withColumn("_d2", F.round(far[0] + far[1] + far[2], 9))
    order = Window.partitionBy(*keys).orderBy("_d2", "offset_no", *AXES)
    return best.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, "dist", "x", "y", "z")


def enough_context(points: DataFrame, shape: tuple[int, int, int], radius: tuple[int, int, int], margin: tuple[int, int, int]) -> DataFrame:
    """Points whose box of +-radius, and a further margin on each side, lies in the volume."""
    out = points
    for a, n, r, m in zip(AXES, shape, radius, margin):
        out = out.where((F.col(a) - r - m >= 0) & (F.col(a) + r + m < n))
    return out


def expanded(seg: DataFrame, voxel_size: tuple[float, float, float], max_distance: float, block: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """Each voxel with `nearest`, its nearest segment (of equally near ones the smallest; 0: none within max_distance), and the distance `dist`; in blocks with a halo of that distance."""
    import numpy as np
    import pandas as pd

    from lamina.operators import kernels

    step = voxel_size[::-1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows[list(AXES)].min().to_numpy()
        at = tuple((rows[k] - o).to_numpy() for k, o in zip(AXES, low))
        a = np.zeros(tuple(int(c.max()) + 1 for c in at), np.int64)
        a[at] = rows["label"]
        dist, near = kernels.nearest(a, step)
        d, n = dist[at], near[at]
        return rows[["volume", *AXES]].assign(nearest=np.where(d <= max_distance, n, 0), dist=d)[rows["is_core"]]

    halo = tuple(int(np.ceil(max_distance / s)) for s in step)
    return with_halo(seg.select("volume", *AXES, "label"), block, halo).groupBy("volume", "bz", "by", "bx").applyInPandas(run, "volume string, z int, y int, x int, nearest long, dist double")


def nearest_in_volume(seg: DataFrame, voxel_size: tuple[float, float, float] = (1, 1, 1), tile: tuple[int, int, int] = (32, 32, 32)) -> DataFrame:
    """Each voxel of (volume, z, y, x, label) with `nearest`, its nearest segment in the whole volume (of equally near ones the smallest; 0 where the volume has none), and the distance `dist`.

    Exact and without a bound: squared distances and labels pass along x, y and z, a row of tiles at a time, so no task holds the volume.
    """
    import numpy as np

    from lamina.operators import kernels, lines

    step = dict(zip(AXES, voxel_size[::-1]))
    packed = lines.tiles(seg, {"near": (F.greatest("label", F.lit(0)), "i8", 0), "there": (F.lit(True), "?", False)}, tile)
    kinds = {"near": "i8", "there": "?"}
    out = {"d": "f8", **kinds}
    for axis in ("x", "y", "z"):

        def run(a: dict, axis: str = axis) -> dict:
            d, near = kernels.envelope(a["d"] if "d" in a else np.where(a["near"] > 0, 0.0, np.inf), a["near"], step[axis])
            return {"d": d if axis != "z" else np.sqrt(d), "near": near, "there": a["there"]}

        packed, kinds = lines.along(packed, axis, tile, kinds, run, out), out
    got = lines.voxels(packed, tile, out, lambda a: a["there"], {"near": "long", "d": "double"})
    return got.withColumnsRenamed({"near": "nearest", "d": "dist"})


def expanded_candidates(seg: DataFrame, voxel_size: tuple[float, float, float] = (1, 1, 1), max_distance: float | None = None, block: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """Candidates of decision points: each voxel takes its nearest segment, no farther than max_distance (in units of voxel_size, xyz); where two such regions touch, the distance is the mean of both sides'.

    The volume is dealt in blocks: with a max_distance they have a halo of that distance, in which distances are found; without
    it, distances come from whole lines of the volume, and blocks need one more voxel only. `volume` tells volumes apart; pairs are not joined across them.
    """
    import numpy as np
    import pandas as pd

    from lamina.operators import kernels

    step = voxel_size[::-1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows[list(AXES)].min().to_numpy()
        shape = tuple((rows[list(AXES)].max().to_numpy() - low + 1).tolist())
        at = tuple((rows[k] - o).to_numpy() for k, o in zip(AXES, low))
        near, dist, there, core = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape, bool), np.zeros(shape, bool)
        there[at], core[at] = True, rows["is_core"]
        if max_distance is None:
            near[at], dist[at] = rows["nearest"], rows["dist"]
        else:
            near[at] = rows["label"]
            dist, near = kernels.nearest(near, step)
            near = np.where(there & (dist <= max_distance), near, 0)
        out = []
        for k, off in enumerate(FORWARD):
            here, there_ = tuple(slice(0, n - o) for n, o in zip(shape, off)), tuple(slice(o, n) for n, o in zip(shape, off))
            one, two = near[here], near[there_]
            z, y, x = np.nonzero((one != two) & (one > 0) & (two > 0) & core[here])
            l, r = one[z, y, x], two[z, y, x]
            mean = (dist[here][z, y, x] + dist[there_][z, y, x]) / 2
            out.append(pd.DataFrame({"volume": rows["volume"].iloc[0], "id_a": np.minimum(l, r), "id_b": np.maximum(l, r), "dist": mean.astype(float), "z": z + low[0], "y": y + low[1], "x": x + low[2], "offset_no": k}))
        return pd.concat(out).astype({"z": "int32", "y": "int32", "x": "int32", "offset_no": "int32"})

    schema = "volume string, id_a long, id_b long, dist double, z int, y int, x int, offset_no int"
    if max_distance is None:
        rows, halo = nearest_in_volume(seg.select("volume", *AXES, "label"), voxel_size, block), (1, 1, 1)
    else:
        # a neighbour of a core voxel looks max_distance further
        rows, halo = seg.select("volume", *AXES, "label"), tuple(int(np.ceil(max_distance / s)) + 1 for s in step)
    return with_halo(rows, block, halo).groupBy("volume", "bz", "by", "bx").applyInPandas(run, schema)


def near_segment(seeds: DataFrame, vox: DataFrame, reach: tuple[int, int, int]) -> DataFrame:
    """Seeds with a labelled voxel within the box of +-reach; cells of twice the reach make it an equi-join."""
    cells = {a: 2 * r + 1 for a, r in zip(AXES, reach)}
    s = seeds
    for a, r in zip(AXES, reach):
        s = s.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((F.col(a) - r) / cells[a]), F.floor((F.col(a) + r) / cells[a]))))
    v = vox.where("label > 0").select(*[F.floor(F.col(a) / cells[a]).alias(f"_c{a}") for a in AXES], *[F.col(a).alias(f"_v{a}") for a in AXES])
    on = [s[f"_c{a}"] == v[f"_c{a}"] for a in AXES] + [F.abs(s[a] - v[f"_v{a}"]) <= r for a, r in zip(AXES, reach)]
    return s.join(v, on, "left_semi").select(seeds.columns).distinct()


def outside_spheres(vox: DataFrame, spheres: DataFrame) -> DataFrame:
    """Voxels with `excluded`: within the radius of any sphere; spheres are cut to cells so the join is on equality."""
    cell = 16
    s = spheres
    for a in AXES:
        s = s.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((F.col(f"s{a}") - F.col("radius")) / cell), F.floor((F.col(f"s{a}") + F.col("radius")) / cell))))
    v = vox.withColumns({f"_c{a}": F.floor(F.col(a) / cell) for a in AXES})
    d2 = sum([(v[a] - s[f"s{a}"]) * (v[a] - s[f"s{a}"]) for a in AXES], F.lit(0))
    hit = v.join(s, [v[f"_c{a}"] == s[f"_c{a}"] for a in AXES] + [d2 <= s["radius"] * s["radius"]], "left_semi").select(*AXES, F.lit(True).alias("_hit"))
    return vox.join(hit, list(AXES), "left").withColumn("excluded", F.coalesce("_hit", F.lit(False))).drop("_hit")
