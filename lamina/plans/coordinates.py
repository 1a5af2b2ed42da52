"""Queries over boxes, coordinates, samples and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import augment, masks, sampling, seeds, spatial
from lamina.plans.base import BOXES, PAIRS, VOX, boxes, r9, shape, table, vox
from lamina.plans.registry import query

S = SparkSession
N_SLICES = "(SELECT count(*) // 16 FROM embeddings)"


@query(f"""WITH {BOXES} SELECT l.box_id AS box_a, r.box_id AS box_b, greatest(l.sz, r.sz) AS sz, greatest(l.sy, r.sy) AS sy, greatest(l.sx, r.sx) AS sx, least(l.ez, r.ez) AS ez, least(l.ey, r.ey) AS ey, least(l.ex, r.ex) AS ex
FROM boxes l JOIN boxes r ON greatest(l.sz, r.sz) < least(l.ez, r.ez) AND greatest(l.sy, r.sy) < least(l.ey, r.ey) AND greatest(l.sx, r.sx) < least(l.ex, r.ex) WHERE l.box_id < r.box_id""")
def box_intersections(spark: S, d: str) -> DataFrame:
    """Common parts of all pairs of boxes."""
    return masks.overlapping_pairs(boxes(spark, d), cell=16)


@query(f"WITH {BOXES} SELECT box_id % 10 AS g, min(sz) AS sz, min(sy) AS sy, min(sx) AS sx, max(ez) AS ez, max(ey) AS ey, max(ex) AS ex FROM boxes GROUP BY 1")
def box_hull(spark: S, d: str) -> DataFrame:
    return masks.hull(boxes(spark, d).withColumn("g", F.col("box_id") % 10), "g")


@query("""WITH t AS (SELECT i AS tile, i % 4 AS ix, i // 4 % 3 AS iy, i // 12 AS iz FROM range(0, 24) AS r(i))
SELECT tile, 5 + ix * 24 AS sx, least(5 + ix * 24 + 32, 105) AS ex, ix = 0 AS first_x, ix = 3 AS last_x,
       iy * 24 AS sy, least(iy * 24 + 32, 70) AS ey, iy = 0 AS first_y, iy = 2 AS last_y,
       iz * 12 AS sz, least(iz * 12 + 16, 20) AS ez, iz = 0 AS first_z, iz = 1 AS last_z FROM t""")
def box_tiling(spark: S, d: str) -> DataFrame:
    return masks.tiling(spark, (5, 0, 0), (100, 70, 20), (32, 32, 16), (8, 8, 4))


@query("""WITH t AS (SELECT i AS tile, i % 4 + 1 AS ix, i // 4 % 3 - 1 AS iy, i // 12 AS iz FROM range(0, 24) AS r(i))
SELECT tile, CAST(CASE WHEN ix < 4 AND iy >= 0 THEN (iz * 3 + iy) * 4 + ix END AS BIGINT) AS next FROM t""")
def tile_neighbours(spark: S, d: str) -> DataFrame:
    return spark.range(24).select(F.col("id").alias("tile"), masks.neighbour(F.col("id"), (4, 3, 2), (1, -1, 0)).alias("next"))


@query(f"WITH {BOXES} SELECT box_id, sz + 1 AS sz, sy + 1 AS sy, sx + 2 AS sx, ez - 1 AS ez, ey - 1 AS ey, ex - 2 AS ex FROM boxes WHERE sz + 1 < ez - 1 AND sy + 1 < ey - 1 AND sx + 2 < ex - 2")
def box_shrink(spark: S, d: str) -> DataFrame:
    return masks.shrink(boxes(spark, d), (1, 1, 2))


@query(f"""WITH {VOX}, g AS (SELECT CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM range(0, 9) AS a(i), range(0, 10) AS b(i), range(0, 12) AS c(i))
SELECT g.z, g.y, g.x, coalesce(v.label, 0) AS label FROM g LEFT JOIN vox v ON v.z = g.z - 2 + 8 AND v.y = g.y - 2 + 5 AND v.x = g.x - 2 + 26
  AND g.z - 2 BETWEEN 0 AND 4 AND g.y - 2 BETWEEN 0 AND 5 AND g.x - 2 BETWEEN 0 AND 7""")
def crop_and_pad(spark: S, d: str) -> DataFrame:
    """A crop of (5, 6, 8) about (10, 8, 30), padded to (9, 10, 12)."""
    return masks.crop_pad(vox(spark, d), (10, 8, 30), (5, 6, 8), (9, 10, 12), "label")


@query(f"""WITH {VOX}, {BOXES}, p AS (SELECT DISTINCT z, y, x FROM vox WHERE label > 0)
SELECT z, y, x FROM p WHERE EXISTS (SELECT 1 FROM boxes WHERE sz <= z - 1 AND ez > z + 1 AND sy <= y - 1 AND ey > y + 1 AND sx <= x - 2 AND ex > x + 2)""")
def filter_oob(spark: S, d: str) -> DataFrame:
    p = vox(spark, d).where("label > 0").withColumn("volume", F.lit("v"))
    return masks.in_boxes(p, boxes(spark, d).withColumn("volume", F.lit("v")), cell=16, radius=(1, 1, 2)).select("z", "y", "x").distinct()


@query(f"""WITH {VOX} SELECT z, y, x FROM vox WHERE label > 0 AND (z % 2 = 1 OR (z BETWEEN 4 AND 13 AND y BETWEEN 2 AND 9 AND x BETWEEN 10 AND 29))""")
def filter_by_volume_boxes(spark: S, d: str) -> DataFrame:
    """Even slices are a volume with a box, odd ones a volume without any, which passes."""
    p = vox(spark, d).where("label > 0").withColumn("volume", (F.col("z") % 2).cast("string")).select("volume", "z", "y", "x")
    b = spark.createDataFrame([("0", 4, 2, 10, 14, 10, 30)], "volume string, sz int, sy int, sx int, ez int, ey int, ex int")
    return masks.in_boxes_or_unbounded(p, b, cell=8).select("z", "y", "x")


@query(f"""WITH {VOX}, s AS (SELECT z, y, x FROM vox WHERE value > 0.25) SELECT s.z, s.y, s.x FROM s
WHERE EXISTS (SELECT 1 FROM vox v WHERE v.label IN (3, 7) AND abs(v.z - s.z) <= 1 AND abs(v.y - s.y) <= 1 AND abs(v.x - s.x) <= 1)""")
def seeds_too_close(spark: S, d: str) -> DataFrame:
    v = vox(spark, d)
    return spatial.near_segment(v.where("value > 0.25").select("z", "y", "x"), v.where("label IN (3, 7)"), (1, 1, 1))


CONTACTS = f"""{VOX}, o AS (SELECT * FROM (VALUES (0,0,0,1), (1,0,1,0), (2,0,1,1), (3,1,0,0), (4,1,0,1), (5,1,1,0), (6,1,1,1)) AS t(offset_no, dz, dy, dx)),
s AS (SELECT z, y, x, label, offset_no, z + dz AS qz, y + dy AS qy, x + dx AS qx FROM vox, o WHERE label > 0),
c AS (SELECT least(s.label, q.label) AS id_a, greatest(s.label, q.label) AS id_b, s.z, s.y, s.x, CAST(offset_no AS INTEGER) AS offset_no
  FROM s JOIN (SELECT z, y, x, label FROM vox WHERE label > 0) q ON q.z = s.qz AND q.y = s.qy AND q.x = s.qx WHERE s.label <> q.label)"""


@query(f"WITH {CONTACTS} SELECT * FROM c")
def contacts(spark: S, d: str) -> DataFrame:
    return spatial.contacts(vox(spark, d), block=(8, 8, 16))


@query(f"""WITH {CONTACTS}, m AS (SELECT *, CAST(offset_no // 3 + 1 AS DOUBLE) AS dist FROM c),
b AS (SELECT * FROM m QUALIFY dist = min(dist) OVER (PARTITION BY id_a, id_b)),
e AS (SELECT *, round(power(z - avg(z) OVER p, 2) + power(y - avg(y) OVER p, 2) + power(x - avg(x) OVER p, 2), 9) AS d2 FROM b WINDOW p AS (PARTITION BY id_a, id_b))
SELECT id_a, id_b, dist, x, y, z FROM e QUALIFY row_number() OVER (PARTITION BY id_a, id_b ORDER BY d2, offset_no, z, y, x) = 1""")
def decision_points_contact(spark: S, d: str) -> DataFrame:
    c = spatial.contacts(vox(spark, d)).withColumn("dist", (F.floor(F.col("offset_no") / 3) + 1).cast("double"))
    return spatial.decision_points(c)


# ---------------------------------------------------------------- sampling

CLASSES = f"{VOX}, k AS (SELECT z, y, x, CAST(CASE WHEN label = 10 THEN 255 ELSE label % 4 END AS INTEGER) AS cls FROM vox)"


def _classes(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", F.when(F.col("label") == 10, 255).otherwise(F.col("label") % 4).cast("int").alias("cls"))


@query(f"""WITH {CLASSES}, n AS (SELECT cls, z, y, x, row_number() OVER (PARTITION BY cls ORDER BY z, y, x) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM k WHERE cls <> 255),
g AS (SELECT max(n) AS goal FROM n)
SELECT cls, z, y, x, CAST(c.i AS INTEGER) AS copy FROM n, g, range(0, 1000) AS c(i) WHERE rn + c.i * n <= goal""")
def coords_balanced(spark: S, d: str) -> DataFrame:
    return sampling.balanced(_classes(spark, d), "cls", order=["z", "y", "x"]).select("cls", "z", "y", "x", "copy")


@query(f"""WITH {CLASSES}, n AS (SELECT cls, z, y, x, row_number() OVER (PARTITION BY cls ORDER BY z, y, x) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM k WHERE cls <> 255)
SELECT cls, z, y, x, CAST(c.i AS INTEGER) AS copy FROM n, range(0, 4001) AS c(i) WHERE rn + c.i * n <= 4000""")
def coords_target_count(spark: S, d: str) -> DataFrame:
    return sampling.balanced(_classes(spark, d), "cls", target=4000, order=["z", "y", "x"]).select("cls", "z", "y", "x", "copy")


@query(f"""WITH {CLASSES} SELECT cls, CAST(max(n) OVER () AS BIGINT) AS n, CAST(count(*) OVER () AS BIGINT) AS classes FROM (SELECT cls, count(*) AS n FROM k WHERE cls <> 255 GROUP BY cls)""")
def coords_shuffled_counts(spark: S, d: str) -> DataFrame:
    """The production form (hashed order, salted numbering): as many rows of each class."""
    got = sampling.balanced(_classes(spark, d), "cls", seed=3).groupBy("cls").agg(F.count("*").alias("n"))
    return got.crossJoin(F.broadcast(got.agg(F.count("*").alias("classes"))))


@query(f"""WITH {VOX} SELECT z, y, x FROM vox WHERE z BETWEEN 2 AND {N_SLICES} - 3 AND y BETWEEN 3 AND 12""")
def margin_crop(spark: S, d: str) -> DataFrame:
    return sampling.within_margin(vox(spark, d), shape(spark, d), (2, 3, 0)).select("z", "y", "x")


@query(f"""WITH {BOXES} SELECT CAST(1000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside""")
def coords_uniform_boxes(spark: S, d: str) -> DataFrame:
    """1,000 draws from the union of boxes by volume: all of them inside their box."""
    b = boxes(spark, d)
    got = sampling.points_in_boxes(b, 1000, seed=5).join(b, "box_id")
    out = F.count_if(~(F.col("z").between(F.col("sz"), F.col("ez") - 1) & F.col("y").between(F.col("sy"), F.col("ey") - 1) & F.col("x").between(F.col("sx"), F.col("ex") - 1)))
    return got.agg(F.count("*").alias("n"), out.alias("outside"))


@query(None)
def coords_weighted_mix(spark: S, d: str) -> DataFrame:
    v = _classes(spark, d)
    return sampling.weighted_mix({"a": (v.where("cls = 1"), 3.0), "b": (v.where("cls = 2"), 1.0)}, 400, seed=2)


@query(f"""WITH {CLASSES}, t AS (SELECT CASE cls WHEN 1 THEN 'a' ELSE 'b' END AS source, z, y, x, row_number() OVER (PARTITION BY cls ORDER BY z, y, x) AS turn FROM k WHERE cls IN (1, 2)),
o AS (SELECT *, row_number() OVER (ORDER BY turn, source) - 1 AS r FROM t)
SELECT source, z, y, x, CAST(turn AS BIGINT) AS turn, CAST(r // 64 AS BIGINT) AS batch FROM o""")
def coords_interleaved_batches(spark: S, d: str) -> DataFrame:
    v = _classes(spark, d).select("z", "y", "x", "cls")
    both = sampling.interleave({"a": v.where("cls = 1").drop("cls"), "b": v.where("cls = 2").drop("cls")}, ["z", "y", "x"])
    return sampling.batches(both, 64, ["turn", "source"])


# ---------------------------------------------------------------- seeds


def grid_sql(offsets: tuple, three_d: bool) -> str:
    off = f"(SELECT unnest({list(offsets)}) AS o, unnest({list(range(len(offsets)))}) AS k)"
    z = f"z >= o AND (z - o) % 16 = 0" if three_d else "true"
    return f"""WITH n AS (SELECT {N_SLICES} AS nz), g AS (SELECT CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM n, range(0, 1000) AS a(i), range(0, 16) AS b(i), range(0, 64) AS c(i) WHERE a.i < nz),
s AS (SELECT k, z, y, x FROM g, {off} WHERE {z} AND y >= o AND (y - o) % 16 = 0 AND x >= o AND (x - o) % 16 = 0)
SELECT CAST(row_number() OVER (ORDER BY k, z, y, x) AS BIGINT) AS ord, z, y, x FROM s"""


@query(grid_sql(seeds.GRID_3D, True))
def seeds_grid3d(spark: S, d: str) -> DataFrame:
    return seeds.grid(spark, shape(spark, d), True)


@query(grid_sql(seeds.GRID_2D, False))
def seeds_grid2d(spark: S, d: str) -> DataFrame:
    return seeds.grid(spark, shape(spark, d), False)


@query(f"WITH {VOX} SELECT CAST(row_number() OVER (ORDER BY value DESC, z DESC, y DESC, x DESC) AS BIGINT) AS ord, z, y, x FROM vox")
def seeds_by_intensity(spark: S, d: str) -> DataFrame:
    return seeds.by_intensity(vox(spark, d))


DENSE = f"{VOX}, s AS (SELECT row_number() OVER (ORDER BY z, y, x) AS ord, z, y, x FROM vox WHERE value > 0.3)"


@query(f"WITH {DENSE} SELECT CAST(ord AS BIGINT) AS ord, z, y, x FROM s")
def seeds_dense(spark: S, d: str) -> DataFrame:
    return seeds.dense(vox(spark, d), 0.3)


@query(f"WITH {DENSE} SELECT CAST(row_number() OVER (ORDER BY ord DESC) AS BIGINT) AS ord, z, y, x FROM s")
def seeds_reverse(spark: S, d: str) -> DataFrame:
    return seeds.reverse(seeds.dense(vox(spark, d), 0.3))


@query(f"WITH {DENSE}, t AS (SELECT row_number() OVER (ORDER BY value DESC, z DESC, y DESC, x DESC) AS ord, z, y, x FROM vox WHERE value > 0.4), u AS (SELECT 0 AS p, * FROM s UNION ALL SELECT 1, * FROM t), n AS (SELECT row_number() OVER (ORDER BY p, ord) AS ord, z, y, x FROM u) SELECT CAST(ord AS BIGINT) AS ord, z, y, x FROM n WHERE ord > 10 AND y >= 1 AND y < 15 AND x >= 2 AND x < 62 AND z >= 1 AND z + 1 < {N_SLICES}")
def seeds_chain(spark: S, d: str) -> DataFrame:
    """Two policies in a row, resumed after the tenth seed, away from the border."""
    v = vox(spark, d)
    both = seeds.chain(seeds.dense(v, 0.3), seeds.by_intensity(v.where("value > 0.4")))
    return seeds.inside(seeds.resume(both, 10), shape(spark, d), (1, 1, 2))


@query(f"WITH {VOX}, o AS (SELECT label AS segment_id, min(z) AS z, min(y) AS y, min(x) AS x FROM vox WHERE label > 0 GROUP BY label) SELECT CAST(row_number() OVER (ORDER BY segment_id DESC) AS BIGINT) AS ord, z, y, x FROM o")
def seeds_of_origins(spark: S, d: str) -> DataFrame:
    o = vox(spark, d).where("label > 0").groupBy(F.col("label").alias("segment_id")).agg(F.min("z").alias("z"), F.min("y").alias("y"), F.min("x").alias("x"))
    return seeds.of_origins(o)


# ---------------------------------------------------------------- augmentation


@query(f"WITH {VOX} SELECT CAST(15 - y AS INTEGER) AS z, z AS y, CAST(63 - x AS INTEGER) AS x, label FROM vox")
def reflect_permute(spark: S, d: str) -> DataFrame:
    v = augment.reflect(vox(spark, d).select("z", "y", "x", "label"), shape(spark, d), (False, True, True))
    return augment.permute(v, ("y", "z", "x")).select("z", "y", "x", "label")


@query(f"WITH {VOX} SELECT z, CAST(CASE WHEN z >= 7 THEN (y + 13) % 16 ELSE y END AS INTEGER) AS y, CAST(CASE WHEN z >= 7 THEN (x + 5) % 64 ELSE x END AS INTEGER) AS x, label FROM vox")
def misalign_slip(spark: S, d: str) -> DataFrame:
    v = augment.misalign(vox(spark, d), 7, -3, 5, shape(spark, d), slip=False)
    return v.select("z", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "label")


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN z IN (3, 9) AND y < 8 AND x >= 20 THEN 0.5 ELSE value END AS value FROM vox")
def missing_section(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", augment.missing(F.col("value"), F.col("z").isin(3, 9), (0, 8, 20, 64), 0.5).alias("value"))


@query(f"WITH {VOX} SELECT z, y, x, round(power(least(greatest((value + 0.6) * 200 / 255 * 1.2 - 0.1, 0), 1), 1.5) * 255, 7) AS value FROM vox")
def grayscale_fixed(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", F.round(augment.grayscale((F.col("value") + 0.6) * 200, 1.2, -0.1, 1.5), 7).alias("value"))


@query(f"WITH {VOX} SELECT z, y, x, round(CASE WHEN label <= 0 THEN (value - m) * 1.5 + m + 0.1 ELSE value END, 9) AS value FROM vox JOIN (SELECT z, avg(value) AS m FROM vox GROUP BY z) USING (z)")
def contrast_background(spark: S, d: str) -> DataFrame:
    return augment.contrast_brightness(vox(spark, d), 1.5, 0.1, "background", "z").select("z", "y", "x", r9(F.col("value"), "value"))


@query(f"WITH {VOX}, g AS (SELECT CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM range(0, (SELECT count(*) // 16 FROM embeddings)) AS a(i), range(0, 64) AS b(i), range(0, 16) AS c(i)) SELECT g.z, g.y, g.x, coalesce(v.value, 0.0) AS value FROM g LEFT JOIN vox v ON v.z = g.z AND v.y = 15 - g.x AND v.x = g.y")
def rotate_quarter(spark: S, d: str) -> DataFrame:
    """A quarter turn in the plane, as a rotation matrix."""
    import numpy as np

    turn = np.array([[1.0, 0, 0], [0, 0, 1], [0, -1, 0]])
    n, ny, nx = shape(spark, d)
    return augment.rotate(vox(spark, d).select("z", "y", "x", "value"), turn, (n, ny, nx), (n, nx, ny))


@query(f"WITH {VOX}, g AS (SELECT CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM range(-2, 18) AS b(i), range(-1, 65) AS c(i)) SELECT z, g.y, g.x, v.label FROM g JOIN vox v ON v.y = least(greatest(g.y, 0), 15) AND v.x = least(greatest(g.x, 0), 63)")
def edge_pad(spark: S, d: str) -> DataFrame:
    return augment.edge_pad(vox(spark, d), shape(spark, d), (0, 2, 1)).select("z", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "label")


@query(f"WITH {PAIRS} SELECT a FROM v WHERE a % 3 = 0 INTERSECT SELECT b AS a FROM v EXCEPT SELECT a FROM v WHERE a = 6")
def label_sets(spark: S, d: str) -> DataFrame:
    from lamina.plans.base import pairs

    v = pairs(spark, d)
    return v.where("a % 3 = 0").select("a").intersect(v.select(F.col("b").alias("a"))).subtract(v.where("a = 6").select("a"))
