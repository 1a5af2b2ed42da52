"""Queries over voxels: scans, scalar functions, masks, aggregations and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import aggregate, contrast, masks, patches, window
from lamina.plans import flagship
from lamina.plans.base import CENTRES, MOVES, PAIRS, VOX, centres, moves, pairs, r9, shape, table, vox
from lamina.plans.registry import query
from lamina.sources import volume

S = SparkSession


@query(f"WITH {VOX} SELECT z, y, x, value, label FROM vox")
def vox_scan(spark: S, d: str) -> DataFrame:
    return vox(spark, d)


@query(f"WITH {VOX} SELECT z, y, x, label FROM vox WHERE z BETWEEN 3 AND 9 AND y < 8 AND x BETWEEN 16 AND 31")
def vox_slice(spark: S, d: str) -> DataFrame:
    return vox(spark, d).where("z BETWEEN 3 AND 9 AND y < 8 AND x BETWEEN 16 AND 31").select("z", "y", "x", "label")


@query(f"WITH {VOX} SELECT z, y, x, label FROM vox WHERE label > 0")
def vox_block_pack(spark: S, d: str) -> DataFrame:
    packed = volume.pack_blocks(vox(spark, d), (8, 8, 16))
    return volume.unpack_blocks(packed).select("z", "y", "x", "label")


@query(f"""WITH {VOX}, {CENTRES}
SELECT cz, cy, cx, CAST(i.i + 1 AS INTEGER) AS pz, CAST(j.i + 2 AS INTEGER) AS py, CAST(k.i + 3 AS INTEGER) AS px, value
FROM c CROSS JOIN range(-1, 2) AS i(i) CROSS JOIN range(-2, 3) AS j(i) CROSS JOIN range(-3, 4) AS k(i) JOIN vox ON z = cz + i.i AND y = cy + j.i AND x = cx + k.i""")
def centred_subvolumes(spark: S, d: str) -> DataFrame:
    """Patches of (3, 5, 7) around a centre on every line of the volume."""
    return patches.patches(centres(spark, d), vox(spark, d), (1, 2, 3), ["value"])


@query("SELECT CAST(p_partkey AS BIGINT) AS id, format('{}/{}/seg-{}_{}_{}.npz', p_size, p_partkey % 7, p_size, p_partkey % 7, p_partkey % 5) AS path, CAST(p_partkey % 5 AS INTEGER) AS z, CAST(p_partkey % 7 AS INTEGER) AS y, CAST(p_size AS INTEGER) AS x FROM part")
def subvolume_paths(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 7).alias("y"), (F.col("p_partkey") % 5).alias("z"))
    p = p.select("id", volume.subvolume_path(F.col("x"), F.col("y"), F.col("z")).alias("path"))
    return p.withColumn("c", volume.corner_of_path(F.col("path"))).select("id", "path", "c.z", "c.y", "c.x")


# ---------------------------------------------------------------- scalar functions


@query(f"WITH {VOX} SELECT z, y, x, round(CAST((value - 0.02) / 0.25 AS DOUBLE), 9) AS v FROM vox")
def normalize_patch(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", r9((F.col("value") - 0.02) / 0.25, "v"))


@query(f"""WITH {VOX}, s(volume, "offset", scale) AS (VALUES (0, 0.1, 2.0), (2, -0.1, 0.5))
SELECT z, y, x, round((value - coalesce("offset", 0.0)) / coalesce(scale, 1.0), 9) AS v FROM vox LEFT JOIN s ON vox.z % 4 = s.volume""")
def offset_scale_lookup(spark: S, d: str) -> DataFrame:
    s = spark.createDataFrame([(0, 0.1, 2.0), (2, -0.1, 0.5)], "volume int, offset double, scale double")
    return scalar.offset_scale(vox(spark, d).withColumn("volume", F.col("z") % 4), s, 0.0, 1.0).select("z", "y", "x", r9(F.col("normalized"), "v"))


@query(f"WITH {VOX} SELECT z, y, x, round(1 / (1 + exp(-value * 8)), 9) AS p, round(ln((value + 1.5) / 3 / (1 - (value + 1.5) / 3)), 9) AS l FROM vox")
def logit_expit(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", r9(scalar.expit(F.col("value") * 8), "p"), r9(scalar.logit((F.col("value") + 1.5) / 3), "l"))


@query(f"WITH {VOX} SELECT z, y, x, CAST(CASE WHEN x = 0 THEN 0 ELSE greatest(least(floor((value + 1) / 2 * 254) + 1, 255), 1) END AS SMALLINT) AS q FROM vox")
def quantize_prob(spark: S, d: str) -> DataFrame:
    p = F.when(F.col("x") == 0, F.lit(math.nan)).otherwise((F.col("value") + 1) / 2)
    return vox(spark, d).select("z", "y", "x", scalar.quantize(p).alias("q"))


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN label = 0 THEN -1.0 ELSE round((label - 0.5) / 255, 6) END AS p FROM vox")
def dequantize_prob(spark: S, d: str) -> DataFrame:
    p = scalar.dequantize(F.col("label"))
    return vox(spark, d).select("z", "y", "x", F.round(F.nanvl(p.cast("double"), F.lit(-1.0)), 6).alias("p"))


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN label > 3 THEN 0.95 ELSE 0.05 END::DOUBLE AS soft FROM vox")
def soften_labels(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", scalar.soften(F.col("label") > 3).alias("soft"))


@query(f"""WITH {VOX}, c AS (SELECT z, label AS own FROM vox WHERE y = 8 AND x = 32)
SELECT vox.z, y, x, label > 0 AND label = own AS mask FROM vox JOIN c USING (z)""")
def local_object_mask(spark: S, d: str) -> DataFrame:
    v = vox(spark, d)
    centre = v.where("y = 8 AND x = 32").select("z", F.col("label").alias("own"))
    return v.join(centre, "z").select("z", "y", "x", ((F.col("label") > 0) & (F.col("label") == F.col("own"))).alias("mask"))


@query(f"WITH {VOX} SELECT z, y, x, least(greatest(value, -0.1), 0.1) AS v, CAST(x >= 8 AS INTEGER) * (1.0 - CAST(label = 2 AS INTEGER))::DOUBLE AS weight FROM vox")
def clip_and_loss_weight(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", scalar.clip(F.col("value"), -0.1, 0.1).alias("v"), scalar.loss_weight(F.col("x") >= 8, F.col("label") == 2).alias("weight"))


@query("SELECT CAST(o_custkey AS BIGINT) AS k, CASE WHEN max(o_orderkey) <= 255 THEN 'uint8' WHEN max(o_orderkey) <= 65535 THEN 'uint16' WHEN max(o_orderkey) <= 4294967295 THEN 'uint32' ELSE 'uint64' END AS width FROM orders GROUP BY 1")
def id_widths(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("k")).agg(scalar.id_width(F.max("o_orderkey")).alias("width"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_orderkey // 1024 AS INTEGER) AS z, CAST(o_orderkey // 64 % 16 AS INTEGER) AS y, CAST(o_orderkey % 64 AS INTEGER) AS x, CAST(o_orderkey AS BIGINT) AS back FROM orders")
def flat_index(spark: S, d: str) -> DataFrame:
    z, y, x = scalar.unravel(F.col("i"), (1, 16, 64))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("i")).select("i", z.alias("z"), y.alias("y"), x.alias("x"))
    return o.withColumn("back", scalar.ravel(F.col("z"), F.col("y"), F.col("x"), (1, 16, 64)))


@query(f"WITH {MOVES} SELECT task, dz, dy, dx, CAST(floor((dz + 4) / 8.0) AS INTEGER) AS lz, CAST(floor((dy - 1 + 1) / 3.0) AS INTEGER) AS ly, CAST(floor(sqrt(dz * dz + dy * dy + dx * dx)) AS INTEGER) AS r, CAST(task | (CAST(dx AS BIGINT) << 32) AS BIGINT) AS packed FROM moves")
def lattice_and_radius(spark: S, d: str) -> DataFrame:
    return moves(spark, d).select(
        "task", "dz", "dy", "dx", scalar.lattice(F.col("dz"), 0, 8).alias("lz"), scalar.lattice(F.col("dy"), 1, 3).alias("ly"),
        scalar.voxel_radius(F.col("dz"), F.col("dy"), F.col("dx")).alias("r"), scalar.pack_pair(F.col("task"), F.col("dx").cast("long")).alias("packed"),
    )


@query("SELECT CAST(s_suppkey AS BIGINT) AS id_a, CAST(s_nationkey AS BIGINT) AS id_b, CAST(s_suppkey % 7 AS BIGINT) AS x, 2::BIGINT AS y, 3::BIGINT AS z, substr(md5(CAST(s_suppkey AS VARCHAR) || CAST(s_nationkey AS VARCHAR)), 1, 2) || '/' || s_suppkey || '-' || s_nationkey || '_at_' || (s_suppkey % 7) || '_2_3' AS target FROM supplier")
def point_targets(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.format_string("%d-%d_at_%d_2_3", F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long"), (F.col("s_suppkey") % 7).cast("long")).alias("name"))
    s = s.select(*scalar.point_pair_of_name(F.col("name")))
    return s.select("id_a", "id_b", "x", "y", "z", scalar.sharded_target(*[F.col(c) for c in ("id_a", "id_b", "x", "y", "z")], 2).alias("target"))


@query(f"WITH {VOX} SELECT z, y, x, CAST(floor((value - m) / (n - m) * 255) AS INTEGER) AS gray FROM vox JOIN (SELECT z, min(value) AS m, max(value) AS n FROM vox GROUP BY z) USING (z)")
def gray_slices(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("z")
    m, n = F.min("value").over(w), F.max("value").over(w)
    return vox(spark, d).select("z", "y", "x", F.floor((F.col("value") - m) / (n - m) * 255).cast("int").alias("gray"))


# ---------------------------------------------------------------- filters and masks


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN x > 0 AND abs(value) < 0.05 THEN 0 ELSE label END AS label FROM vox")
def threshold_segmentation(spark: S, d: str) -> DataFrame:
    v = vox(spark, d)
    p = v.select("z", "y", "x", F.when(F.col("x") == 0, F.lit(math.nan)).otherwise(F.abs("value")).alias("p"))
    weak = ~F.isnan("p") & (F.col("p") < 0.05)  # unvisited voxels stay
    return v.select("z", "y", "x", "label").join(p, ["z", "y", "x"]).select("z", "y", "x", F.when(weak, F.lit(0)).otherwise(F.col("label")).alias("label"))


@query(f"WITH {VOX} SELECT z, y, x, (label IN (2, 5) OR NOT (value BETWEEN -0.2 AND 0.2)) OR (z * 2 + y > x AND x < 10) AS mask FROM vox")
def mask_channels(spark: S, d: str) -> DataFrame:
    one = masks.Mask((masks.Channel("label", (2, 5)), masks.Channel("value", low=-0.2, high=0.2, invert=True)))
    two = masks.Mask(expression="z * 2 + y > x and x < 10")
    return vox(spark, d).select("z", "y", "x", masks.build_mask([one, two]).alias("mask"))


@query(f"WITH {VOX} SELECT z, y, x, NOT (z + y * 2 < x) AS mask FROM vox")
def mask_expression(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select("z", "y", "x", masks.build_mask([masks.Mask(expression="z + y * 2 < x", invert=True)]).alias("mask"))


BOX3 = """SELECT {keys}z, y, x, {src} AS v, CAST(sum({src}) OVER (PARTITION BY {keys}y, x ORDER BY z RANGE BETWEEN {rz} PRECEDING AND {rz} FOLLOWING) AS BIGINT) AS s1{more} FROM {tab}"""


def box_sql(value: str, rz: int, ry: int, rx: int, keys: str = "", tab: str = "vox", more: str = "") -> str:
    k = f"{keys}, " if keys else ""
    carry = f", {more}" if more else ""
    w = lambda src, others, axis, r: f"CAST(sum({src}) OVER (PARTITION BY {k}{others} ORDER BY {axis} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS BIGINT)"
    return f"""b1 AS (SELECT {k}z, y, x{carry}, {w(value, 'y, x', 'z', rz)} AS s FROM {tab}),
b2 AS (SELECT {k}z, y, x{carry}, {w('s', 'z, x', 'y', ry)} AS s FROM b1),
b3 AS (SELECT {k}z, y, x{carry}, {w('s', 'z, y', 'x', rx)} AS box FROM b2)"""


@query(f"WITH {VOX}, {box_sql('CAST(value > 0.3 AS INTEGER)', 1, 1, 2)} SELECT z, y, x, box >= 1 AS dilated FROM b3")
def mask_dilate(spark: S, d: str) -> DataFrame:
    return masks.dilate(vox(spark, d).withColumn("m", F.col("value") > 0.3), "m", (1, 1, 2)).select("z", "y", "x", "dilated")


@query(f"WITH {VOX} SELECT z, y, x, CAST(EXISTS (SELECT 1 FROM (VALUES (2, 2, 4, 8, 12, 40), (5, 0, 20, 20, 9, 64)) AS b(sz, sy, sx, ez, ey, ex) WHERE vox.z >= sz AND vox.z < ez AND vox.y >= sy AND vox.y < ey AND vox.x >= sx AND vox.x < ex) AS DOUBLE) AS weight FROM vox")
def oob_mask(spark: S, d: str) -> DataFrame:
    b = spark.createDataFrame([("v", 2, 2, 4, 8, 12, 40), ("v", 5, 0, 20, 20, 9, 64)], "volume string, sz int, sy int, sx int, ez int, ey int, ex int")
    return masks.oob_weight(vox(spark, d).withColumn("volume", F.lit("v")), b, cell=16).select("z", "y", "x", "weight")


@query(f"WITH {VOX} SELECT z, y, x, EXISTS (SELECT 1 FROM (VALUES (5, 5, 5, 4), (10, 12, 40, 6)) AS s(sz, sy, sx, r) WHERE (z-sz)*(z-sz)+(y-sy)*(y-sy)+(x-sx)*(x-sx) <= r*r) AS excluded FROM vox")
def spherical_exclusion(spark: S, d: str) -> DataFrame:
    from lamina.operators.spatial import outside_spheres

    s = spark.createDataFrame([(5, 5, 5, 4), (10, 12, 40, 6)], "sz int, sy int, sx int, radius int")
    return outside_spheres(vox(spark, d), s).select("z", "y", "x", "excluded")


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN value < 0.05 THEN 'weak' WHEN z < 2 OR y < 2 OR x < 2 OR y > 13 OR x > 61 THEN 'no-context' WHEN label % 2 = 1 THEN 'segmented' ELSE 'valid' END AS reason FROM vox")
def valid_positions(spark: S, d: str) -> DataFrame:
    """Why the traversal may not move to a voxel."""
    border = (F.col("z") < 2) | (F.col("y") < 2) | (F.col("x") < 2) | (F.col("y") > 13) | (F.col("x") > 61)
    reason = F.when(F.isnan("value") | (F.col("value") < 0.05), "weak").when(border, "no-context").when(F.col("label") % 2 == 1, "segmented").otherwise("valid")
    return vox(spark, d).select("z", "y", "x", reason.alias("reason"))


# ---------------------------------------------------------------- aggregations


@query(f"WITH {VOX} SELECT label, count(*) AS n FROM vox GROUP BY label")
def segment_sizes(spark: S, d: str) -> DataFrame:
    return aggregate.sizes(vox(spark, d))


@query(f"WITH {VOX}, n AS (SELECT label, count(*) AS n FROM vox GROUP BY label) SELECT z, y, x, CAST(CASE WHEN n < 1600 THEN 0 ELSE label END AS BIGINT) AS label FROM vox JOIN n USING (label)")
def clear_dust(spark: S, d: str) -> DataFrame:
    return aggregate.clear_dust(vox(spark, d), 1600).select("z", "y", "x", "label")


CONSENSUS = """j AS (SELECT a, b, count(*) AS cnt FROM {src} GROUP BY a, b),
m AS (SELECT max(a) AS mx FROM {src}),
k AS (SELECT a, b, cnt, row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) AS rn FROM j),
l AS (SELECT a, b, cnt, CASE WHEN cnt < {least} OR a = 0 THEN 'drop' WHEN rn = 1 THEN 'keep' ELSE 'new' END AS kind FROM k),
c AS (SELECT a, b, cnt, kind, CAST(CASE kind WHEN 'drop' THEN 0 WHEN 'keep' THEN a
  ELSE mx + sum(CASE WHEN kind = 'new' THEN 1 ELSE 0 END) OVER (ORDER BY b, a ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS label FROM l CROSS JOIN m)"""


@query(f"WITH {PAIRS}, {CONSENSUS.format(src='v', least=95)} SELECT * FROM c")
def split_consensus(spark: S, d: str) -> DataFrame:
    return aggregate.split_consensus(pairs(spark, d), 95)


@query(f"""WITH {VOX}, n AS (SELECT label, count(*) AS n FROM vox GROUP BY label),
u AS (SELECT z, y, x, CAST(CASE WHEN n < 400 THEN 0 ELSE label END AS BIGINT) AS a, CAST(x // 8 + 1 AS BIGINT) AS b FROM vox JOIN n USING (label)),
{CONSENSUS.format(src='u', least=40)}
SELECT c.label, count(*) AS n, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x
FROM u JOIN c USING (a, b) WHERE c.label > 0 GROUP BY c.label""")
def consensus_hulls(spark: S, d: str) -> DataFrame:
    return flagship.consensus_hulls(spark, d)


@query(f"WITH {PAIRS} SELECT a, b, count(*) AS cnt FROM v GROUP BY a, b")
def overlap_counts(spark: S, d: str) -> DataFrame:
    return aggregate.overlap_counts(pairs(spark, d))


@query(f"WITH {VOX} SELECT label, round(CAST(sum(CAST(value > 0.05 AND x < 40 AS BIGINT)) AS DOUBLE) / sum(CAST(value > 0.05 OR x < 40 AS BIGINT)), 9) AS iou FROM vox GROUP BY label")
def iou_by_segment(spark: S, d: str) -> DataFrame:
    return vox(spark, d).groupBy("label").agg(F.round(aggregate.iou(F.col("value") > 0.05, F.col("x") < 40), 9).alias("iou"))


@query(f"""WITH {VOX}, o AS (SELECT label AS old_id, count(*) AS original_size, sum(CAST(value > 0.1 AS BIGINT)) AS n FROM vox WHERE label > 0 GROUP BY label)
SELECT CAST(old_id AS BIGINT) AS old_id, original_size, CAST(n AS BIGINT) AS n FROM o WHERE n > 0""")
def endpoint_overlaps(spark: S, d: str) -> DataFrame:
    """Which old segments a new object covers, how far, and how large they were."""
    v = vox(spark, d).where("label > 0").groupBy(F.col("label").alias("old_id"))
    return v.agg(F.count("*").alias("original_size"), F.count_if(F.col("value") > 0.1).alias("n")).where("n > 0")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels),
s AS (SELECT *, (tp + tn) / greatest(tp + tn + fp + fn, 1) AS a, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, tn / greatest(tn + fp, 1) AS q FROM c)
SELECT tp, fp, fn, tn, round(a, 9) AS accuracy, round(p, 9) AS "precision", round(r, 9) AS recall, round(q, 9) AS specificity, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM s""")
def confusion_metrics(spark: S, d: str) -> DataFrame:
    out = aggregate.confusion(table(spark, d, "labels"), "quality", "toxic")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")])


@query(f"""WITH {MOVES}, m AS (SELECT CAST(floor(sqrt(dz*dz + dy*dy + dx*dx)) AS INTEGER) AS r, wanted AS w, executed AS e FROM moves WHERE wanted OR executed)
SELECT r, count(*) FILTER (w AND e) AS correct, count(*) FILTER (w AND NOT e) AS missed, count(*) FILTER (NOT w AND e) AS spurious FROM m GROUP BY ROLLUP (r)""")
def move_stats_by_radius(spark: S, d: str) -> DataFrame:
    return aggregate.move_stats(moves(spark, d), scalar.voxel_radius(F.col("dz"), F.col("dy"), F.col("dx")))


@query(f"WITH {VOX} SELECT z, round(avg((greatest(value * 8, 0) - value * 8 * t + ln(1 + exp(-abs(value * 8)))) * w), 9) AS loss FROM (SELECT *, CAST(label > 4 AS DOUBLE) AS t, CAST(x >= 4 AS DOUBLE) AS w FROM vox) GROUP BY z")
def patch_loss(spark: S, d: str) -> DataFrame:
    loss = scalar.F.avg(aggregate.sigmoid_loss(F.col("value") * 8, (F.col("label") > 4).cast("double")) * (F.col("x") >= 4).cast("double"))
    return vox(spark, d).groupBy("z").agg(F.round(loss, 9).alias("loss"))


@query(f"WITH {VOX} SELECT z, count(*) AS voxels, count(*) FILTER (w = 0) AS masked, sum(w) AS weight FROM (SELECT z, CAST(x >= 4 AND label <> 3 AS DOUBLE) AS w FROM vox) GROUP BY z")
def fov_stats(spark: S, d: str) -> DataFrame:
    return aggregate.fov_stats(vox(spark, d).withColumn("w", ((F.col("x") >= 4) & (F.col("label") != 3)).cast("double")), "w", "z")


@query("SELECT CAST(user_id AS BIGINT) AS task, event_type AS name, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY GROUPING SETS ((user_id, event_type), (event_type))")
def counter_rollup(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("long").alias("task"), F.col("event_type").alias("name"), F.floor("value").alias("delta"))
    return aggregate.counters(e)


@query("SELECT event_type AS name, count(*) AS n, round(count(*) / greatest((SELECT count(*) FROM events), 1), 9) AS rate, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_pop(value), 6) AS dev FROM events GROUP BY 1")
def class_and_timing_stats(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    total = e.agg(F.count("*").alias("t"))
    out = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.stddev_pop("value"), 6).alias("dev"))
    return out.crossJoin(F.broadcast(total)).select("name", "n", F.round(F.col("n") / F.greatest("t", F.lit(1)), 9).alias("rate"), "mean", "low", "high", "dev")


LUT = f"""{VOX}, q AS (SELECT z, y, x, CAST(floor((value + 1) * 100) AS BIGINT) AS g FROM vox),
h AS (SELECT g, count(*) AS n FROM q GROUP BY g),
cdf AS (SELECT g, CAST(sum(n) OVER (ORDER BY g) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS tot FROM h),
lut AS (SELECT CAST(i AS INTEGER) AS i, min(g) AS v FROM range(0, 256) AS r(i), cdf WHERE cum * 255 >= i * tot GROUP BY i)"""


@query(f"WITH {LUT} SELECT i, v FROM lut")
def histogram_lut(spark: S, d: str) -> DataFrame:
    return aggregate.histogram_lut(vox(spark, d).withColumn("g", F.floor((F.col("value") + 1) * 100)), "g")


@query(f"""WITH {LUT}, s AS (SELECT z, g, count(*) AS n FROM q GROUP BY z, g),
c AS (SELECT z, g, CAST(sum(n) OVER (PARTITION BY z ORDER BY g) * 255 // sum(n) OVER (PARTITION BY z) AS INTEGER) AS i FROM s)
SELECT q.z, q.y, q.x, lut.v AS matched FROM q JOIN c USING (z, g) JOIN lut USING (i)""")
def match_histogram(spark: S, d: str) -> DataFrame:
    v = vox(spark, d).withColumn("g", F.floor((F.col("value") + 1) * 100))
    return aggregate.match_histogram(v, aggregate.histogram_lut(v, "g"), "g").select("z", "y", "x", "matched")


#: Contrast-limited equalisation of slices of 16 by 64 voxels: 8 by 8 tiles of 2 by 8, a bin keeps one voxel or an eighth of a tile.
EQUALISED = f"""{LUT}, r AS (SELECT z, min(value) AS low, max(value) AS high FROM vox GROUP BY z),
b AS (SELECT vox.z, y, x, label, value, y // 2 AS py, x // 8 AS px, CAST(least(floor((value - low) / (high - low) * 64), 63) AS INTEGER) AS bin FROM vox JOIN r USING (z)),
hs AS (SELECT z, py, px, bin, count(*) AS n FROM b GROUP BY ALL),
cl AS (SELECT z, py, px, i AS bin, least(coalesce(n, 0), 2.0) AS kept, sum(greatest(coalesce(n, 0) - 2.0, 0)) OVER (PARTITION BY z, py, px) AS over
  FROM (SELECT DISTINCT z, py, px FROM hs) CROSS JOIN range(0, 64) AS u(i) LEFT JOIN (SELECT z, py, px, bin AS i, n FROM hs) USING (z, py, px, i)),
mp AS (SELECT z, py, px, bin, (sum(kept) OVER (PARTITION BY z, py, px ORDER BY bin) + over * (bin + 1) / 64) / 16 AS m FROM cl),
pl AS (SELECT *, greatest(0, least(7, (y - 0.5) / 2)) AS fy, greatest(0, least(7, (x - 3.5) / 8)) AS fx FROM b),
nb AS (SELECT pl.*, CAST(least(floor(fy), 6) AS INTEGER) AS iy, CAST(least(floor(fx), 6) AS INTEGER) AS ix FROM pl),
eq AS (SELECT nb.z, nb.y, nb.x, label, value, (1 - (fy - iy)) * ((1 - (fx - ix)) * m00.m + (fx - ix) * m01.m) + (fy - iy) * ((1 - (fx - ix)) * m10.m + (fx - ix) * m11.m) AS e FROM nb
  JOIN mp m00 ON m00.z = nb.z AND m00.py = iy AND m00.px = ix AND m00.bin = nb.bin JOIN mp m01 ON m01.z = nb.z AND m01.py = iy AND m01.px = ix + 1 AND m01.bin = nb.bin
  JOIN mp m10 ON m10.z = nb.z AND m10.py = iy + 1 AND m10.px = ix AND m10.bin = nb.bin JOIN mp m11 ON m11.z = nb.z AND m11.py = iy + 1 AND m11.px = ix + 1 AND m11.bin = nb.bin)"""


@query(f"WITH {EQUALISED} SELECT z, y, x, round(e, 9) AS equalised FROM eq")
def equalised_slices(spark: S, d: str) -> DataFrame:
    """Contrast-limited equalisation of every slice."""
    return contrast.equalised(vox(spark, d), limit=0.125, bins=64).select("z", "y", "x", F.round("equalised", 9).alias("equalised"))


@query(f"""WITH {EQUALISED}, lv AS (SELECT *, CAST(floor(e * 255 + 1e-9) AS INTEGER) AS lev, label = 3 OR z % 6 = 5 AS hid FROM eq),
lc AS (SELECT z, lev, count(*) FILTER (NOT hid) AS n FROM lv GROUP BY z, lev),
ld AS (SELECT z, lev, sum(n) OVER (PARTITION BY z ORDER BY lev) AS cum, sum(n) OVER (PARTITION BY z) AS tot FROM lc),
le AS (SELECT z, lev, tot, CAST(greatest(cum, min(cum) FILTER (cum > 0) OVER (PARTITION BY z)) * 255 // tot AS INTEGER) AS i FROM ld WHERE tot > 0)
SELECT z, y, x, round(coalesce(CAST(lut.v AS DOUBLE), value), 9) AS matched FROM lv LEFT JOIN le USING (z, lev) LEFT JOIN lut USING (i)""")
def match_histogram_masked(spark: S, d: str) -> DataFrame:
    """Slices matched to the whole volume's distribution after contrast-limited equalisation; one label and every sixth slice are masked."""
    v = vox(spark, d)
    lut = aggregate.histogram_lut(v.withColumn("g", F.floor((F.col("value") + 1) * 100)), "g")
    hidden = v.withColumn("hidden", (F.col("label") == 3) | (F.col("z") % 6 == 5))
    got = contrast.matched(hidden, lut.withColumn("v", F.col("v").cast("double")), masked="hidden", limit=0.125, bins=64)
    return got.select("z", "y", "x", F.round("matched", 9).alias("matched"))


@query(f"WITH {VOX} SELECT label, count(*) AS n, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM vox WHERE label > 0 GROUP BY label")
def segment_extents(spark: S, d: str) -> DataFrame:
    return aggregate.extents(vox(spark, d))


@query(f"WITH {VOX} SELECT round(sum(CAST(label = 2 AND value > 0.1 AS INTEGER)) / greatest(sum(CAST(label = 2 AS INTEGER)), 1), 9) AS fraction FROM vox")
def recovery_fraction(spark: S, d: str) -> DataFrame:
    return aggregate.recovered(vox(spark, d).withColumn("hit", F.col("value") > 0.1), 2, "hit").select(F.round("fraction", 9).alias("fraction"))


@query(f"WITH {VOX} SELECT z, bool_and(label = 0) AS all_masked, bool_or(label = 3) AS any_three, count(DISTINCT label) AS n FROM vox WHERE y = 3 GROUP BY z")
def occupied_labels(spark: S, d: str) -> DataFrame:
    return vox(spark, d).where("y = 3").groupBy("z").agg(F.bool_and(F.col("label") == 0).alias("all_masked"), F.bool_or(F.col("label") == 3).alias("any_three"), F.countDistinct("label").alias("n"))


# ---------------------------------------------------------------- windows


@query(f"WITH {VOX}, {box_sql('CAST(label > 0 AS INTEGER)', 1, 2, 3)} SELECT z, y, x, box FROM b3 WHERE z BETWEEN 1 AND (SELECT count(*) // 16 FROM embeddings) - 2 AND y BETWEEN 2 AND 13 AND x BETWEEN 3 AND 60")
def box_sum(spark: S, d: str) -> DataFrame:
    v = window.box_sum(vox(spark, d).withColumn("on", (F.col("label") > 0).cast("int")), "on", (1, 2, 3), block=(8, 8, 16))
    return window.interior(v, shape(spark, d), (1, 2, 3)).select("z", "y", "x", "box")


#: Labelled voxels with the number of voxels of the same label in the box of +-(1, 1, 2) around them.
SAME = """lab AS (SELECT z, y, x, label FROM vox WHERE label > 0),
b3 AS (SELECT p.z, p.y, p.x, count(*) AS box FROM lab p, range(-1, 2) AS a(i), range(-1, 2) AS b(i), range(-2, 3) AS c(i) JOIN lab q ON q.label = p.label AND q.z = p.z + a.i AND q.y = p.y + b.i AND q.x = p.x + c.i GROUP BY p.z, p.y, p.x)"""
THRESHOLDS = (0.02, 0.04, 0.06, 0.1, 0.2)


@query(f"""WITH {VOX}, {SAME}
SELECT vox.z, vox.y, vox.x, CAST(CASE WHEN vox.x = 10 THEN 255 WHEN b3.box IS NULL THEN 0 ELSE 1 + {' + '.join(f'CAST(box / 45.0 >= {t} AS INTEGER)' for t in THRESHOLDS)} END AS INTEGER) AS "partition"
FROM vox LEFT JOIN b3 USING (z, y, x) WHERE vox.z BETWEEN 1 AND (SELECT count(*) // 16 FROM embeddings) - 2 AND vox.y BETWEEN 1 AND 14 AND vox.x BETWEEN 2 AND 61""")
def partition_map(spark: S, d: str) -> DataFrame:
    v = vox(spark, d).withColumn("off", F.col("x") == 10)
    return window.partition_map(v, list(THRESHOLDS), (1, 1, 2), shape(spark, d), "off", (8, 8, 16)).select("z", "y", "x", "partition")


@query(f"""WITH {VOX}, o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i), range(-1, 2) AS c(i)),
s AS (SELECT z, y, x, label, dz, dy, dx, z + dz AS qz, y + dy AS qy, x + dx AS qx FROM vox, o)
SELECT s.z, s.y, s.x, CAST(dz AS INTEGER) AS dz, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, s.label > 0 AND s.label = q.label AS same
FROM s JOIN vox q ON q.z = s.qz AND q.y = s.qy AND q.x = s.qx""")
def redundant_lom(spark: S, d: str) -> DataFrame:
    return window.redundant_affinities(vox(spark, d), (1, 1, 1), (8, 8, 16))


@query(f"""WITH {VOX}, f AS (
  SELECT z, y, x, value, unnest(['z-', 'z+', 'y-', 'y+', 'x-', 'x+']) AS face, unnest([z = 8, z = 12, y = 6, y = 10, x = 28, x = 36]) AS on_face
  FROM vox WHERE z BETWEEN 8 AND 12 AND y BETWEEN 6 AND 10 AND x BETWEEN 28 AND 36),
r AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY value DESC, z, y, x) AS k FROM f WHERE on_face)
SELECT DISTINCT value AS score, CAST(z - 10 AS INTEGER) AS dz, CAST(y - 8 AS INTEGER) AS dy, CAST(x - 32 AS INTEGER) AS dx FROM r WHERE k = 1 AND value >= 0.1""")
def face_max_moves(spark: S, d: str) -> DataFrame:
    return window.face_maxima(vox(spark, d), (10, 8, 32), (2, 2, 4), 0.1)


@query(f"WITH {VOX} SELECT z, y, x, CAST(sum(CAST(label > 0 AS INTEGER)) OVER (PARTITION BY z, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM vox")
def running_sum(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("z", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return vox(spark, d).select("z", "y", "x", F.sum((F.col("label") > 0).cast("int")).over(w).alias("run"))


@query(f"""WITH {VOX}, m AS (SELECT z, y, x, CAST(value > -0.1 AS INTEGER) AS m FROM vox),
o(dz, dy, dx) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)),
n AS (SELECT z + dz AS z, y + dy AS y, x + dx AS x, count(*) AS k FROM m, o WHERE m = 1 GROUP BY 1, 2, 3)
SELECT m.z, m.y, m.x, m = 1 AND coalesce(k, 0) = 6 AS eroded FROM m LEFT JOIN n ON n.z = m.z AND n.y = m.y AND n.x = m.x""")
def erode_once(spark: S, d: str) -> DataFrame:
    return window.erode(vox(spark, d).withColumn("m", F.col("value") > -0.1), "m", 1).select("z", "y", "x", "eroded")


@query(f"""WITH {VOX}, few AS (SELECT label FROM vox WHERE label > 0 GROUP BY label HAVING count(*) % 2 = 0), {SAME}
SELECT vox.z, vox.y, vox.x, CAST(CASE WHEN box IS NULL OR few.label IS NULL THEN 0 ELSE 1 + {' + '.join(f'CAST(box / 45.0 >= {t} AS INTEGER)' for t in THRESHOLDS)} END AS INTEGER) AS "partition"
FROM vox LEFT JOIN b3 USING (z, y, x) LEFT JOIN few ON few.label = vox.label WHERE vox.z BETWEEN 1 AND (SELECT count(*) // 16 FROM embeddings) - 2 AND vox.y BETWEEN 1 AND 14 AND vox.x BETWEEN 2 AND 61""")
def partition_map_of_some(spark: S, d: str) -> DataFrame:
    """The partition map of the labels with an even number of voxels only."""
    v = vox(spark, d)
    few = v.where("label > 0").groupBy("label").count().where("count % 2 = 0")
    return window.partition_map(v, list(THRESHOLDS), (1, 1, 2), shape(spark, d), block=(8, 8, 16), whitelist=few).select("z", "y", "x", "partition")
