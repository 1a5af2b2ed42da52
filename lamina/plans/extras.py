"""Further queries: restrictors, canvases, boxes, evaluation, moves and example pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import aggregate, evaluation, labels, masks, patches, seeds, spatial, traverse, window
from lamina.operators.shared import kept
from lamina.plans.base import BOXES, CENTRES, VOX, boxes, centres, r9, shape, table, vox
from lamina.plans.coordinates import CONTACTS
from lamina.plans.registry import query
from lamina.plans.voxels import CONSENSUS, SAME, THRESHOLDS

S = SparkSession
N_SLICES = "(SELECT count(*) // 16 FROM embeddings)"


@query("SELECT CAST(l_orderkey AS BIGINT) AS x, n_name AS volume, CAST(coalesce(CASE WHEN l_linenumber > 3 THEN l_suppkey END, 0) AS BIGINT) AS segment_id, CAST(0.0 AS DOUBLE) AS radius FROM lineitem JOIN nation ON l_suppkey % 25 = n_nationkey")
def decoded_coordinates(spark: S, d: str) -> DataFrame:
    """Coordinates with a volume index: the name comes from the dimension table, optional columns get their defaults."""
    l = table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey") % 25)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("volume"))
    seg = F.coalesce(F.when(F.col("l_linenumber") > 3, F.col("l_suppkey")), F.lit(0)).cast("long")
    return l.join(n, "k").select(F.col("l_orderkey").cast("long").alias("x"), "volume", seg.alias("segment_id"), F.coalesce(F.lit(None).cast("double"), F.lit(0.0)).alias("radius"))


@query(f"""WITH {VOX}, {SAME},
p AS (SELECT vox.z, vox.y, vox.x, CAST(CASE WHEN b3.box IS NULL THEN 0 ELSE 1 + {' + '.join(f'CAST(box / 45.0 >= {t} AS INTEGER)' for t in THRESHOLDS)} END AS INTEGER) AS part
  FROM vox LEFT JOIN b3 USING (z, y, x) WHERE vox.z BETWEEN 1 AND {N_SLICES} - 2 AND vox.y BETWEEN 1 AND 14 AND vox.x BETWEEN 2 AND 61),
f AS (SELECT coalesce(part, 255) AS "partition" FROM vox LEFT JOIN p USING (z, y, x))
SELECT "partition", count(*) AS n FROM f GROUP BY 1""")
def partition_volume_counts(spark: S, d: str) -> DataFrame:
    """The full volume with 255 where no partition was computed, counted by partition."""
    v = vox(spark, d)
    p = window.partition_map(v, list(THRESHOLDS), (1, 1, 2), shape(spark, d)).select("z", "y", "x", F.col("partition").alias("_p"))
    full = v.join(p, ["z", "y", "x"], "left").withColumn("partition", F.coalesce("_p", F.lit(255)).cast("int"))
    return full.groupBy("partition").agg(F.count("*").alias("n"))


@query("SELECT string_agg(name || ': ' || n, chr(10) ORDER BY name) AS dump FROM (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1)")
def counter_dump(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("name", "n")))
    return e.agg(F.concat_ws("\n", F.transform(lines, lambda r: F.concat(r["name"], F.lit(": "), r["n"].cast("string")))).alias("dump"))


@query(f"WITH {VOX} SELECT z, y, x, round((1 / (1 + exp(-value * 4)) - 0.1) / 0.8, 9) AS shade, CAST(sqrt((value + 0.7) / 1.4) * 250 AS INTEGER) >= 0 AS ok FROM vox WHERE z = 2")
def display_slice(spark: S, d: str) -> DataFrame:
    v = vox(spark, d).where("z = 2")
    r = scalar.palette((F.col("value") + 0.7) / 1.4)[0]
    return v.select("z", "y", "x", F.round(scalar.display(F.col("value") * 4, "sig", 0.1, 0.9), 9).alias("shade"), r).withColumn("ok", F.col("r") >= 0).drop("r")


@query(f"""WITH {VOX}, m AS (SELECT z, y, x FROM vox WHERE value > 0.35), s AS (SELECT z, y // 2 AS y, x // 2 AS x FROM vox WHERE greatest(abs(value * 20), abs(label - 5)) >= 6 AND z % 3 = 0),
p AS (SELECT z, y, x FROM vox WHERE label > 0),
n AS (SELECT DISTINCT p.z, p.y, p.x FROM (SELECT *, unnest([z - 1, z, z + 1]) AS qz, (y - 1) // 2 AS y0, (y + 1) // 2 AS y1, (x - 1) // 2 AS x0, (x + 1) // 2 AS x1 FROM p) p JOIN (SELECT DISTINCT z, y, x FROM s) s ON s.z = p.qz AND s.y BETWEEN y0 AND y1 AND s.x BETWEEN x0 AND x1)
SELECT z, y, x FROM p WHERE (z, y, x) NOT IN (SELECT (z, y, x) FROM m) AND (z, y, x) NOT IN (SELECT (z, y, x) FROM n)""")
def movement_restrictor(spark: S, d: str) -> DataFrame:
    """Positions that are not masked and have no strongly shifted voxel (at half resolution in the plane) in their box."""
    v = vox(spark, d)
    p = v.where("label > 0").select("z", "y", "x")
    free = p.join(v.where("value > 0.35").select("z", "y", "x"), ["z", "y", "x"], "left_anti")
    shift = v.where((F.greatest(F.abs(F.col("value") * 20), F.abs(F.col("label") - 5).cast("double")) >= 6) & (F.col("z") % 3 == 0))
    shift = shift.select(F.col("z").alias("sz"), F.floor(F.col("y") / 2).alias("sy"), F.floor(F.col("x") / 2).alias("sx")).distinct()
    near = free.withColumn("sz", F.explode(F.sequence(F.col("z") - 1, F.col("z") + 1)))
    for a in "yx":
        near = near.withColumn(f"s{a}", F.explode(F.sequence(F.floor((F.col(a) - 1) / 2), F.floor((F.col(a) + 1) / 2))))
    hit = near.join(shift, ["sz", "sy", "sx"]).select("z", "y", "x").distinct()
    return free.join(hit, ["z", "y", "x"], "left_anti")


@query(f"WITH {BOXES} SELECT box_id, ez - sz AS dz, greatest(sz, 10) AS sz, greatest(sy, 5) AS sy, greatest(sx, 0) AS sx, least(ez, 60) AS ez, least(ey, 70) AS ey, least(ex, 50) AS ex FROM boxes WHERE greatest(sz, 10) < least(ez, 60) AND greatest(sy, 5) < least(ey, 70) AND greatest(sx, 0) < least(ex, 50)")
def clip_boxes(spark: S, d: str) -> DataFrame:
    low, high = {"z": 10, "y": 5, "x": 0}, {"z": 60, "y": 70, "x": 50}
    b = boxes(spark, d).withColumn("dz", F.col("ez") - F.col("sz"))
    b = b.withColumns({f"s{a}": F.greatest(F.col(f"s{a}"), F.lit(v)) for a, v in low.items()} | {f"e{a}": F.least(F.col(f"e{a}"), F.lit(v)) for a, v in high.items()})
    return b.where("sz < ez AND sy < ey AND sx < ex").select("box_id", "dz", "sz", "sy", "sx", "ez", "ey", "ex")


@query(f"""WITH {VOX}, n AS (SELECT z + 4 AS z, y + 2 AS y, x + 10 AS x, value * 2 AS v FROM vox WHERE z < 3 AND y < 5 AND x < 7)
SELECT z, y, x, round(coalesce(v, value), 9) AS pasted, round(value + coalesce(v, 0), 9) AS added FROM vox LEFT JOIN n USING (z, y, x)""")
def paste_and_update_seed(spark: S, d: str) -> DataFrame:
    """A patch written over, and added to, a larger array at an offset."""
    v = vox(spark, d)
    new = v.where("z < 3 AND y < 5 AND x < 7").select((F.col("z") + 4).alias("z"), (F.col("y") + 2).alias("y"), (F.col("x") + 10).alias("x"), (F.col("value") * 2).alias("v"))
    return v.join(F.broadcast(new), ["z", "y", "x"], "left").select("z", "y", "x", r9(F.coalesce("v", "value"), "pasted"), r9(F.col("value") + F.coalesce("v", F.lit(0.0)), "added"))


@query("SELECT CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x, CASE WHEN a.i = 2 AND b.i = 3 AND c.i = 4 THEN 0.95 ELSE 0.05 END::DOUBLE AS seed FROM range(0, 5) AS a(i), range(0, 7) AS b(i), range(0, 9) AS c(i)")
def seed_patch(spark: S, d: str) -> DataFrame:
    z, y, x = scalar.unravel(F.col("id"), (5, 7, 9))
    g = spark.range(5 * 7 * 9).select(z.alias("z"), y.alias("y"), x.alias("x"))
    return g.withColumn("seed", F.when((F.col("z") == 2) & (F.col("y") == 3) & (F.col("x") == 4), 0.95).otherwise(0.05))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(33 + 2 * 8 * (n_nationkey % 3) AS INTEGER) AS labels, CAST(33 + 2 * 8 * (n_nationkey % 3 + 1) AS INTEGER) AS labels_max_pred FROM nation")
def training_sizes(spark: S, d: str) -> DataFrame:
    """Edge of a training region: field of view, two deltas a move, and one more move for adaptive policies."""
    m = F.col("n_nationkey") % 3
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (33 + 16 * m).cast("int").alias("labels"), (33 + 16 * (m + 1)).cast("int").alias("labels_max_pred"))


@query(f"""WITH {VOX}, w AS (SELECT label AS a, CAST(CASE WHEN value > 0 THEN x // 16 + 1 ELSE 0 END AS BIGINT) AS b FROM vox),
{CONSENSUS.format(src='w', least=200)},
o AS (SELECT label AS segment_id, min(z) AS z FROM vox WHERE label > 0 GROUP BY label)
SELECT o.segment_id, o.z FROM o WHERE segment_id IN (SELECT label FROM c WHERE label > 0)""")
def consensus_origins(spark: S, d: str) -> DataFrame:
    """Origins whose segments survive a consensus."""
    v = vox(spark, d)
    two = v.select(F.col("label").alias("a"), F.when(F.col("value") > 0, F.floor(F.col("x") / 16) + 1).otherwise(0).cast("long").alias("b"))
    left = aggregate.split_consensus(two, 200).where("label > 0").select(F.col("label").alias("segment_id")).distinct()
    o = v.where("label > 0").groupBy(F.col("label").alias("segment_id")).agg(F.min("z").alias("z"))
    return o.join(left, "segment_id", "left_semi")


#: Pairs in contact within slabs of four slices, their points, two stand-in runs over a wider box, and the moves of both.
PAIRED = f"""{CONTACTS}, c4 AS (SELECT *, z // 4 AS slab, CAST(offset_no // 3 + 1 AS DOUBLE) AS dist FROM c),
near AS (SELECT * FROM c4 QUALIFY dist = min(dist) OVER (PARTITION BY slab, id_a, id_b)),
far AS (SELECT *, round(power(z - avg(z) OVER p, 2) + power(y - avg(y) OVER p, 2) + power(x - avg(x) OVER p, 2), 9) AS d2 FROM near WINDOW p AS (PARTITION BY slab, id_a, id_b)),
pt AS (SELECT CAST(slab * 1000000 + id_a * 1000 + id_b AS BIGINT) AS pair, id_a, id_b, z AS cz, y AS cy, x AS cx FROM far QUALIFY row_number() OVER (PARTITION BY slab, id_a, id_b ORDER BY d2, offset_no, z, y, x) = 1),
box AS (SELECT pt.*, i.i AS dz, j.i AS dy, k.i AS dx, label, value FROM pt CROSS JOIN range(-2, 3) AS i(i) CROSS JOIN range(-2, 3) AS j(i) CROSS JOIN range(-3, 4) AS k(i) LEFT JOIN vox v ON v.z = cz + i.i AND v.y = cy + j.i AND v.x = cx + k.i),
m AS (SELECT *, coalesce(label = id_a, false) AS sa, coalesce(label = id_b, false) AS sb, coalesce(value >= -0.07, false) AS ra, coalesce(value >= -0.05 AND dx < 3, false) AS rb, pair % 7 <> 3 AS whole,
  CASE WHEN value > 0.2 THEN 1 + abs(dx) % 2 ELSE 0 END AS del FROM box),
w AS (SELECT pair, dz, dy, dx, u.k, u.v FROM m, LATERAL (SELECT unnest([1, 2, 3, 4]) AS k, unnest([sa, sb, ra, rb AND whole]) AS v) u),
edt AS (SELECT pair, k, CASE WHEN bool_or(NOT v) IS NULL OR NOT bool_or(NOT v) THEN NULL ELSE coalesce(max(d) FILTER (v), 0) END AS e FROM (
  SELECT p.pair, p.k, p.v, sqrt(min(CASE WHEN p.v AND NOT q.v THEN (p.dz - q.dz) * (p.dz - q.dz) * 4.0 + (p.dy - q.dy) * (p.dy - q.dy) + (p.dx - q.dx) * (p.dx - q.dx) END)) AS d
  FROM w p JOIN w q ON p.pair = q.pair AND p.k = q.k GROUP BY p.pair, p.k, p.v, p.dz, p.dy, p.dx) GROUP BY pair, k),
sc AS (SELECT pair, id_a, id_b, cz AS z, cy AS y, cx AS x, CASE WHEN whole THEN 'ok' ELSE 'incomplete' END AS status, count(*) FILTER (sa) AS num_voxels_a, count(*) FILTER (sb) AS num_voxels_b,
  count(*) FILTER (ra AND rb) / nullif(count(*) FILTER (ra OR rb), 0) AS iou,
  count(*) FILTER (ra) AS a_num_voxels, count(*) FILTER (rb) AS b_num_voxels, CAST(sum(del) AS BIGINT) AS a_deleted_voxels, CAST(sum(del) FILTER (dx <> 0) AS BIGINT) AS b_deleted_voxels,
  count(*) FILTER (ra AND sa) / nullif(count(*) FILTER (sa), 0) AS a_segment_a_consistency, count(*) FILTER (ra AND sb) / nullif(count(*) FILTER (sb), 0) AS a_segment_b_consistency,
  count(*) FILTER (rb AND sa) / nullif(count(*) FILTER (sa), 0) AS b_segment_a_consistency, count(*) FILTER (rb AND sb) / nullif(count(*) FILTER (sb), 0) AS b_segment_b_consistency
  FROM m GROUP BY ALL),
ev AS (SELECT sc.*, e1.e AS max_edt_a, e2.e AS max_edt_b, e3.e AS a_max_edt, e4.e AS b_max_edt FROM sc
  JOIN edt e1 ON e1.pair = sc.pair AND e1.k = 1 JOIN edt e2 ON e2.pair = sc.pair AND e2.k = 2 JOIN edt e3 ON e3.pair = sc.pair AND e3.k = 3 JOIN edt e4 ON e4.pair = sc.pair AND e4.k = 4)"""
SCORES = [c.split()[0] for c in evaluation.SCORES]


def _evaluated(spark: S, d: str) -> DataFrame:
    """The pairs in contact within each slab of slices, scored. Two runs stand in for a network's: thresholds of the image; every seventh pair has one run only."""
    v = vox(spark, d)
    c = spatial.contacts(v, block=(8, 8, 16)).withColumns({"volume": F.floor(F.col("z") / 4), "dist": (F.floor(F.col("offset_no") / 3) + 1).cast("double")})
    pairs = kept(spatial.decision_points(c).withColumn("pair", F.col("volume") * 1000000 + F.col("id_a") * 1000 + F.col("id_b")), "pairs")
    centre = pairs.select("pair", *[F.col(a).alias(f"c{a}") for a in "zyx"])
    wide = centre.join(patches.patches(centre, v, (3, 3, 4), ["value"]), ["cz", "cy", "cx"])
    wide = wide.select("pair", *[(F.col(f"c{a}") + F.col(f"p{a}") - r).alias(a) for a, r in (("z", 3), ("y", 3), ("x", 4))], (F.col("px") - 4).alias("dx"), "value")
    run = F.explode(F.when(F.col("pair") % 7 != 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    wide = kept(wide.select("*", run.alias("run")), "runs")
    shift = F.when(F.col("run") == "a", F.col("value") + 0.57).when(F.col("dx") < 3, F.col("value") + 0.55)
    moves = wide.where("value > 0.2 AND (run = 'a' OR dx <> 0)").select("pair", "run", "z", "y", "x", (1 + F.abs("dx") % 2).alias("deleted"))
    return evaluation.pair_evaluation(pairs, v, wide.select("pair", "run", "z", "y", "x", shift.alias("prob")), moves, (2, 2, 3), (1, 1, 2))


@query(f"WITH {PAIRED} SELECT pair, id_a, id_b, z, y, x, status, {', '.join(f"CASE WHEN status = 'ok' THEN round({c}, 9) END AS {c}" if 'iou' in c or 'edt' in c or 'cons' in c else f"CASE WHEN status = 'ok' THEN {c} END AS {c}" for c in SCORES)} FROM ev")
def pair_evaluation(spark: S, d: str) -> DataFrame:
    """Both runs of each pair in contact: sizes, largest distances, overlap, the four consistencies, voxels taken back, and a status instead of exceptions."""
    e = _evaluated(spark, d)
    return e.select("pair", "id_a", "id_b", "z", "y", "x", "status", *[F.round(c, 9).alias(c) if dict(e.dtypes)[c] == "double" else c for c in SCORES])


@query(f"""WITH {PAIRED} SELECT pair, id_a, id_b, status = 'ok' AND coalesce(iou > 0.5 AND a_segment_a_consistency > 0.6 AND a_segment_b_consistency > 0.6 AND b_segment_a_consistency > 0.6 AND b_segment_b_consistency > 0.6
  AND (coalesce(a_deleted_voxels / nullif(a_num_voxels, 0) < 0.05, false) OR coalesce(b_deleted_voxels / nullif(b_num_voxels, 0) < 0.05, false)), false) AS merge FROM ev""")
def merge_decision(spark: S, d: str) -> DataFrame:
    """Which of the scored pairs are merges: high overlap, high consistency, few voxels taken back."""
    return _evaluated(spark, d).select("pair", "id_a", "id_b", evaluation.accepts_merge(0.5, 0.6, 0.05).alias("merge"))


@query(f"""WITH {VOX}, {CENTRES}
SELECT cz, cy, cx, bool_or(value > 0.3) AS move FROM c CROSS JOIN range(-2, 3) AS i(i) CROSS JOIN range(-2, 3) AS j(i) CROSS JOIN range(-2, 3) AS k(i) JOIN vox ON z = cz + i.i AND y = cy + j.i AND x = cx + k.i
WHERE greatest(abs(i.i), abs(j.i), abs(k.i)) = 2 GROUP BY cz, cy, cx""")
def shell_window_moves(spark: S, d: str) -> DataFrame:
    """A move is made if any voxel of the shell around its end is bright; an end on every line of the volume."""
    return patches.shell_any(centres(spark, d), vox(spark, d), (2, 2, 2), F.col("value") > 0.3, ["value"])


@query("SELECT CAST(a.i AS INTEGER) AS dz, CAST(b.i AS INTEGER) AS dy, CAST(c.i AS INTEGER) AS dx, CAST(row_number() OVER (ORDER BY c.i, b.i, a.i) AS INTEGER) AS ord FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i), range(-1, 2) AS c(i) WHERE NOT (a.i = 0 AND b.i = 0 AND c.i = 0)")
def neighbour_moves(spark: S, d: str) -> DataFrame:
    """The 26 moves, x outermost."""
    g = spark.range(27).select((F.col("id") % 3 - 1).cast("int").alias("dz"), (F.floor(F.col("id") / 3) % 3 - 1).cast("int").alias("dy"), (F.floor(F.col("id") / 9) - 1).cast("int").alias("dx"))
    g = g.where("NOT (dz = 0 AND dy = 0 AND dx = 0)")
    return g.withColumn("ord", F.row_number().over(Window.orderBy("dx", "dy", "dz")))


@query(f"""WITH {VOX}, e AS (SELECT z, y, x, label, value,
  CASE WHEN value * 10 >= 2 THEN 1.0 ELSE 0.0 END AS over, value * 10 AS new, CASE WHEN x % 3 = 0 THEN NULL ELSE -value * 5 END AS old FROM vox),
s AS (SELECT *, avg(over) OVER (PARTITION BY z) > 0 AS biased FROM e)
SELECT z, y, x, round(CASE WHEN biased AND old IS NOT NULL AND old < 0 AND new > old THEN old ELSE new END, 9) AS logit, coalesce(old, -1) >= ln(0.8 / 0.2) AND new < 0 AS deleted FROM s""")
def disconnected_update(spark: S, d: str) -> DataFrame:
    """How a prediction meets the old logits: background stays background where the patch is mostly object."""
    new, old = F.col("value") * 10, F.when(F.col("x") % 3 == 0, None).otherwise(-F.col("value") * 5)
    v = vox(spark, d).withColumns({"new": new, "old": old})
    v = v.withColumn("biased", F.avg((F.col("new") >= 2).cast("double")).over(Window.partitionBy("z")) > 0)
    hold = F.col("biased") & F.col("old").isNotNull() & (F.col("old") < 0) & (F.col("new") > F.col("old"))
    gone = (F.coalesce("old", F.lit(-1.0)) >= float(np.log(0.8 / 0.2))) & (F.col("new") < 0)
    return v.select("z", "y", "x", r9(F.when(hold, F.col("old")).otherwise(F.col("new")), "logit"), gone.alias("deleted"))


@query(f"""WITH {VOX}, {CENTRES},
p AS (SELECT c.*, i.i AS dz, j.i AS dy, k.i AS dx, value, label FROM c CROSS JOIN range(-1, 2) AS i(i) CROSS JOIN range(-1, 2) AS j(i) CROSS JOIN range(-1, 2) AS k(i) JOIN vox ON z = cz + i.i AND y = cy + j.i AND x = cx + k.i),
o AS (SELECT *, max(CASE WHEN dz = 0 AND dy = 0 AND dx = 0 THEN label END) OVER (PARTITION BY cz, cy, cx) AS own FROM p)
SELECT cz, cy, cx, CAST(1 - dx AS INTEGER) AS px, CAST(dz + 1 AS INTEGER) AS pz, CAST(dy + 1 AS INTEGER) AS py, round((value - 0.1) / 0.5, 9) AS image, CASE WHEN label > 0 AND label = own THEN 0.95 ELSE 0.05 END::DOUBLE AS target FROM o""")
def training_examples(spark: S, d: str) -> DataFrame:
    """Coordinates to examples: crop, object mask about the centre, soft targets, reflection in x, normalised image."""
    return patches.examples(centres(spark, d), vox(spark, d), (1, 1, 1), 0.1, 0.5, (False, False, True)).withColumn("image", r9(F.col("image"), "image"))


#: A small network: (weight, bias, output weight) of each hidden unit, and the output's bias.
HIDDEN = [(8.0, -0.5, 1.5), (-6.0, 0.25, -2.0), (3.0, 1.0, 0.5), (12.0, -2.0, 1.0)]
BIAS = -0.75


@query(f"WITH {VOX} SELECT z, y, x, round({BIAS} + {' + '.join(f'greatest(value * {w} + {b}, 0) * {v}' for w, b, v in HIDDEN)}, 9) AS logit FROM vox".replace("+ -", "- "))
def batched_predictions(spark: S, d: str) -> DataFrame:
    """A network over Arrow batches; its weights are made once per task."""

    def make():
        w, b, v = np.array(HIDDEN).T
        return lambda rows: BIAS + np.maximum(rows["value"].to_numpy()[:, None] * w + b, 0) @ v

    out = traverse.predicted(vox(spark, d).select("z", "y", "x", "value"), make)
    return out.select("z", "y", "x", r9(F.col("logit"), "logit"))


@query(f"WITH {VOX} SELECT 'xy' AS plane, y AS u, x AS v, value * (CASE WHEN y = 8 OR x = 32 THEN 0.5 ELSE 1 END) AS value FROM vox WHERE z = 10 UNION ALL SELECT 'xz', z, x, value * (CASE WHEN z = 10 OR x = 32 THEN 0.5 ELSE 1 END) FROM vox WHERE y = 8 UNION ALL SELECT 'yz', z, y, value * (CASE WHEN z = 10 OR y = 8 THEN 0.5 ELSE 1 END) FROM vox WHERE x = 32")
def ortho_planes(spark: S, d: str) -> DataFrame:
    """Three planes through a point, the cross-hair at half brightness."""
    v = vox(spark, d)
    centre = {"z": 10, "y": 8, "x": 32}
    parts = []
    for plane, fixed, (p, q) in (("xy", "z", "yx"), ("xz", "y", "zx"), ("yz", "x", "zy")):
        hair = (F.col(p) == centre[p]) | (F.col(q) == centre[q])
        parts.append(v.where(F.col(fixed) == centre[fixed]).select(F.lit(plane).alias("plane"), F.col(p).alias("u"), F.col(q).alias("v"), (F.col("value") * F.when(hair, 0.5).otherwise(1.0)).alias("value")))
    return labels.union_all(*parts)


@query(f"""WITH {VOX}, t AS (SELECT label, row_number() OVER (ORDER BY label) AS local FROM (SELECT DISTINCT label FROM vox WHERE label > 0))
SELECT label, count(*) AS n, CAST(coalesce(min(local), 0) AS BIGINT) AS local FROM vox LEFT JOIN t USING (label) GROUP BY label""")
def local_ids(spark: S, d: str) -> DataFrame:
    """Ids of a sub-volume and their contiguous local ones."""
    v = vox(spark, d)
    own = labels.contiguous(v.withColumn("local", F.col("label")), "local")
    return own.groupBy("label").agg(F.count("*").alias("n"), F.min("local").cast("long").alias("local"))


@query(f"""WITH {VOX}, f AS (SELECT * FROM vox WHERE value >= (SELECT max(value) FROM vox)),
a AS (SELECT z, y, x, value, 1 AS k FROM f QUALIFY row_number() OVER (ORDER BY z, y, x) = 1),
g AS (SELECT v.z, v.y, v.x, v.value FROM vox v, a WHERE NOT (abs(v.z - a.z) <= 2 AND abs(v.y - a.y) <= 3 AND abs(v.x - a.x) <= 4)),
b AS (SELECT z, y, x, value, 2 AS k FROM g QUALIFY row_number() OVER (ORDER BY value DESC, z, y, x) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def starting_locations(spark: S, d: str) -> DataFrame:
    """The brightest voxel, and the next one outside the box around it."""
    return seeds.brightest(vox(spark, d), 2, (2, 3, 4))


@query(f"""WITH RECURSIVE {VOX}, m AS (SELECT z, y, x FROM vox WHERE value > 0.02 AND z BETWEEN 6 AND 14 AND y BETWEEN 2 AND 13 AND x BETWEEN 20 AND 44),
s AS (SELECT z, y, x FROM m ORDER BY abs(z - 10) + abs(y - 8) + abs(x - 32), z, y, x LIMIT 1),
r(z, y, x) AS (SELECT z, y, x FROM s UNION SELECT m.z, m.y, m.x FROM r JOIN m ON abs(m.z - r.z) + abs(m.y - r.y) + abs(m.x - r.x) = 1)
SELECT z, y, x FROM r""")
def reachable_moves(spark: S, d: str) -> DataFrame:
    """Lattice cells that moves can reach from the start, in rounds."""
    m = vox(spark, d).where("value > 0.02 AND z BETWEEN 6 AND 14 AND y BETWEEN 2 AND 13 AND x BETWEEN 20 AND 44").select("z", "y", "x")
    m = labels.kept(m, "cells")
    front = m.orderBy(F.abs(F.col("z") - 10) + F.abs(F.col("y") - 8) + F.abs(F.col("x") - 32), "z", "y", "x").limit(1)
    seen = front = labels.kept(front, "front")
    offs = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("zyx", o)]) for o in ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))])
    while True:
        near = front.withColumn("o", F.explode(offs)).select(*[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "zyx"]).distinct()
        front = labels.kept(near.join(m, ["z", "y", "x"]).join(seen, ["z", "y", "x"], "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = labels.kept(seen.unionByName(front), "seen")


@query(None)
def load_segmentation(spark: S, d: str) -> DataFrame:
    """A saved segmentation as it is used: weak voxels and masked ones go, parts are split, small ones go, ids are renumbered."""
    v = vox(spark, d)
    weak = (F.abs("value") < 0.05) | masks.build_mask([masks.Mask(expression="x < 4")])
    out, ids = labels.cleaned(v.withColumn("label", F.when(weak, 0).otherwise(F.col("label"))), (8, 8, 32), 5)
    return out.join(ids.select(F.col("new_id").alias("label"), "old_id", "n"), "label")
