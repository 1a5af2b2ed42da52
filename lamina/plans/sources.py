"""Queries over saved segmentations, boxes in columns, restrictors and augmentation chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import augment, boxes, labels, masks, seeds, spatial
from lamina.operators.shared import shared_dir
from lamina.plans.base import BOXES, VOX, r9, shape, table, vox
from lamina.plans.base import boxes as box_table
from lamina.plans.registry import query
from lamina.sources import segmentation

S = SparkSession
CORNER = "(z // 16) * 16 AS cz, CAST(0 AS INTEGER) AS cy, (x // 32) * 32 AS cx"


def _cornered(spark: S, d: str) -> DataFrame:
    c = lambda a, n: (F.floor(F.col(a) / n) * n).cast("int")
    prob = F.least(F.greatest(F.floor((F.col("value") + 0.5) * 254) + 1, F.lit(1)), F.lit(255)).cast("int")
    return vox(spark, d).withColumns({"cz": c("z", 16), "cy": F.lit(0), "cx": c("x", 32), "prob": prob})


@query(f"""WITH {VOX}, c AS (SELECT *, {CORNER}, least(greatest(CAST(floor((value + 0.5) * 254) AS INTEGER) + 1, 1), 255) AS prob FROM vox),
s AS (SELECT *, CASE WHEN cz % 32 = 0 AND cx = 0 THEN 'final' WHEN cx = 0 THEN 'legacy' ELSE 'checkpoint' END AS kind FROM c),
l AS (SELECT cz, cy, cx, z, y, x, CASE WHEN kind = 'final' THEN label WHEN kind = 'legacy' THEN label + 100 ELSE label + 200 END AS label, prob FROM s)
SELECT z, y, x, CASE WHEN (prob - 0.5) / 255 < 0.4 OR x + y < 9 THEN 0 ELSE label END AS label FROM l""")
def saved_segmentations(spark: S, d: str) -> DataFrame:
    """Corners saved under three kinds, read by preference with a probability threshold and a mask."""
    v, root = _cornered(spark, d), f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    upper = (F.col("cz") % 32 == 0) & (F.col("cx") == 0)
    segmentation.save_segmentation(v.where(upper), root, "final", prob="prob")
    segmentation.save_segmentation(v.where(F.col("cx") == 0).withColumn("label", F.col("label") + 100), root, "legacy", prob="prob")
    segmentation.save_segmentation(v.withColumn("label", F.col("label") + 200), root, "checkpoint", prob="prob")
    source = segmentation.SegmentationSource(root, allow_checkpoint=True, threshold=0.4, mask="x + y < 9")
    return segmentation.load_from_source(spark, source)[0].select("z", "y", "x", "label")


@query(f"""WITH {VOX}, n AS (SELECT label, count(*) AS n FROM vox WHERE label > 0 AND z < 16 AND x < 32 GROUP BY label HAVING count(*) >= 200),
i AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS BIGINT) AS new_id FROM n)
SELECT new_id AS segment_id, CAST(label AS INTEGER) AS z, CAST(1 AS INTEGER) AS y, CAST(2 AS INTEGER) AS x FROM i""")
def surviving_saved_origins(spark: S, d: str) -> DataFrame:
    """Origins of one saved corner, under the new ids of the segments that are large enough."""
    v, root = _cornered(spark, d), f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    segmentation.save_segmentation(v, root)
    o = v.where("label > 0").select("cz", "cy", "cx", F.col("label").alias("segment_id"), F.col("label").cast("int").alias("z"), F.lit(1).alias("y"), F.lit(2).alias("x")).distinct()
    segmentation.save_origins(o, root)
    _, ids = segmentation.load_segmentation(spark, root, (0, 0, 0), min_size=200)
    return labels.surviving_origins(segmentation.load_origins(spark, root, (0, 0, 0)), ids).select("segment_id", "z", "y", "x")


@query(f"WITH {VOX} SELECT DISTINCT {CORNER}, CASE WHEN x < 32 THEN 'final' ELSE 'checkpoint' END AS kind FROM vox")
def existing_corners(spark: S, d: str) -> DataFrame:
    v, root = _cornered(spark, d), f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    segmentation.save_segmentation(v.where("cx = 0"), root, "final")
    segmentation.save_segmentation(v, root, "checkpoint")
    return segmentation.existing(spark, root, allow_checkpoint=True)


@query(f"WITH {VOX} SELECT CAST(z - 3 AS INTEGER) AS z, CAST(y + 2 AS INTEGER) AS y, x, CASE WHEN x % 5 = 0 THEN 0 ELSE label END AS label, CAST(label % 250 AS INTEGER) AS prob FROM vox")
def unaligned_segmentation(spark: S, d: str) -> DataFrame:
    """Saved in the frame before the alignment, marks below zero as background, with probabilities."""
    v, root = _cornered(spark, d), f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    marked = v.withColumn("prob", F.col("label") % 250).withColumn("label", F.when(F.col("x") % 5 == 0, -1).otherwise(F.col("label")))
    segmentation.save_segmentation(marked, root, offset=(3, -2, 0), prob="prob")
    return segmentation.load_segmentation(spark, root)[0].select("z", "y", "x", "label", "prob")


@query(f"WITH {VOX} SELECT z, y, x, value FROM vox WHERE (z // 16) * 16 = 0 AND x >= 32")
def raw_image_dump(spark: S, d: str) -> DataFrame:
    v, root = _cornered(spark, d), f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    segmentation.save_raw(v, root)
    return spark.read.parquet(f"{root}/raw").where("cz = 0 AND cx = 32").select("z", "y", "x", "value")


@query(f"WITH {VOX} SELECT CAST(z - 4 AS INTEGER) AS z, CAST(y - 2 AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, value, label FROM vox WHERE z BETWEEN 4 AND 12 AND y BETWEEN 2 AND 9 AND x BETWEEN 10 AND 40")
def cut_box(spark: S, d: str) -> DataFrame:
    return segmentation.cut(vox(spark, d), (4, 2, 10), (9, 8, 31)).select("z", "y", "x", "value", "label")


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS volume FROM supplier")
def preferred_column(spark: S, d: str) -> DataFrame:
    """The first of the preferred names that the file has."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), "s_nationkey", "s_name")
    return segmentation.pick(s, ["s_volume", "s_name", "s_nationkey"], "volume")


@query(f"""WITH {BOXES}, b AS (SELECT box_id, sz, sy, sx, ez, ey, ex FROM boxes)
SELECT box_id, 'moved' AS how, sz + 1 AS sz, sy - 2 AS sy, sx + 3 AS sx, ez + 1 AS ez, ey - 2 AS ey, ex + 3 AS ex FROM b
UNION ALL SELECT box_id, 'grown', sz - 1, sy - 1, sx - 1, ez + 2, ey + 2, ex + 2 FROM b
UNION ALL SELECT box_id, 'head', sz, sy, sx, sz + 2, sy + 3, sx + 4 FROM b
UNION ALL SELECT box_id, 'tail', sz + 2, sy + 3, sx + 4, ez, ey, ex FROM b
UNION ALL SELECT box_id, 'inner', sz + 1, sy + 1, sx + 1, sz + 6, sy + 7, sx + 8 FROM b
UNION ALL SELECT box_id, 'before', sz - 3, sy - 3, sx - 3, sz + 2, sy + 2, sx + 2 FROM b
UNION ALL SELECT box_id, 'sized', ez - 5, ey - 6, ex - 7, ez, ey, ex FROM b""")
def box_arithmetic(spark: S, d: str) -> DataFrame:
    """Boxes moved, grown, cut relative to their start, and made from size and end."""
    b = box_table(spark, d)
    end = tuple(F.col(f"e{a}") for a in "zyx")
    ways = {
        "moved": boxes.translated(b, (1, -2, 3)),
        "grown": boxes.adjusted(b, (-1, -1, -1), (2, 2, 2)),
        "head": boxes.sub(b, end=(2, 3, 4)),
        "tail": boxes.sub(b, start=(2, 3, 4)),
        "inner": boxes.sub(b, start=(1, 1, 1), size=(5, 6, 7)),
        "before": boxes.sub(b, end=(2, 2, 2), size=(5, 5, 5)),
        "sized": boxes.box(b, size=(5, 6, 7), end=end),
    }
    return labels.union_all(*[f.select("box_id", F.lit(n).alias("how"), "sz", "sy", "sx", "ez", "ey", "ex") for n, f in ways.items()])


@query(f"""WITH {VOX}, g AS (SELECT CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM range(0, 10) AS a(i), range(0, 20) AS b(i), range(0, 40) AS c(i))
SELECT g.z, g.y, g.x, coalesce(v.label, -7) AS label FROM g LEFT JOIN vox v ON v.z + 5 - 8 = g.z AND v.y + 0 - 3 = g.y AND v.x + 7 - 30 = g.x""")
def align_and_crop(spark: S, d: str) -> DataFrame:
    """A sub-volume at (5, 0, 7) in the frame of one at (8, 3, 30)."""
    return boxes.align_and_crop(vox(spark, d), (5, 0, 7), (8, 3, 30), (10, 20, 40), "label", -7)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS x, CAST(p_partkey % 9 - 4 AS BIGINT) AS y, CAST(p_partkey AS BIGINT) AS z FROM part")
def int_vectors(spark: S, d: str) -> DataFrame:
    """Vectors given as text, checked for three whole numbers."""
    t = F.concat_ws(", ", F.col("p_size").cast("string"), (F.col("p_partkey") % 9 - 4).cast("string"), F.concat(F.col("p_partkey").cast("string"), F.lit(".0")))
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), scalar.int_vector(t).alias("v")).select("id", "v.*")


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN x % 4 = 0 OR x % 4 = 1 THEN 0.0 ELSE value END AS logit FROM vox")
def unvisited_logits(spark: S, d: str) -> DataFrame:
    """NaN and null logits, of places never visited, become 0."""
    v = F.when(F.col("x") % 4 == 0, F.lit(float("nan"))).when(F.col("x") % 4 == 1, F.lit(None).cast("double")).otherwise(F.col("value"))
    return vox(spark, d).select("z", "y", "x", scalar.unvisited_to_zero(v).alias("logit"))


@query(f"WITH {VOX} SELECT z, y, x FROM vox WHERE value > 0.3 AND z - 3 >= 0 AND z + 3 < (SELECT count(*) // 16 FROM embeddings) AND y - 4 >= 0 AND y + 4 < 16 AND x - 8 >= 0 AND x + 8 < 64")
def enough_context(spark: S, d: str) -> DataFrame:
    """Points whose analysis box and margin lie in the volume."""
    return spatial.enough_context(vox(spark, d).where("value > 0.3").select("z", "y", "x"), shape(spark, d), (2, 3, 6), (1, 1, 2))


@query(f"""WITH {VOX}, m AS (SELECT z // 4 AS bz, x // 8 AS bx, label = 3 OR z // 4 = 1 OR (z * 2 + y > x AND x < 10) AS mask, y < 2 OR x // 8 = 5 AS seed_mask FROM vox)
SELECT bz, bx, count(*) AS n, count(*) FILTER (mask) AS masked, count(*) FILTER (seed_mask) AS no_seed, count(*) FILTER (mask OR seed_mask) AS excluded FROM m GROUP BY bz, bx HAVING NOT bool_and(mask) AND NOT bool_and(seed_mask)""")
def restricted_blocks(spark: S, d: str) -> DataFrame:
    """Sub-volumes with room for moves and seeds, and how much of them is masked."""
    v = vox(spark, d).withColumns({"bz": F.floor(F.col("z") / 4), "bx": F.floor(F.col("x") / 8)})
    moves = [masks.Mask((masks.Channel("label", (3,)), masks.Channel("bz", (1,)))), masks.Mask(expression="z * 2 + y > x and x < 10")]
    starts = [masks.Mask((masks.Channel("y", low=0, high=1), masks.Channel("bx", (5,))))]
    out = masks.restricted(v, ["bz", "bx"], moves, starts)
    return out.groupBy("bz", "bx").agg(F.count("*").alias("n"), F.count_if("mask").alias("masked"), F.count_if("seed_mask").alias("no_seed"), F.count_if(masks.excluded(F.lit(False), F.col("mask"), F.col("seed_mask"))).alias("excluded"))


@query(f"""WITH {VOX}, o AS (SELECT CAST(b.i AS INTEGER) AS dy, CAST(c.i AS INTEGER) AS dx FROM range(-3, 4) AS b(i), range(-3, 4) AS c(i) WHERE b.i * b.i + c.i * c.i <= 9),
t AS (SELECT z, 0.5 * max(value) AS floor FROM vox GROUP BY z),
d AS (SELECT s.z, s.y, s.x, max(v.value) AS top FROM (SELECT z, y, x, y + dy AS qy, x + dx AS qx FROM vox, o WHERE y BETWEEN 3 AND 12 AND x BETWEEN 3 AND 60) s JOIN vox v ON v.z = s.z AND v.y = s.qy AND v.x = s.qx GROUP BY s.z, s.y, s.x)
SELECT CAST(row_number() OVER (ORDER BY z, y, x) AS BIGINT) AS ord, z, y, x FROM vox JOIN d USING (z, y, x) JOIN t USING (z) WHERE value = top AND value > floor""")
def seeds_peaks_2d_disk(spark: S, d: str) -> DataFrame:
    return seeds.peaks_2d_disk(vox(spark, d), 3, 0.5)


AUGMENTED = f"""{VOX}, m AS (SELECT z, CASE WHEN z >= 7 THEN (y + 13) % 16 ELSE y END AS y, CASE WHEN z >= 7 THEN (x + 5) % 64 ELSE x END AS x, value, label FROM vox),
g AS (SELECT z, y, x, label, power(least(greatest((value + 0.6) * 200 / 255 * 1.2 - 0.1, 0), 1), 1.5) * 255 AS value FROM m)"""


@query(f"WITH {AUGMENTED} SELECT CAST(15 - y AS INTEGER) AS z, z AS y, CAST(63 - x AS INTEGER) AS x, label, round(value, 7) AS value FROM g")
def augmentation_chain(spark: S, d: str) -> DataFrame:
    """Misalignment and grayscale of sections, then reflection and permutation of the axes, image and labels together."""
    v = vox(spark, d).select("z", "y", "x", ((F.col("value") + 0.6) * 200).alias("value"), "label")
    sections = {"misaligned": {"z": 7, "dy": -3, "dx": 5}, "gray": {"contrast": 1.2, "brightness": -0.1, "gamma": 1.5}}
    out = augment.apply_augmentation(v, shape(spark, d), [], 3, sections, (False, True, True), ("y", "z", "x"))
    return out.select("z", "y", "x", "label", F.round("value", 7).alias("value"))


@query(f"WITH {VOX} SELECT z, count(*) AS n, round(sum(value), 6) AS total FROM vox GROUP BY z")
def augmentations_skipped(spark: S, d: str) -> DataFrame:
    """With a share of 1 to skip every example stays as it was."""
    v = vox(spark, d).select("z", "y", "x", "value", "label")
    all_off = {k: {"strength": 1.0, "skip": 1.0} for k in ("elastic", "affine", "focus")} | {"lost": {"ratio": 0.5, "skip": 1.0}, "gray": {"contrast": 3.0, "skip": 1.0}}
    out = augment.section_augmentations(v, shape(spark, d), ["z"], 9, **all_off)
    return out.groupBy("z").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH e AS (SELECT CAST(user_id AS BIGINT) AS id, CASE event_id % 7 WHEN 0 THEN 'removed' WHEN 1 THEN 'bad' ELSE 'ok' END AS mark, event_id AS seq FROM events),
l AS (SELECT id, arg_max(mark, seq) AS mark FROM e GROUP BY id)
SELECT CAST(c_custkey AS BIGINT) AS id, coalesce(mark = 'bad', false) AS bad FROM customer LEFT JOIN l ON l.id = c_custkey WHERE mark IS NULL OR mark <> 'removed'""")
def reviewed_objects(spark: S, d: str) -> DataFrame:
    """Objects after review: removed ones are gone, bad ones are marked, the last mark counts."""
    k = F.col("event_id") % 7
    marks = table(spark, d, "events").select(F.col("user_id").cast("long").alias("id"), F.when(k == 0, "removed").when(k == 1, "bad").otherwise("ok").alias("mark"), F.col("event_id").alias("seq"))
    return labels.reviewed(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), marks)
