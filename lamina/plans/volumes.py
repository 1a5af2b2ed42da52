"""Queries over chunked volumes, record files and runs that are stopped and started again."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import runs, sampling, window
from lamina.operators.shared import shared_dir
from lamina.plans.base import VOX, shape, vox
from lamina.plans.coordinates import CLASSES, coords_balanced
from lamina.plans.extras import N_SLICES
from lamina.plans.registry import query
from lamina.plans.voxels import SAME, THRESHOLDS
from lamina.sources import chunked, records
from lamina.streaming import shuffle

S = SparkSession
CHUNK = (8, 8, 32)


def _place(spark: S, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN label % 3 = 0 THEN -1 ELSE label END AS value FROM vox WHERE z >= 6 AND y < 11 AND x BETWEEN 30 AND 50")
def chunked_box(spark: S, d: str) -> DataFrame:
    """The label volume written in chunks, voxels without a value as -1, read again in a box of any depth: only its chunks are opened."""
    path = _place(spark, "volume")
    chunked.write_volume(vox(spark, d).where("label % 3 <> 0"), path, shape(spark, d), CHUNK, fill=-1)
    return chunked.read_volume(spark, path).where("z >= 6 AND y < 11 AND x BETWEEN 30 AND 50")


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN x % 7 = 2 THEN label + 1000 ELSE label END AS value FROM vox")
def chunked_additions(spark: S, d: str) -> DataFrame:
    """A volume to which some voxels of every chunk are added later: the others keep their values."""
    path, v = _place(spark, "volume"), vox(spark, d)
    chunked.write_volume(v, path, shape(spark, d), CHUNK)
    chunked.add_to_volume(v.where("x % 7 = 2").withColumn("label", F.col("label") + 1000), path)
    return chunked.read_volume(spark, path)


PARTS = f"""{VOX}, {SAME},
p AS (SELECT vox.z, vox.y, vox.x, CAST(CASE WHEN b3.box IS NULL THEN 0 ELSE 1 + {' + '.join(f'CAST(box / 45.0 >= {t} AS INTEGER)' for t in THRESHOLDS)} END AS INTEGER) AS part
  FROM vox LEFT JOIN b3 USING (z, y, x) WHERE vox.z BETWEEN 1 AND {N_SLICES} - 2 AND vox.y BETWEEN 1 AND 14 AND vox.x BETWEEN 2 AND 61),
f AS (SELECT z, y, x, CAST(coalesce(part, 255) AS BIGINT) AS part FROM vox LEFT JOIN p USING (z, y, x))"""


@query(f"""WITH {PARTS}, c AS (SELECT part, count(*) AS n FROM f GROUP BY 1)
SELECT f.part AS "partition", z // 8 AS cz, count(*) AS n, any_value(c.n) AS n_attribute FROM f JOIN c USING (part) GROUP BY 1, 2""")
def partition_volume_saved(spark: S, d: str) -> DataFrame:
    """The partition volume written at full size, 255 where nothing was computed, with the boxes and the counts that the tasks took as
    attributes; read back and counted by slab, beside the attribute."""
    path, size = _place(spark, "partitions"), shape(spark, d)
    p = window.partition_map(vox(spark, d), list(THRESHOLDS), (1, 1, 2), size)
    boxes = [{"start": [1, 1, 2], "end": [size[0] - 1, size[1] - 1, size[2] - 2]}]
    chunked.write_volume(p, path, size, CHUNK, "uint8", "partition", 255, {"bounding_boxes": boxes}, count=True)
    counts = [(int(k), n) for k, n in chunked.attributes(path)["partition_counts"].items()]  # a value each, 256 at most
    got = chunked.read_volume(spark, path).groupBy(F.col("value").alias("partition"), F.floor(F.col("z") / 8).cast("int").alias("cz")).agg(F.count("*").alias("n"))
    return got.join(F.broadcast(spark.createDataFrame(counts, "partition long, n_attribute long")), "partition")


@query(f"""WITH {CLASSES}, n AS (SELECT cls, z, y, x, row_number() OVER (PARTITION BY cls ORDER BY z, y, x) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM k WHERE cls <> 255),
g AS (SELECT max(n) AS goal FROM n)
SELECT 'class ' || cls AS volume, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(count(*) AS BIGINT) AS n
FROM n, g, range(0, 1000) AS c(i) WHERE rn + c.i * n <= goal GROUP BY ALL""")
def coords_in_records(spark: S, d: str) -> DataFrame:
    """All balanced coordinates, shuffled, as gzipped record files of examples; read back and counted."""
    path = _place(spark, "records")
    c = coords_balanced(spark, d).withColumn("volume", F.format_string("class %d", "cls"))
    records.write_coordinate_records(sampling.epoch(c, 0, 7, "cls", "z", "y", "x", "copy"), path)
    return records.read_coordinate_records(spark, path).groupBy("volume", "z", "y", "x").agg(F.count("*").alias("n"))


def _narrowed(corner: tuple[int, int, int], rows: pd.DataFrame) -> pd.DataFrame:
    """Ids of a corner's own, from 1 in the order of the labels; 0 stays."""
    ids = {label: k for k, label in enumerate(sorted(set(rows["label"]) - {0}), 1)} | {0: 0}
    return rows.assign(id=rows["label"].map(ids))


@query(f"""WITH {VOX}, c AS (SELECT CAST((z // 8) * 8 AS INTEGER) AS cz, CAST(0 AS INTEGER) AS cy, CAST((x // 32) * 32 AS INTEGER) AS cx, z, y, x, label FROM vox),
i AS (SELECT *, dense_rank() OVER (PARTITION BY cz, cx ORDER BY label) - CAST(min(label) OVER (PARTITION BY cz, cx) = 0 AS INTEGER) AS id FROM c)
SELECT cz, cy, cx, z, y, x, label, id, CASE WHEN cz % 16 = 0 THEN 'first' ELSE 'second' END AS run FROM i""")
def resumed_corners(spark: S, d: str) -> DataFrame:
    """A run that was stopped after half of its corners, and a second one over all of them, which does the other half only."""
    path = _place(spark, "run")
    v = vox(spark, d).select("z", "y", "x", "label").withColumns({"cz": F.floor(F.col("z") / 8) * 8, "cy": F.lit(0), "cx": F.floor(F.col("x") / 32) * 32})
    corners = v.select("cz", "cy", "cx").distinct()
    kind = "z int, y int, x int, label long, id long"
    runs.run(corners.where("cz % 16 = 0"), v, _narrowed, kind, path, "first")
    runs.run(corners, v, _narrowed, kind, path, "second")
    return runs.results(spark, path, kind)


@query(f"WITH {VOX} SELECT z, y, x, label, CAST(1 AS BIGINT) AS n, TRUE AS gapless FROM vox WHERE label > 0")
def shuffle_buffered(spark: S, d: str) -> DataFrame:
    """All labelled coordinates as a stream through a shuffle buffer, stopped once and started again: every row once, draws without gaps."""
    path = _place(spark, "shuffle")
    rows = vox(spark, d).where("label > 0").select("z", "y", "x", "label")
    shuffle.write_rows(rows.where("z % 2 = 0"), f"{path}/in")
    out = shuffle.buffered(shuffle.read_rows(spark, f"{path}/in", rows.schema), ["z", "y", "x"], 256, 64, 11, 8)
    shuffle.work_through(out, f"{path}/out", f"{path}/state")
    shuffle.write_rows(rows.where("z % 2 = 1"), f"{path}/in")
    shuffle.end_epoch(spark, f"{path}/in", rows.schema, 8)
    got = shuffle.work_through(out, f"{path}/out", f"{path}/state")
    lanes = got.groupBy("lane").agg(((F.min("position") == 0) & (F.max("position") == F.count("*") - 1) & (F.countDistinct("position") == F.count("*"))).alias("gapless"))
    return got.join(F.broadcast(lanes), "lane").groupBy("z", "y", "x", "label").agg(F.count("*").alias("n"), F.min("gapless").alias("gapless"))
