"""Derived tables that the queries run on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources import volume
from lamina.sources.volume import table

AXES = ("z", "y", "x")

VOX = """vox AS (
  SELECT CAST(vec_id // 16 AS INTEGER) AS z, CAST(vec_id % 16 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
         CAST(embedding[i] AS DOUBLE) AS value,
         CAST(CASE WHEN embedding[i] > 0 THEN label + 1 ELSE 0 END AS BIGINT) AS label
  FROM embeddings, range(1, 65) AS r(i)
  WHERE vec_id < 16 * ((SELECT count(*) FROM embeddings) // 16))"""
PAIRS = "v AS (SELECT CAST(l_partkey % 40 AS BIGINT) AS a, CAST(l_suppkey % 15 AS BIGINT) AS b FROM lineitem)"
BOXES = """boxes AS (
  SELECT CAST(p_partkey AS BIGINT) AS box_id, CAST(p_partkey % 97 AS BIGINT) AS sz, CAST(p_partkey % 89 AS BIGINT) AS sy, CAST(p_partkey % 83 AS BIGINT) AS sx,
         CAST(p_partkey % 97 + p_size % 7 + 1 AS BIGINT) AS ez, CAST(p_partkey % 89 + p_size % 5 + 1 AS BIGINT) AS ey, CAST(p_partkey % 83 + p_size AS BIGINT) AS ex
  FROM part)"""
MOVES = """moves AS (
  SELECT CAST(user_id AS BIGINT) AS task, event_type AS name, value,
         user_id % 3 <> 0 AS wanted, event_id % 2 = 0 AS executed,
         CAST(event_id % 5 - 2 AS INTEGER) AS dz, CAST(event_id % 7 - 3 AS INTEGER) AS dy, CAST(user_id % 4 AS INTEGER) AS dx
  FROM events)"""
CENTRES = "c AS (SELECT CAST(vec_id // 16 AS INTEGER) AS cz, CAST(vec_id % 16 AS INTEGER) AS cy, CAST(vec_id * 7 % 64 AS INTEGER) AS cx FROM embeddings)"
EDGES = "edges AS (SELECT DISTINCT CAST(l_partkey % 400 AS BIGINT) AS src, CAST(400 + l_suppkey % 37 + 37 * (l_partkey % 11) AS BIGINT) AS dst FROM lineitem)"


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.voxels_of_vectors(table(spark, sf_dir, "embeddings"))


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    return table(spark, sf_dir, "embeddings").count() // 16, 16, 64


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centre for every row of the table."""
    return table(spark, sf_dir, "embeddings").selectExpr("CAST(vec_id DIV 16 AS INT) AS cz", "CAST(vec_id % 16 AS INT) AS cy", "CAST(vec_id * 7 % 64 AS INT) AS cx")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.two_segmentations(table(spark, sf_dir, "lineitem"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    start = {"sz": k % 97, "sy": k % 89, "sx": k % 83}
    size = {"ez": start["sz"] + s % 7 + 1, "ey": start["sy"] + s % 5 + 1, "ex": start["sx"] + s}
    return table(spark, sf_dir, "part").select(k.cast("long").alias("box_id"), *[c.cast("long").alias(n) for n, c in (start | size).items()])


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        u.cast("long").alias("task"), F.col("event_type").alias("name"), "value",
        (u % 3 != 0).alias("wanted"), (e % 2 == 0).alias("executed"),
        (e % 5 - 2).cast("int").alias("dz"), (e % 7 - 3).cast("int").alias("dy"), (u % 4).cast("int").alias("dx"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((p % 400).cast("long").alias("src"), (400 + s % 37 + 37 * (p % 11)).cast("long").alias("dst")).distinct()


def r9(c, name: str):
    return F.round(c.cast("double"), 9).alias(name)
