"""The flagship plan: consensus of two label columns after dust removal, with size and hull per surviving segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import aggregate
from lamina.plans import base


def consensus_hulls(spark: SparkSession, sf_dir: str, dust: int = 400, min_size: int = 40) -> DataFrame:
    v = aggregate.clear_dust(base.vox(spark, sf_dir), dust)
    two = v.select("z", "y", "x", F.col("label").alias("a"), (F.floor(F.col("x") / 8) + 1).cast("long").alias("b"))
    names = aggregate.split_consensus(two.select("a", "b"), min_size).select("a", "b", "label")
    merged = two.join(names, ["a", "b"]).where("label > 0")
    return aggregate.extents(merged)
