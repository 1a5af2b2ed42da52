"""Intermediate tables in the shared folder, and numbering of rows in an order without one task for all of them."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a session whose executors are in its own process, as in tests, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/lamina-{getpass.getuser()}"
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: short lineage, and nothing is lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows numbered from 1 in the given order: ranges are sorted each on their own, and the rows of the ranges before are added.

    Rows that tie on all of `order` keep distinct numbers, in no fixed order among themselves.
    """
    if "_at" in df.columns or "_range" in df.columns:
        raise ValueError("columns _at and _range are taken")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id holds the range above 33 bits and the row's place in it below
    rows = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))  # one row a range
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + place + 1).drop("_range", "_at", "_before")
