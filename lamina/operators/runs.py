"""Runs over the corners of a volume that can be stopped and started again: finished corners are left out before any work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamina.sources import corners

CORNER = list(corners.CORNER)


def unfinished(wanted: DataFrame, root: str) -> DataFrame:
    """The corners that no run has finished yet."""
    done = corners.finished(wanted.sparkSession, root).select(*CORNER)
    return wanted.select(*[F.col(c).cast("int").alias(c) for c in CORNER]).distinct().join(done, CORNER, "left_anti")


def run(wanted: DataFrame, inputs: DataFrame, work: Callable[[tuple[int, int, int], pd.DataFrame], pd.DataFrame], schema: str, root: str, name: str | None = None) -> str:
    """Work on every wanted corner that is not finished, each in one piece with the input rows dealt to it; returns the run's name.

    wanted: (cz, cy, cx); inputs: rows with the corner that they are dealt to (in several, as halos are, if need be). A corner
    without input rows is worked on with none, one with null in it is none. work(corner, rows) gives a frame of `schema`; it must
    give the same rows if it is called again. A corner counts as finished once its rows are written, at once and not at
    the end of the job: after a failure or a kill, calling this again does the rest.
    """
    name = name or uuid4().hex
    todo = unfinished(wanted.dropna(subset=CORNER), root)
    columns = [c for c in inputs.columns if c not in CORNER]
    if "_given" in columns:
        raise ValueError("column _given is taken")
    given = inputs.select(*[F.col(c).cast("int").alias(c) for c in CORNER], *columns, F.lit(True).alias("_given"))
    dealt = todo.join(given, CORNER, "left")
    fields = StructType.fromDDL(schema)
    kept = to_arrow_schema(fields)

    def one(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corner = tuple(int(k) for k in key)
        rows = pd.concat(list(batches), ignore_index=True)
        out = work(corner, rows.loc[rows["_given"].notna(), columns].reset_index(drop=True))
        corners.finish(root, corner, pa.Table.from_pandas(out[fields.names], kept, preserve_index=False), name)
        yield pd.DataFrame({"rows": [len(out)]})

    # the results go from the task to their file; Spark sees their number only
    dealt.groupBy(*CORNER).applyInPandas(one, "rows long").write.format("noop").mode("overwrite").save()
    return name


def results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all finished corners, with cz, cy, cx and the name of the run."""
    return corners.read_finished(spark, root, schema)
