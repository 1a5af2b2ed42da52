"""Results by corner: each corner's rows are a Parquet file, and a marker written after it says that the corner is finished.

Corners are finished one by one while a job runs, so what a killed job has done is kept; rows are read only through markers.
"""

from __future__ import annotations

import io
import json
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.sources import store

CORNER = ("cz", "cy", "cx")
MARKER = "cz int, cy int, cx int, file string, rows long, run string"


def finish(root: str, corner: tuple[int, int, int], rows: pa.Table, run: str) -> None:
    """Write a corner's rows and then its marker, inside the task that made them.

    A task that runs again writes a file of its own and replaces the marker; the file that no marker names is not read.
    """
    system, inner = store.opened(root)
    out = io.BytesIO()
    pq.write_table(rows, out)
    file = f"{uuid.uuid4().hex}.parquet"
    store.put(system, f"{inner}/rows/{'/'.join(f'{c}={v}' for c, v in zip(CORNER, corner))}/{file}", out.getvalue())
    marker = dict(zip(CORNER, corner)) | {"file": file, "rows": rows.num_rows, "run": run}
    store.put(system, f"{inner}/finished/{'_'.join(map(str, corner))}.json", json.dumps(marker).encode() + b"\n")


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(cz, cy, cx, file, rows, run) of the corners that are finished; none where nothing has run yet."""
    system, inner = store.opened(root)
    system.create_dir(f"{inner}/finished", recursive=True)
    return spark.read.schema(MARKER).option("mode", "FAILFAST").json(f"{root.rstrip('/')}/finished")


def read_finished(spark: SparkSession, root: str, schema: str | StructType) -> DataFrame:
    """The rows of all finished corners, with their corner and the run that made them. Filters on cz, cy, cx choose folders."""
    system, inner = store.opened(root)
    system.create_dir(f"{inner}/rows", recursive=True)
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*wanted.fields, *StructType.fromDDL("cz int, cy int, cx int").fields])
    rows = spark.read.schema(full).parquet(f"{root.rstrip('/')}/rows").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(finished(spark, root).select(*CORNER, "file", "run"), [*CORNER, "file"]).drop("file")
