"""Exact dedup over a persistent index of digests, bucketed and sorted by digest.

Texts are equal when they are the same after A-Z became a-z; null counts as empty. Of equal texts the row with the largest id
stays; rows that agree in id and text are told apart by batch and place, and one of them stays.

The index is a Parquet table in a shared folder, one partition a batch, dealt into buckets by the SHA-256 digest and
sorted by it within each file. A batch is first reduced to one row per digest (partly before the shuffle, so a text that
makes up a third of all rows is no load), then deduplicated against the index by a sort-merge anti-join that shuffles only
the batch: digests the index does not know are appended as new, the others as revisions (a larger id, more copies).
`entries` adds those up bucket by bucket, without a shuffle.

A batch shows with one rename of its partition, and a batch that is there already is skipped, so a failed or repeated commit does no harm.
One writer at a time; readers see whole batches. The number of buckets is fixed when an index is made.

`resolve` gives each row its group. Digests of more than 1 in 1024 of the indexed rows, of which there are fewer than 1024, are
broadcast; the rest meet in a sort-merge join in which no key has more rows than that share.

Defined cases: a null id is smaller than any other and stays only where no row of the group has an id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests with more than one in so many rows are broadcast by `resolve`: fewer than so many, at about 70 bytes.
HOT = 1024


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII texts take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row): each row of the table with the digest of its text; written once, so that places stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(lower_ascii(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows, "digests")[0]


class DigestIndex:
    """The index in one folder, made there if there is none. id_type: the type of the ids, as Spark writes it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.table = "digests_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, id {id_type}, row BIGINT, n BIGINT, first BOOLEAN, batch STRING) "
            f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/buckets={buckets}'"
        )
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets={buckets}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        if spark.table(self.table).schema["id"].dataType.simpleString() != id_type:
            raise ValueError("the index holds ids of another type")

    def batches(self) -> list[str]:
        return [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Deduplicate a batch of digested rows against the index and append what it brings. Returns the rows with their batch."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("name a batch by letters, digits, - and _")
        if batch not in self.batches():
            groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n")).repartition(self.buckets, "digest")
            known = self.spark.table(self.table).select("digest").hint("merge")
            new, old = (groups.join(known, "digest", how).withColumn("first", F.lit(how == "left_anti")) for how in ("left_anti", "left_semi"))
            out = new.unionByName(old).select("digest", "top.id", "top.row", "n", "first", F.lit(batch).alias("batch"))
            mode = "spark.sql.sources.partitionOverwriteMode"
            was = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")  # only this batch's partition is replaced, as left by a commit that failed
            try:
                out.write.mode("overwrite").insertInto(self.table)
            finally:
                self.spark.conf.set(mode, was)
        return rows.withColumn("batch", F.lit(batch))

    def entries(self) -> DataFrame:
        """One row per digest: the row that stays (keep: id, batch, row) and how many rows hold the text."""
        return self.spark.table(self.table).groupBy("digest").agg(F.max(F.struct("id", "batch", "row")).alias("keep"), F.sum("n").alias("n"))

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Rows that were added: id, keep_id, group_size, kept, text_sha256."""
        entries = self.entries()
        total = self.spark.table(self.table).agg(F.sum("n")).first()[0] or 0
        hot = entries.where(F.col("n") * HOT > total)
        marked = rows.join(F.broadcast(hot), "digest", "left")
        cold = marked.where("n IS NULL").select("digest", "id", "batch", "row").repartition(self.buckets, "digest").join(entries.hint("merge"), "digest")
        out = marked.where("n IS NOT NULL").unionByName(cold)
        stays = F.col("keep.row").eqNullSafe(F.col("row")) & (F.col("keep.batch") == F.col("batch"))
        return out.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last(docs: DataFrame, index: DigestIndex, batches: list[tuple[str, Column]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a table to an index in batches (name, condition on the id, as `id`) and give each of its rows its group. Every row must be in one batch."""
    rows = digested(docs, id_col, text_col)
    added = None
    for name, which in batches:
        part = index.add(rows.where(which), name)
        added = part if added is None else added.unionByName(part)
    return index.resolve(added).withColumnRenamed("id", id_col)
