"""Token counts as delta-maintained rollups.

A batch holds signed rows: an insert adds a document's counts, a delete takes them away, a revision takes the
old counts away and adds the new ones, maybe under another tokenizer version. A commit sums the batch by
source, language and tokenizer version, adds these sums to the totals of the last version and writes the new
totals to a folder of their own: its cost depends on the batch and the number of keys, not on the commits before.

A version is one small file in `log`, named by its number, that names the folder of its totals and its batch. It is written
aside and put in place only if that number is not taken: by a hard link where the folder is a file system of the
machine, else by a rename that Hadoop refuses onto a file that exists (HDFS does both in one step; a store without such a step
must not be written to by two at a time). Of two commits at a time one gets the number, and the other starts anew on its version.
Every batch has a marker in `batches`. A commit first sets the marker of the last version's batch, in case that commit died
before it could, and only then goes on; so the markers hold all batches before the next version can be there, and a
batch that is committed again changes nothing. Old versions stay readable until `vacuum` removes them.

Defined cases: a null text has no tokens; null source or language is a group of its own; repeated rows
count as often as they come; keys whose totals are all zero vanish; an empty batch changes nothing but its name
is known; a rollup without commits has no rows; a batch that takes away more documents, tokens or bytes than a key has is
refused (NegativeTotal), and nothing changes; further columns of a batch are ignored.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens", "n_bytes"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
#: Tokenizer versions and their token patterns (fixed values).
TOKENIZERS = {"spaced-1": r"[^ \t\n\f\r]+", "alnum-2": r"[0-9A-Za-z]+"}


class NegativeTotal(ValueError):
    """A batch takes away more than there is, as a document deleted twice does."""


def counts(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def signed(docs: DataFrame, version: str, sign: int, text_col: str = "text") -> DataFrame:
    """Signed count rows of documents under one tokenizer version."""
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"),
        (counts(F.col(text_col), version) * sign).alias("n_tokens"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") * sign).alias("n_bytes"),
    )


def inserts(docs: DataFrame, version: str) -> DataFrame:
    return signed(docs, version, 1)


def deletes(docs: DataFrame, version: str) -> DataFrame:
    return signed(docs, version, -1)


def revisions(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Both signs of each document in one pass over the texts."""
    text = F.col("text")
    way = lambda v, s: F.struct(F.lit(v).alias("tokenizer"), F.lit(s).cast("long").alias("n_docs"), (counts(text, v) * s).alias("n_tokens"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * s).alias("n_bytes"))
    both = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.explode(F.array(way(old, -1), way(new, 1))).alias("d"))
    return both.select("source", "lang", "d.*")


class Rollup:
    """Additive totals in a folder that all executors share: log/<number>, batches/<name>, data/<folder>, and `last`, a hint where to look for the last version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str:
        stream = self._files().open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self._files().create(self._at(name), True)
        out.writeBytes(text)
        out.close()

    def _publish(self, name: str, text: str) -> bool:
        """Create a file with its whole text; False if it is there already."""
        aside = f"aside/{uuid.uuid4().hex}"
        self._put(aside, text)
        fs, to = self._files(), self._at(name)
        fs.mkdirs(to.getParent())
        if fs.getUri().getScheme() == "file":
            try:
                os.link(self._at(aside).toUri().getPath(), to.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(self._at(aside), False)
        return self._renamed(self._at(aside), to)

    def _renamed(self, aside, to) -> bool:
        """Rename a file unless the new name is taken; then the file goes."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, to, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._files().delete(aside, False)
            return False

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, in order."""
        fs, root = self._files(), self._at("log")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root)) if fs.exists(root) else []

    def last(self) -> int:
        """The number of the last version, 0 if there is none: from the hint on, or from the whole log where the hint fails."""
        fs = self._files()
        try:
            hint = self._text("last")
        except Py4JJavaError:  # none yet, or another commit is just writing it
            hint = ""
        number = int(hint) if hint.isdigit() and fs.exists(self._at(f"log/{int(hint):020d}")) else max(self.versions(), default=0)
        while fs.exists(self._at(f"log/{number + 1:020d}")):
            number += 1
        return number

    def _read(self, number: int) -> tuple[DataFrame, str | None]:
        """The totals of a version, and its batch."""
        if not number:
            return self.spark.createDataFrame([], SCHEMA), None
        folder, batch = self._text(f"log/{number:020d}").split("\n")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{folder}"), batch

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch to the totals; False if it is in them already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch names are letters, digits, - and _: {batch!r}")
        fs = self._files()
        while True:
            number = self.last()
            totals, before = self._read(number)
            if before is not None:
                self._publish(f"batches/{before}", before)
            if fs.exists(self._at(f"batches/{batch}")):
                return False
            sums = totals.unionByName(delta.select(*KEYS, *[F.col(c).cast("long").alias(c) for c in TOTALS])).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
            folder = uuid.uuid4().hex
            sums.where(" OR ".join(f"{c} <> 0" for c in TOTALS)).write.parquet(f"{self.path}/data/{folder}")
            written = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{folder}")
            if not written.where(" OR ".join(f"{c} < 0" for c in TOTALS)).isEmpty():
                fs.delete(self._at(f"data/{folder}"), True)
                raise NegativeTotal(f"batch {batch!r} takes away more than there is")
            if self._publish(f"log/{number + 1:020d}", f"{folder}\n{batch}"):
                self._publish(f"batches/{batch}", batch)
                try:
                    self._put("last", str(number + 1))
                except Py4JJavaError:  # two at a time; the log counts
                    pass
                return True
            fs.delete(self._at(f"data/{folder}"), True)  # another commit was faster

    def totals(self, version: int | None = None) -> DataFrame:
        """The totals of a version, or of the last one."""
        return self._read(self.last() if version is None else version)[0]

    def vacuum(self, keep: int) -> None:
        """Remove all but the last versions; who reads an older one is cut off."""
        fs = self._files()
        for number in self.versions()[: -max(keep, 1)]:
            folder, batch = self._text(f"log/{number:020d}").split("\n")
            self._publish(f"batches/{batch}", batch)
            fs.delete(self._at(f"data/{folder}"), True)
            fs.delete(self._at(f"log/{number:020d}"), False)
