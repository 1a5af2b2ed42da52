"""Graphs of segments under edits, kept in versions: an edit relabels the components that it touches and leaves the others alone.

A graph in a folder has two tables of changes, `edges` (src < dst, alive) and `parts` (node, component), each in files by version. A
version writes the changed rows only; what holds at a version is the last row of each edge and node up to it. A version counts when its
marker is there, which comes after its rows, so a job that dies half-way leaves nothing that is read; the same number is then written
again. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import labels
from lamina.operators.shared import kept
from lamina.sources import store

EDGE, PART = "src long, dst long, alive boolean", "node long, component long"


def _plain(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, smaller end first; loops and nulls go."""
    return edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src < dst").distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def version(spark: SparkSession, path: str) -> int:
    """The last finished version; -1 where there is none."""
    system, inner = store.opened(path)
    k = 0
    while store.get(system, f"{inner}/done/{k}") is not None:
        k += 1
    return k - 1


def _rows(spark: SparkSession, path: str, name: str, schema: str, upto: int) -> DataFrame:
    return spark.read.schema(schema + ", version int").parquet(*[f"{path}/{name}/{k}" for k in range(upto + 1)]) if upto >= 0 else spark.createDataFrame([], schema + ", version int")


def edges_at(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(src, dst) of the edges that hold at a version (None: the last)."""
    rows = _rows(spark, path, "edges", EDGE, version(spark, path) if at is None else at)
    return rows.groupBy("src", "dst").agg(F.max_by("alive", "version").alias("alive")).where("alive").select("src", "dst")


def parts_at(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(node, component) at a version: the component's smallest node. A node that lost its edges is a component of its own."""
    rows = _rows(spark, path, "parts", PART, version(spark, path) if at is None else at)
    return rows.groupBy("node").agg(F.max_by("component", "version").alias("component"))


def _write(rows: DataFrame, path: str, name: str, number: int) -> None:
    rows.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{name}/{number}")


def _joined(parts: DataFrame, added: DataFrame) -> DataFrame:
    """Changed and new rows of components after edges were added: joined through a graph whose nodes are components, or nodes that are new."""
    ends = kept(_ends(added).join(parts, "node", "left"), "ends")
    side = {e: ends.select(F.col("node").alias(e), F.coalesce("component", "node").alias(f"c_{e}")) for e in ("src", "dst")}
    links = added.join(side["src"], "src").join(side["dst"], "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))
    joined = labels.components(_plain(links)).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    moved = parts.join(joined.where("component <> _to"), "component").select("node", F.col("_to").alias("component"))
    new = ends.where("component IS NULL").select("node", F.col("node").alias("component"))
    return moved.unionByName(new.join(joined, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))


def _parted(parts: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Changed rows of components after edges went: those that lost one are found anew, from the edges of their own nodes."""
    hit = parts.join(_ends(gone), "node", "left_semi").select("component").distinct()
    touched = kept(parts.join(hit, "component", "left_semi").select("node", "component"), "touched")
    left = edges.join(gone, ["src", "dst"], "left_anti").join(touched.select(F.col("node").alias("src")), "src", "left_semi")
    anew = touched.join(labels.components(left).withColumnRenamed("component", "_new"), "node", "left").withColumn("_new", F.coalesce("_new", "node"))
    return anew.where("_new <> component").select("node", F.col("_new").alias("component"))


def _leaving(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with one end in the set."""
    n = nodes.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct()
    e = edges.join(n.select(F.col("node").alias("src"), F.lit(True).alias("_s")), "src", "left").join(n.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    return e.where("isnull(_s) <> isnull(_d)").select("src", "dst")


def commit(spark: SparkSession, path: str, merge: DataFrame | None = None, isolate: DataFrame | None = None, cut: DataFrame | None = None) -> int:
    """Write the next version and return its number: edges (src, dst) of `merge` are added, then those with one end in the set `isolate` (node) go, then those of `cut`.

    Components that an added edge joins are renamed through the graph of components, without looking at their edges. Only components
    that lost an edge are found anew, from the edges of their own nodes. Edges that are there already, or are cut without being there, change nothing.
    """
    now = version(spark, path)
    held, parts = kept(edges_at(spark, path, now), "held"), kept(parts_at(spark, path, now), "parts")
    empty = spark.createDataFrame([], "src long, dst long")
    added = gone = empty
    changed = spark.createDataFrame([], PART)
    edges = held
    if merge is not None:
        added = kept(_plain(merge).join(held, ["src", "dst"], "left_anti"), "added")
        # where there is no version yet, no node has a component
        changed = kept(_joined(parts, added), "joined") if now >= 0 else labels.components(added)
        edges = held.unionByName(added)
    if isolate is not None or cut is not None:
        gone = _leaving(edges, isolate) if isolate is not None else empty
        if cut is not None:
            gone = gone.unionByName(edges.join(_plain(cut), ["src", "dst"], "left_semi")).distinct()
        gone = kept(gone, "gone")
        if merge is None:
            changed = _parted(parts, edges, gone)
        else:
            after = kept(parts.join(changed, "node", "left_anti").unionByName(changed), "after")
            again = kept(_parted(after, edges, gone), "parted")
            both = changed.join(again, "node", "left_anti").unionByName(again)
            # what came back to its old component has not changed
            changed = both.join(parts.withColumnRenamed("component", "_was"), "node", "left").where("_was IS NULL OR component <> _was").select("node", "component")
    lost = gone if merge is None else gone.join(held, ["src", "dst"], "left_semi")
    state = added.join(gone, ["src", "dst"], "left_anti").withColumn("alive", F.lit(True)).unionByName(lost.withColumn("alive", F.lit(False)))
    _write(state, path, "edges", now + 1)
    _write(changed, path, "parts", now + 1)
    system, inner = store.opened(path)
    store.put(system, f"{inner}/done/{now + 1}", b"")
    return now + 1


def pointers(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """(split, index): how many nodes of each path (split, step, node; steps from 0) are shown after its moves (split, seq, delta): 1 at first, then held between 1 and the path's length at each move."""
    length = paths.groupBy("split").agg(F.count("*").cast("int").alias("_n"))
    steps = moves.groupBy("split").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("delta").cast("int").alias("delta")))), lambda m: m["delta"]).alias("_moves"))
    moved = F.aggregate(F.coalesce("_moves", F.array().cast("array<int>")), F.lit(1), lambda at, d: F.greatest(F.lit(1), F.least(F.col("_n"), at + d)))
    return length.join(steps, "split", "left").select("split", moved.alias("index"))


def accepted(paths: DataFrame, index: DataFrame) -> DataFrame:
    """(split, src, dst): the edge after the last shown node of each path; none where the whole path is shown."""
    p = paths.join(index, "split")
    a = p.where(F.col("step") == F.col("index") - 1).select("split", F.col("node").alias("src"))
    return a.join(p.where(F.col("step") == F.col("index")).select("split", F.col("node").alias("dst")), "split")
