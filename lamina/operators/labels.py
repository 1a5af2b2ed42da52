"""Relabelling, connected components across blocks, and graphs of segments."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import kernels
from lamina.operators.shared import kept, number
from lamina.sources.volume import with_halo

AXES = ("z", "y", "x")
#: Edges that one task joins at once, whatever the size of the graph.
ONE_TASK = 1 << 20


def relabel(vox: DataFrame, table: DataFrame, on: list[str] | None = None, label: str = "label") -> DataFrame:
    """Map labels through (old_id, new_id), maybe per volume; missing or negative targets keep the label."""
    on = on or []
    t = table.select(*on, F.col("old_id").alias(label), F.col("new_id").alias("_new"))
    out = vox.join(t, [*on, label], "left")
    return out.withColumn(label, F.when(F.col("_new").isNull() | (F.col("_new") < 0), F.col(label)).otherwise(F.col("_new"))).drop("_new")


def contiguous(vox: DataFrame, label: str = "label") -> DataFrame:
    """Nonzero labels become 1, 2, ... in their order; 0 stays. The ranking is over distinct labels only."""
    ids = vox.where(F.col(label) > 0).select(F.col(label).alias("old_id")).distinct()
    ids = number(ids, "new_id", "old_id")
    return relabel(vox, ids, label=label)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): smallest node reachable.

    Edges near each other in the order of their ends are joined within a task, which leaves a graph of the smallest nodes found there;
    what nodes seen by several tasks link is solved in one task if it has few edges, else in rounds.
    """
    both = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node")))
    kind = both.schema["node"].dataType
    e = kept(edges.select(F.col(src).cast(kind).alias("u"), F.col(dst).cast(kind).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "edges")
    if e.count() <= ONE_TASK:
        return kept(_stars(e.coalesce(1)), "labels").withColumnRenamed("root", "component")
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = kept(_stars(e.repartitionByRange(n, "u", "v").sortWithinPartitions("u", "v")), "stars")
    least = kept(stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("_other")), "least")
    several = least.where("root <> _other").select("node", F.col("root").alias("v"))
    links = kept(stars.join(several, "node").where("root <> v").select(F.col("root").alias("u"), "v").distinct(), "links")
    names = _stars(links.coalesce(1)).withColumnRenamed("root", "component") if links.count() <= ONE_TASK else _rounds(links)
    named = least.join(names.withColumnRenamed("node", "root"), "root", "left")
    return kept(named.select("node", F.coalesce("component", "root").alias("component")), "labels")


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of edges (u, v): the smallest node that edges of the same task, at most ONE_TASK at a time, lead to."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ONE_TASK:
                yield solved(held)
                held, n = [], 0
        if n:
            yield solved(held)

    def solved(held: list) -> pa.RecordBatch:
        u, v = (pa.chunked_array([b[c] for b in held]) for c in ("u", "v"))
        node, root = kernels.smallest(u.to_numpy(), v.to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node, u.type), pa.array(root, u.type)], ["node", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInArrow(run, f"node {kind}, root {kind}")


def _rounds(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v). Labels of neighbours and pointer jumps until nothing changes."""
    both = kept(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = kept(step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels


def shortest_paths(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(split, step, node): a shortest path for each of `goals` (split, start, goal; a split once), all searched together; no rows where there is none.

    A round takes each front one edge further; a new node keeps its smallest parent, and can only be known from this front or the
    one before. A search ends at its goal or where nothing new is reached. Fronts carry their paths, so nothing walks back.
    """
    both = kept(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct(), "both")
    start = F.col("start").cast("long")
    front = kept(goals.select("split", F.col("goal").cast("long").alias("goal"), start.alias("node"), F.array(start).alias("path")), "front")
    before, found = front.limit(0), [front.where("node = goal")]
    while True:
        going = front.where("node <> goal")
        done = front.where("node = goal").select("split").distinct()
        new = going.join(done, "split", "left_anti").withColumnRenamed("node", "u").join(both, "u")
        new = new.groupBy("split", "goal", F.col("v").alias("node")).agg(F.min_by("path", "u").alias("path"))
        new = new.join(before.select("split", "node").unionByName(front.select("split", "node")), ["split", "node"], "left_anti")
        before, front = front, kept(new.select("split", "goal", "node", F.concat("path", F.array("node")).alias("path")), "front")
        rows, hits = front.agg(F.count("*"), F.count_if(F.col("node") == F.col("goal"))).first()
        if hits:
            found.append(front.where("node = goal"))
        if not rows:
            return union_all(*found).select("split", F.posexplode("path").alias("step", "node"))


def shortest_path(edges: DataFrame, start: int, goal: int) -> DataFrame:
    """(step, node) of one shortest path; empty where there is none."""
    one = edges.sparkSession.createDataFrame([(0, start, goal)], "split int, start long, goal long")
    return shortest_paths(edges, one).select("step", "node")


def chain_edges(selection: DataFrame) -> DataFrame:
    """Edges between successive nodes of each selection (sel, pos, node)."""
    nxt = F.lead("node").over(Window.partitionBy("sel").orderBy("pos"))
    return selection.select(F.col("node").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


def isolate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends or no end in the set."""
    n = nodes.select("node").distinct().withColumn("_in", F.lit(True))
    e = edges.join(n.withColumnsRenamed({"node": "src", "_in": "_s"}), "src", "left").join(n.withColumnsRenamed({"node": "dst", "_in": "_d"}), "dst", "left")
    return e.where(F.coalesce("_s", F.lit(False)) == F.coalesce("_d", F.lit(False))).select("src", "dst")


def without_edge(edges: DataFrame, cut: DataFrame) -> DataFrame:
    c = cut.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    return edges.join(c, (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b")), "left_anti")


def last_class(reviews: DataFrame) -> DataFrame:
    """The last class given to each id."""
    return reviews.groupBy("id").agg(F.max_by("cls", "seq").alias("cls"))


def page(objects: DataFrame, size: int, page_no: int) -> DataFrame:
    """The given page (from 0) of objects in the order of their ids."""
    return number(objects, "_n", "id").where((F.col("_n") > size * page_no) & (F.col("_n") <= size * (page_no + 1))).drop("_n")


def resized(size: int, page_no: int, double: bool) -> tuple[int, int]:
    """(size, page) after pages were doubled or halved, at the page that holds the first object of the old one; a page has one object at least."""
    new = size * 2 if double else max(size // 2, 1)
    return new, size * page_no // new


def reviewed(objects: DataFrame, marks: DataFrame) -> DataFrame:
    """Objects (id) with the last of their marks (id, mark, seq): `bad` ones stay, marked; `removed` ones go; `ok` takes a mark back."""
    last = marks.groupBy("id").agg(F.max_by("mark", "seq").alias("_mark"))
    return objects.join(last, "id", "left").where("_mark IS NULL OR _mark <> 'removed'").withColumn("bad", F.coalesce(F.col("_mark") == "bad", F.lit(False))).drop("_mark")


def split_components(vox: DataFrame, block: tuple[int, int, int], connectivity: int = 1) -> DataFrame:
    """Voxels with `component`: the smallest raster key (z, y, x packed) of each connected part of one label.

    Parts are found within blocks that hold one more voxel on each side; parts that meet there are merged over the graph of their names.
    """
    bits = 21

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows[list(AXES)].to_numpy().min() < 0 or rows[list(AXES)].to_numpy().max() >> bits:
            raise ValueError(f"coordinates must be from 0 to {(1 << bits) - 1}: shift the volume first")
        low = rows[list(AXES)].min().to_numpy()
        at = tuple((rows[a] - o).to_numpy() for a, o in zip(AXES, low))
        a = np.zeros(tuple(int(c.max()) + 1 for c in at), np.int64)
        a[at] = rows["label"]
        part = kernels.components(a, connectivity)[at]
        key = (rows["z"].to_numpy(np.int64) << (2 * bits)) | (rows["y"].to_numpy(np.int64) << bits) | rows["x"].to_numpy(np.int64)
        least = np.full(part.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, part, key)
        return pd.DataFrame({"z": rows["z"], "y": rows["y"], "x": rows["x"], "label": rows["label"], "is_core": rows["is_core"], "part": least[part]})

    halo = with_halo(vox.where("label > 0").select(*AXES, "label"), block, (1, 1, 1))
    parts = kept(halo.groupBy("bz", "by", "bx").applyInPandas(run, "z int, y int, x int, label long, is_core boolean, part long"), "parts")
    core = parts.where("is_core")
    seen = parts.where("NOT is_core").select(*AXES, F.col("part").alias("other"))
    links = core.join(seen, list(AXES)).where("part <> other").select(F.col("part").alias("src"), F.col("other").alias("dst")).distinct()
    names = components(links)
    return core.join(names.withColumnRenamed("node", "part"), "part", "left").select(*AXES, "label", F.coalesce("component", "part").alias("component"))


def cleaned(vox: DataFrame, block: tuple[int, int, int], min_size: int, connectivity: int = 1) -> tuple[DataFrame, DataFrame]:
    """(voxels with new ids, map new id -> original id and size): parts split, small ones dropped, ids by original id and first voxel."""
    parts = split_components(vox, block, connectivity)
    size = parts.groupBy("component").agg(F.count("*").alias("n"), F.min_by("label", F.struct(*AXES)).alias("orig")).where(F.col("n") >= min_size)
    ids = number(size, "new_id", "orig", "component")
    out = parts.join(ids.select("component", "new_id"), "component").select(*AXES, F.col("new_id").alias("label"))
    return out, ids.select("new_id", F.col("orig").alias("old_id"), "n")


def surviving_origins(origins: DataFrame, ids: DataFrame) -> DataFrame:
    """Origins under the new ids of what is left of their segments."""
    return origins.join(ids.select(F.col("old_id").alias("segment_id"), "new_id"), "segment_id").drop("segment_id").withColumnRenamed("new_id", "segment_id")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
