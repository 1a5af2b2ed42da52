"""One numbering for segments of overlapping tiles whose ids are local.

Tiles see common voxels under ids of their own. Of two tiles, segments match where each is the other's best: most common voxels,
as a share of the voxels that either has where both tiles look. Matches are edges of a graph over (tile, id), whose components
are the segments of the whole volume. A voxel is taken from the tile that sees most around it. Neither the order of the
rows nor that of the tiles matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import labels
from lamina.operators.shared import kept, number

AXES = ("z", "y", "x")


def overlap_votes(tiles: DataFrame) -> DataFrame:
    """(tile_a, id_a, tile_b, id_b, n, share): pairs of segments of two tiles with common voxels. tiles: (tile, z, y, x, label), background included.

    Voxels meet once, by coordinates; a voxel has as many rows as tiles see it. share is n over the voxels that either segment has where both tiles look.
    """
    seen = tiles.groupBy(*AXES).agg(F.sort_array(F.collect_list(F.struct("tile", "label"))).alias("s")).where(F.size("s") > 1)
    pairs = seen.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a.tile < b.tile")
    counts = kept(pairs.groupBy(F.col("a.tile").alias("tile_a"), F.col("a.label").alias("id_a"), F.col("b.tile").alias("tile_b"), F.col("b.label").alias("id_b")).agg(F.count("*").alias("n")), "votes")
    size = lambda e: counts.groupBy("tile_a", "tile_b", f"id_{e}").agg(F.sum("n").alias(f"n_{e}"))
    both = counts.where("id_a > 0 AND id_b > 0").join(size("a"), ["tile_a", "tile_b", "id_a"]).join(size("b"), ["tile_a", "tile_b", "id_b"])
    return both.select("tile_a", "id_a", "tile_b", "id_b", "n", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("share"))


def matches(votes: DataFrame, min_share: float) -> DataFrame:
    """Pairs that are each other's best in their two tiles (ties: the smaller id), with at least that share."""
    best = lambda own, other: F.row_number().over(Window.partitionBy("tile_a", "tile_b", own).orderBy(F.desc("share"), other))
    return votes.withColumns({"_a": best("id_a", "id_b"), "_b": best("id_b", "id_a")}).where(F.col("share") >= min_share).where("_a = 1 AND _b = 1").drop("_a", "_b")


def global_ids(tiles: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(tile, label, global_id) of all segments: ids from 1, in the order of the first (tile, id) of each."""
    nodes = kept(number(tiles.where("label > 0").select("tile", "label").distinct(), "node", "tile", "label"), "nodes")
    end = lambda e: nodes.select(F.col("tile").alias(f"tile_{e}"), F.col("label").alias(f"id_{e}"), F.col("node").alias(e))
    found = matches(overlap_votes(tiles), min_share).join(end("a"), ["tile_a", "id_a"]).join(end("b"), ["tile_b", "id_b"])
    parts = labels.components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = nodes.join(parts, "node", "left").select("tile", "label", F.coalesce("component", "node").alias("root"))
    ids = number(named.select("root").distinct(), "global_id", "root")
    return named.join(ids, "root").select("tile", "label", "global_id")


def stitched(tiles: DataFrame, ids: DataFrame) -> DataFrame:
    """(z, y, x, label): each voxel once, under global ids, from the tile whose border is farthest from it (ties: the smallest tile)."""
    box = tiles.groupBy("tile").agg(*[F.min(a).alias(f"_l{a}") for a in AXES], *[F.max(a).alias(f"_h{a}") for a in AXES])
    room = F.least(*[F.col(a) - F.col(f"_l{a}") for a in AXES], *[F.col(f"_h{a}") - F.col(a) for a in AXES])
    owner = tiles.join(box, "tile").groupBy(*AXES).agg(F.min_by(F.struct("tile", "label"), F.struct(-room, "tile")).alias("o"))
    rows = owner.select(*AXES, F.col("o.tile").alias("tile"), F.col("o.label").alias("label"))
    return rows.join(ids, ["tile", "label"], "left").select(*AXES, F.coalesce("global_id", F.lit(0)).cast("long").alias("label"))
