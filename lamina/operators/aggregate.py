"""Aggregations over labels: dust, consensus, overlaps, scores, counters, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.shared import kept

AXES = ("z", "y", "x")


def sizes(vox: DataFrame, label: str = "label") -> DataFrame:
    return vox.groupBy(label).agg(F.count("*").alias("n"))


def clear_dust(vox: DataFrame, min_size: int, label: str = "label") -> DataFrame:
    """Labels of fewer voxels become 0. The counts are summed before they meet the voxels, so a background of most voxels is no hot key."""
    small = sizes(vox, label).where(F.col("n") < min_size).select(F.col(label).alias("_small"))
    out = vox.join(small, F.col(label) == F.col("_small"), "left")
    return out.withColumn(label, F.when(F.col("_small").isNotNull(), F.lit(0).cast("long")).otherwise(F.col(label))).drop("_small")


def overlap_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cnt"))


def split_consensus(pairs: DataFrame, min_size: int) -> DataFrame:
    """(a, b, cnt, kind, label): the b with the largest overlap keeps a's id, others get new ids in (b, a) order; small overlaps and a = 0 go.

    The last numbering runs over pairs of labels, which are few beside the voxels.
    """
    j = overlap_counts(pairs)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cnt"), "b"))
    kind = F.when((F.col("cnt") < min_size) | (F.col("a") == 0), "drop").when(F.col("rn") == 1, "keep").otherwise("new")
    k = j.withColumn("rn", rank).withColumn("kind", kind)
    top = j.agg(F.max("a").alias("mx"))
    new = F.row_number().over(Window.orderBy("b", "a"))
    fresh = k.where("kind = 'new'").crossJoin(F.broadcast(top)).select("a", "b", (F.col("mx") + new).alias("_new"))
    out = k.join(fresh, ["a", "b"], "left")
    label = F.when(F.col("kind") == "drop", 0).when(F.col("kind") == "keep", F.col("a")).otherwise(F.col("_new")).cast("long")
    return out.select("a", "b", "cnt", "kind", label.alias("label"))


def iou(in_a: Column, in_b: Column) -> Column:
    """Aggregate; NaN where both masks are empty."""
    both, any_ = F.sum((in_a & in_b).cast("long")), F.sum((in_a | in_b).cast("long"))
    return F.when(F.coalesce(any_, F.lit(0)) == 0, F.lit(float("nan"))).otherwise(both / any_)


def confusion(rows: DataFrame, wanted: str, got: str, *keys: str) -> DataFrame:
    """Counts and scores of a binary decision; empty denominators count as 1."""
    w, g = F.col(wanted).cast("boolean"), F.col(got).cast("boolean")
    out = rows.groupBy(*keys).agg(F.count_if(w & g).alias("tp"), F.count_if(~w & g).alias("fp"), F.count_if(w & ~g).alias("fn"), F.count_if(~w & ~g).alias("tn"))
    share = lambda n, d: n / F.greatest(d, F.lit(1))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": share(tp + tn, tp + tn + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def move_stats(moves: DataFrame, radius: Column) -> DataFrame:
    """Correct, missed and spurious moves by radius, and over all (null radius); moves neither wanted nor made don't count."""
    w, e = F.col("wanted"), F.col("executed")
    return moves.withColumn("r", radius).where(w | e).rollup("r").agg(F.count_if(w & e).alias("correct"), F.count_if(w & ~e).alias("missed"), F.count_if(~w & e).alias("spurious"))


def sigmoid_loss(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def fov_stats(weights: DataFrame, weight: str, *keys: str) -> DataFrame:
    return weights.groupBy(*keys).agg(F.count("*").alias("voxels"), F.count_if(F.col(weight) == 0).alias("masked"), F.sum(weight).alias("weight"))


def counters(events: DataFrame) -> DataFrame:
    """Totals by task, and by name over all tasks (null task)."""
    return events.cube("task", "name").agg(F.sum("delta").cast("long").alias("value")).where("name IS NOT NULL")


def histogram_lut(vox: DataFrame, value: str, steps: int = 255) -> DataFrame:
    """(i, v): smallest value whose cumulative share reaches i / steps. Ranges of values have running sums of their own, and the totals of the ranges before are added."""
    counts = vox.groupBy(value).agg(F.count("*").alias("n"))
    n_ranges = int(vox.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(counts.repartitionByRange(n_ranges, value).withColumn("_range", F.spark_partition_id()), "values")
    totals = ranged.groupBy("_range").agg(F.sum("n").alias("_sum"))  # one row a range
    totals = totals.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_tot"))
    cdf = ranged.join(F.broadcast(totals), "_range").withColumn("_cum", F.col("_before") + F.sum("n").over(Window.partitionBy("_range").orderBy(value)))
    low = F.col("_cum") - F.col("n")
    # value v serves all i with low / total < i / steps <= cum / total
    cdf = cdf.withColumn("_from", F.when(low == 0, F.lit(0)).otherwise(F.floor(low * steps / F.col("_tot")) + 1)).withColumn("_to", F.floor(F.col("_cum") * steps / F.col("_tot")))
    seq = F.sequence(F.col("_from").cast("int"), F.col("_to").cast("int"))
    return cdf.where("_from <= _to").select(F.explode(seq).alias("i"), F.col(value).alias("v"))


def match_histogram(vox: DataFrame, lut: DataFrame, value: str, steps: int = 255) -> DataFrame:
    """Values mapped through a table by their cumulative share within the slice."""
    counts = vox.groupBy("z", value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("z").orderBy(value)
    share = counts.withColumn("i", F.floor(F.sum("n").over(w) * steps / F.sum("n").over(Window.partitionBy("z"))).cast("int"))
    mapped = share.join(lut, "i").select("z", value, F.col("v").alias("matched"))
    return vox.join(mapped, ["z", value])


def extents(vox: DataFrame, label: str = "label") -> DataFrame:
    aggs = [F.count("*").alias("n")] + [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    return vox.where(F.col(label) > 0).groupBy(label).agg(*aggs)


def recovered(vox: DataFrame, segment: int, covered: str) -> DataFrame:
    own = F.col("label") == segment
    return vox.agg((F.sum((own & F.col(covered)).cast("long")) / F.greatest(F.sum(own.cast("long")), F.lit(1))).alias("fraction"))
