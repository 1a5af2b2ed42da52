"""URL filters: gradient-boosted trees on lexical features, below explicit rules.

Labelled addresses are those that the filter's rules fit, and any that the caller gives (url, block). Trees are trained
on at most MOST_ROWS of them (the first by a hash of the address) and decide on the addresses that no rule
fits. Features: length, depth, share of digits, entropy, numbers of parameters and labels, and statistics of the
host's suffix. These statistics come from all labelled addresses; those of a labelled address leave out its own
fold, so that its label is not among its features. `held_out` measures trees of the other folds on one fold.

Rules that name a whole suffix only to block parts of it (net/es/) leave the trees without any allowed address below
that suffix; labels from elsewhere mend that.

Defined cases: a null address, or one without ://, has empty host and path and fits no rule; if only one class
is labelled, or nothing, the other addresses get that class, or allow; repeated rows each get a
verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialize

#: (verdict, host, path); the longest that fits wins (fixed values).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Labelled addresses that the trees are fitted on, at most.
MOST_ROWS = 20_000
TREES, DEPTH = 12, 4
#: Parts of the labelled addresses; tasks that share the rows of one suffix.
FOLDS, SALTS = 5, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ["n_url", "n_host", "n_path", "depth", "digits", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_rate", "suffix_log"]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], field: int) -> Column:
    """The longest fitting rule's verdict (field 0) or text (field 1), else null."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit((verdict, h + p)[field])).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """Lexical feature columns from `_url`, `host` and `path`."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.split(url, "")
    share = F.transform(F.array_distinct(letters), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(F.filter(share, lambda q: q > 0), F.lit(0.0), lambda s, q: s - q * F.log2(q))
    return pages.withColumns(
        {
            "n_url": F.length(url).cast("double"),
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": F.when(F.length(url) > 0, entropy).otherwise(F.lit(0.0)),
            "n_params": F.length(F.regexp_replace(url, "[^=]", "")).cast("double"),
            "n_labels": F.size(F.split("host", r"\.")).cast("double"),
            "n_hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
        }
    )


def _labelled(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None, keep: list) -> DataFrame:
    """Features of all pages, with `_label` (the rule's verdict), `rule`, `_fold` and `_y` (1 for block, null without a label)."""
    host, path = parts(F.col("_url"))
    own = pages.select(*keep, F.col("_url"), F.lit(None).cast("double").alias("_y"), F.lit(True).alias("_own"))
    if labels is not None:
        none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in keep]
        own = own.unionByName(labels.select(*none, F.col("url").alias("_url"), F.col("block").cast("double").alias("_y"), F.lit(False).alias("_own")))
    own = own.withColumn("host", host).withColumn("path", path)
    own = own.withColumn("_label", rule_of(F.col("host"), F.col("path"), rules, 0)).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 1))
    own = own.withColumn("_y", F.coalesce((F.col("_label") == "block").cast("double"), "_y")).withColumn("_fold", F.pmod(F.xxhash64("_url"), F.lit(FOLDS)).cast("int"))
    return _with_suffix_statistics(lexical(own))


def _with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """suffix_rate and suffix_log over the labelled addresses of the host's suffix, pulled towards one half where few; hot suffixes are salted."""
    part = rows.groupBy("suffix", "_fold").agg(F.count("_y").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("b")).where("n > 0")
    folds = F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("n", "b"))))  # FOLDS entries at most
    stats = part.groupBy("suffix").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), folds.alias("_of"))
    stats = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("_url", F.lit(1)), F.lit(SALTS)).cast("int")).join(stats, ["suffix", "_salt"], "left")
    mine = F.when(F.col("_y").isNotNull(), F.element_at("_of", F.col("_fold")))
    n, b = (F.coalesce(F.col(f"_{k}"), F.lit(0)) - F.coalesce(mine[k], F.lit(0)) for k in "nb")
    return out.withColumns({"suffix_rate": (b + 1) / (n + 2), "suffix_log": F.log1p(n)}).drop("_salt", "_n", "_b", "_of")


def _sample(rows: DataFrame, most_rows: int) -> DataFrame:
    picked = rows.where(F.col("_y").isNotNull()).select("_y", "_url", "_fold", *LEXICAL).orderBy(F.xxhash64("_url"), "_url", "_y").limit(most_rows)
    return materialize(picked, "urls")[0]


def _fit(sample: DataFrame):
    gather = VectorAssembler(inputCols=LEXICAL, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, cacheNodeIds=False, predictionCol="_pred")
    trees.setProbabilityCol("_p").setRawPredictionCol("_raw")
    model = trees.fit(gather.transform(sample))
    return lambda rows: model.transform(gather.transform(rows)).withColumn("p_block", vector_to_array(F.col("_p"))[1])


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", most_rows: int = MOST_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the trees' probability of block."""
    rows = _labelled(pages.select(F.col(id_col), F.col(url_col).alias("_url")), rules, labels, [id_col])
    sample = _sample(rows, most_rows)
    seen = {r["_y"] for r in sample.select("_y").distinct().collect()}
    rows = rows.where("_own")
    if len(seen) < 2:
        decided = rows.withColumn("p_block", F.lit(float(seen == {1.0})))
    else:
        decided = _fit(sample)(rows)
    by_trees = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return decided.select(id_col, "host", "path", "rule", F.coalesce("_label", by_trees).alias("verdict"), "p_block")


def held_out(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", most_rows: int = MOST_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """Labelled addresses of fold 0 with the probability that trees of the other folds give them: _url, _y, p_block."""
    sample = _sample(_labelled(pages.select(F.col(url_col).alias("_url")), rules, labels, []), most_rows)
    return _fit(sample.where("_fold <> 0"))(sample.where("_fold = 0")).select("_url", "_y", "p_block")
