"""Equalisation by tables against the same on arrays: slices of odd sizes, empty tiles, masks, nulls."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lamina.operators import contrast, kernels


def volume(spark, *slices):
    parts = []
    for z, a in enumerate(slices):
        y, x = np.indices(a.shape).reshape(2, -1)
        parts.append(pd.DataFrame({"z": z, "y": y + 3, "x": x - 2, "value": a.ravel()}))
    return spark.createDataFrame(pd.concat(parts))


def test_equalised_as_on_arrays(spark):
    rng = np.random.default_rng(4)
    slices = [rng.random((16, 24)), rng.random((8, 40)) ** 3, rng.integers(0, 4, (24, 8)).astype(float), np.full((8, 8), 3.0), rng.random((5, 1))]
    got = contrast.equalised(volume(spark, *slices), tiles=8, limit=0.05, bins=32).toPandas()
    for z, a in enumerate(slices):
        one = got[got["z"] == z]
        have = np.full(a.shape, np.nan)
        have[one["y"] - 3, one["x"] + 2] = one["equalised"]
        np.testing.assert_allclose(have, kernels.clahe(a, 8, 0.05, 32), atol=1e-9)


def test_holes_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    vox = volume(spark, rng.random((12, 12))).where("NOT (y < 9 AND x < 4)").withColumn("m00", F.lit(1))
    vox = vox.withColumn("value", F.when(F.col("x") == 8, None).when(F.col("x") == 7, float("nan")).otherwise(F.col("value")))
    got = contrast.equalised(vox, tiles=4).collect()
    assert len(got) == vox.count() and all((r["equalised"] is None) == (r["x"] in (7, 8)) for r in got)
    assert all(0 <= r["equalised"] <= 1 + 1e-9 for r in got if r["x"] < 7)
    assert contrast.equalised(vox.limit(0)).count() == 0


def test_matched_leaves_masked_slices_alone(spark):
    rng = np.random.default_rng(6)
    vox = volume(spark, rng.random((10, 10)), rng.random((10, 10))).withColumn("m", F.when(F.col("z") == 1, True).when(F.col("x") > 3, False))
    lut = spark.range(256).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1000.0).alias("v"))
    got = contrast.matched(vox, lut, masked="m", tiles=2).toPandas()
    assert (got[got["z"] == 1]["matched"] == got[got["z"] == 1]["value"]).all()
    first = contrast.equalised(vox.where("z = 0"), tiles=2).toPandas()
    level = np.floor(first["equalised"] * 255 + 1e-9)
    want = {(r.y, r.x): 1000 + np.floor((level <= lev).mean() * 255) for r, lev in zip(first.itertuples(), level)}
    assert {(r.y, r.x): r.matched for r in got[got["z"] == 0].itertuples()} == want
