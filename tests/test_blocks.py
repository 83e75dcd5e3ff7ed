"""Long series in blocks, against the folds over whole series."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelscope.operators import blocks, detectors

DAY = date(2020, 1, 1)


def rows_of(df):
    return sorted((r["ticker"], r["t"]) for r in df.collect())


def series(spark, **values):
    frame = pd.concat([pd.DataFrame({"ticker": k, "t": np.arange(len(v)), "r": v}) for k, v in values.items()])
    return spark.createDataFrame(frame, "ticker string, t int, r double").withColumn("date", F.lit(DAY))


@pytest.mark.parametrize("cooldown", [0, 1, 7, 30])
def test_cooldowns_by_doubling(spark, cooldown):
    rng = np.random.default_rng(cooldown)
    ts = {"dense": range(300), "sparse": np.flatnonzero(rng.random(3000) < 0.02).tolist(), "gaps": [5, 6, 400, 401, 438, 439, 440, 1000], "one": [9]}
    c = spark.createDataFrame([(k, int(t)) for k, v in ts.items() for t in [*v, *list(v)[:3]]], "ticker string, t int")
    assert rows_of(blocks.cooled(c, cooldown)) == rows_of(detectors.cooled(c.distinct(), cooldown))
    assert blocks.cooled(c.limit(0), cooldown).count() == 0


@pytest.mark.parametrize("rows", [1, 37, 4096])
def test_cusum_by_blocks(spark, rows):
    rng = np.random.default_rng(1)
    drifting = rng.normal(0, 1, 240) + np.repeat([0, 0.8, -0.8, 0.4], 60)
    flat = rng.normal(0, 1, 240)
    flat[50:120] = 0.5
    r = series(spark, a=drifting, b=flat, c=rng.standard_t(3, 25), d=np.zeros(30))
    n = 60 if rows == 1 else 240
    r = r.where(F.col("t") < n)
    assert rows_of(blocks.detect_cusum(r, 15, 2.0, 9, rows=rows)) == rows_of(detectors.detect_cusum(r, 15, 2.0, 9)) != []


def test_one_long_series(spark):
    rng = np.random.default_rng(2)
    r = series(spark, a=rng.standard_t(4, 120_000)).repartition(4)
    assert rows_of(blocks.detect_cusum(r, 60, 4.0, 30)) == rows_of(detectors.detect_cusum(r, 60, 4.0, 30))
    c = spark.range(100_000).select(F.lit("a").alias("ticker"), F.col("id").cast("int").alias("t"))
    assert rows_of(blocks.cooled(c, 30)) == [("a", t) for t in range(0, 100_000, 31)]
