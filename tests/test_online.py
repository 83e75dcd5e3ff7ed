"""Bayesian run lengths against a loop, and on planted breaks."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelscope.operators import online


def by_loop(xs, hazard, prior, least):
    runs, best, found = [(0, 0.0, 1.0)], 0, []
    for t, x in enumerate(xs):
        if x is None or math.isnan(x):
            continue
        weighed = []
        for n, s, mass in runs:
            known = 1 / prior**2 + n
            var = 1 + 1 / known
            weighed.append((n, s, mass * math.exp(-((x - s / known) ** 2) / (2 * var)) / math.sqrt(var)))
        total = sum(m for *_, m in weighed)
        runs = [(0, 0.0, hazard)] + [(n + 1, s + x, m / total * (1 - hazard)) for n, s, m in weighed if total and m / total * (1 - hazard) >= least]
        now = max((m, n) for n, _, m in runs)[1]
        if now < best:
            found.append((t, t - now + 1))
        best = now
    return found


def frame(spark, **series):
    rows = pd.concat([pd.DataFrame({"ticker": k, "t": np.arange(len(v)), "z": np.array(v, float)}) for k, v in series.items()])
    return spark.createDataFrame(rows, "ticker string, t int, z double")


def test_against_a_loop(spark):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(np.repeat(rng.normal(0, 2, 5), 40), 1) for k in "abc"}
    data["c"][10:30] = np.nan
    data["d"] = np.r_[rng.normal(0, 1, 30), 1e9, rng.normal(0, 1, 30)]
    got = online.detect_bayes(frame(spark, **data), hazard=0.02, prior=3.0, least=1e-4).collect()
    for k, x in data.items():
        assert sorted((r["t"], r["began"]) for r in got if r["ticker"] == k) == by_loop(x, 0.02, 3.0, 1e-4)


def test_planted_breaks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(np.repeat([0.0, 3.0, -2.0], [80, 60, 90]), 1)
    got = [(r["t"], r["began"]) for r in online.detect_bayes(frame(spark, a=x, calm=rng.normal(0, 1, 230))).orderBy("t").collect()]
    for at in (80, 140):
        assert any(at <= t <= at + 6 and abs(began - at) <= 2 for t, began in got)
    calm = online.detect_bayes(frame(spark, calm=rng.normal(0, 1, 400))).count()
    assert calm <= 4


def test_nothing(spark):
    df = frame(spark, a=[1.0])
    assert online.detect_bayes(df.limit(0)).count() == 0 and online.detect_bayes(df).count() == 0
    assert online.detect_bayes(df.withColumn("z", F.lit(None).cast("double"))).count() == 0


def test_many_series_in_step(spark):
    """More series than are taken together, of all lengths; they go through batches of arrays, not row by row."""
    rng = np.random.default_rng(3)
    data = {f"s{k}": rng.normal(np.repeat(rng.normal(0, 2, 3), k // 5 + 1), 1) for k in range(300)}
    made = online.detect_bayes(frame(spark, **data), hazard=0.02)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.collect()
    for k, x in data.items():
        assert sorted((r["t"], r["began"]) for r in got if r["ticker"] == k) == by_loop(x, 0.02, 2.0, 1e-3)
