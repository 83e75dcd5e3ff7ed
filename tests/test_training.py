"""Training by sums: fold states that are put together, and positions trained on the Sharpe ratio."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelscope.operators import backtest, training

DAY = date(2020, 1, 1)


def rows_of(spark, seed=1, n=900, tickers=("a", "b")):
    rng = np.random.default_rng(seed)
    frame = pd.concat([pd.DataFrame({"ticker": k, "date": [DAY + timedelta(2 * t) for t in range(n)], "r": rng.normal(0, 1, n)}) for k in tickers])
    frame["x"] = frame.groupby("ticker")["r"].shift(1)
    frame = frame.astype(object).where(frame.notna(), None)
    return spark.createDataFrame(frame, "ticker string, date date, r double, x double")


def test_states_equal_training_each_fold_anew(spark):
    data = rows_of(spark)
    late = data.where("ticker = 'b' and date >= '2022-06-01'").withColumn("ticker", F.lit("late"))
    gap = data.where("ticker = 'a' and (date < '2020-06-01' or date >= '2024-01-01')").withColumn("ticker", F.lit("gap"))
    data = data.unionByName(late).unionByName(gap)
    folds = backtest.folds(spark, 2020, 2021, 2025, 1)
    got = backtest.expanding_positions(data.select("ticker", "date", "r"), backtest.mean_sign(), folds)
    want = backtest.expanding_window_backtest(data, lambda train: lambda test: test["r"] * 0 + (1.0 if train["r"].mean() >= 0 else -1.0), folds)
    key = lambda df: sorted((r["fold"], r["ticker"], r["date"], r["position"]) for r in df.collect())
    assert key(got) == key(want) and {r[1] for r in key(got)} == {"a", "b", "late", "gap"}
    assert not [r for r in key(got) if r[1] == "late" and r[0] < 2]


def test_pooled_regression_against_numpy(spark):
    data = rows_of(spark, 2)
    folds = backtest.folds(spark, 2020, 2021, 2024, 1)
    got = backtest.expanding_positions(data, backtest.regression("x"), folds, ()).toPandas()
    frame = data.toPandas()
    for k, year in enumerate((2021, 2022, 2023)):
        train = frame[(frame["date"] < date(year, 1, 1)) & frame["x"].notna()]
        slope, level = np.polyfit(train["x"], train["r"], 1)
        mine = got[got["fold"] == k].sort_values(["ticker", "date"])
        assert (mine["position"].to_numpy() == np.sign(slope * mine["x"].to_numpy(float) + level)).all() and len(mine)
    flat = backtest.expanding_positions(data.withColumn("x", F.lit(3.0)), backtest.regression("x"), folds, ())
    assert {r["position"] for r in flat.select("position").distinct().collect()} == {0.0}


def test_training_rows_stay_where_they_are(spark, tmp_path):
    rows_of(spark).write.parquet(str(tmp_path / "p"))
    made = backtest.expanding_positions(spark.read.parquet(str(tmp_path / "p")), backtest.mean_sign(), backtest.folds(spark, 2020, 2021, 2024, 1))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Python" not in plan and "partial_sum" in plan
    empty = backtest.folds(spark, 2020, 2030, 2030, 1)
    assert backtest.expanding_positions(spark.read.parquet(str(tmp_path / "p")), backtest.mean_sign(), empty).count() == 0
    uneven = backtest.folds(spark, 2020, 2021, 2022, 1).union(backtest.folds(spark, 2019, 2022, 2023, 1))
    with pytest.raises(ValueError):
        backtest.fold_states(rows_of(spark), backtest.mean_sign(), uneven, ["ticker"])


def loss_of(data, weights):
    x = np.c_[np.ones(len(data)), data[["f", "g"]].fillna(0)]
    z = np.tanh(x @ weights) * data["r"]
    return -np.sqrt(252) * z.mean() / z.std(ddof=0)


def planted(spark, n=4000):
    rng = np.random.default_rng(3)
    f, g = rng.normal(0, 1, n), rng.normal(0, 1, n)
    frame = pd.DataFrame({"f": f, "g": g, "r": 0.1 * f + rng.normal(0, 1, n)})
    frame.loc[::50, "g"] = np.nan
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "f double, g double, r double")


def test_gradient_by_differences(spark):
    frame, df = planted(spark, 500)
    at = np.array([0.2, 0.5, -0.3])
    told = training.loss_and_gradient(training.gradient_sums(df, ("f", "g"), (0.0, 0.0), (1.0, 1.0), tuple(at)), 3).first()
    assert told["loss"] == pytest.approx(loss_of(frame, at), rel=1e-9)
    for k in range(3):
        step = 1e-5 * (np.arange(3) == k)
        assert told[f"g{k}"] == pytest.approx((loss_of(frame, at + step) - loss_of(frame, at - step)) / 2e-5, rel=1e-5, abs=1e-7)
    trials = [at, at * 2]
    assert training.losses_at(df, ("f", "g"), (0.0, 0.0), (1.0, 1.0), trials) == pytest.approx([loss_of(frame, w) for w in trials])


def test_training_finds_planted_momentum(spark):
    frame, df = planted(spark)
    model = training.train(df, ("f", "g"), steps=12)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and model.losses[-1] < -1.2
    assert model.weights[1] > 3 * abs(model.weights[2])
    held = df.select(model.position().alias("p"), "f").toPandas()
    assert np.corrcoef(held["p"], held["f"])[0, 1] > 0.9


def test_training_on_nothing(spark):
    df = spark.createDataFrame([], "f double, r double")
    assert training.train(df, ("f",)).losses == () and training.train(df.selectExpr("r"), ()).weights == (0.1,)
    same = spark.createDataFrame([(1.0, 0.5)] * 5 + [(None, None)], "f double, r double")
    assert training.train(same, ("f",)).losses == ()
