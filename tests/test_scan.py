"""Exponential moments by blocks."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelscope.operators import momentum, scan

DAY = date(2020, 1, 1)


def test_blocks_and_what_they_carry(spark):
    """Several blocks, slow and fast decays, gaps longer than a block, a level far from zero: as pandas has them."""
    rng = np.random.default_rng(1)
    n = 6000
    data = {"a": 1e6 + rng.normal(0, 1, n), "b": rng.normal(0, 1, n), "c": rng.normal(5, 2, 7)}
    data["b"][100:4000] = np.nan
    data["b"][:3] = np.nan
    frames = [pd.DataFrame({"ticker": k, "t": np.arange(len(x)) + (5 if k == "c" else 0), "x": x}) for k, x in data.items()]
    df = spark.createDataFrame(pd.concat(frames))
    moments = {f"{kind}{d}": scan.Moment("x", kind, d) for kind in ("mean", "sd") for d in (0.5, 0.9, 0.999)}
    assert scan.block_rows(list(moments.values())) < 500
    got = scan.ewm(df, moments).orderBy("ticker", "t").toPandas()
    for k, x in data.items():
        mine = got[got["ticker"] == k].reset_index(drop=True)
        for name, m in moments.items():
            with np.errstate(all="ignore"):
                w = pd.Series(x).ewm(alpha=1 - m.decay, adjust=True, ignore_na=False)
                want = (w.mean() if m.kind == "mean" else w.std()).to_numpy()
            # after so long a gap the weights of what went before are nothing to a double, here as there
            alive = np.isfinite(want) & mine[name].notna().to_numpy()
            np.testing.assert_allclose(mine[name].to_numpy(float)[alive], want[alive], rtol=1e-6, err_msg=f"{k} {name}")
            assert alive.mean() > 0.2 and (k == "b" or m.kind == "sd" or alive.all())


def test_one_long_group_is_spread(spark):
    n = 200_000
    x = np.sin(np.arange(n) / 50) + np.random.default_rng(2).normal(0, 0.1, n)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "a", "t": np.arange(n), "r": x}))
    made = scan.ewm(df, {"m": scan.Moment("r", "mean", 0.99), "s": scan.Moment("r", "sd", 0.99)})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    per_block = df.groupBy(F.floor(F.col("t") / scan.block_rows([scan.Moment("r", "sd", 0.99)]))).count()
    assert per_block.count() > 50 and per_block.agg(F.max("count")).first()[0] <= scan.ROWS
    got = made.orderBy("t").toPandas()
    w = pd.Series(x).ewm(alpha=0.01)
    np.testing.assert_allclose(got["m"], w.mean(), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(got["s"][1:], w.std()[1:], rtol=1e-7)


def test_edges(spark):
    df = spark.createDataFrame([("a", 0, None, "kept"), ("b", 0, 2.0, "kept"), ("b", 1, float("nan"), "kept")], "ticker string, t int, r double, own string")
    made = {(r["ticker"], r["t"]): r for r in scan.ewm(df, {"m": scan.Moment("r", "mean", 0.5), "s": scan.Moment("r", "sd", 0.5)}).collect()}
    assert made["a", 0]["m"] is None and made["b", 0]["m"] == 2 and made["b", 1]["m"] == 2 and made["b", 1]["s"] is None and made["b", 1]["own"] == "kept"
    assert scan.ewm(df.limit(0), {"m": scan.Moment("r", "mean", 0.5)}).count() == 0
    for bad in (("r", "median", 0.5), ("r", "mean", 1.0)):
        with pytest.raises(ValueError):
            scan.Moment(*bad)


def test_signals_need_no_python(spark):
    panel = spark.createDataFrame([(DAY + timedelta(k), "a", 1.0 + k) for k in range(5)], "date date, ticker string, price double")
    for df in (momentum.macd(panel), momentum.normalised_returns(panel)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan
