"""Windows by running sums, and the comparison of detectors in one pass."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelscope.functions.stats import t_bounds, two_sided_p
from panelscope.operators import comparison, detectors, events, features, rolling

DAY = date(2020, 1, 1)


def series(spark, **values):
    rows = [(name, t, DAY + timedelta(t), None if v is None else float(v)) for name, vs in values.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "ticker string, t int, date date, r double")


def moments(df, first, last):
    made = rolling.with_moments(rolling.with_running(df, "r", "ticker", "t"), {"w": (first, last)}, "ticker", "t")
    return rolling.without_running(made).orderBy("ticker", "t").toPandas()


@pytest.mark.parametrize("level", [0.0, 1e6, -1e9])
def test_level_costs_no_digits(spark, level):
    """Deviations of a millionth of the level, as sharp as those without it."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 700)
    got = moments(series(spark, a=level + x), 59, 0)
    want = pd.Series((level + x) - level).rolling(60)
    np.testing.assert_allclose(got["w_var"][59:], want.var()[59:], rtol=1e-7)
    np.testing.assert_allclose(got["w_mean"][59:] - level, want.mean()[59:], atol=1e-6 if level else 1e-12)


def test_far_jump_of_level_leaves_windows_exact(spark):
    x = np.r_[np.tile([0.0, 1.0], 50), 1e6 + np.tile([0.0, 1.0], 50)]
    got = moments(series(spark, a=x), 3, 0)
    assert got["w_var"][20] == pytest.approx(1 / 3, rel=1e-6) and got["w_var"][190] == pytest.approx(1 / 3, rel=1e-6)
    flat = moments(series(spark, a=[5.0] * 10 + [7.0] * 10), 3, 0)
    assert flat["w_var"][9] == 0 and flat["w_var"][19] == 0 and flat["w_var"][10] > 0


def test_missing_values_and_short_groups(spark):
    got = moments(series(spark, a=[1, None, float("nan"), 4, float("inf"), 6], b=[3], c=[None]), 2, 1)
    a = got[got["ticker"] == "a"]
    assert a["w_n"].tolist() == [0, 1, 1, 0, 1, 1]
    assert a["w_mean"].fillna(-1).tolist() == pytest.approx([-1, 1, 1, -1, 4, 4]) and a["w_var"].isna().all()
    assert got[got["ticker"] != "a"]["w_mean"].isna().all()
    assert moments(series(spark, a=[1]).limit(0), 2, 1).empty


def test_plan_does_not_grow_with_the_window(spark):
    frames = lambda n: features.add_realized_vol(spark.createDataFrame([(DAY, "a", 1.0)], "date date, ticker string, price double"), ((n, "x"),))._jdf.queryExecution().executedPlan().toString()
    plan = frames(10_000)
    assert "-9999" not in plan.replace("lag", "") and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window") == frames(10).count("Window")


def jumps_by_definition(x, window, threshold, cooldown):
    last, found = -cooldown - 1, []
    for t in range(window, len(x)):
        before = x[t - window : t]
        sd = before.std(ddof=1)
        if sd >= 1e-12 and abs((x[t] - before.mean()) / sd) > threshold and t - last > cooldown:
            found.append(t)
            last = t
    return found


def test_jumps_against_a_loop(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.standard_t(3, 300) for k in "abc"}
    data["b"][:80] = 0.25
    got = detectors.detect_jump(series(spark, **data), 30, 2.0, 15).collect()
    for k, x in data.items():
        assert sorted(r["t"] for r in got if r["ticker"] == k) == jumps_by_definition(x, 30, 2.0, 15)


def panel_of(spark, seed, n, tickers):
    rng = np.random.default_rng(seed)
    rows = [(DAY + timedelta(t), k, float(p)) for k in tickers for t, p in enumerate(100 * np.exp(np.cumsum(rng.standard_t(3, n) * 0.02)))]
    return spark.createDataFrame(rows, "date date, ticker string, price double")


def test_comparison_in_one_pass_equals_the_tables(spark):
    days = pd.date_range(DAY, periods=6, freq="45D")
    dated = spark.createDataFrame([(f"e{k}", d.date()) for k, d in enumerate([*days, pd.Timestamp("1990-01-01")])], "event string, event_date date")
    panel = panel_of(spark, 3, 260, ["a", "b", "c"]).unionByName(panel_of(spark, 4, 1, ["single"])).unionByName(panel_of(spark, 5, 0, ["none"]))
    d = comparison.Detectors((30, 4.0, 15), (20, 2.0, 10), (15, 0.2, 10))
    got = comparison.compared(panel, dated, d, 12)
    r = detectors.simple_returns(panel)
    found = detectors.labelled(cusum=detectors.detect_cusum(r, *d.cusum), jump=detectors.detect_jump(r, *d.jump), ttest=detectors.detect_ttest(r, *d.ttest))
    cps = events.match_events(panel, dated)
    want = events.evaluate(found, cps, events.spine_of(cps, d.names), 12)
    rows = lambda df: sorted(repr(tuple(x[c] for c in ("ticker", "method", "n_det", "n_tp", "n_fp", "fpr", "recall", "delays", "mean_delay"))) for x in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 9
    assert sum(x["n_tp"] for x in got.collect()) > 0
    one = comparison.compared(panel, dated, comparison.Detectors(None, (20, 2.0, 10), None), 12)
    assert rows(one) == [x for x in rows(want) if "'jump'" in x]
    assert comparison.compared(panel.limit(0), dated, d).count() == 0 and comparison.compared(panel, dated.limit(0), d).count() == 0


def test_comparison_reads_once(spark, tmp_path):
    panel_of(spark, 6, 100, ["a", "b"]).write.parquet(str(tmp_path / "p"))
    dated = spark.createDataFrame([("e", DAY + timedelta(50))], "event string, event_date date")
    plan = comparison.compared(spark.read.parquet(str(tmp_path / "p")), dated)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(ticker") == 1


def test_wide_windows_and_long_series_are_exact(spark):
    """Windows past the longs' reach go by decimals, with the same digits; sums over long series don't overflow."""
    rng = np.random.default_rng(4)
    x = rng.choice([-1.0, 1.0], 150_000) * 1e6 + rng.normal(0, 1e-3, 150_000)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "a", "t": np.arange(len(x)), "r": x}), "ticker string, t int, r double")
    windows = {"narrow": (rolling.NARROW, 1), "wide": (rolling.NARROW + 1, 1), "three": (3, 1)}
    last = rolling.with_moments(rolling.with_running(df, "r", "ticker", "t"), windows, "ticker", "t").where(f"t = {len(x) - 1}").first()
    for key, (first, _) in windows.items():
        part = x[-first - 1 : -1]
        assert last[f"{key}_mean"] == pytest.approx(part.mean(), abs=1e-6)
        assert last[f"{key}_var"] == pytest.approx(part.var(ddof=1), rel=1e-12, abs=1e-9)


def test_detectors_work_out_moments_once(spark):
    """A filter on what is made of the moments would be put beneath them, with all that they are made of in it."""
    r = spark.createDataFrame([("a", t, float(t % 7)) for t in range(99)], "ticker string, t int, r double")
    for found in (detectors.jump_candidates(r, 10, 1.0), detectors.detect_ttest(r, 10, 0.3, 5), detectors.detect_cusum(r, 10)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter" in line and "_unit" in line for line in plan.splitlines())


@pytest.mark.parametrize("alpha", [0.3, 0.05, 0.001])
def test_bounds_of_t(alpha):
    low, high = t_bounds(alpha, 19, 38)
    assert two_sided_p(low, 38) > alpha > two_sided_p(low * (1 + 3e-6), 38)
    assert two_sided_p(high, 19) < alpha < two_sided_p(high * (1 - 3e-6), 19)
