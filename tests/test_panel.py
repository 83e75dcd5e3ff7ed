"""Known answers, differential tests against pandas, and the traps of the panel operators."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelscope.functions.stats import clipped, exchange_of, half_even, severity, sigmoid, student_t_two_sided, t_angle
from panelscope.operators import backtest, benchmarks, comparison, coverage, detectors, events, features, gaussian, momentum, panel, scan
from panelscope.sources import prices

DAY = date(2020, 1, 1)


def long(spark, **series):
    rows = [(DAY + timedelta(k), name, float(v)) for name, vs in series.items() for k, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "date date, ticker string, price double")


def returns_of(spark, **series):
    rows = [(name, k, DAY + timedelta(k), None if v is None else float(v)) for name, vs in series.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "ticker string, t int, date date, r double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).select(f"`{name}`").collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-9), (got, want)


def random_panel(seed=1, n=300):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame({c: 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))) for c in ("AA LN", "BB/C FP", "CC GA")}, index=pd.date_range(DAY, periods=n))
    wide.iloc[:40, 0] = np.nan
    wide.iloc[250:, 1] = np.nan
    wide.iloc[100:105, 2] = np.nan
    return wide


def as_spark(spark, wide):
    rows = [(d.date(), c, float(v)) for c in wide for d, v in wide[c].dropna().items()]
    return spark.createDataFrame(rows, "date date, ticker string, price double")


def test_equal_weight_fill(spark):
    p = long(spark, a=[1, 2, None, None], b=[1, 1.1, 1.21, 1.331])
    near(column(benchmarks.equal_weight_returns(p), "ret", "date"), [None, 0.55, 0.05, 0.05])
    near(column(benchmarks.equal_weight_returns(p, "none"), "ret", "date"), [None, 0.55, 0.1, 0.1])
    with pytest.raises(ValueError):
        benchmarks.equal_weight_returns(p, "other")


def test_index_passes_over_nulls(spark):
    r = spark.createDataFrame([(DAY, None), (DAY + timedelta(1), 0.1), (DAY + timedelta(2), None), (DAY + timedelta(3), 0.1)], "date date, ret double")
    near(column(benchmarks.index_of_returns(r), "price", "date"), [100, 110, None, 121])


def test_features_against_pandas(spark):
    wide = random_panel()
    got = features.add_features(as_spark(spark, wide)).orderBy("ticker", "date").toPandas()
    for ticker in wide:
        p = wide[ticker].dropna()
        mine = got[got["ticker"] == ticker]
        for n, name in ((1, "1d"), (20, "20d"), (252, "252d")):
            np.testing.assert_allclose(mine[f"{name}_log_ret"].astype(float), np.log(p).diff(n), rtol=1e-9, atol=1e-12)
            np.testing.assert_allclose(mine[f"{name}_arith_ret"].astype(float), p / p.shift(n) - 1, rtol=1e-9, atol=1e-12)
        for n, name in ((20, "20d"), (60, "60d"), (252, "252d")):
            np.testing.assert_allclose(mine[f"{name}_vol"].astype(float), np.log(p).diff().rolling(n).std() * np.sqrt(252), rtol=1e-8)


def test_features_share_one_exchange(spark):
    plan = features.add_features(as_spark(spark, random_panel()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_vol_begins_after_its_window(spark):
    vol = column(features.add_realized_vol(long(spark, a=range(1, 22)), ((20, "20d"),)), "20d_vol", "date")
    assert vol[:20] == [None] * 20 and vol[20] is not None


def test_zero_price_gives_null(spark):
    assert column(features.add_arith_returns(long(spark, a=[0, 1]), ((1, "1d"),)), "1d_arith_ret", "date") == [None, None]


def test_wide_to_long_and_back(spark):
    wide = spark.createDataFrame([(DAY, 1.0, None), (DAY + timedelta(1), float("nan"), 2.0)], "date date, `BT/A LN` double, `X.Y GA` double")
    made = panel.wide_to_long(wide)
    assert sorted(tuple(r) for r in made.collect()) == [(DAY, "BT/A LN", 1.0), (DAY + timedelta(1), "X.Y GA", 2.0)]
    assert panel.long_to_wide(made, "ticker", ["BT/A LN", "X.Y GA"]).count() == 2


def test_country_region(spark):
    got = {r["ticker"]: (r["exchange"], r["country"], r["region"]) for r in panel.add_country_region(long(spark, **{"BT/A LN": [1], "ALPHA GA": [1], "ONE": [1]})).collect()}
    assert got == {"BT/A LN": ("LN", "United Kingdom", "UK & Ireland"), "ALPHA GA": ("GA", None, None), "ONE": ("ONE", None, None)}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        half_even(F.lit(0.125)).alias("h"), clipped(F.lit(None).cast("double"), 0, 1).alias("c"), exchange_of(F.lit(" A  LN ")).alias("e"),
        sigmoid(F.lit(1e9), F.lit(0.0), F.lit(1.0)).alias("s"), severity(F.lit(0.0)).alias("v"), severity(F.lit(1e9)).alias("w"),
    ).first()
    assert row["h"] == 0.12 and row["c"] is None and row["e"] == "LN" and abs(row["s"] - 1) < 1e-12 and row["v"] == 0.5 and row["w"] == 1


@pytest.mark.parametrize("dof", [2.0, 3.0, 17.3, 38.0, 498.0, 3000.0])
def test_student_t_by_quadrature(spark, dof):
    angles = np.linspace(0, np.pi / 2, 2_000_001)
    density = np.cos(angles) ** (dof - 1)
    tail = np.r_[np.cumsum(((density[1:] + density[:-1]) / 2)[::-1])[::-1], 0]
    ts = [0.01, 0.7, 2.0, 4.5, 9.0]
    df = spark.createDataFrame([(t, dof) for t in ts], "t double, v double").select("t", student_t_two_sided(t_angle(F.col("t"), F.col("v")), F.col("v")).alias("p"))
    want = np.interp(np.arctan(np.array(ts) / np.sqrt(dof)), angles, tail) / tail[0]
    np.testing.assert_allclose(column(df, "p", "t"), want, atol=2e-7)


def test_student_t(spark):
    rows = spark.createDataFrame([(2.0, 2.0), (2.8453, 20.0), (2.7116, 38.0)], "t double, v double").select(student_t_two_sided(t_angle(F.col("t"), F.col("v")), F.col("v")).alias("p")).collect()
    np.testing.assert_allclose([r["p"] for r in rows], [0.18350342, 0.010001, 0.009999], atol=1e-6)


def test_risk_stats_against_pandas(spark):
    wide = pd.DataFrame({"SXXR": [100, 103, 99, 101, 104.0], "EW": [50, 51, 50.5, 52, 53.0]})
    stack = spark.createDataFrame([(DAY + timedelta(k), c, float(v)) for c in wide for k, v in enumerate(wide[c])], "date date, benchmark string, price double")
    r = wide.pct_change().dropna()
    cagr, vol = (1 + r.mean()) ** 252 - 1, r.std() * np.sqrt(252)
    for row in benchmarks.risk_stats(stack).collect():
        b = row["benchmark"]
        want = (cagr[b] * 100, vol[b] * 100, cagr[b] / vol[b], (wide[b] / wide[b].cummax() - 1).min() * 100)
        np.testing.assert_allclose([row[c] for c in ("cagr_pct", "vol_pct", "sharpe", "max_dd_pct")], np.round(want, 2), atol=0.011)


def test_coverage(spark):
    p = long(spark, a=[1, 2, 3], b=[None, 1, None])
    s = coverage.coverage_summary(p).first()
    assert (s["min_obs"], s["median_obs"], s["max_obs"], s["full_history"], s["n_tickers"]) == (1, 2, 3, 1, 2)
    assert coverage.nan_fraction(p).first()[0] == pytest.approx(1 / 3)
    assert column(coverage.alive_fraction(p), "fraction", "date") == [0.5, 1.0, 0.5]
    values = spark.createDataFrame([(x,) for x in (-5.0, -0.1, 0.0, 0.1, 5.0)], "x double")
    assert sum(r["n"] for r in coverage.histogram(values, "x").collect()) == 5


def test_cooldown(spark):
    c = spark.createDataFrame([("a", t) for t in (45, 10, 50, 30)], "ticker string, t int")
    assert column(detectors.cooled(c, 30), "t", "t") == [10, 45]


def cusum_by_definition(returns, window, threshold, cooldown, slack=0.5):
    """A detection is where some stretch of z that ends there and began after the last detection sums to more than the
    threshold beyond its slack, in either direction, once the cooldown is over."""
    blocks = np.lib.stride_tricks.sliding_window_view(returns, window)[: len(returns) - window]
    sd = blocks.std(axis=1, ddof=1)
    at = np.flatnonzero(sd >= 1e-12)
    z = (returns[window:][at] - blocks[at].mean(axis=1)) / sd[at]
    sums = np.cumsum(np.r_[[[0.0, 0.0]], np.c_[z - slack, -z - slack]], axis=0)
    found, begin = [], 0
    for k in range(1, len(sums)):
        stretch = sums[k] - sums[begin:k]
        if stretch.max() > threshold and (not found or at[k - 1] + window - found[-1] > cooldown):
            found.append(int(at[k - 1]) + window)
            begin = k
    return found


def test_detectors_against_loops(spark):
    rng = np.random.default_rng(3)
    series = {k: rng.normal(0, 1, 160) for k in "abc"}
    series["a"][80:] += 2
    series["b"][:70] = 0.0  # a window that doesn't vary
    r = returns_of(spark, **series)
    for got, want in (
        (detectors.detect_cusum(r, 30, 4.0, 15), {k: cusum_by_definition(v, 30, 4.0, 15) for k, v in series.items()}),
        (detectors.detect_jump(r, 30, 2.0, 15), None),
    ):
        found = {k: sorted(x["t"] for x in got.collect() if x["ticker"] == k) for k in series}
        if want:
            assert found == want
        for ts in found.values():
            assert all(b - a > 15 for a, b in zip(ts, ts[1:]))


def test_welch_detects_a_shift(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 120)
    x[60:] += 3
    found = column(detectors.detect_ttest(returns_of(spark, a=x), 30, 0.001, 20), "t", "t")
    assert found and 60 < found[0] <= 90
    flat = returns_of(spark, a=[0.0] * 10 + [1.0] * 10)
    p = {x["t"]: x["p"] for x in detectors.welch_stats(flat, 5).collect()}
    assert p[10] is None and p[15] == 0.0


def test_match_events(spark):
    days = ("2020-01-03", "2020-01-07", "2020-01-20")
    p = spark.createDataFrame([(date.fromisoformat(d), "a", 1.0) for d in days], "date date, ticker string, price double")
    e = spark.createDataFrame([(k, date.fromisoformat(d)) for k, d in enumerate(("2020-01-05", "2020-01-13", "2020-02-15"))], "event int, event_date date")
    assert sorted(column(events.match_events(p, e), "t", "t")) == [0, 1]


def evaluated(spark, found, cps):
    d = spark.createDataFrame([("a", "m", t) for t in found], "ticker string, method string, t int")
    c = spark.createDataFrame([("a", t) for t in cps], "ticker string, t int")
    s = spark.createDataFrame([("a", "m")], "ticker string, method string")
    return events.evaluate(d, c, s).first()


def test_evaluate(spark):
    e = evaluated(spark, [10, 30, 31, 90], [25, 28, 60])
    assert (e["n_det"], e["n_tp"], e["n_fp"], e["fpr"], e["delays"], e["mean_delay"]) == (4, 3, 1, 0.25, [5], 5.0) and e["recall"] == pytest.approx(1 / 3)
    for cps in ([5], []):
        e = evaluated(spark, [], cps)
        assert (e["fpr"], e["recall"], e["mean_delay"]) == (0, 0, None)
    e = evaluated(spark, [5], [])
    assert (e["fpr"], e["recall"]) == (1, 1)
    with_both = spark.createDataFrame([("a", "m", 0.0, 1.0, 2.0), ("b", "m", 1.0, 0.0, None)], "ticker string, method string, fpr double, recall double, mean_delay double")
    s = events.method_summary(with_both).first()
    assert (s["mean_fpr"], s["std_fpr"], s["mean_delay"]) == (0.5, 0.5, 2.0)


def test_gaussian_process():
    rng = np.random.default_rng(5)
    nu, gamma = gaussian.cpd_scores(np.zeros((1, 21)))
    assert (nu[0], gamma[0]) == (0.0, 0.5)
    assert np.isnan(gaussian.cpd_scores(np.full((1, 21), np.nan))[0][0])
    # by day 10 the mean moves
    broken = np.r_[rng.normal(0, 0.1, 10), rng.normal(3, 0.1, 11)]
    nu, gamma = gaussian.cpd_scores(np.stack([broken, rng.normal(size=21)]))
    assert nu[0] > 0.85 and abs(gamma[0] - 0.5) < 0.15 and (0 <= nu).all() and (nu <= 1).all()
    y = rng.normal(size=(3, 21))
    k = gaussian.matern32(21, np.ones(3), np.ones(3))
    v = k + (1 + 1e-6) * np.eye(21)
    want = [0.5 * a @ np.linalg.solve(b, a) + 0.5 * np.linalg.slogdet(b)[1] + 10.5 * np.log(2 * np.pi) for a, b in zip(y, v)]
    np.testing.assert_allclose(gaussian.nlml(k, y, np.ones(3)), want, rtol=1e-9)
    best, p = gaussian.fit_matern(y)
    assert (best <= np.array(want) + 1e-9).all()
    # a local optimum from the prescribed start: no small step in any parameter is better
    for k in range(3):
        for step in (-0.05, 0.05):
            moved = p * np.exp(step * (np.arange(3) == k))
            assert (gaussian.nlml(gaussian.matern32(21, *moved[:, :2].T), y, moved[:, 2]) >= best - 1e-4).all()
    cp, _ = gaussian.fit_changepoint(y, p)
    assert (cp <= best + 0.5).all()


def test_gaussian_process_fits_reach_the_grid():
    """The likelihood at the fit is as good as the best of a grid, and as at the prescribed starts, for both kernels."""
    rng = np.random.default_rng(15)
    n = 21
    trend = np.sin(np.arange(n) / 3)
    y = np.stack([rng.normal(size=n), trend + rng.normal(0, 0.2, n), np.r_[rng.normal(0, 0.2, 10), rng.normal(2, 0.2, 11)], np.r_[rng.normal(0, 0.1, 9), rng.normal(0, 2, 12)], np.cumsum(rng.normal(size=n))])
    y = (y - y.mean(1, keepdims=True)) / y.std(1, keepdims=True)
    base, p = gaussian.fit_matern(y)
    steps = np.exp(np.linspace(-4, 4, 17))
    sf, length, noise = (g.ravel() for g in np.meshgrid(steps, steps, steps, indexing="ij"))
    kernels = gaussian.matern32(n, sf, length)
    for window, value in zip(y, base):
        grid = gaussian.nlml(kernels, np.broadcast_to(window, (len(sf), n)), noise)
        assert value <= grid.min() + 1e-3
    cp, q = gaussian.fit_changepoint(y, p)
    for window, value, b in zip(y, cp, p):
        one = lambda centre, steep: {"sf1": np.full(len(centre), b[0]), "l1": np.full(len(centre), b[1]), "sf2": np.full(len(centre), b[0]), "l2": np.full(len(centre), b[1]), "c": centre, "s": steep}
        start = gaussian.nlml(gaussian.changepoint_kernel(n, one(np.array([(n - 1) / 2]), np.ones(1))), window[None], np.array([b[2]]))
        assert value <= start[0] + 1e-9
    nu, gamma = gaussian.cpd_scores(y)
    # planted breaks of the mean and of the variance
    assert nu[2] > 0.85 and abs(gamma[2] - 9.5 / 20) < 0.15 and nu[3] > 0.85 and abs(gamma[3] - 8.5 / 20) < 0.15


def test_rolled_scores(spark):
    rows = [("a", t, DAY + timedelta(t), None if t == 3 else v) for t, v in enumerate((0.2, 0.95, 0.91, 0.0, 0.5, 0.95, 0.1))] + [("b", 0, DAY, None)]
    got = {r["ticker"]: r for r in gaussian.rolled(spark.createDataFrame(rows, "ticker string, t int, last_date date, nu double"), top=3).collect()}
    a, b = got["a"], got["b"]
    assert (a["n_windows"], a["n_hot"], a["hot_dates"]) == (7, 3, [DAY + timedelta(t) for t in (1, 2, 5)]) and a["mean_nu"] == pytest.approx(3.61 / 6)
    assert [tuple(x) for x in a["highest"]] == [(0.95, DAY + timedelta(1)), (0.95, DAY + timedelta(5)), (0.91, DAY + timedelta(2))]
    assert (b["n_windows"], b["mean_nu"], b["n_hot"], b["highest"]) == (1, None, 0, [])


def test_gp_frames(spark):
    rng = np.random.default_rng(6)
    r = returns_of(spark, a=rng.normal(size=60))
    s = gaussian.gp_scores(r, 21, 10).orderBy("t").collect()
    assert [x["t"] for x in s] == [21, 31, 41, 51] and s[0]["last_date"] == DAY + timedelta(20)
    assert gaussian.detect_gp(r, 21, 0.85, 0.5, 20, 10).columns == ["ticker", "t"]
    w = gaussian.cpd_windows(r, 21, 20)
    assert gaussian.fits(w).count() == 2 and len(gaussian.fits(w, "changepoint").first()["parameters"]) == 7


def test_ewm_against_pandas(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=80)
    r = returns_of(spark, a=x)
    got = column(momentum.ewm_vol(r, 10), "vol", "t")
    np.testing.assert_allclose(np.array(got[1:], float), pd.Series(x).ewm(span=10).std()[1:], rtol=1e-9)
    assert got[0] is None


def test_ewm_of_long_histories_and_nulls(spark):
    """Against the sums of the definition: weights of all rows count, nulls age them and give what went before."""
    rng = np.random.default_rng(8)
    x = [None if k in (0, 7, 8, 300) else float(v) for k, v in enumerate(rng.normal(5, 1, 2000))]
    rows = scan.ewm(returns_of(spark, a=x).select("ticker", "t", "r", F.lit("kept").alias("own")), {"m": scan.Moment("r", "mean", 0.95), "s": scan.Moment("r", "sd", 0.95)}).orderBy("t").collect()
    assert {r["own"] for r in rows} == {"kept"} and rows[0]["m"] is None and rows[1]["s"] is None
    for t in (1, 2, 9, 300, 1999):
        known = [(0.95 ** (t - k), v) for k, v in enumerate(x[: t + 1]) if v is not None]
        w, w2 = sum(a for a, _ in known), sum(a * a for a, _ in known)
        mean = sum(a * v for a, v in known) / w
        assert rows[t]["m"] == pytest.approx(mean, rel=1e-9)
        if len(known) > 1:
            var = sum(a * (v - mean) ** 2 for a, v in known) / w * w * w / (w * w - w2)
            assert rows[t]["s"] == pytest.approx(var**0.5, rel=1e-9)


def test_momentum_against_pandas(spark):
    wide = random_panel(8, 400)
    p = as_spark(spark, wide)
    signals = momentum.macd(p).orderBy("ticker", "t").toPandas()
    position = momentum.macd_position(momentum.macd(p)).orderBy("ticker", "t").toPandas()
    normed = momentum.normalised_returns(p).orderBy("ticker", "t").toPandas()
    for ticker in wide:
        x = wide[ticker].dropna().reset_index(drop=True)
        mine, responses = signals[signals["ticker"] == ticker], []
        for a, b in momentum.MACD_PAIRS:
            q = (x.ewm(alpha=1 / a).mean() - x.ewm(alpha=1 / b).mean()) / x.rolling(63).std()
            y = q / q.rolling(252).std()
            np.testing.assert_allclose(mine[f"macd_{a}_{b}"].astype(float), y, rtol=1e-6, atol=1e-9)
            responses.append(y * np.exp(-y * y / 4) / 0.89)
        np.testing.assert_allclose(position[position["ticker"] == ticker]["position"].astype(float), sum(responses) / 3, rtol=1e-6, atol=1e-9)
        vol = x.pct_change().ewm(span=60).std()
        for k in momentum.NORM_HORIZONS:
            np.testing.assert_allclose(normed[normed["ticker"] == ticker][f"norm_{k}"].astype(float), (x / x.shift(k) - 1) / vol / np.sqrt(k), rtol=1e-8)
    for weight, values in ((0.0, {-1.0, 0.0, 1.0}), (0.5, {-1.0, -0.5, 0.0, 0.5, 1.0}), (1.0, {-1.0, 0.0, 1.0})):
        assert set(column(momentum.tsmom_position(p, weight).where("position is not null"), "position", "t")) <= values
    m = momentum.portfolio_metrics(detectors.simple_returns(p)).collect()
    assert len(m) == 3 and all(-1 <= x["max_drawdown"] <= 0 and 0 <= x["hit_ratio"] <= 1 for x in m)
    r = detectors.simple_returns(p)
    x = np.concatenate([wide[c].dropna().pct_change().dropna() for c in wide])
    loss = momentum.sharpe_loss(momentum.long_only(p), r).first()[0]
    assert loss == pytest.approx(-np.sqrt(252) * x.mean() / x.std(), rel=0.05)
    scaled = column(momentum.vol_scaled(r).where("ticker = 'CC GA'"), "scaled", "t")
    daily = wide["CC GA"].dropna().pct_change().dropna()
    np.testing.assert_allclose(np.array(scaled[2:], float), (daily * 0.15 / (daily.ewm(span=60).std().shift(1) * np.sqrt(252)))[2:], rtol=1e-8)


def test_backtest(spark):
    r = detectors.simple_returns(as_spark(spark, random_panel(9)))
    f = backtest.folds(spark, 2020, 2020, 2021, 1)
    f = f.withColumn("test_start", F.to_date(F.lit("2020-06-01")))
    out = backtest.expanding_window_backtest(r, lambda train: lambda test: test["r"] * 0 + len(train), f).toPandas()
    assert (pd.to_datetime(out["date"]) >= "2020-06-01").all() and out["position"].gt(0).all()


def test_sources(spark, tmp_path):
    (tmp_path / "prices_2020.csv").write_text("Date,AA LN,BT/A LN\n2020-01-01,1,\n2020-01-02,2,3\n")
    (tmp_path / "prices_2021.csv").write_text("Date,CC FP\n2021-01-01,5\n")
    made = prices.read_yearly(spark, [str(tmp_path / f"prices_{y}.csv") for y in (2021, 2020)])
    assert made.count() == 4
    (tmp_path / "u.csv").write_text("Date,AA LN,BT/A LN")
    assert column(prices.read_universe(spark, str(tmp_path / "u.csv")), "ticker", "ticker") == ["AA LN", "BT/A LN"]
    (tmp_path / "u.json").write_text('{"2020": ["AA LN"], "2021": ["CC FP", "AA LN"]}')
    years = prices.read_universe_by_year(spark, str(tmp_path / "u.json"))
    assert years.count() == 3 and panel.in_universe(made, years).count() == 3
    for name in ("out.csv", "out.parquet"):
        prices.write_table(made, str(tmp_path / name))
        assert prices.read_processed(spark, str(tmp_path / name), ("date", "ticker", "price")).exceptAll(made.select("date", "ticker", "price")).count() == 0
    prices.write_table(made, str(tmp_path / "y"), by_year=True)
    (tmp_path / "b.csv").write_text("Date,price\n2020-01-01,7\n")
    assert prices.read_benchmark(spark, str(tmp_path / "b.csv")).first()["price"] == 7.0


def test_workbook_loader(spark, monkeypatch):
    """A workbook's two sheets, as pandas would read them."""
    days = pd.to_datetime(["2020-01-01", "2020-01-02", "2020-01-03"])
    sheets = {"price": pd.DataFrame({"Ticker": days, "AA LN": [1.0, 2.0, np.nan], "BB FP": [4.0, 5.0, 6.0]}), "benchmark": pd.DataFrame({"Date": days, "price": [7.0, 8.0, 9.0], "note": "x"})}
    monkeypatch.setattr(pd, "read_excel", lambda path, sheet_name: sheets[sheet_name].copy())
    wide, long, both = prices.load_market(spark, "book.xlsx")
    assert wide.columns == ["date", "AA LN", "BB FP"] and wide.count() == 3
    assert sorted((r["ticker"], r["price"], r["region"]) for r in long.collect()) == [("AA LN", 1.0, "UK & Ireland"), ("AA LN", 2.0, "UK & Ireland"), ("BB FP", 4.0, "Western Europe"), ("BB FP", 5.0, "Western Europe"), ("BB FP", 6.0, "Western Europe")]
    near([r["price"] for r in both.orderBy("benchmark", "date").collect()], [100, 162.5, 162.5 * 1.1, 7, 8, 9])


def test_finalize_and_rebase(spark):
    p = long(spark, a=[2, 4], b=[None, 5])
    assert panel.finalize(p.withColumn("extra", F.lit(1))).columns == ["date", "ticker", "price"]
    near(column(benchmarks.rebased_first_valid(p), "level", "ticker", "date"), [100, 200, 100])
    assert panel.normalised(p.withColumn("price", F.lit(float("nan")))).count() == 0


def test_generated_code_of_the_comparison_is_short_enough_to_be_compiled(spark):
    """The JVM compiles no method of over 8000 bytes, and such a one takes several times as long."""
    panel = spark.createDataFrame([("A", "2020-01-01", 1.0)], "ticker string, date string, price double").withColumn("date", F.col("date").cast("date"))
    listed = spark.createDataFrame([("e", "2020-01-01")], "event string, event_date string").withColumn("event_date", F.col("event_date").cast("date"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = comparison.compared(panel, listed)._jdf.queryExecution().debug().codegenToSeq()
        assert max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
