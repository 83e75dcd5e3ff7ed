"""Gaussian-process changepoint scores: severity nu and location gamma of a window of returns.

A Matern 3/2 kernel is fitted to a window, then one that blends two of them by a sigmoid; nu compares
their likelihoods. Spark makes the windows and deals them out; an Arrow batch of windows is fitted at
once, by a bounded quasi-Newton method over all of them in step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.operators.detectors import cooled

#: Jitter of the covariance, value of a failed likelihood, bound of log parameters, and what stands for infinite
#: covariances of either sign (fixed values).
JITTER, FAILED, LOG_BOUND, INFINITE = 1e-6, 1e10, 10.0, (1e10, 0.0)


def matern32(n: int, scale: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(windows, n, n) covariances of positions 0..n-1."""
    gap = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    r = np.sqrt(3.0) * gap / np.maximum(length, 1e-10)[:, None, None]
    return np.nan_to_num(scale[:, None, None] ** 2 * (1 + r) * np.exp(-r), nan=0.0, posinf=INFINITE[0], neginf=INFINITE[1])


def blend(n: int, centre: np.ndarray, steepness: np.ndarray) -> np.ndarray:
    z = np.clip(steepness[:, None] * (np.arange(n) - centre[:, None]), -500, 500)
    return 1 / (1 + np.exp(-z))


def changepoint_kernel(n: int, p: dict[str, np.ndarray]) -> np.ndarray:
    after = blend(n, p["c"], p["s"])
    before = 1 - after
    return matern32(n, p["sf1"], p["l1"]) * after[:, :, None] * after[:, None, :] + matern32(n, p["sf2"], p["l2"]) * before[:, :, None] * before[:, None, :]


def nlml(k: np.ndarray, y: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Negative log marginal likelihood of each window; FAILED where the covariance has no Cholesky factor."""
    n = y.shape[1]
    v = k + (noise**2 + JITTER)[:, None, None] * np.eye(n)
    try:
        factor = np.linalg.cholesky(v)
        bad = np.zeros(len(v), bool)
    except np.linalg.LinAlgError:
        factor, bad = np.broadcast_to(np.eye(n), v.shape).copy(), np.ones(len(v), bool)
        for i, one in enumerate(v):
            try:
                factor[i], bad[i] = np.linalg.cholesky(one), False
            except np.linalg.LinAlgError:
                pass
    white = np.linalg.solve(factor, y[:, :, None])[:, :, 0]
    out = 0.5 * (white**2).sum(1) + np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1) + 0.5 * n * np.log(2 * np.pi)
    return np.where(bad | ~np.isfinite(out), FAILED, out)


def minimised(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int, ftol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Least values and points of f(which, x) for each row of start within bounds: BFGS with projected steps."""
    x = np.clip(start, low, high)
    m, p = x.shape
    everyone = np.arange(m)
    value = f(everyone, x)
    step = 1e-6

    def gradient(which: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for k in range(p):
            h = np.where(x[:, k] + step > high[k], -step, step)
            moved = x.copy()
            moved[:, k] += h
            out[:, k] = (f(which, moved) - value) / h
        return out

    grad = gradient(everyone, x, value)
    inverse = np.broadcast_to(np.eye(p), (m, p, p)).copy()
    active = everyone
    for _ in range(rounds):
        if not len(active):
            break
        g, xa = grad[active], x[active]
        held = ((xa <= low) & (g > 0)) | ((xa >= high) & (g < 0))
        g = np.where(held, 0, g)
        d = -np.einsum("mij,mj->mi", inverse[active], g)
        d = np.where(held, 0, d)
        uphill = (d * g).sum(1) >= 0
        inverse[active[uphill]] = np.eye(p)
        d[uphill] = -g[uphill]
        d /= np.maximum(1, np.abs(d).max(1, keepdims=True) / 2)
        best, best_value = xa.copy(), value[active].copy()
        open_ = np.ones(len(active), bool)
        for t in 0.5 ** np.arange(14):
            which = np.flatnonzero(open_)
            if not len(which):
                break
            trial = np.clip(xa[which] + t * d[which], low, high)
            tried = f(active[which], trial)
            good = tried <= value[active[which]] + 1e-4 * ((trial - xa[which]) * g[which]).sum(1)
            good &= tried < value[active[which]]
            best[which[good]], best_value[which[good]] = trial[good], tried[good]
            open_[which[good]] = False
        moved = ~open_
        gained = value[active] - best_value
        done = ~moved | (gained <= ftol * np.maximum(np.maximum(np.abs(value[active]), np.abs(best_value)), 1))
        new_grad = grad[active].copy()
        new_grad[moved] = gradient(active[moved], best[moved], best_value[moved])
        s, y = best - xa, new_grad - grad[active]
        sy = (s * y).sum(1)
        use = sy > 1e-10
        if use.any():
            rho, su, yu, h = 1 / sy[use], s[use], y[use], inverse[active[use]]
            left = np.eye(p) - rho[:, None, None] * su[:, :, None] * yu[:, None, :]
            inverse[active[use]] = left @ h @ left.transpose(0, 2, 1) + rho[:, None, None] * su[:, :, None] * su[:, None, :]
        x[active], value[active], grad[active] = best, best_value, new_grad
        active = active[~done]
    return value, x


def fit_matern(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nlml, parameters sf, l, noise) of each standardised window, from all ones."""
    m, n = y.shape
    bound = np.full(3, LOG_BOUND)
    f = lambda which, t: nlml(matern32(n, *np.exp(t[:, :2]).T), y[which], np.exp(t[:, 2]))
    value, t = minimised(f, np.zeros((m, 3)), -bound, bound, 200)
    return value, np.exp(t)


def fit_changepoint(y: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nlml, parameters sf1, l1, sf2, l2, c, s, noise), both kernels starting from base and c in the middle; where
    both come out alike, a second fit from all ones takes the place of the first."""
    n = y.shape[1]

    def fit(y: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.log(base)
        start = np.c_[b[:, 0], b[:, 1], b[:, 0], b[:, 1], np.full(len(y), (n - 1) / 2), np.zeros(len(y)), b[:, 2]]
        low, high = np.full(7, -LOG_BOUND), np.full(7, LOG_BOUND)
        low[4], high[4] = 0.5, n - 1.5

        def f(which: np.ndarray, t: np.ndarray) -> np.ndarray:
            e = np.exp(t)
            p = {"sf1": e[:, 0], "l1": e[:, 1], "sf2": e[:, 2], "l2": e[:, 3], "c": t[:, 4], "s": e[:, 5]}
            return nlml(changepoint_kernel(n, p), y[which], e[:, 6])

        value, t = minimised(f, start, low, high, 300)
        out = np.exp(t)
        out[:, 4] = t[:, 4]
        return value, out

    value, p = fit(y, base)
    alike = np.isclose(p[:, 0], p[:, 2], rtol=1e-3) & np.isclose(p[:, 1], p[:, 3], rtol=1e-3)
    if alike.any():
        value[alike], p[alike] = fit(y[alike], np.ones((int(alike.sum()), 3)))
    return value, p


def cpd_scores(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nu, gamma) of each window, standardised by its population deviation; (0, 0.5) where it doesn't vary, NaN
    where it has a NaN."""
    m, n = windows.shape
    nu, gamma = np.zeros(m), np.full(m, 0.5)
    missing = ~np.isfinite(windows).all(1)
    nu[missing] = gamma[missing] = np.nan
    sd = windows.std(1)
    use = ~missing & (sd >= 1e-12)
    if use.any():
        y = (windows[use] - windows[use].mean(1, keepdims=True)) / sd[use, None]
        base, parameters = fit_matern(y)
        value, p = fit_changepoint(y, parameters)
        nu[use] = 1 - 1 / (1 + np.exp(np.clip(base - value, -700, 700)))
        gamma[use] = p[:, 4] / (n - 1)
    return np.clip(nu, 0, 1), np.clip(gamma, 0, 1)


def cpd_windows(returns: DataFrame, lookback: int = 21, stride: int = 1, value: str = "r") -> DataFrame:
    """(ticker, t, last_date, window): the `lookback` returns before t, from t = lookback on by stride. last_date is the
    last date inside the window."""
    w = Window.partitionBy("ticker").orderBy("t").rowsBetween(-lookback, -1)
    x = F.coalesce(F.col(value), F.lit(float("nan")))
    made = returns.select("ticker", "t", F.max("date").over(w).alias("last_date"), F.collect_list(x).over(w).alias("window"))
    return made.where((F.col("t") >= lookback) & ((F.col("t") - lookback) % stride == 0))


def gp_scores(returns: DataFrame, lookback: int = 21, stride: int = 1, value: str = "r") -> DataFrame:
    """(ticker, t, last_date, nu, gamma). Windows are dealt out one by one, as each costs milliseconds; null for
    windows with a null."""

    @F.pandas_udf("nu double, gamma double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nu, gamma = cpd_scores(np.stack(batch.to_list())) if len(batch) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"nu": nu, "gamma": gamma})

    # a number of partitions that is asked for isn't reduced because the windows are few bytes
    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cpd_windows(returns, lookback, stride, value).repartition(parts, "ticker", "t")
    scored = spread.select("ticker", "t", "last_date", score("window").alias("s"))
    return scored.select("ticker", "t", "last_date", F.when(~F.isnan("s.nu"), F.col("s.nu")).alias("nu"), F.when(~F.isnan("s.gamma"), F.col("s.gamma")).alias("gamma"))


def placed(daily: DataFrame) -> DataFrame:
    """(ticker, t, date, r) of a column r that is null on each ticker's first date, t counting from the second."""
    w = Window.partitionBy("ticker").orderBy("date")
    return daily.select("ticker", (F.row_number().over(w) - 2).alias("t"), "date", "r").where("t >= 0")


def rolled(scores: DataFrame, hot: float = 0.9, top: int = 5) -> DataFrame:
    """Per ticker: n_windows, mean_nu over those that have a score, n_hot of nu over `hot`, the hot_dates in order, and the
    `top` highest as (nu, last_date), the earlier first on ties."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc_nulls_last("nu"), "last_date"))
    is_hot = F.coalesce(F.col("nu") > hot, F.lit(False))
    high = F.when((F.col("rank") <= top) & F.col("nu").isNotNull(), F.struct("rank", "nu", "last_date"))
    made = scores.withColumn("rank", rank).groupBy("ticker").agg(
        F.count("*").alias("n_windows"), F.avg("nu").alias("mean_nu"), F.count_if(is_hot).alias("n_hot"),
        F.array_sort(F.collect_list(F.when(is_hot, F.col("last_date")))).alias("hot_dates"), F.array_sort(F.collect_list(high)).alias("high"),
    )
    return made.withColumn("highest", F.transform("high", lambda x: F.struct(x["nu"].alias("nu"), x["last_date"].alias("last_date")))).drop("high")


def fits(windows: DataFrame, model: str = "matern") -> DataFrame:
    """windows with nlml and parameters of the matern or changepoint fit of column `window`, taken as standardised."""

    @F.pandas_udf("nlml double, parameters array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = np.stack(batch.to_list())
            value, p = fit_matern(y)
            if model == "changepoint":
                value, p = fit_changepoint(y, p)
            yield pd.DataFrame({"nlml": value, "parameters": list(p)})

    return windows.withColumn("fit", run("window")).select(*windows.columns, "fit.*")


def detect_gp(returns: DataFrame, lookback: int = 21, nu_threshold: float = 0.85, gamma_min: float = 0.5, cooldown: int = 20, stride: int = 1) -> DataFrame:
    """Windows with nu over its threshold and the change in their later part."""
    return cooled(gp_scores(returns, lookback, stride).where((F.col("nu") > nu_threshold) & (F.col("gamma") > gamma_min)), cooldown)
