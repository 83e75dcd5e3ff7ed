"""Changepoint detectors on simple returns: z-score jumps, Welch's t-test and a two-sided CUSUM.

A detector gives rows (ticker, t), t being the position of the return, 0 for the second price. What
depends on the last detection is a fold over a ticker's candidates in order, inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import ratio_return, student_t_two_sided, t_angle, t_bounds, welch
from panelscope.operators import rolling

TINY = 1e-12


def _by_t() -> Window:
    return Window.partitionBy("ticker").orderBy("t")


def simple_returns(panel: DataFrame) -> DataFrame:
    """(ticker, t, date, r) without each ticker's first row."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = ratio_return(F.col("price"), F.lag("price").over(w))
    return panel.select("ticker", (F.row_number().over(w) - 2).alias("t"), "date", r.alias("r")).where("t >= 0")


def zscores(returns: DataFrame, window: int) -> DataFrame:
    """returns with mu, sigma and z against the `window` returns before; z is null where they don't vary."""
    known = rolling.with_moments(rolling.with_running(returns, "r", "ticker", "t"), {"_w": (window, 1)}, "ticker", "t").where(F.col("t") >= window)
    known = known.select(*returns.columns, F.col("_w_mean").alias("mu"), F.sqrt("_w_var").alias("sigma"))
    return known.withColumn("z", z_of("mu", "sigma"))


def z_of(mu: str, sigma: str) -> Column:
    return F.when(F.col(sigma) >= TINY, (F.col("r") - F.col(mu)) / F.col(sigma))


def told(rows: DataFrame, condition: Column, *columns: str) -> DataFrame:
    """(ticker, <columns>) of the rows with that condition, as a generator gives them: a filter would be put beneath the
    moments, and work them out anew for every mention of one in the condition."""
    return rows.select("ticker", F.explode(F.when(condition, F.array(F.struct(*columns)))).alias("told")).select("ticker", *[f"told.{c}" for c in columns])


def cooled_of(ts: Column, cooldown: int) -> Column:
    """Of positions in order those that are more than `cooldown` after the last one kept."""

    def step(kept: Column, t: Column) -> Column:
        far = (F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) > cooldown)
        return F.when(far, F.concat(kept, F.array(t))).otherwise(kept)

    return F.aggregate(ts, F.array().cast("array<int>"), step)


def cooled(candidates: DataFrame, cooldown: int) -> DataFrame:
    """Keeps a candidate if it is more than `cooldown` after the last one kept."""
    in_order = candidates.groupBy("ticker").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return in_order.select("ticker", F.explode(cooled_of(F.col("ts"), cooldown)).alias("t"))


def jump_candidates(returns: DataFrame, window: int = 60, threshold: float = 3.0) -> DataFrame:
    return told(zscores(returns, window), F.abs("z") > threshold, "t")


def detect_jump(returns: DataFrame, window: int = 60, threshold: float = 3.0, cooldown: int = 20) -> DataFrame:
    return cooled(jump_candidates(returns, window, threshold), cooldown)


def _tested(returns: DataFrame, window: int) -> DataFrame:
    known = rolling.with_moments(rolling.with_running(returns, "r", "ticker", "t"), {"far": (2 * window, window + 1), "near": (window, 1)}, "ticker", "t")
    return with_test(known.where(F.col("t") >= 2 * window), window)


def welch_stats(returns: DataFrame, window: int = 30, more: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, t, t_stat, dof, p) for the `window` returns before t and the `window` before those, and `more` columns of
    returns. Twins that don't vary have p 0 if their means differ, and null if not."""
    return _tested(returns, window).select("ticker", "t", "t_stat", "dof", p_of_twins().alias("p"), *more)


def with_test(known: DataFrame, window: int) -> DataFrame:
    """known (with the moments of both windows, far and near) with t_stat, dof and angle."""
    t_stat, dof = welch(F.col("far_mean"), F.col("far_var"), F.col("near_mean"), F.col("near_var"), window)
    return known.withColumns({"t_stat": t_stat, "dof": dof}).withColumn("angle", t_angle(F.col("t_stat"), F.col("dof")))


def flat_twins() -> Column:
    return (F.col("far_var") == 0) & (F.col("near_var") == 0)


def p_of_twins() -> Column:
    return F.when(flat_twins(), F.when(F.col("far_mean") != F.col("near_mean"), 0.0)).otherwise(student_t_two_sided(F.col("angle"), F.col("dof")))


def significant(window: int, alpha: float) -> Column:
    """p < alpha. There are window - 1 to twice as many degrees of freedom, and p itself is only worked out where they matter."""
    low, high = t_bounds(alpha, window - 1, 2 * (window - 1))
    return F.when(F.abs("t_stat") >= high, True).when(F.abs("t_stat") < low, False).otherwise(p_of_twins() < alpha)


def detect_ttest(returns: DataFrame, window: int = 30, alpha: float = 0.001, cooldown: int = 20) -> DataFrame:
    return cooled(told(_tested(returns, window), significant(window, alpha), "t"), cooldown)


def cusum_of(zs: Column, threshold: float, cooldown: int, slack: float = 0.5) -> Column:
    """Positions of the detections, from (t, z) in order."""

    def step(s: Column, x: Column) -> Column:
        up = F.greatest(F.lit(0.0), s["up"] + x["z"] - slack)
        down = F.greatest(F.lit(0.0), s["down"] - x["z"] - slack)
        hit = (F.greatest(up, down) > threshold) & (x["t"] - s["last"] > cooldown)
        return F.struct(
            F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"),
            F.when(hit, x["t"]).otherwise(s["last"]).alias("last"), F.when(hit, F.concat(s["found"], F.array(x["t"]))).otherwise(s["found"]).alias("found"),
        )

    none = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(-cooldown - 1).alias("last"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(zs, none, step, lambda s: s["found"])


def detect_cusum(returns: DataFrame, ref_window: int = 60, threshold: float = 4.0, cooldown: int = 20, slack: float = 0.5) -> DataFrame:
    """Page's sums of z above slack, both ways. Rows whose window doesn't vary are passed over; sums go on during the
    cooldown, and both start anew at a detection."""
    known = F.when(F.col("z").isNotNull(), F.struct("t", "z"))
    in_order = zscores(returns, ref_window).groupBy("ticker").agg(F.array_sort(F.collect_list(known)).alias("zs"))
    return in_order.select("ticker", F.explode(cusum_of(F.col("zs"), threshold, cooldown, slack)).alias("t"))


def labelled(**found: DataFrame) -> DataFrame:
    """(ticker, method, t) of several detectors."""
    parts = [df.select("ticker", F.lit(name).alias("method"), "t") for name, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
