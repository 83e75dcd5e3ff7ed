"""Expanding-window backtests: a model is trained on all years before a fold's test years."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folds(spark: SparkSession, start: int, first_test: int, end: int, years: int = 5) -> DataFrame:
    """(fold, train_start, test_start, test_end): tests of `years` years from first_test up to end."""
    rows = [(k, f"{start}-01-01", f"{y}-01-01", f"{min(y + years, end)}-01-01") for k, y in enumerate(range(first_test, end, years))]
    made = spark.createDataFrame(rows, "fold int, train_start string, test_start string, test_end string")
    return made.select("fold", *[F.col(c).cast("date").alias(c) for c in ("train_start", "test_start", "test_end")])


def fold_rows(data: DataFrame, fold_table: DataFrame) -> DataFrame:
    """data with fold and part (train or test): a range join with a handful of folds."""
    inside = (data["date"] >= fold_table["train_start"]) & (data["date"] < fold_table["test_end"])
    part = F.when(F.col("date") < F.col("test_start"), "train").otherwise("test")
    return data.join(F.broadcast(fold_table), inside).withColumn("part", part).select("fold", "part", *data.columns)


@dataclass(frozen=True)
class Model:
    """A model whose training is a state of sums. state: for each sum what a row adds, null for nothing. position: what it
    holds on a row, of the row's columns and of the state's."""

    state: dict[str, Column]
    position: Column

    def __post_init__(self) -> None:
        if not self.state:
            raise ValueError("a model needs a state, if only a count of its rows")


def mean_sign() -> Model:
    """Long if the mean training return isn't negative, else short; short as well if no training return is known."""
    known = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    return Model({"_sum": F.col("r"), "_n": F.col("r").isNotNull().cast("int")}, F.when(known >= 0, 1.0).otherwise(-1.0))


def regression(feature: str, target: str = "r") -> Model:
    """The sign of the return that a least-squares line on one feature expects: 0 where the feature is null or its training
    values don't vary."""
    x, y = F.col(feature), F.col(target)
    both = lambda c: F.when(x.isNotNull() & y.isNotNull(), c)
    state = {"_n": both(F.lit(1.0)), "_x": both(x), "_y": both(y), "_xx": both(x * x), "_xy": both(x * y)}
    n, sx, sy, sxx, sxy = (F.col(c) for c in state)
    slope = F.try_divide(n * sxy - sx * sy, F.when(n * sxx - sx * sx > 1e-12 * n * sxx, n * sxx - sx * sx))
    expected = slope * x + (sy - slope * sx) / n
    return Model(state, F.coalesce(F.signum(expected), F.lit(0.0)))


def fold_states(data: DataFrame, model: Model, fold_table: DataFrame, by: list[str]) -> DataFrame:
    """(<by>, fold, <state>): each group's training state for each fold, where it has training rows.

    The folds' first test days cut the time before them into slices. A slice is summed once, next to the rows; a fold's
    state is the sum of all slices up to it, over a handful of rows a group. All folds begin at one day; the list of folds
    is short.
    """
    known = sorted(fold_table.collect(), key=lambda r: (r["test_start"], r["fold"]))
    if len({r["train_start"] for r in known}) > 1:
        raise ValueError("the folds' training must begin on the same day")
    if not known:
        return data.select(*by, F.lit(0).alias("fold"), *[F.lit(0.0).alias(c) for c in model.state]).limit(0)
    ends = F.lit([r["test_start"] for r in known])
    placed = data.where((F.col("date") >= F.lit(known[0]["train_start"])) & (F.col("date") < F.lit(known[-1]["test_start"])))
    placed = placed.withColumn("_slice", F.size(F.filter(ends, lambda e: e <= F.col("date"))))
    sums = placed.groupBy(*by, "_slice").agg(*[F.sum(c).alias(name) for name, c in model.state.items()])
    w = Window.partitionBy(*by).orderBy("_slice") if by else Window.partitionBy(F.lit(0)).orderBy("_slice")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    total = sums.withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in model.state} | {"_next": F.lead("_slice").over(w)})
    # a slice without rows adds nothing, so its fold has the state of the one before
    each = total.withColumn("_at", F.explode(F.sequence("_slice", F.coalesce(F.col("_next"), F.lit(len(known))) - 1)))
    return each.select(*by, F.lit([r["fold"] for r in known])[F.col("_at")].alias("fold"), *model.state)


def expanding_positions(data: DataFrame, model: Model, fold_table: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(fold, <columns of data>, position) for the test rows of each fold, of a model trained on all rows of its group before the
    fold; by=() trains one for all rows. Groups without training rows have no test rows. Training rows are summed
    where they lie and go nowhere; only test rows meet the states."""
    keys = list(by)
    states = fold_states(data, model, fold_table, keys)
    tests = fold_table.select("fold", F.explode(F.expr("sequence(test_start, date_sub(test_end, 1))")).alias("date"))
    rows = data.join(F.broadcast(tests), "date").join(states, ["fold", *keys])
    return rows.select("fold", *data.columns, model.position.alias("position"))


def expanding_window_backtest(data: DataFrame, model: Callable[[pd.DataFrame], Callable[[pd.DataFrame], pd.Series]], fold_table: DataFrame, by: str = "ticker") -> DataFrame:
    """(fold, <by>, date, position, r): model(train) gives a function of test; one model for each fold and group, whose
    rows are those of one ticker, so a task holds one ticker's history. For models that expanding_positions() can't express."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        train, test = group[group["part"] == "train"], group[group["part"] == "test"]
        if not len(train) or not len(test):
            return group[:0].assign(position=0.0)[["fold", by, "date", "position", "r"]]
        return test.assign(position=model(train)(test))[["fold", by, "date", "position", "r"]]

    rows = fold_rows(data.select(by, "date", "r"), fold_table)
    return rows.groupBy("fold", by).applyInPandas(run, f"fold int, {by} string, date date, position double, r double")
