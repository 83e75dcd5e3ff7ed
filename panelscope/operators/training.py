"""Positions trained on the Sharpe ratio: a full-batch gradient out of one aggregate.

A row holds the position p = tanh(bias + weights . features) and gains z = p * r. The loss is minus the yearly ratio of
the mean of z to its deviation, both over all rows, so that it isn't a sum over rows; yet it and its gradient are functions
of the sums of z, z * z, z' and z * z', z' being the derivatives of z. An aggregate brings these few sums to the driver,
and no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.schema import TRADING_DAYS


@dataclass(frozen=True)
class Trained:
    """weights: the bias, and one for each feature once it is less its mean and by its deviation. losses: before the first
    step, and after each."""

    features: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    losses: tuple[float, ...]

    def position(self) -> Column:
        return position_of(self.features, self.centre, self.scale, self.weights)


def inputs(features: tuple[str, ...], centre: tuple[float, ...], scale: tuple[float, ...]) -> list[Column]:
    """1 for the bias, and the features in their scale; null counts as the mean."""
    return [F.lit(1.0)] + [F.coalesce((F.col(c) - m) / s, F.lit(0.0)) for c, m, s in zip(features, centre, scale)]


def position_of(features: tuple[str, ...], centre: tuple[float, ...], scale: tuple[float, ...], weights: tuple[float, ...]) -> Column:
    total = F.lit(0.0)
    for w, x in zip(weights, inputs(features, centre, scale)):
        total = total + w * x
    return F.tanh(total)


def scales(data: DataFrame, features: tuple[str, ...]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Means and deviations; 0 and 1 for a feature without values, 1 for one that doesn't vary."""
    if not features:
        return (), ()
    row = data.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return tuple(row[f"m{i}"] or 0.0 for i in range(len(features))), tuple(row[f"s{i}"] or 1.0 for i in range(len(features)))


def gradient_sums(data: DataFrame, features: tuple[str, ...], centre: tuple[float, ...], scale: tuple[float, ...], weights: tuple[float, ...], target: str = "r") -> DataFrame:
    """(n, z, zz, d<k>, zd<k>): one row of sums over the rows with a known return."""
    x = inputs(features, centre, scale)
    p = position_of(features, centre, scale, weights)
    rows = data.where(F.col(target).isNotNull()).select(p.alias("_p"), F.col(target).alias("_r"), *[c.alias(f"_x{k}") for k, c in enumerate(x)])
    rows = rows.withColumn("_z", F.col("_p") * F.col("_r")).withColumns({f"_d{k}": F.col("_r") * (1 - F.col("_p") * F.col("_p")) * F.col(f"_x{k}") for k in range(len(x))})
    sums = [F.sum(f"_d{k}").alias(f"d{k}") for k in range(len(x))] + [F.sum(F.col("_z") * F.col(f"_d{k}")).alias(f"zd{k}") for k in range(len(x))]
    return rows.agg(F.count("*").alias("n"), F.sum("_z").alias("z"), F.sum(F.col("_z") * F.col("_z")).alias("zz"), *sums)


def loss_and_gradient(sums: DataFrame, size: int) -> DataFrame:
    """(loss, g<k>) of gradient_sums(); null where the gains don't vary."""
    mean, root = F.col("z") / F.col("n"), math.sqrt(TRADING_DAYS)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("zz") / F.col("n") - mean * mean))
    made = sums.where("n > 0").withColumns({"_m": mean, "_s": F.when(sd > 0, sd)})
    slope = lambda k: F.col(f"d{k}") / F.col("n") / F.col("_s") - F.col("_m") * (F.col(f"zd{k}") - F.col("_m") * F.col(f"d{k}")) / F.col("n") / F.pow("_s", F.lit(3))
    return made.select((-root * F.col("_m") / F.col("_s")).alias("loss"), *[(-root * slope(k)).alias(f"g{k}") for k in range(size)])


def losses_at(data: DataFrame, features: tuple[str, ...], centre: tuple[float, ...], scale: tuple[float, ...], trials: list[np.ndarray], target: str = "r") -> list[float]:
    """The loss at each of several weights, in one aggregate; infinite where gains don't vary."""
    known = data.where(F.col(target).isNotNull())
    gains = [position_of(features, centre, scale, tuple(map(float, w))) * F.col(target) for w in trials]
    row = known.agg(*[f(z).alias(f"{k}{i}") for i, z in enumerate(gains) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [-math.sqrt(TRADING_DAYS) * row[f"m{i}"] / row[f"s{i}"] if row[f"s{i}"] else math.inf for i in range(len(trials))]


def train(data: DataFrame, features: tuple[str, ...], steps: int = 20, target: str = "r", least_gain: float = 1e-4) -> Trained:
    """Weights that lower the loss, by steepest descent. A step costs two passes: one for the gradient, and one for the losses at
    several lengths along it, of which the best is taken; training ends where none gains. It begins at no position but
    a small bias, which is long throughout. Rows with a null return don't count; a feature's null is its mean. Without rows
    the weights stay as they begin, and no losses are told."""
    data = data.select(*{target: 0, **dict.fromkeys(features, 0)}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centre, scale = scales(data, features)
        weights = np.zeros(len(features) + 1)
        weights[0] = 0.1
        losses: list[float] = []
        for _ in range(steps):
            told = loss_and_gradient(gradient_sums(data, features, centre, scale, tuple(weights.tolist()), target), len(weights)).first()
            if told is None or told["loss"] is None:
                break
            slope = np.array([told[f"g{k}"] for k in range(len(weights))])
            losses = losses or [told["loss"]]
            norm = float(np.linalg.norm(slope))
            if not norm:
                break
            trials = [weights - slope / norm * length for length in (0.01, 0.03, 0.1, 0.3, 1.0)]
            found = losses_at(data, features, centre, scale, trials, target)
            best = int(np.argmin(found))
            if losses[-1] - found[best] < least_gain:
                break
            weights = trials[best]
            losses.append(found[best])
        return Trained(features, centre, scale, tuple(weights.tolist()), tuple(losses))
    finally:
        data.unpersist()
