"""Exponentially weighted moments by a segmented scan: blocks of rows are summed where they lie, what the blocks carry on
is put together from their totals, and each row adds what its block was carried.

A moment's sums follow s(t) = decay * s(t - 1) + x(t), which is associative: a stretch of rows is a pair (decay to the
power of its length, its own sum), whatever came before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import finite

#: Digits that weights inside a block may span, of the 308 that a double has, squares included; rows of a block at most.
SPAN, ROWS = 140, 2048
#: A sum of weights under this is none, since a double holds fewer and fewer digits of its square.
FAINT = 1e-140


@dataclass(frozen=True)
class Moment:
    """Of a column, its exponentially weighted mean, or its unbiased deviation (sd); a row before counts decay times as much."""

    column: str
    kind: str
    decay: float

    def __post_init__(self) -> None:
        if self.kind not in ("mean", "sd") or not 0 < self.decay < 1:
            raise ValueError(f"a moment is a mean or an sd with a decay between 0 and 1, not {self}")

    def sums(self) -> tuple[str, ...]:
        """Of weights and of values; for a deviation also of squared weights and of squares."""
        return ("w", "x") if self.kind == "mean" else ("w", "x", "ww", "xx")

    def decay_of(self, of: str) -> float:
        return self.decay**2 if of == "ww" else self.decay


def block_rows(moments: list[Moment]) -> int:
    return max(1, min(ROWS, int(SPAN / -math.log10(min(m.decay for m in moments)))))


def _carried(totals: DataFrame, sums: dict[str, float], rows: int, by: str) -> DataFrame:
    """totals (by, block, sums) with each sum replaced by that of all blocks before, decayed to the block's beginning. Sums
    of 2, 4, 8 ... blocks are put together of the two halves, until what is older would be nothing to a double."""
    w = Window.partitionBy(by).orderBy("block")
    rounds = {c: max(1, math.ceil(math.log2(max(2.0, 308 / (-math.log10(d) * rows)))) + 1) for c, d in sums.items()}
    for k in range(max(rounds.values())):
        step = {c: F.col(c) + d ** (rows << k) * F.coalesce(F.lag(c, 1 << k).over(w), F.lit(0.0)) for c, d in sums.items() if k < rounds[c]}
        totals = totals.withColumns(step)
    return totals.select(by, "block", *[F.coalesce(F.lag(c).over(w), F.lit(0.0)).alias(f"_c{c}") for c in sums])


def ewm(values: DataFrame, moments: dict[str, Moment], by: str = "ticker", order: str = "t") -> DataFrame:
    """values (by, order, ...) with a column for each moment up to the row itself. `order` counts a group's rows from any
    number on without gaps. Nulls age the weights and give what went before, as do NaN and infinite values, until the gap
    has left nothing of the weights (FAINT), and then null; a deviation is null before the second value.

    Rows are dealt by group and block, so that a long group is spread over tasks; from block to block go a few sums.
    """
    columns = sorted({m.column for m in moments.values()})
    specs = sorted({(m.column, m.decay, m.kind == "sd") for m in moments.values()})
    rows = block_rows(list(moments.values()))
    # deviations are taken from the group's mean, near which squares lose nothing
    centres = values.groupBy(by).agg(*[F.coalesce(F.avg(finite(F.col(c))), F.lit(0.0)).alias(f"_m_{c}") for c in columns])
    placed = values.join(centres, by).withColumns({f"_x_{c}": finite(F.col(c)) - F.col(f"_m_{c}") for c in columns})
    placed = placed.withColumns({"block": F.floor(F.col(order) / rows), "_i": F.pmod(F.col(order), F.lit(rows))}).repartition(by, "block")
    so_far = Window.partitionBy(by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums: dict[str, float] = {}
    local: dict[str, Column] = {}
    for k, (c, decay, sd) in enumerate(specs):
        x = F.col(f"_x_{c}")
        known = F.when(x.isNotNull(), 1.0).otherwise(0.0)
        parts = {"w": (known, decay), "x": (F.coalesce(x, F.lit(0.0)), decay)} | ({"ww": (known, decay**2), "xx": (F.coalesce(x * x, F.lit(0.0)), decay)} if sd else {})
        for name, (value, d) in parts.items():
            sums[f"{name}{k}"] = d
            # a row counts for the later ones of its block; scaled by the block's first, its weight is a power of its place
            local[f"{name}{k}"] = F.sum(value * F.pow(F.lit(1 / d), F.col("_i"))).over(so_far) * F.pow(F.lit(d), F.col("_i"))
        local[f"n{k}"] = F.sum(known).over(so_far)
        sums[f"n{k}"] = 1.0
    inside = placed.withColumns(local)
    ends = inside.groupBy(by, "block").agg(F.max_by(F.struct(*sums), order).alias("s")).select(by, "block", "s.*")
    counts = [c for c in sums if c.startswith("n")]
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = {f"_c{c}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in counts}
    carried = _carried(ends, {c: d for c, d in sums.items() if c not in counts}, rows, by).join(ends.select(by, "block", *[v.alias(c) for c, v in seen.items()]), [by, "block"])
    joined = inside.join(carried, [by, "block"])
    # the first row of a block is one row after the last one of the block before
    whole = {c: F.col(c) + F.col(f"_c{c}") * (1.0 if c in counts else F.pow(F.lit(d), F.col("_i") + 1)) for c, d in sums.items()}
    made = joined.withColumns(whole)
    out = {}
    for name, m in moments.items():
        k = next(k for k, (c, d, sd) in enumerate(specs) if (c, d, sd) == (m.column, m.decay, m.kind == "sd"))
        w, x = F.col(f"w{k}"), F.col(f"x{k}")
        mean = F.when(w > FAINT, F.try_divide(x, w))
        if m.kind == "mean":
            out[name] = mean + F.col(f"_m_{m.column}")
        else:
            var = F.greatest(F.lit(0.0), F.try_divide(F.col(f"xx{k}"), w) - mean * mean)
            out[name] = F.when((F.col(f"n{k}") >= 2) & (w > FAINT), F.sqrt(F.try_divide(var, 1 - F.try_divide(F.try_divide(F.col(f"ww{k}"), w), w))))
    return made.select(*values.columns, *[c.alias(name) for name, c in out.items()])
