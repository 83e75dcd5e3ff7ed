"""Moments of sliding windows as differences of running sums, at a cost that doesn't depend on the window.

A value less its group's mean is turned into a whole number of units, the unit being so small a part of
the group's spread that doubles hold no more. Running sums of these numbers and of their squares are exact,
so that a difference of two loses nothing, whatever the level or the length of the series. A number is two
halves of LIMB bits; the halves' products are summed in halves again, as longs, which are far cheaper than decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import finite

#: Bits of a value by its group's spread, and of each of its halves: sums of halves fit a long for 2**39 rows.
BITS, LIMB = 46, 23
#: Windows of so many values at most are put together from longs, wider ones from decimals.
NARROW = 8192
_HELD = ("_run", "_centre", "_unit")
_SUMS = ("n", "h", "l", "hh1", "hh0", "hl1", "hl0", "ll1", "ll0")


def with_running(df: DataFrame, value: str, by: str, order: str, name: str = "") -> DataFrame:
    """df with what moments() takes differences of. Nulls, NaN and infinite values don't count. name: to keep several apart."""
    run, centre, unit = (f"{c}{name}" for c in _HELD)
    whole = Window.partitionBy(by)
    so_far = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = finite(F.col(value))
    known = df.withColumns({centre: F.avg(x).over(whole), "_least": F.min(x).over(whole), "_most": F.max(x).over(whole)})
    spread = F.greatest(F.col("_most") - F.col(centre), F.col(centre) - F.col("_least"))
    power = F.when(spread > 0, F.pow(F.lit(2.0), BITS - F.ceil(F.log2(spread)))).otherwise(1.0)
    known = known.withColumn(unit, power).withColumn("_units", F.rint((x - F.col(centre)) * F.col(unit)).cast("long")).drop("_least", "_most")
    high = lambda c: F.shiftright(c, LIMB)
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << LIMB) - 1).cast("long"))
    known = known.withColumns({"_h": high("_units"), "_l": low("_units")})
    known = known.withColumns({"_hh": F.col("_h") * F.col("_h"), "_hl": F.col("_h") * F.col("_l"), "_ll": F.col("_l") * F.col("_l")})
    parts = {"h": F.col("_h"), "l": F.col("_l")} | {f"{c}{k}": half(f"_{c}") for c in ("hh", "hl", "ll") for k, half in ((1, high), (0, low))}
    sums = F.struct(F.count("_units").over(so_far).alias("n"), *[F.coalesce(F.sum(parts[c]).over(so_far), F.lit(0).cast("long")).alias(c) for c in _SUMS[1:]])
    return known.withColumn(run, sums).drop("_units", "_h", "_l", "_hh", "_hl", "_ll")


def with_moments(df: DataFrame, windows: dict[str, tuple[int, int]], by: str, order: str, name: str = "") -> DataFrame:
    """df (of with_running) with <key>_n, <key>_mean and <key>_var for each window {key: (first, last)}, the rows from `first`
    rows before the current one to `last` rows before it: the number of known values, their mean, and their sample variance,
    null for fewer than two. Values that differ by less than a unit, 2**-46 of the group's spread, count as equal."""
    run, centre, unit = (f"{c}{name}" for c in _HELD)
    w = Window.partitionBy(by).orderBy(order)
    none = f"named_struct({', '.join(f"'{c}', 0L" for c in _SUMS)})"
    before = lambda k: F.col(run) if k == 0 else F.expr(f"lag({run}, {k}, {none})").over(w)
    ends = {f"_at{k}{name}": before(k) for k in sorted({k for first, last in windows.values() for k in (last, first + 1)})}
    df = df.withColumns(ends)
    limb = 1 << LIMB
    for key, (first, last) in windows.items():
        high, low = f"_at{last}{name}", f"_at{first + 1}{name}"
        part = {f"_{c}": F.expr(f"{high}.{c} - {low}.{c}") for c in _SUMS}
        # less the nearest whole number to their mean, the values are as small as they can be
        near = {"_s": F.expr(f"_h * {limb}D + _l")}
        whole = {"_q": F.expr("cast(rint(_s / greatest(_n, 1L)) as bigint)")}
        halves = {"_qh": F.shiftright("_q", LIMB), "_ql": F.col("_q").bitwiseAND(F.lit(limb - 1).cast("long"))}
        # which way is known from the window's width, as generated code of both would be too long to be compiled
        steps = _narrow() if first - last < NARROW else [{"_r": _rest_of_wide(), "_square": _square_of_wide()}]
        products = {c: F.expr(e) for step in steps for c, e in step.items()}
        var = F.when(F.col("_n") > 1, F.greatest(F.lit(0.0), F.col("_square") - F.col("_r") * F.col("_r") / F.col("_n")) / (F.col("_n") - 1) / F.col(unit) / F.col(unit))
        mean = F.when(F.col("_n") > 0, F.col(centre) + F.col("_s") / F.col("_n") / F.col(unit))
        for step in (part, near, whole, halves, *({c: products[c] for c in step} for step in steps)):
            df = df.withColumns(step)
        df = df.withColumns({f"{key}_n": F.col("_n"), f"{key}_mean": mean, f"{key}_var": var}).drop(*part, *near, *whole, *halves, *products)
    return df.drop(*ends)


def _narrow() -> list[dict[str, str]]:
    """The sum (_r) and the sum of squares of the values less _q, in longs where high halves nearly cancel."""
    limb = 1 << LIMB
    return [
        {
            "_a": f"_hh1 * {limb}L + _hh0 - 2L * _qh * _h + _n * _qh * _qh",
            "_b": f"_hl1 * {limb}L + _hl0 - _qh * _l - _ql * _h + _n * _qh * _ql",
            "_c": f"_ll1 * {limb}L + _ll0 - 2L * _ql * _l + _n * _ql * _ql",
            "_r": f"cast((_h - _n * _qh) * {limb}L + _l - _n * _ql as double)",
        },
        {"_square": f"case when _a < {2 * NARROW}L then cast(_a * {limb**2}L + _b * {2 * limb}L + _c as double) else _a * {limb**2}D + _b * {2 * limb}D + _c end"},
    ]


def _dec(c: str) -> str:
    return f"cast({c} as decimal(38,0))"


def _rest_of_wide() -> str:
    """The sum less the window's size times _q."""
    return f"cast({_dec('_h')} * {1 << LIMB}BD + {_dec('_l')} - {_dec('_n')} * {_dec('_q')} as double)"


def _square_of_wide() -> str:
    """The sum of squares of the values less _q."""
    sums = [("_hh1", 3 * LIMB), ("_hh0", 2 * LIMB), ("_hl1", 2 * LIMB + 1), ("_hl0", LIMB + 1), ("_ll1", LIMB), ("_ll0", 0)]
    squares = " + ".join(f"{_dec(c)} * {1 << bits}BD" for c, bits in sums)
    total = f"({_dec('_h')} * {1 << LIMB}BD + {_dec('_l')})"
    return f"cast({squares} - 2BD * {_dec('_q')} * {total} + {_dec('_n')} * {_dec('_q')} * {_dec('_q')} as double)"


def without_running(df: DataFrame, name: str = "") -> DataFrame:
    return df.drop(*(f"{c}{name}" for c in _HELD))


def full_deviation(key: str, size: int) -> Column:
    """The sample deviation of a window, null until it is full."""
    return F.when(F.col(f"{key}_n") == size, F.sqrt(f"{key}_var"))
