"""Online changepoints: the posterior of the current run's length, row by row.

A run is a stretch of values with one mean, around which they vary by one (so scale them first, as z-scores are). Each row
every run either goes on, or ends, by a constant chance; runs that have next to no mass left are dropped, so that a row
costs the same however long the series is. A change is told where the likeliest run becomes a shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tickers whose rows are taken in step: their runs fit a core's cache.
TOGETHER = 256


def changes_of(series: list[np.ndarray], hazard: float = 1 / 250, prior: float = 2.0, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, at, length): in series `which` the likeliest run became a shorter one, of that length, with value `at`. All
    series go forward in step, each with its runs in order of length. prior: deviation of runs' means around 0. least:
    the mass under which a run is dropped."""
    order = np.argsort([-len(x) for x in series], kind="stable")
    size = np.array([len(series[k]) for k in order], np.int64)
    values, begin = np.concatenate([np.zeros(0), *(series[k] for k in order)]), np.cumsum(size) - size
    n, s, mass, owner = np.zeros(len(size), np.int64), np.zeros(len(size)), np.ones(len(size)), np.arange(len(size))
    first, best, found = owner.copy(), np.zeros(len(size), np.int64), []
    for k in range(int(size[0]) if len(size) else 0):
        going = int(np.searchsorted(-size, -k))  # series are in order of size, so those that end are the last ones
        if going < len(best):
            runs = int(first[going])
            n, s, mass, owner, first, best = n[:runs], s[:runs], mass[:runs], owner[:runs], first[:going], best[:going]
        x = values[begin[:going] + k][owner]
        known = 1 / prior**2 + n
        var = 1 + 1 / known
        off = x - s / known
        weight = mass * np.exp(-off * off / (2 * var)) / np.sqrt(var)
        total = np.add.reduceat(weight, first)
        # a value that no run can explain leaves none of them
        share = weight / np.where(total > 0, total, np.inf)[owner] * (1 - hazard)
        on = np.flatnonzero(share >= least)
        of = owner[on]
        # each series' new run comes first, so that the others move on by one for each series up to theirs
        at, runs = np.arange(len(on)) + of + 1, len(on) + going
        longer, sums, n, s, mass, owner = n[on] + 1, s[on] + x[on], np.zeros(runs, np.int64), np.zeros(runs), np.full(runs, hazard), np.empty(runs, np.int64)
        n[at], s[at], mass[at], owner[at] = longer, sums, share[on], of
        count = np.bincount(of, minlength=going) + 1
        first = np.cumsum(count) - count
        owner[first] = np.arange(going)
        likeliest = mass == np.maximum.reduceat(mass, first)[owner]
        now = np.maximum.reduceat(np.where(likeliest, n, -1), first)
        shorter = np.flatnonzero(now < best)
        if len(shorter):
            found.append((order[shorter], np.full(len(shorter), k), now[shorter]))
        best = now
    which, at, length = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found) if found else ((), (), ())))
    return which, at, length


def detect_bayes(values: DataFrame, value: str = "z", hazard: float = 1 / 250, prior: float = 2.0, least: float = 1e-3) -> DataFrame:
    """(ticker, t, began) of values (ticker, t, <value>), whose deviation around their mean is about one. Nulls and NaN are
    passed over, and so are runs' ends in them. A ticker's values are gathered in order; what is carried from row to row
    has as many runs as hold a mass of `least` or more."""
    known = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col("t").cast("int").alias("t"), F.col(value).cast("double").alias("x")))
    in_order = values.select("ticker", known.alias("x")).groupBy("ticker").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("ticker", "xs.t", "xs.x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                ts, xs = ([x.values.to_numpy() for x in part[c]] for c in ("t", "x"))
                which, at, length = changes_of(xs, hazard, prior, least)
                t = np.array([ts[w][a] for w, a in zip(which.tolist(), at.tolist())], np.int32)
                yield pa.RecordBatch.from_arrays([part["ticker"].take(pa.array(which)), pa.array(t), pa.array((t - length + 1).astype(np.int32))], names=["ticker", "t", "began"])

    return in_order.mapInArrow(run, f"ticker {values.schema['ticker'].dataType.simpleString()}, t int, began int")
