"""Several detectors against dated events in one pass over a panel.

All rolling moments are differences of the same running sums. Each ticker's candidates, its z-scores and its rows near
events are gathered once, in the exchange that the windows need anyway; folds make detections of them, and a detector's
record is worked out from the two short lists of its detections and the ticker's events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import ratio_return
from panelscope.operators import detectors, rolling
from panelscope.operators.events import NEAR_DAYS


@dataclass(frozen=True)
class Detectors:
    """(window, threshold, cooldown) of each, the t-test's threshold being its level; those that are None are left out."""

    cusum: tuple[int, float, int] | None = (60, 4.0, 20)
    jump: tuple[int, float, int] | None = (60, 3.0, 20)
    ttest: tuple[int, float, int] | None = (30, 0.001, 20)

    @property
    def names(self) -> list[str]:
        return [name for name in ("cusum", "jump", "ttest") if getattr(self, name)]


def _reach(events: DataFrame, days: int) -> DataFrame:
    """(date, near): for each date within reach of an event, the events and how far they are. The list is one that people
    keep, and so short."""
    each = events.select("event", "event_date", F.explode(F.expr(f"sequence(date_sub(event_date, {days}), date_add(event_date, {days}))")).alias("date"))
    return each.groupBy("date").agg(F.collect_set(F.struct("event", "event_date", F.abs(F.datediff("date", "event_date")).alias("away"))).alias("near"))


def found_by(panel: DataFrame, events: DataFrame, d: Detectors = Detectors(), days: int = NEAR_DAYS) -> DataFrame:
    """(ticker, cps, <detector> ...): for each ticker the positions of its events, as match_events() has them, and those that
    each detector finds, all in order."""
    w = Window.partitionBy("ticker").orderBy("date")
    near = panel.select("ticker", "date", "price").join(F.broadcast(_reach(events, days)), "date", "left")
    rows = near.select("ticker", (F.row_number().over(w) - 2).alias("t"), ratio_return(F.col("price"), F.lag("price").over(w)).alias("r"), "near")
    windows: dict[str, tuple[int, int]] = {}
    if d.cusum:
        windows["c"] = (d.cusum[0], 1)
    if d.jump:
        windows["j"] = (d.jump[0], 1)
    if d.ttest:
        windows |= {"far": (2 * d.ttest[0], d.ttest[0] + 1), "near": (d.ttest[0], 1)}
    known = rolling.with_running(rows, "r", "ticker", "t")
    for key, window in windows.items():  # generated code of all of them at once would be too long to be compiled
        known = rolling.with_moments(known, {key: window}, "ticker", "t")
    z = lambda k: detectors.z_of(f"{k}_mean", f"{k}_sd")
    known = known.withColumns({f"{k}_sd": F.sqrt(f"{k}_var") for k in ("c", "j") if k in windows})
    gathered = {"hits": F.flatten(F.collect_list(F.transform("near", lambda e: F.struct(e["event"].alias("event"), e["event_date"].alias("event_date"), e["away"].alias("away"), (F.col("t") + 1).alias("pos"))))), "n": F.count("*")}
    if d.cusum:
        known = known.withColumn("z_c", F.when(F.col("t") >= d.cusum[0], z("c")))
        gathered["cusum"] = F.array_sort(F.collect_list(F.when(F.col("z_c").isNotNull(), F.struct("t", F.col("z_c").alias("z")))))
    if d.jump:
        gathered["jump"] = F.array_sort(F.collect_list(F.when((F.col("t") >= d.jump[0]) & (F.abs(z("j")) > d.jump[1]), F.col("t"))))
    if d.ttest:
        window, alpha, _ = d.ttest
        known = detectors.with_test(known, window)
        gathered["ttest"] = F.array_sort(F.collect_list(F.when((F.col("t") >= 2 * window) & detectors.significant(window, alpha), F.col("t"))))
    lists = known.groupBy("ticker").agg(*[c.alias(name) for name, c in gathered.items()])
    folds = {"cusum": lambda p: detectors.cusum_of(F.col("cusum"), *p[1:]), "jump": lambda p: detectors.cooled_of(F.col("jump"), p[2]), "ttest": lambda p: detectors.cooled_of(F.col("ttest"), p[2])}
    nearest = lambda e: F.array_min(F.transform(F.filter("hits", lambda h: h["e"] == e), lambda h: h["at"]))["pos"]
    named = F.transform("hits", lambda h: F.struct(F.struct(h["event"].alias("event"), h["event_date"].alias("event_date")).alias("e"), F.struct(h["away"].alias("away"), h["pos"].alias("pos")).alias("at")))
    lists = lists.withColumn("hits", named)
    each = F.transform(F.array_distinct(F.transform("hits", lambda h: h["e"])), lambda e: F.least(nearest(e), F.col("n") - 2).cast("int"))
    cps = F.when(F.col("n") > 1, F.array_sort(F.array_distinct(each))).otherwise(F.array().cast("array<int>"))
    return lists.select("ticker", cps.alias("cps"), *[folds[name](getattr(d, name)).alias(name) for name in d.names])


def record(found: Column, cps: Column, tolerance: int) -> Column:
    """What events.evaluate() says of a ticker's detections and events, from both lists: n_det, n_tp and delays."""
    found, cps = F.array_sort(F.array_distinct(found)), F.array_sort(F.array_distinct(cps))
    first = F.transform(found, lambda t: F.struct(t.alias("t"), F.array_min(F.filter(cps, lambda c: F.abs(t - c) <= tolerance)).alias("cp")))
    true = F.filter(first, lambda x: x["cp"].isNotNull())
    nearest = F.transform(cps, lambda c: F.array_min(F.transform(F.filter(true, lambda x: x["cp"] == c), lambda x: F.struct(F.abs(x["t"] - c).alias("away"), x["t"].alias("t"), (x["t"] - c).alias("d")))))
    delays = F.transform(F.filter(nearest, lambda x: x.isNotNull()), lambda x: x["d"])
    return F.struct(F.size(found).cast("long").alias("n_det"), F.size(true).cast("long").alias("n_tp"), F.size(cps).alias("n_cps"), delays.alias("delays"))


def compared(panel: DataFrame, events: DataFrame, d: Detectors = Detectors(), tolerance: int = 20, days: int = NEAR_DAYS) -> DataFrame:
    """The rows of events.evaluate() for every ticker that has an event, and every detector."""
    lists = found_by(panel, events, d, days).where(F.size("cps") > 0)
    each = lists.select("ticker", "cps", F.explode(F.array(*[F.struct(F.lit(name).alias("method"), F.col(name).alias("found")) for name in d.names])).alias("x"))
    told = each.select("ticker", "x.method", record(F.col("x.found"), F.col("cps"), tolerance).alias("e"))
    n_fp = F.col("e.n_det") - F.col("e.n_tp")
    recall = F.when(F.col("e.n_det") == 0, 0.0).otherwise(F.size("e.delays") / F.col("e.n_cps"))
    mean = F.try_divide(F.aggregate("e.delays", F.lit(0).cast("long"), lambda s, x: s + x), F.size("e.delays"))
    return told.select(
        "ticker", "method", "e.n_det", "e.n_tp", n_fp.alias("n_fp"), F.coalesce(F.try_divide(n_fp, F.col("e.n_det")), F.lit(0.0)).alias("fpr"),
        recall.alias("recall"), "e.delays", mean.alias("mean_delay"),
    )
