"""Matching detections with dated events, and what that says of a detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR_DAYS = 7


def match_events(panel: DataFrame, events: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """(ticker, t): for each event, the ticker's nearest row within `days` calendar days, the earlier on a tie; its
    position is read as one of the returns, and kept within them. events (event, event_date) is a list that people
    keep; it is joined by the dates within reach, so nothing is paired that isn't near."""
    w = Window.partitionBy("ticker").orderBy("date")
    placed = panel.select("ticker", "date", (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy("ticker")).alias("n"))
    reach = events.select("event", "event_date", F.explode(F.expr(f"sequence(date_sub(event_date, {days}), date_add(event_date, {days}))")).alias("date"))
    near = placed.join(F.broadcast(reach), "date").withColumn("away", F.abs(F.datediff("date", "event_date")))
    best = near.groupBy("ticker", "event", "event_date").agg(F.min(F.struct("away", "pos", "n")).alias("best"))
    return best.where("best.n > 1").select("ticker", F.least("best.pos", F.col("best.n") - 2).cast("int").alias("t")).distinct()


def evaluate(detections: DataFrame, events: DataFrame, spine: DataFrame, tolerance: int = 20) -> DataFrame:
    """One row for each (ticker, method) of spine: n_det, n_tp, n_fp, fpr, recall, delays and mean_delay.

    A detection belongs to the earliest event within tolerance, and is false without one; an event's
    delay is that of its nearest detection, the earlier on a tie. Without detections fpr and recall
    are 0; with detections but no events recall is 1. fpr is the share of detections that are false.
    """
    found = detections.select("ticker", "method", "t").distinct()
    cps = events.select("ticker", F.col("t").alias("cp")).distinct()
    # equal buckets of `tolerance` positions bring near positions together by an equality join
    width = max(1, tolerance)
    spread = cps.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("cp") / width) + k for k in (-1, 0, 1)])))
    keyed = found.withColumn("bucket", F.floor(F.col("t") / width))
    near = keyed.join(spread, ["ticker", "bucket"], "left").withColumn("cp", F.when(F.abs(F.col("t") - F.col("cp")) <= tolerance, F.col("cp")))
    first = near.groupBy("ticker", "method", "t").agg(F.min("cp").alias("cp"))
    nearest = first.where("cp is not null").groupBy("ticker", "method", "cp").agg(F.min(F.struct(F.abs(F.col("t") - F.col("cp")).alias("away"), "t")).alias("best"))
    delays = nearest.groupBy("ticker", "method").agg(F.count("*").alias("n_matched"), F.sort_array(F.collect_list(F.struct("cp", (F.col("best.t") - F.col("cp")).alias("d")))).alias("ds"))
    counts = first.groupBy("ticker", "method").agg(F.count("*").alias("n_det"), F.count("cp").alias("n_tp"))
    n_cps = cps.groupBy("ticker").agg(F.count("*").alias("n_cps"))
    all_ = spine.join(counts, ["ticker", "method"], "left").join(delays, ["ticker", "method"], "left").join(n_cps, "ticker", "left")
    all_ = all_.na.fill(0, ["n_det", "n_tp", "n_matched", "n_cps"])
    recall = F.when(F.col("n_det") == 0, 0.0).when(F.col("n_cps") == 0, 1.0).otherwise(F.try_divide(F.col("n_matched"), F.col("n_cps")))
    fpr = F.when(F.col("n_det") == 0, 0.0).otherwise(F.try_divide(F.col("n_det") - F.col("n_tp"), F.col("n_det")))
    d = F.coalesce(F.transform("ds", lambda x: x["d"]), F.array().cast("array<int>"))
    mean = F.try_divide(F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x), F.size(d))
    return all_.select("ticker", "method", "n_det", "n_tp", (F.col("n_det") - F.col("n_tp")).alias("n_fp"), fpr.alias("fpr"), recall.alias("recall"), d.alias("delays"), mean.alias("mean_delay"))


def spine_of(events: DataFrame, methods: list[str]) -> DataFrame:
    """Every ticker that has an event, with every method, so that pairs without detections count."""
    return events.select("ticker").distinct().withColumn("method", F.explode(F.array(*map(F.lit, methods))))


def method_summary(evaluated: DataFrame) -> DataFrame:
    """Means and population deviations over tickers; tickers without delays don't count in mean_delay."""
    return evaluated.groupBy("method").agg(
        F.avg("fpr").alias("mean_fpr"), F.stddev_pop("fpr").alias("std_fpr"), F.avg("recall").alias("mean_recall"),
        F.stddev_pop("recall").alias("std_recall"), F.avg("mean_delay").alias("mean_delay"), F.count("*").alias("n_tickers"),
    )


def detail(evaluated: DataFrame, methods: list[str]) -> DataFrame:
    """One row for each ticker, with <method>_fpr and <method>_recall."""
    return evaluated.groupBy("ticker").pivot("method", methods).agg(F.first("fpr", ignorenulls=True).alias("fpr"), F.first("recall", ignorenulls=True).alias("recall"))


def formatted(evaluated: DataFrame) -> DataFrame:
    """The evaluation as text: counts, percentages with one decimal, and the mean delay in days; halves go to the even digit."""
    share = lambda c: F.format_string("%.1f%%", F.bround(F.col(c) * 100, 1))
    delay = F.coalesce(F.format_string("%+.1f", F.bround(F.col("mean_delay").cast("double"), 1)), F.lit("-"))
    delay = F.when(F.col("mean_delay").isNull(), "-").otherwise(delay)
    return evaluated.select("ticker", "method", F.col("n_det").alias("detections"), share("fpr").alias("fpr"), share("recall").alias("recall"), delay.alias("mean_delay"))
