"""Detectors on series too long for one array: cooldowns by pointer doubling, CUSUM block by block.

What is kept or detected depends on what was kept or detected last, along the whole series. Yet where a cooldown goes on
from a candidate depends on that candidate alone: these pointers are followed 1, 2, 4, 8 ... steps at a time. And a block of
a CUSUM depends on what came before through two sums and the last detection alone: all blocks run at once, each from
what the block before it ended with in the last round, until none ends otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.operators import detectors
from panelscope.sources.shared import cut


def _next(candidates: DataFrame, cooldown: int) -> DataFrame:
    """(ticker, t, next): for each candidate the first one that is more than `cooldown` after it, null if there is none.
    In blocks of cooldown + 1 positions that one is in the next block, or is the first of the one after that has any."""
    width = cooldown + 1
    blocks = candidates.select("ticker", F.floor(F.col("t") / width).alias("block"), F.col("t").cast("int").alias("t")).groupBy("ticker", "block").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    w = Window.partitionBy("ticker").orderBy("block")
    known = blocks.select("ticker", "block", "ts", F.lead("block").over(w).alias("b1"), F.lead("ts").over(w).alias("ts1"), F.lead(F.col("ts")[0], 2).over(w).alias("first2"))
    each = known.select("ticker", F.explode("ts").alias("t"), "block", "b1", "ts1", "first2")
    late = F.array_min(F.filter("ts1", lambda x: x > F.col("t") + cooldown))
    return each.select("ticker", "t", F.when(F.col("b1") == F.col("block") + 1, F.coalesce(late, F.col("first2"))).otherwise(F.col("ts1")[0]).alias("next"))


def cooled(candidates: DataFrame, cooldown: int) -> DataFrame:
    """(ticker, t) as detectors.cooled() has them, in rounds of joins whose number is the logarithm of the longest chain; no
    group holds more than a cooldown's positions."""
    jumps = cut(_next(candidates, cooldown))
    reached = cut(jumps.groupBy("ticker").agg(F.min("t").alias("t")))
    found = reached.count()
    while found:
        further = reached.join(jumps.where("next is not null"), ["ticker", "t"]).select("ticker", F.col("next").alias("t"))
        reached = cut(reached.unionByName(further).distinct())
        now = reached.count()
        if now == found:
            break
        found = now
        twice = jumps.select("ticker", F.col("t").alias("next"), F.col("next").alias("after"))
        jumps = cut(jumps.where("next is not null").join(twice.where("after is not null"), ["ticker", "next"]).select("ticker", "t", F.col("after").alias("next")))
    return reached


def _run(zs: Column, begin: Column, threshold: float, cooldown: int, slack: float) -> Column:
    """The fold of detectors.cusum_of() over (t, z) in order, from a state: with up, down and last at the end, and what was found."""

    def step(s: Column, x: Column) -> Column:
        up = F.greatest(F.lit(0.0), s["up"] + x["z"] - slack)
        down = F.greatest(F.lit(0.0), s["down"] - x["z"] - slack)
        hit = (F.greatest(up, down) > threshold) & (x["t"] - s["last"] > cooldown)
        return F.struct(
            F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"),
            F.when(hit, x["t"]).otherwise(s["last"]).alias("last"), F.when(hit, F.concat(s["found"], F.array(x["t"]))).otherwise(s["found"]).alias("found"),
        )

    none = F.struct(begin["up"].alias("up"), begin["down"].alias("down"), begin["last"].alias("last"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(zs, none, step)


def detect_cusum(returns: DataFrame, ref_window: int = 60, threshold: float = 4.0, cooldown: int = 20, slack: float = 0.5, rows: int = 4096) -> DataFrame:
    """(ticker, t) as detectors.detect_cusum() has them, from arrays of `rows` positions at most.

    In the first round all blocks begin afresh. A round is right for one block more than the one before at least; as sums
    return to 0 within a block as a rule, and a detection outlives its cooldown, two or three rounds are enough, and only
    the blocks that begin otherwise are run again.
    """
    x = F.when(F.col("z").isNotNull(), F.struct(F.col("t").cast("int").alias("t"), "z"))
    z = detectors.zscores(returns, ref_window).select("ticker", F.floor(F.col("t") / rows).alias("block"), x.alias("x"))
    blocks = cut(z.groupBy("ticker", "block").agg(F.array_sort(F.collect_list("x")).alias("zs")).where(F.size("zs") > 0))
    fresh = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(-cooldown - 1).alias("last"))
    w = Window.partitionBy("ticker").orderBy("block")

    def ended(of: DataFrame) -> DataFrame:
        """(ticker, block, begin, found, end): a detection that the next block's first row is free of doesn't count in end."""
        ran = of.withColumn("e", _run(F.col("zs"), F.col("begin"), threshold, cooldown, slack))
        last = F.greatest(F.col("e.last"), F.element_at("zs", -1)["t"] - cooldown)
        return ran.select("ticker", "block", "begin", "e.found", F.struct(F.col("e.up").alias("up"), F.col("e.down").alias("down"), last.alias("last")).alias("end"))

    known = cut(ended(blocks.withColumn("begin", fresh)))
    while True:
        due = known.withColumn("due", F.coalesce(F.lag("end").over(w), fresh))
        again = cut(due.where(~F.col("due").eqNullSafe(F.col("begin"))).select("ticker", "block", F.col("due").alias("begin")))
        if not again.count():
            return known.select("ticker", F.explode("found").alias("t"))
        redone = ended(blocks.join(again, ["ticker", "block"]))
        known = cut(known.join(again.select("ticker", "block"), ["ticker", "block"], "left_anti").unionByName(redone))
