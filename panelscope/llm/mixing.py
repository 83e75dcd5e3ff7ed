"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every row of a source should be copied target / source_size times. The whole part is certain; the
fractional parts are rounded together: two units meet, and words pass from one to the other, at random
either way, until one of them is 0 or 1, so that all words together stay what they were, and every
unit's chance too. Units meet in blocks of about BLOCK, largest first; the one that a block leaves open
goes up a reduction tree, block by block, until a source has a single one, and the decisions come back
down the same tree. Before that, the few rows that hold more than 1/256 of their source's words are
drawn, largest first, and what each adds or lacks is spread over all rows after it: a source misses its
target by a row of that size at most, if it has others to make up for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import kept, word_count

#: Weights of the sources in order, repeating; words of the mix for each word of input; most copies of a row.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
#: Units in a block of the reduction tree, about.
BLOCK = 192
#: A unit is large if it has more than one in so many of its source's words, so that a source has no more of them than that.
LARGE = 256
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, n_units) with source_id and target, one row for each source.

    Sources come in code point order, null last. Targets divide share * all sizes by weight, and stop
    at copies * source_size; what is above is shared again by weight until none is. That level is
    found in one pass: in the order in which sources reach their limit, it is the first at which the
    rest of the mix fits into the remaining sources. The windows run over one row for each source.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") - 1) % len(weights) + 1)
    t = sizes.withColumn("source_id", order).withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * copies)
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "source_id")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (share * F.sum("source_size").over(everything) - before) / after)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    whole = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.coalesce(F.first(fits, ignorenulls=True).over(whole), F.lit(float("inf")))
    target = F.when(F.col("most") == 0, 0.0).otherwise(F.least("most", level * F.col("weight")))
    return t.select("source", "source_size", "n_units", "source_id", target.alias("target"))


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _drawn(units: Column, words: Column, level: int) -> Column:
    """struct(won, shift): the units that are in, each drawn in turn, and what the probabilities of all that come after the last
    are shifted by. units: structs with order (minus the size), p and h, in the order in which they are drawn. words: of these
    and of all after them. What a unit adds or lacks is spread over all after it, by size, so that theirs keep their means
    as long as none of them leaves 0 to 1; one beyond is 0 or 1, and the rest of it passes on."""
    none = F.struct(F.lit(0.0).alias("shift"), words.cast("double").alias("left"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("won"))

    def draw(s: Column, x: Column) -> Column:
        size, p = -x["order"], x["p"] + s["shift"]
        chosen = _uniform(F.lit(level), x["h"]) < p
        left = s["left"] - size
        more = F.coalesce((p - chosen.cast("int")) * size / F.when(left > 0.5, left), F.lit(0.0))
        return F.struct((s["shift"] + more).alias("shift"), left.alias("left"), (s["k"] + 1).alias("k"), F.when(chosen, F.concat(s["won"], F.array(s["k"]))).otherwise(s["won"]).alias("won"))

    return F.aggregate(units, none, draw)


def _pivoted(units: Column, level: int) -> Column:
    """struct(open, p, won): the unit left open, its probability, and the units that are in. units: structs with order (minus
    the size), p and h, in the order in which they meet.

    Two that meet pass words from one to the other, either way, until one is 0 or 1; the chances of the ways are such that
    either keeps its mean. One that is below 0 or above 1 before, from what it was passed, gives that up first.
    """
    none = F.struct(F.lit(-1).alias("open"), F.lit(0.0).alias("p"), F.lit(1.0).alias("size"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("won"))

    def bound(s: Column, x: Column) -> Column:
        """The words that may go to the open unit (up) and from it (down)."""
        mine, own = -x["order"], s["size"]
        return F.struct(F.least((1 - s["p"]) * own, x["p"] * mine).alias("up"), F.least(s["p"] * own, (1 - x["p"]) * mine).alias("down"))

    def meet(s: Column, x: Column) -> Column:
        size = -x["order"]
        start = F.struct(s["k"].alias("open"), x["p"].alias("p"), size.alias("size"), (s["k"] + 1).alias("k"), s["won"].alias("won"))

        def settled(gone: Column, into: Column, stays: Column, p: Column, of: Column) -> Column:
            won = F.when(into, F.concat(s["won"], F.array(gone))).otherwise(s["won"])
            return F.struct(stays.alias("open"), p.alias("p"), of.alias("size"), (s["k"] + 1).alias("k"), won.alias("won"))

        def both(of: Column) -> Column:
            to_open = _uniform(F.lit(level), x["h"]) < F.coalesce(of["down"] / F.nullif(of["up"] + of["down"], F.lit(0.0)), F.lit(1.0))
            words = F.when(to_open, of["up"]).otherwise(-of["down"])
            p, q = s["p"] + words / s["size"], x["p"] - words / size
            # whichever is nearer to a whole number has got there
            mine = F.least(F.abs(p), F.abs(1 - p)) <= F.least(F.abs(q), F.abs(1 - q))
            return F.when(mine, settled(s["open"], p > 0.5, s["k"], q, size)).otherwise(settled(s["k"], q > 0.5, s["open"], p, s["size"]))

        over, under = (lambda p: F.greatest(p - 1, F.lit(0.0)) + F.least(p, F.lit(0.0))), (lambda p: (p > 1) | (p < 0))
        passed = settled(s["open"], s["p"] > 1, s["k"], x["p"] + over(s["p"]) * s["size"] / size, size)
        given = settled(s["k"], x["p"] > 1, s["open"], s["p"] + over(x["p"]) * size / s["size"], s["size"])
        return F.when(s["open"] < 0, start).when(under(s["p"]), passed).when(under(x["p"]), given).otherwise(both(bound(s, x)))

    return F.aggregate(units, none, meet)


def _level(units: DataFrame, level: int) -> DataFrame:
    """units (source_id, block, unit: struct) folded block by block, largest first."""
    folded = units.groupBy("source_id", "n_blocks", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    return kept(folded.withColumn("end", _pivoted(F.col("units"), level)))


def large_first(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(large units with chosen, other units with p shifted): units have words, their source's. What the large ones of a
    source add or lack is taken from or given to its other units, in proportion to their sizes."""
    large = F.col("size") * LARGE > F.col("words")
    unit = F.struct((-F.col("size")).alias("order"), "h", "p", "item").alias("unit")
    of = units.groupBy("source_id").agg(F.sum("size").alias("left"), F.sort_array(F.collect_list(F.when(large, unit))).alias("units"))
    drawn = kept(of.where(F.size("units") > 0).withColumn("end", _drawn(F.col("units"), F.col("left"), -2)))
    each = drawn.select("source_id", "end", F.posexplode("units").alias("at", "unit"))
    told = each.select("source_id", F.array_contains("end.won", F.col("at")).cast("int").alias("chosen"), F.col("unit.item").alias("item"))
    rest = units.where(~large).join(drawn.select("source_id", F.col("end.shift").alias("shift")), "source_id", "left")
    return told, rest.withColumn("p", F.col("p") + F.coalesce("shift", F.lit(0.0))).drop("shift")


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(float(BLOCK))).cast("long")


def rounded(units: DataFrame) -> DataFrame:
    """units (source_id, n, h, size, p, item) with `chosen`, 0 or 1, of mean p; n is the source's number of units, and no size is 0.

    All that doesn't fit into memory is spread: a source of any size has blocks of about BLOCK units.
    """
    unit = F.struct((-F.col("size")).alias("order"), "h", "p", "item").alias("unit")
    first = units.select("source_id", _blocks(F.col("n")).alias("n_blocks"), "h", unit).withColumn("block", F.pmod("h", "n_blocks"))
    levels = [_level(first, 0)]
    while levels[-1].where("n_blocks > 1").limit(1).count():
        last = levels[-1].where("n_blocks > 1")
        at = F.element_at("units", F.col("end.open") + 1)
        h = F.xxhash64(F.lit(len(levels)), "block", "source_id")
        up = last.select("source_id", _blocks(F.col("n_blocks")).alias("n_blocks"), h.alias("h"), F.struct(at["order"].alias("order"), h.alias("h"), F.col("end.p").alias("p"), F.col("block").alias("item")).alias("unit"))
        levels.append(_level(up.withColumn("block", F.pmod("h", "n_blocks")), len(levels)))
    decided = None
    for k, level in reversed(list(enumerate(levels))):
        # the one left open at the top of a source is drawn by itself
        alone = (_uniform(F.lit(-1), F.col("source_id")) < F.col("end.p")).cast("int")
        if decided is None:
            level = level.withColumn("chosen_open", alone)
        else:
            level = level.join(decided, ["source_id", "block"], "left").withColumn("chosen_open", F.when(F.col("n_blocks") == 1, alone).otherwise(F.coalesce("chosen", F.lit(0)))).drop("chosen")
        each = level.select("source_id", "end", "chosen_open", F.posexplode("units").alias("at", "unit"))
        chosen = F.when(F.col("at") == F.col("end.open"), F.col("chosen_open")).otherwise(F.array_contains("end.won", F.col("at")).cast("int"))
        decided = each.select("source_id", chosen.alias("chosen"), F.col("unit.item").alias("block" if k else "item"))
    return decided


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, m, source_size, target, base, extra): the m rows alike in the first three are one unit, of
    which each row is taken `base` times, and `extra` of them once more."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = kept(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units"))
    t = kept(targets(sizes))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + 1e-12).cast("int")
    part = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("m") * (rate - base))).otherwise(0.0)
    sure = F.floor(part + 1e-12).cast("long")
    p = F.greatest(F.lit(0.0), part - sure)
    item = F.struct("doc_id", "source", "size", "m", "source_size", "target", base.alias("base"), sure.alias("sure"))
    known = units.join(t, units["source"].eqNullSafe(t["source"])).drop(t["source"])
    known = known.select("source_id", F.col("n_units").alias("n"), F.xxhash64("doc_id", "size", "source").alias("h"), "size", p.alias("p"), item.alias("item"))
    is_open = F.col("p") > 1e-12
    large, rest = large_first(known.where(is_open).withColumn("words", F.col("item.source_size")))
    both = rounded(rest).select("item", "chosen").union(large.select("item", "chosen")).union(known.where(~is_open).select("item", F.lit(0)))
    return both.select("item.*", (F.col("item.sure") + F.col("chosen")).alias("extra")).drop("sure")


def _copies(nth: str, unit: str = "") -> Column:
    return F.col(f"{unit}base") + (F.col(nth) <= F.col(f"{unit}extra")).cast("int")


def mixed(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies and taken = copies * size.

    size is the number of words; null and blank texts have none and are never in the mix's words.
    Rows alike in source, doc_id and size are one unit, whose copies are dealt to them in turn, so
    repeated rows are safe at any number. Without any words all targets are 0. Draws are hashes of
    ids, so reruns agree. Targets are found by windows over one row a source: sources are kinds of text
    by which a mix is planned; where each host is one, group hosts first. Other columns are ignored.
    """
    each = dealt(docs).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    out = each.select("doc_id", "source", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", _copies("nth").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with size, source_size, target and copy (1 and up) after their own
    columns; see mixed(). Columns named like the new ones are replaced.

    Rows alike in doc_id, source and size, repeats included, are numbered by their texts' hashes, and each
    has the copies of its number: the rows that come out for each unit are those that mixed() deals. Null
    and blank texts, and all rows if there are no words, are left out; an empty table gives an empty one.
    """
    made = ("size", "source_size", "target", "copy")
    own = [c for c in docs.columns if c not in made]
    # nulls inside a struct are equal; one exchange of the texts serves both numbering and join
    key = lambda size: F.struct("doc_id", "source", size.cast("long").alias("size")).alias("_unit")
    rows = docs.select(*own, key(word_count(F.col("text"))))
    order = Window.partitionBy("_unit").orderBy(F.xxhash64("text"), F.xxhash64(*own))
    rows = rows.withColumn("_nth", F.row_number().over(order))
    told = dealt(docs).select(key(F.col("size")), F.struct(F.col("source_size").cast("long").alias("source_size"), "target", "base", "extra").alias("_told"))
    both = rows.join(told, "_unit").withColumn("_copies", _copies("_nth", "_told.")).where("_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy")
    return both.select(*own, F.col("_unit.size").alias("size"), "_told.source_size", "_told.target", copies)
