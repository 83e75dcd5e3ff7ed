"""How filters of a corpus interact, by inclusion and exclusion over the counts of their joint failures.

For each set of filters one number is counted: the documents that fail all of them, which is the sum of
the product of their flags. The 32 counts of five filters are all that is asked of the corpus; whatever
the order of the filters, survivors, unique failures, redundancy and Shapley values follow from them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import WORD, kept, word_count
from panelscope.llm.winnow import joined

#: The flag of rows whose text a row of a smaller doc_id has.
COPY = "copy"


def few_words(text: Column, least: int = 200) -> Column:
    return word_count(text) < least


def few_different_words(text: Column, percent: int = 50) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(text: Column, percent: int = 2) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.char_length(text)


def odd_symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


@dataclass(frozen=True)
class Filters:
    """names: a letter for each filter, in the order of the flags. tests: the flag of each, from a text that isn't null;
    COPY for rows whose text a smaller doc_id has."""

    tests: dict[str, object] = field(default_factory=lambda: {"A": few_words, "B": few_different_words, "C": many_capitals, "D": odd_symbols, "E": COPY})

    @property
    def names(self) -> str:
        return "".join(self.tests)

    def subsets(self) -> range:
        """A set of filters is a number whose bit k stands for the k-th filter."""
        return range(1 << len(self.tests))


def failures(docs: DataFrame, f: Filters = Filters()) -> DataFrame:
    """(doc_id, part, <letter> ...): one boolean for each filter, never null, and one row for each row of docs.

    Null texts are empty ones; a null source is the part "". A text is a copy if any row of a smaller doc_id has the same
    one, wherever that row is; null doc_ids are neither smaller nor larger than any. Texts are told apart by SHA-256.
    Copies are looked up in a table of the texts that occur twice; those of the most frequent texts are broadcast, so that
    no task gets all copies of one.
    """
    text = F.coalesce("text", F.lit(""))
    own = {name: test(text) for name, test in f.tests.items() if test is not COPY}
    flags = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("_text"), *[c.alias(name) for name, c in own.items()]))
    if len(own) < len(f.tests):
        texts = kept(flags.groupBy("_text").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"))
        alone = flags.join(texts.select("_text"), "_text", "left_anti").withColumn("least", F.lit(None).cast("long"))
        shared = joined(flags, texts, ["_text"])
        copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
        flags = alone.unionByName(shared).withColumns({name: copy for name, test in f.tests.items() if test is COPY})
    return flags.select("doc_id", "part", *f.names)


def joint_failures(flags: DataFrame, names: str, weights: dict[str, Column]) -> DataFrame:
    """(part, <weight> ...): for each weight an array of its sums over the rows that fail all filters of a set, one for each
    set; the empty set has all rows."""
    ones = flags.select("part", *[F.col(c).cast("long").alias(c) for c in names], *[w.cast("long").alias(f"_{k}") for k, w in weights.items()])
    sets = range(1 << len(names))
    product = lambda s, w: " * ".join([c for k, c in enumerate(names) if s >> k & 1] + [f"_{w}"])
    sums = ones.groupBy("part").agg(*[F.expr(f"sum({product(s, w)})").alias(f"{w}_{s}") for w in weights for s in sets])
    return sums.select("part", *[F.array(*[f"{w}_{s}" for s in sets]).alias(w) for w in weights])


def survivors(counts: DataFrame, weights: Iterable[str], n: int) -> DataFrame:
    """counts with its arrays of joint failures turned into arrays of survivors: at each set of filters, the sum of the
    joint failures of its subsets with alternating signs. The sums of all sets are made together, a filter at a time: what
    survives a set with the filter is what survives the set without it, less those of them that fail it."""
    for k in range(n):
        bit = F.lit(1 << k)
        without = lambda w: F.transform(w, lambda x, i: F.when(i.bitwiseAND(bit) == 0, x).otherwise(F.get(F.col(w), i.bitwiseXOR(bit)) - x))
        counts = counts.withColumns({w: without(w) for w in weights})
    return counts


def shapley(failures: Column, k: int, n: int) -> Column:
    """What filter k removes, summed over all orders. A set's worth is what its filters remove together; the dividend of a
    set is its joint failures, with alternating signs, of which each of its filters gets an equal share. n! orders make
    the shares whole numbers."""
    share = lambda s: F.element_at(F.array(*[F.lit(factorial(n) // size if size % 2 else -factorial(n) // size) for size in range(1, n + 1)]), F.bit_count(s))
    shares = F.transform(failures, lambda x, s: F.when(F.getbit(s, F.lit(k)) == 1, x * share(s)).otherwise(0))
    return F.aggregate(shares, F.lit(0).cast("long"), lambda total, x: total + x)


def interactions(flags: DataFrame, labels: DataFrame, f: Filters = Filters()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each part, each
    order of the filters and each of its steps. No flags give no rows; rows of flags that repeat count each; a document
    that labels says several things of is good, or toxic, if one of them says so."""
    n, names = len(f.names), f.names
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    known = flags.select("doc_id", "part", *names).join(said, "doc_id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = joint_failures(known, names, {"all": F.lit(1), "good": is_("_good"), "toxic": is_("_toxic")})
    worth = counts.withColumns({"fails": F.array(*[F.col("all")[1 << k] for k in range(n)]), "shapley": F.array(*[shapley(F.col("all"), k, n) for k in range(n)])})
    left = survivors(worth, ("all", "good", "toxic"), n)
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, k, before, before | 1 << k))
            before |= 1 << k
    # the same few hundred rows, whatever the corpus
    table = flags.sparkSession.createDataFrame(steps, "filter_order string, step int, k int, before int, after int")
    lost = lambda w: F.col(w)[F.col("before")] - F.col(w)[F.col("after")]
    every = (1 << n) - 1
    alone = F.col("all")[F.expr(f"{every} - shiftleft(1, k)")] - F.col("all")[every]
    return left.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(F.broadcast(table), "k").select(
        "part", "filter_order", "step", F.col("all")[F.col("after")].alias("kept"), lost("all").alias("removed"), (F.col("fails")[F.col("k")] - lost("all")).alias("redundant"),
        alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley")[F.col("k")].alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, f: Filters = Filters()) -> DataFrame:
    """interactions() of the filters on docs. docs needs doc_id, text and source, labels doc_id, quality and toxic; other
    columns are ignored."""
    return interactions(failures(docs, f), labels, f)
