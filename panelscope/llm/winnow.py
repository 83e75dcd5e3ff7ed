"""Winnowed anchors: where two texts could share a run of `window` units, and what may differ there.

Every window's anchor is its least-hashed gram, so equal windows have equal anchors at equal offsets.
Neighbouring windows that share an anchor form a segment, and a text is a chain of segments. Segments
are compared in place of windows: those with one anchor and one content form a class: both are hashed
by polynomials of their own, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import RollingHash, kept, mixed, packed, sliding_minimum

HASHES = RollingHash(0x9E3779B97F4A7C15), RollingHash(0xC2B2AE3D27D4EB4F)

SEGMENT = "row long, doc_id long, anchor long, content long, first int, count int, off int"
#: What a row is known by: a hash of its text, and its doc_id or a second hash. Repeated rows share both, and share what
#: is found for them.
ROW = ["row", "doc_id"]
#: A key is heavy if more than one in so many rows have it; there can't be more heavy keys than that.
HEAVY = 2000


def text_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.sha1(F.col("text").cast("binary")), "doc_id")


def joined(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """left with the other columns of right, which has each of its keys once and says in n how many rows of left have it.
    Heavy keys, HEAVY of them at most, are broadcast, so that their rows stay where they are and no task gets them all."""
    made = [c for c in right.columns if c not in (*keys, n)]
    total = right.agg(F.sum(n)).first()[0] or 0
    told = right.select(*keys, (F.col(n) > total / HEAVY).alias("heavy"), F.struct(F.lit(1).alias("_"), *made).alias("told"))
    first = left.join(F.broadcast(told.where("heavy").drop("heavy")), keys, "left")
    rest = first.where("told is null").drop("told").join(told.where("not heavy").drop("heavy"), keys)
    return first.where("told is not null").unionByName(rest).select(*left.columns, *[f"told.{c}" for c in made])


@dataclass(frozen=True)
class Units:
    """How a text becomes 64-bit units, how long a repeat is, and how long a gram."""

    split: Callable[[str | None], np.ndarray]
    window: int
    gram: int


def segments(values: np.ndarray, u: Units) -> dict[str, np.ndarray]:
    """first: the segment's first window; count: its windows; off: its anchor's distance from first."""
    if len(values) < u.window:
        empty = np.zeros(0, np.int64)
        return {"anchor": empty, "content": empty, "first": empty, "count": empty, "off": empty}
    at = np.arange(len(values) - u.gram + 1)
    grams = HASHES[0].runs(HASHES[0].prefix(values), at, at + u.gram)
    anchors = sliding_minimum(grams, u.window - u.gram + 1)
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    count = np.diff(np.r_[first, len(anchors)])
    end = first + count + u.window - 1
    anchor = anchors[first]
    content = HASHES[1].runs(HASHES[1].prefix(values), first, end).view(np.int64)
    return {"anchor": mixed(grams[anchor]).view(np.int64), "content": content, "first": first, "count": count, "off": anchor - first}


def ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the lengths n, one after another: each element's run, and its place in the run."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def windows(values: np.ndarray, start: np.ndarray, u: Units) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the windows that start there."""
    return tuple(h.runs(h.prefix(values), start, start + u.window).view(np.int64) for h in HASHES)


def segment_table(docs: DataFrame, u: Units) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [segments(u.split(t), u) for t in batch["text"]]
            n = [len(f["first"]) for f in found]
            if sum(n):
                out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
                yield pd.DataFrame({"row": np.repeat(batch["row"].to_numpy(), n), "doc_id": np.repeat(batch["doc_id"].to_numpy(), n), **out})

    return docs.select("row", "doc_id", "text").mapInPandas(run, SEGMENT)


def shared_segments(docs: DataFrame, u: Units, *, across: bool) -> tuple[DataFrame, DataFrame]:
    """The segments whose anchor occurs again (across: in a document of another doc_id), and their classes: (anchor,
    content, owner, n, variants), owner being the class's least segment, n the number of its segments, and variants the
    number of classes that the anchor has."""
    found = kept(segment_table(docs, u))
    again = F.min("doc_id") < F.max("doc_id") if across else F.count("*") > 1
    anchors = kept(found.groupBy("anchor").agg(F.count("*").alias("n"), again.alias("again")).where("again").drop("again"))
    shared = kept(joined(found, anchors, ["anchor"]))
    owner = F.min(F.struct("doc_id", "row", "first", "count", "off")).alias("owner")
    classes = kept(shared.groupBy("anchor", "content").agg(owner, F.count("*").alias("n")))
    variants = kept(classes.groupBy("anchor").agg(F.count("*").alias("variants")).withColumn("total", F.col("variants")))
    return shared, joined(classes, variants, ["anchor"], "total")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, doc_id, text, items) for the rows of `wanted`, text packed; items lists its other columns, one text's own segments."""
    items = wanted.groupBy(*ROW).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in ROW])).alias("items"))
    return packed(docs.select(*ROW, "text")).join(items, ROW).dropDuplicates(ROW)
