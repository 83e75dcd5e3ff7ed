"""Quality rules: counts that decide by themselves, and divergence from how a language looks.

A document's histograms of character classes and of common words are compared with references of its
language by Jensen-Shannon distance. References are means of the histograms of all documents of the
language, so long documents don't outweigh others; documents too short for a histogram to mean
anything are spared the comparison.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm.common import hash_words, kept

#: The symbol characters that are counted (fixed values).
SYMBOLS = "#*$%&|<>"
#: ASCII white space, which ends words.
SPACE = " \t\n\v\f\r"
CLASSES = 8


@dataclass(frozen=True)
class Limits:
    """Least words, most repeated words in 100; largest distances from the language's reference, and the least words
    and characters with which a distance counts; word buckets, and how many of them are common. A histogram of few
    words is far from any by chance, so the limit on word_distance is widened by one over the root of the words."""

    words: int = 50
    repeated: int = 50
    char_distance: float = 0.22
    word_distance: float = 0.2
    least_chars: int = 200
    least_words: int = 50
    buckets: int = 4096
    common: int = 24


#: Languages whose sums a task holds before it sends them on.
HELD = 256


@cache
def char_classes() -> np.ndarray:
    """The class of each code point: lower, upper, other letters, digits, spaces, punctuation, symbols, rest."""
    kinds = {"Ll": 0, "Lu": 1, "L": 2, "N": 3, "Z": 4, "P": 5, "S": 6}
    out = np.full(sys.maxunicode + 1, 7, np.uint8)
    for c in range(len(out)):
        kind = unicodedata.category(chr(c))
        out[c] = kinds.get(kind, kinds.get(kind[0], 7))
    out[[ord(c) for c in SPACE]] = 4
    out[[ord(c) for c in SYMBOLS]] = 6
    return out


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(char_classes()[points], minlength=CLASSES)


def word_histogram(words: list[bytes], buckets: int) -> np.ndarray:
    if not words:
        return np.zeros(buckets, np.int64)
    return np.bincount(np.fromiter(map(crc32, words), np.int64, len(words)) % buckets, minlength=buckets)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms, row by row: 0 to 1."""
    p, q = (x / np.maximum(x.sum(-1, keepdims=True), 1e-300) for x in (p, q))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.nan_to_num(p * np.log2(p / m)) + np.nan_to_num(q * np.log2(q / m))
    return np.sqrt(np.maximum(parts.sum(-1) / 2, 0))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if len(words) > 3:
        h = hash_words(words)
        triple = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:]
        _, which, n = np.unique(triple, return_inverse=True, return_counts=True)
        again = n[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _common(histogram: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The common buckets' shares, and the rest as one more."""
    own = histogram[buckets]
    return np.r_[own, histogram.sum() - own.sum()]


REFERENCE = "key string, chars array<double>, buckets array<int>, words array<double>"


def references(docs: DataFrame, p: Limits = Limits()) -> DataFrame:
    """(key, chars, buckets, words), one row for each language, and one with a null key for all documents: the mean
    class histogram, the common buckets and their mean shares with the rest. Means are over all documents that are long
    enough; each task sends rows of sums for the languages it has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str | None, np.ndarray] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for key, s in sums.items():
                at = np.flatnonzero(s)
                yield pd.DataFrame({"key": pd.Series([key] * len(at), dtype=object), "at": at, "x": s[at]})
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                if text and len(text) >= p.least_chars and len(words) >= p.least_words:
                    one = np.r_[char_histogram(text) / len(text), word_histogram(words, p.buckets) / len(words)]
                    for key in {None, lang}:
                        sums[key] = sums.get(key, 0) + one
            if len(sums) > HELD:
                yield from sent()
        yield from sent()

    parts = docs.select("text", "lang").mapInPandas(run, "key string, at int, x double")
    sums = kept(parts.groupBy("key", "at").agg(F.sum(F.round("x", 9).cast("decimal(38,9)")).cast("double").alias("x")))
    # a language has CLASSES + p.buckets rows at most
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("x"), "at"))
    common = sums.where(F.col("at") >= CLASSES).withColumn("rank", rank).where(F.col("rank") <= p.common)
    common = common.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", (F.col("at") - CLASSES).alias("bucket"), "x"))).alias("top"))
    class_sum = [F.coalesce(F.sum(F.when(F.col("at") == k, F.col("x"))), F.lit(0.0)) for k in range(CLASSES)]
    # a mean document's shares of words add up to what its shares of characters do
    of = sums.groupBy("key").agg(F.array(*class_sum).alias("chars"), F.sum(F.when(F.col("at") >= CLASSES, F.col("x"))).alias("all_words"))
    both = of.join(common, of["key"].eqNullSafe(common["key"])).select(of["*"], "top")
    seen = F.transform("top", lambda t: t["x"])
    rest = F.col("all_words") - F.aggregate(seen, F.lit(0.0), lambda s, x: s + x)
    return kept(both.select("key", "chars", F.transform("top", lambda t: t["bucket"]).alias("buckets"), F.concat(seen, F.array(rest)).alias("words")))


def judged(docs: DataFrame, p: Limits = Limits()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed and kept after its own columns.

    base_failed: under p.words words, or over p.repeated in 100 words repeated. kept: neither that nor a
    distance over its limit. Distances are null below the least lengths, and where no reference was
    learned; a null language, and one without a document long enough, is compared with the reference of
    all documents. References are joined by language, so their number has no limit. A null text has no
    words, so it isn't kept. Whole texts count; a row's verdict doesn't depend on its repeats
    but for their part in the means. Columns named like the new ones are replaced.
    """
    made = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "char_distance": pa.float64(), "word_distance": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_()}
    known = references(docs, p)
    for_all = known.where("key is null").first()
    held = docs.select(F.struct(*[c for c in docs.columns if c not in made]).alias("own"), "text", F.col("lang").alias("_lang"))
    by_language = known.where("key is not null").select("key", F.struct("chars", "buckets", "words").alias("reference"))
    held = held.join(by_language, F.col("_lang") == F.col("key"), "left").select("own", "text", "reference")

    def arrays(reference: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        return None if reference is None else tuple(np.array(reference[c], k) for c, k in (("chars", float), ("buckets", int), ("words", float)))

    pooled = arrays(for_all.asDict() if for_all else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"].to_pylist(), batch["reference"]):
                n = counts(text)
                far = [None, None]
                if text and pooled and len(text) >= p.least_chars and n[0] >= p.least_words:
                    chars, buckets, common = arrays(own.as_py()) or pooled
                    words = word_histogram(text.encode("utf-8", "surrogatepass").split(), p.buckets)
                    far = [float(distance(char_histogram(text), chars)), float(distance(_common(words, buckets), common))]
                failed = n[0] < p.words or 100 * n[4] > p.repeated * n[0]
                odd = far[0] is not None and (far[0] > p.char_distance or far[1] > p.word_distance + n[0] ** -0.5)
                rows.append((*n, *far, failed, not failed and not odd))
            columns = zip(*rows) if rows else [[]] * len(made)
            yield pa.RecordBatch.from_arrays([batch["own"], *(pa.array(list(c), k) for c, k in zip(columns, made.values()))], names=["own", *made])

    kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}
    schema = T.StructType([held.schema["own"], *(T.StructField(c, kinds[k]) for c, k in made.items())])
    return held.mapInArrow(run, schema).select("own.*", *made)
