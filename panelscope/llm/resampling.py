"""Importance resampling: a quality classifier as the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Words and word pairs are hashed into buckets. One model has the bucket counts of the target (labelled
good text), the other those of all raw text; a document's weight is the ratio of its likelihoods.
Adding Gumbel noise to the log weights and keeping the k largest samples without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept


@dataclass(frozen=True)
class Settings:
    """buckets of the models; raw counts of smoothing for each bucket; share of
    the rows that have words to keep (None: the share of quality 1 among the labelled documents); most labelled documents
    that the target's model is fitted on, those of the least hash; seed of the noise."""

    buckets: int = 1 << 16
    smoothing: float = 3.0
    share: float | None = None
    labelled: int = 20_000
    seed: int = 11


def grams(text: str | None, buckets: int) -> tuple[np.ndarray, int]:
    """The buckets of the text's words and word pairs, A-Z in lower case, and its number of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
    return (np.r_[h * np.uint64(0x9E3779B1) >> np.uint64(7), pairs] % np.uint64(buckets)).astype(np.int64), len(words)


def models(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (target, raw) over all rows (text, target); a task sends one row for each bucket it has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"]):
                at, n = grams(text, buckets)
                if n:
                    one = np.bincount(at, minlength=buckets) if len(at) > 4096 else None
                    for k in (0, 1) if target else (1,):
                        if one is None:
                            np.add.at(sums[k], at, 1)
                        else:
                            sums[k] += one
        seen = np.flatnonzero(sums[1])
        yield pd.DataFrame({"bucket": seen, "target": sums[0, seen], "raw": sums[1, seen]})

    out = np.zeros((2, buckets))
    parts = rows.select("text", "target").mapInPandas(run, "bucket int, target long, raw long")
    for r in parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toLocalIterator():
        out[:, r["bucket"]] = r["target"], r["raw"]
    return out[0], out[1]


@dataclass(frozen=True)
class Ratio:
    """Counts of the target and of all raw text; both are smoothed so that a bucket seen in neither tells nothing."""

    target: np.ndarray
    raw: np.ndarray
    smoothing: float

    def log_weight(self, at: np.ndarray, own: bool) -> float:
        """log of the target's likelihood over the raw one, the text's own counts left out of both."""
        buckets, n = np.unique(at, return_counts=True)
        total, everything = self.target.sum() - own * len(at), self.raw.sum() - len(at)
        if total <= 0 or everything <= 0:
            return 0.0
        seen, raw = self.target[buckets] - n * own, self.raw[buckets] - n
        return float((n * np.log((seen / total * everything + self.smoothing) / (raw + self.smoothing))).sum())


def threshold(keys: DataFrame, k: int) -> int:
    """The k-th largest of the longs key_bits: a radix select, whose rounds each count at most a few thousand digits."""
    prefix, left = None, k
    for shift in (51, 39, 26, 13, 0):
        digit = F.shiftright("key_bits", shift).alias("digit")
        held = keys if prefix is None else keys.where(F.shiftright("key_bits", above) == prefix)
        for r in held.groupBy(digit).count().orderBy(F.desc("digit")).collect():
            if r["count"] >= left:
                prefix, above = r["digit"], shift
                break
            left -= r["count"]
    return prefix


def resampled(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, log_weight, sample_key and kept, one row for each row of docs.

    The target is the text of documents with a label of quality 1 and not toxic, s.labelled of them at
    most; the raw model counts all rows. Several labels of one document count as their best quality and worst toxicity. Every document is weighed
    without its own counts, so that labelled and other documents are treated alike. k is a share of the rows that have
    words; rows with keys equal to the k-th are all kept, so repeated rows stand or fall together.
    Null and blank texts have a weight and key of null and aren't kept. Without labels of the target
    all weights are 0 and the sample is uniform. Noise is a hash of doc_id, so reruns agree.
    """
    tags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    share = s.share if s.share is not None else (tags.agg(F.avg(good.cast("int"))).first()[0] or 1.0)
    chosen = tags.where(good & (F.coalesce("toxic", F.lit(0)) == 0)).orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.labelled)
    # s.labelled ids at most, so texts are never shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    target, raw = models(rows, s.buckets)
    shared = docs.sparkSession.sparkContext.broadcast(Ratio(target, raw, s.smoothing))

    @F.pandas_udf("n_words long, log_weight double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ratio = shared.value
        for texts, own in batches:
            found = [(*grams(t, s.buckets), o) for t, o in zip(texts, own)]
            yield pd.DataFrame({"n_words": [n for _, n, _ in found], "log_weight": [ratio.log_weight(at, o) for at, _, o in found]})

    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    scored = rows.select("doc_id", score("text", "target").alias("s")).select("doc_id", "s.*")
    scored = scored.withColumn("log_weight", F.when(F.col("n_words") > 0, F.col("log_weight"))).withColumn("sample_key", F.col("log_weight") + noise)
    scored = kept(scored.withColumn("key_bits", _ordered(F.col("sample_key"))))
    n = scored.where("sample_key is not null").count()
    k = max(1, round(share * n))
    least = threshold(scored.where("sample_key is not null").select("key_bits"), k) if n else 0
    return scored.select("doc_id", "n_words", "log_weight", "sample_key", F.coalesce(F.col("key_bits") >= least, F.lit(False)).alias("kept"))


def _ordered(key: Column) -> Column:
    """A long in the order of the key: its value in units of 2**-32, held within 2**30; null for null."""
    held = F.greatest(F.lit(-(2.0**30)), F.least(F.lit(2.0**30), key))
    return F.when(key.isNotNull(), F.floor(held * float(1 << 32)).cast("long"))
