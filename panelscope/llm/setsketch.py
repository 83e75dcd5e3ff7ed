"""Near-duplicates by SetSketch: registers of exponentially spaced, truncated minima.

An element of a set has an exponentially distributed value for each register, and a register keeps the
least value of its set on a logarithmic scale, so that sketches of two sets give that of their union by
the greater registers. Two sets agree in a register about as often as their Jaccard similarity says:
bands of registers lead similar sets to the same buckets. From how many registers of one set are above,
below and equal to the other's, and from both sizes, the similarity is estimated by its likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept, mixed
from panelscope.llm.linking import Likeness, linked
from panelscope.llm.simhash import shingle_set, text_key
from panelscope.llm.winnow import joined

#: Shingles whose values are made at once.
CHUNK = 1 << 18


@dataclass(frozen=True)
class SetSketch:
    """shingle: words in a shingle. percent: least similarity of linked sets. bands of rows registers each lead to buckets;
    registers is a prime number, at least bands * rows. base and rate: the registers' scale (b and a), of 16 bits. A pair is
    left out where the likelihood of the least similarity is exp(-doubt) of the greatest or less: five deviations."""

    shingle: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 5
    registers: int = 163
    base: float = 1.001
    rate: float = 20.0
    doubt: float = 12.5

    @cached_property
    def like(self) -> Likeness:
        return Likeness(2 * self.registers, self.keys, self.near, self.alike)

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """A mix of each band's registers; the lowest bits are the band's number, so that bands don't meet."""
        k = sketches.view("<u2")[:, : self.bands * self.rows].reshape(len(sketches), self.bands, self.rows).astype(np.uint64)
        key = np.zeros(k.shape[:2], np.uint64)
        for j in range(self.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + k[:, :, j] + np.uint64(1))
        return (key // np.uint64(self.bands) * np.uint64(self.bands) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def share(self, x: np.ndarray) -> np.ndarray:
        """The probability that a register is above the other's, for a set with the share x of its own in the sum of sizes."""
        return -np.log1p(-x * (self.base - 1) / self.base) / np.log(self.base)

    def likelihood(self, j: np.ndarray, u: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
        p, q = self.share(np.maximum(u - (1 - u) * j, 1e-12)), self.share(np.maximum(1 - u - u * j, 1e-12))
        return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    def estimate(self, u: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The most likely similarity for registers so fine that share(x) is x, which is the root of a quadratic equation. u: the
        first set's size in the sum of both; counts: registers of the first above, below and equal to the other's."""
        above, below, equal = counts
        v, n = 1 - u, above + below + equal
        b = equal * (u * u + v * v) + above * v * v + below * u * u
        return (b - np.sqrt(np.maximum(b * b - 4 * n * equal * (u * v) ** 2, 0))) / (2 * n * u * v)

    def near(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which pairs of sketches may be of sets as similar as linked ones are."""
        fit = 100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)
        at = np.flatnonzero(fit)
        if len(at):
            x, y = a[at].view("<u2"), b[at].view("<u2")
            above, equal = (x > y).sum(1).astype(float), (x == y).sum(1).astype(float)
            counts = (above, self.registers - above - equal, equal)
            u = n_a[at] / (n_a[at] + n_b[at])
            # the likelihood ends where the smaller set is a part of the larger
            most = np.minimum(u / (1 - u), (1 - u) / u) * (1 - 1e-9)
            least, best = np.minimum(self.percent / 100, most), np.minimum(self.estimate(u, counts), most)
            worse = self.likelihood(best, u, *counts) - self.likelihood(least, u, *counts)
            fit[at] = (best >= least) | (worse < self.doubt)
        return fit

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, registers) of 16 bits; 0 throughout for an empty set.

        An element's values are one in each of `registers` equal parts of the probability, dealt to the registers in an
        order of its own: its k-th least value goes to the k-th register of that order. So part by part is made, of the sets
        that still have an empty register; what later parts hold is larger.
        """
        m = self.registers
        least = np.full((len(sets), m), 2**64 - 1, np.uint64)
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        begin = 0
        while begin < len(sets):
            end = max(begin + 1, int(np.searchsorted(np.cumsum(size[begin:]), CHUNK, side="right")) + begin)
            self._fill(least[begin:end], np.concatenate(sets[begin:end]), np.repeat(np.arange(end - begin), size[begin:end]))
            begin = end
        part = (least >> np.uint64(32)).astype(float) + ((least & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) / 2**32
        with np.errstate(divide="ignore", invalid="ignore"):
            value = -np.log1p(-part / m) / self.rate
            register = np.floor(1 - np.log(value) / np.log(self.base))
        register[size == 0] = 0
        return np.clip(register, 0, 65535).astype("<u2")

    def _fill(self, least: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> None:
        m, flat = np.uint64(self.registers), least.reshape(-1)
        for k in range(self.registers):
            if not len(hashes):
                break
            if k % 4 == 0:
                spread = mixed(hashes + np.uint64(0xD1B54A32D192ED03))
                first, step = spread % m, (spread >> np.uint64(32)) % (m - np.uint64(1)) + np.uint64(1)
            at = ((first + np.uint64(k) * step) % m).astype(np.int64) + of * self.registers
            value = mixed(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(32) | np.uint64(k) << np.uint64(32)
            np.minimum.at(flat, at, value)
            if k < 8 or k % 4 == 3:
                open_ = (least == np.uint64(2**64 - 1)).any(1)[of]
                if not open_.all():
                    hashes, of = hashes[open_], of[open_]
                    first, step = first[open_], step[open_]


CONTRACT = SetSketch()


def sketched(docs: DataFrame, p: SetSketch) -> DataFrame:
    """(doc_id, k1, k2, node, size, sketch) for every row; node stands for the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sets = [shingle_set(t, p.shingle) for t in batch["text"].to_pylist()]
                known = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                data = [row.tobytes() for row in p.sketches(sets)]
                columns = [*(batch[c] for c in ("doc_id", "k1", "k2")), pa.array(known, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "known", "size", "sketch"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key())
    made = keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, known long, size long, sketch binary")
    return made.select("doc_id", "k1", "k2", F.xxhash64("known", "size", "sketch").alias("node"), "size", "sketch")


def near_duplicates(docs: DataFrame, p: SetSketch = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs: n_shingles is the number of different shingles,
    component_id the smallest doc_id reachable over links, and kept says that it is the row's own.

    Rows with one shingle set are one node, so a group of copies costs one row. A text of fewer words than a shingle has is
    one shingle; a null or blank text has none and is linked with nothing. Repeated rows give repeated rows; a row with a null
    doc_id takes part, but never gives a component its id unless all of them are null, and is kept only then. Other
    columns are ignored.
    """
    rows = kept(sketched(docs, p))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first")
    nodes = kept(rows.where("size > 0").groupBy("node").agg(first, F.count("*").alias("n"), F.first("sketch").alias("sketch"), F.first("size").alias("size")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """From one text of each, which is looked up by its row's id as well, as many rows may have it."""
        of = nodes.join(wanted, "node", "left_semi").select("node", F.struct("first.doc_id", "first.k1", "first.k2").alias("key"))
        texts = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *text_key()).alias("key"), "text").join(of, "key").select("node", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [shingle_set(t, p.shingle).tobytes() for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(made, pa.binary())], names=["node", "set"])

        return texts.dropDuplicates(["node"]).mapInArrow(run, "node long, set binary")

    roots = linked(nodes.select("node", "sketch", "size"), sets_of, p.like)
    of = kept(nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = of.join(of.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "n", F.col("least.doc_id").alias("component_id"))
    full = joined(rows.where("size > 0").select("doc_id", "size", "node"), named, ["node"])
    empty = rows.where("size = 0").select("doc_id", "size", "node", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
