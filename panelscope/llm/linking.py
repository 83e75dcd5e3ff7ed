"""Links between sets that share buckets, confirmed on the sets, with no bucket paired in full.

First each node is compared with the node that it shares most buckets with; then members of different
components are compared in the buckets that hold several, block by block: by their sketches, and what
these leave by the sets themselves. A pair is looked at in the first bucket that it shares, and a link
makes two components one, so that what comes out grows with the nodes and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept
from panelscope.llm.components import connected_components
from panelscope.llm.winnow import joined

#: Members of a bucket's block, and 64-bit numbers of its sets, about: what a task holds at once is two blocks.
BLOCK, VALUES = 256, 1 << 21
#: Pairs of sketches compared at once.
STEP = 1 << 16


@dataclass(frozen=True)
class Likeness:
    """width: bytes of a sketch. keys: for sketches (n, width) the keys of their buckets, one column for each band, of which
    no two have keys in common. near: for sketches (n, width) and sizes of nodes and of as many others, which may be alike.
    alike: whether two sets, sorted numbers, are."""

    width: int
    keys: Callable[[np.ndarray], np.ndarray]
    near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    alike: Callable[[np.ndarray, np.ndarray], bool]


def sketches_of(data: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), width)


def buckets(nodes: DataFrame, like: Likeness) -> DataFrame:
    """(key, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = like.keys(sketches_of(batch["sketch"], like.width))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch["node"].to_numpy(), keys.shape[1]))], names=["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long")


def near_pairs(pairs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs (u, v) whose sketches are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                (a, n_a), (b, n_b) = ((sketches_of(batch[f"sketch_{x}"], like.width), batch[f"size_{x}"].to_numpy()) for x in "uv")
                yield batch.select(["u", "v"]).filter(pa.array(like.near(a, n_a, b, n_b)))

    for x in "uv":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("size").alias(f"size_{x}")), x)
    return pairs.select("u", "v", "sketch_u", "size_u", "sketch_v", "size_v").mapInArrow(run, "u long, v long")


def alike_pairs(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs (u, v) whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [like.alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(batch["set_u"], batch["set_v"])]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    for x in "uv":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")), x)
    return pairs.select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted batches, cut where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch[c].to_numpy() for c in by], axis=1)
        end = int(np.flatnonzero((keys == keys[-1]).all(1))[0])
        if held and (end or any(held[-1][c][len(held[-1]) - 1].as_py() != batch[c][0].as_py() for c in by)):
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = []
        elif end:
            yield pa.Table.from_batches([batch.slice(0, end)])
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def _near_in_groups(rows: pa.Table, by: list[str], like: Likeness) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): places of rows of one group that may be alike, are of different roots and, between blocks, of different ones,
    and whose first common band is the group's. A few at a time, with no group's pairs all at once."""
    keys = rows.select(by).to_pandas().to_numpy()
    root, block, size = (rows[c].to_numpy() for c in ("root", "block", "size"))
    sketch = sketches_of(rows["sketch"].combine_chunks(), like.width)
    bands = like.keys(sketch)
    band, inner = np.argmax(bands == keys[:, :1], axis=1), keys[:, 1] == keys[:, 2]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
    end = np.repeat(np.r_[first[1:], len(keys)], np.diff(np.r_[first, len(keys)]))
    after = end - np.arange(len(keys)) - 1
    sums = np.cumsum(after)
    low = 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + STEP, side="right")))
        a = np.repeat(np.arange(low, high), after[low:high])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[low:high]) - after[low:high], after[low:high])
        low = high
        for use in (
            lambda a, b: (root[a] != root[b]) & (inner[a] | (block[a] != block[b])),
            lambda a, b: np.argmax(bands[a] == bands[b], axis=1) == band[a],
            lambda a, b: like.near(sketch[a], size[a], sketch[b], size[b]),
        ):
            ok = use(a, b)
            a, b = a[ok], b[ok]
        yield a, b


def _cells(contested: DataFrame) -> DataFrame:
    """contested (key, node, root, size, n, total), dealt to cells (key, i, j) in which block i meets block j."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / VALUES))
    dealt = contested.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "size")


def across(members: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, like: Likeness) -> DataFrame:
    """(u, v): confirmed links between different components in the buckets of members (key, node), enough to join all that a
    pair of any bucket joins."""
    own = nodes.select("node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = kept(members.join(own, "node"))
    mixed = kept(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("total")).where("lo < hi").select("key", "n", F.col("n").alias("bucket"), "total"))
    contested = kept(joined(placed, mixed, ["key"]).withColumnRenamed("bucket", "n"))
    by = ["key", "i", "j"]

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, by):
            found = np.zeros(len(rows), bool)
            for a, b in _near_in_groups(rows, by, like):
                found[a] = found[b] = True
            yield from rows.select([*by, "block", "node", "root"]).filter(pa.array(found)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}  # roots that this task has linked

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        for rows in _whole_groups(batches, by):
            node, root = rows["node"].to_numpy(), rows["root"].to_numpy().tolist()
            sets, links = rows["set"].combine_chunks(), []
            held = lambda k: np.frombuffer(sets[k].as_buffer(), np.uint64)
            for a, b in _near_in_groups(rows, by, like):
                for i, j in zip(a.tolist(), b.tolist()):
                    x, y = top(root[i]), top(root[j])
                    if x != y and like.alike(held(i), held(j)):
                        links.append((node[i], node[j]))
                        above[max(x, y)] = min(x, y)
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sketched = nodes.select("node", "sketch")
    cells = _cells(contested).join(sketched, "node").repartition(*by).sortWithinPartitions(*by)
    near = kept(cells.select(*by, "block", "node", "root", "size", "sketch").mapInArrow(sieve, "key long, i long, j long, block long, node long, root long"))
    held = near.join(nodes.select("node", "sketch", "size"), "node").join(sets, "node").repartition(*by).sortWithinPartitions(*by)
    return held.select(*by, "block", "node", "root", "size", "sketch", "set").mapInArrow(confirm, "u long, v long").distinct()


def linked(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], like: Likeness) -> DataFrame:
    """(node, root) of the nodes that have a link, by components of all links that the buckets lead to. nodes: (node, sketch,
    size), a node once. sets_of: the sets (node, set) of the nodes it is given, which are those that share a bucket."""
    placed = kept(buckets(nodes, like))
    shared = placed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    members = kept(joined(placed, kept(shared), ["key"]))
    met = members.select("node", F.when(F.col("lo") != F.col("node"), F.col("lo")).otherwise(F.col("hi")).alias("met"))
    # two that share a bucket by chance alone are told apart by their sketches
    times = kept(met.groupBy("node", "met").agg(F.count("*").alias("times")))
    pairs = times.groupBy("node").agg(F.max(F.struct("times", "met")).alias("best")).select(F.least("node", "best.met").alias("u"), F.greatest("node", "best.met").alias("v")).distinct()
    close = kept(near_pairs(pairs, nodes, like))
    sets = kept(sets_of(members.select("node").distinct()))
    roots = kept(connected_components(alike_pairs(close, sets, like)))
    more = across(members.select("key", "node"), nodes, sets, roots, like)
    return connected_components(roots.select(F.col("root").alias("u"), F.col("node").alias("v")).where("u <> v").union(more))
