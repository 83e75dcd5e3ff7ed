"""Removal of repeated byte strings: a suffix array by a distributed merge sort that knows common prefixes.

The suffix array is sparse. Equal strings of `length` bytes have equal winnowed anchors at equal
offsets, so only suffixes that start at an anchor are sorted, one for each content that an anchor's
segment takes, with the number of times that it does; a segment whose anchor occurs once has no
repeat. The array is in order of the anchors' hashes and then of bytes, so that ranges of equal width
are even, and need no sample. Each task sorts the suffixes it has into a run and front-codes it: an
entry is the length of the prefix shared with the entry before, and the rest. Runs are exchanged by
range, and each range is merged by a loser tree that compares two entries from the prefix on which
both agree with the last output, so that no known byte is read again. The merge leaves the shared
prefixes of neighbours; suffixes of one anchor stand together. A content that occurs more than once
repeats in whole; the window that begins d bytes before the anchor repeats if two contents share
length - d bytes from the anchor on and d bytes before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm.common import kept, packed, unpacked
from panelscope.llm.winnow import ROW, Units, joined, ragged, shared_segments, text_hash, windows, with_texts

LENGTH = 200
#: Suffixes in a sorted run, and in a range that one task merges, about.
RUN, RANGE = 1 << 14, 1 << 14
#: Bytes of an anchor's hash, which come before those of the suffix.
HEAD = 8
#: Up to so many contents of one anchor are compared in pairs, beyond by classes of shared bytes; an anchor with more
#: than CROWD is spread over tasks by the fingerprints of its windows.
PAIRS, CROWD = 24, 20_000

TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def units(length: int = LENGTH) -> Units:
    return Units(lambda text: TABLE[np.frombuffer(as_bytes(text), np.uint8)], length, max(1, length // 6))


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Of each with the one before; 0 for the first."""
    size = np.array(list(map(len, strings)), np.int64)
    if not len(size):
        return size
    table = np.zeros((len(strings), size.max() + 1), np.uint8)
    table[np.arange(table.shape[1]) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    out = np.zeros(len(strings), np.int64)
    differ = table[1:] != table[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def decoded(shared: np.ndarray, size: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 0, b""
    for n, m in zip(shared.tolist(), size.tolist()):
        end = at + m - n
        last = last[:n] + rests[at:end]
        at = end
        yield n, last


def _mismatch(a: bytes, b: bytes, at: int) -> int:
    """The first position from `at` on where a and b differ, else the length of the shorter."""
    n = min(len(a), len(b))
    while at + 16 <= n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return at


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, prefix shared with the entry before) of all entries in order, by a loser tree.

    Each run gives (prefix shared with its entry before, entry). The tree keeps for each run the
    prefix its head shares with the last output; of two heads the one that shares more comes first,
    and only on a tie are bytes compared, from that prefix on.
    """
    k = len(runs)
    heads: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, run in enumerate(runs):
        heads[i] = next(run, (0, None))[1]

    def first(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), with the loser's prefix set to what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        at = _mismatch(x, y, shared[a])
        if x[at : at + 1] > y[at : at + 1]:
            a, b = b, a
        shared[b] = at
        return a, b

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, losers[node] = first(build(2 * node), build(2 * node + 1))
        return a

    best = build(1) if k > 1 else 0
    while heads[best] is not None:
        yield best, shared[best]
        shared[best], heads[best] = next(runs[best], (0, None))
        node = (best + k) // 2
        while node:
            best, losers[node] = first(best, losers[node])
            node //= 2


SPANS = "anchor long, content long, at int, count int"
RUNS = "range int, shared binary, size binary, rests binary, left_size binary, lefts binary, anchor binary, content binary, count binary, n binary"


def sorted_runs(material: DataFrame, ranges: int) -> DataFrame:
    """Front-coded runs by range of the anchor's hash, so that an anchor's suffixes stay together."""

    def one(part: pd.DataFrame) -> Iterator[dict]:
        anchors = part["anchor"].to_numpy(np.int64).view(np.uint64)
        heads = anchors.astype(">u8").tobytes()
        keys = [heads[HEAD * i : HEAD * i + HEAD] + c[o:] for i, (c, o) in enumerate(zip(part["bytes"], part["off"]))]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        part = part.iloc[order]
        keys = [keys[k] for k in order]
        lefts = [c[:o] for c, o in zip(part["bytes"], part["off"])]
        to = (anchors[order] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        for k in np.unique(to):
            at = np.flatnonzero(to == k)
            mine, shared = [keys[i] for i in at], shared_prefixes([keys[i] for i in at])
            numbers = {c: part[c].to_numpy(np.int64)[at].tobytes() for c in ("anchor", "content", "count", "n")}
            yield {
                "range": k, "shared": shared.astype(np.int32).tobytes(), "size": np.array(list(map(len, mine)), np.int32).tobytes(), "rests": b"".join(x[n:] for x, n in zip(mine, shared.tolist())),
                "left_size": np.array([len(lefts[i]) for i in at], np.int32).tobytes(), "lefts": b"".join(lefts[i] for i in at), **numbers,
            }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= RUN:
                yield pd.DataFrame(list(one(pd.concat(held, ignore_index=True))))
                held, n = [], 0
        if n:
            yield pd.DataFrame(list(one(pd.concat(held, ignore_index=True))))

    return material.select("anchor", "content", "count", "off", "n", "bytes").mapInPandas(run, RUNS)


@dataclass
class Entry:
    """A suffix: the bytes before its anchor, the class that it stands for, its windows, and how often it occurs."""

    left: bytes
    anchor: int
    content: int
    count: int
    n: int

    @property
    def least(self) -> int:
        """The least distance from a window of the segment to the anchor; the greatest is len(left)."""
        return len(self.left) - self.count + 1

    def span(self, least: int, most: int) -> tuple[int, int, int, int]:
        """(anchor, content, at, count) of the windows at these distances, at being the first one's place in the segment."""
        return self.anchor, self.content, len(self.left) - most, most - least + 1


def _repeats_in_pairs(group: list[Entry], shared: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    for i, a in enumerate(group):
        ahead = length
        for j in range(i + 1, len(group)):
            ahead = min(ahead, shared[j])
            b = group[j]
            back = _mismatch(a.left[::-1], b.left[::-1], 0)
            if back + ahead < length:
                continue
            for x in (a, b):
                least, most = max(length - ahead, x.least), min(back, len(x.left))
                if x.n == 1 and least <= most:
                    yield x.span(least, most)


def _repeats_in_classes(group: list[Entry], shared: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """For each distance: entries are alike if they share enough after the anchor, by the runs of the shared prefixes,
    and before it, by those of the reversed bytes in their own order."""
    reverse = [e.left[::-1] for e in group]
    order = sorted(range(len(group)), key=reverse.__getitem__)
    behind = shared_prefixes([reverse[k] for k in order])
    ahead = np.array(shared)
    least, most = np.array([e.least for e in group]), np.array([len(e.left) for e in group])
    single = np.array([e.n == 1 for e in group])
    for d in range(max(0, int(least.min())), int(most.max()) + 1):
        here = np.flatnonzero((least <= d) & (d <= most))
        if len(here) < 2:
            continue
        by_left = np.empty(len(group), np.int64)
        by_left[order] = np.cumsum(behind < d)
        alike = np.cumsum(ahead < length - d)[here] * len(group) + by_left[here]
        _, which, n = np.unique(alike, return_inverse=True, return_counts=True)
        for k in here[(n[which] > 1) & single[here]].tolist():
            yield group[k].span(d, d)


def merged_runs(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, content, at, count): the windows of each class that repeat."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        numbers = lambda c, kind: [np.frombuffer(x, kind) for x in part[c]]
        size, left_size = numbers("size", np.int32), numbers("left_size", np.int32)
        sources = [decoded(s, z, r) for s, z, r in zip(numbers("shared", np.int32), size, part["rests"])]
        left_end = [np.cumsum(x) for x in left_size]
        anchor, content, count, n = (numbers(c, np.int64) for c in ("anchor", "content", "count", "n"))
        following = [0] * len(sources)
        found: list[tuple[int, int, int, int]] = []
        group: list[Entry] = []
        shares: list[int] = []

        def close() -> None:
            found.extend(e.span(e.least, len(e.left)) for e in group if e.n > 1)
            if len(group) > 1:
                found.extend((_repeats_in_pairs if len(group) <= PAIRS else _repeats_in_classes)(group, shares, length))

        lefts = part["lefts"].to_list()
        for k, shared in merged(sources):
            i = following[k]
            following[k] += 1
            if group and shared < HEAD + gram:
                close()
                group, shares = [], []
            end = int(left_end[k][i])
            group.append(Entry(lefts[k][end - int(left_size[k][i]) : end], int(anchor[k][i]), int(content[k][i]), int(count[k][i]), int(n[k][i])))
            shares.append(shared - HEAD if len(group) > 1 else 0)
        close()
        return pd.DataFrame(found, columns=["anchor", "content", "at", "count"]).astype("int64")

    return runs.groupBy("range").applyInPandas(merge, SPANS)


def _material(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """The bytes of one segment of each class."""
    wanted = classes.select("owner.row", "owner.doc_id", "anchor", "content", "owner.first", "owner.count", "owner.off", "n", "variants")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text, items in zip(batch["text"], batch["items"]):
                data = as_bytes(unpacked(text))
                found += [(*i.values(), data[i["first"] : i["first"] + i["count"] + length - 1]) for i in items]
            yield pd.DataFrame(found, columns=["anchor", "content", "first", "count", "off", "n", "variants", "bytes"])

    return with_texts(docs, wanted).mapInPandas(run, "anchor long, content long, first int, count int, off int, n long, variants long, bytes binary")


def _by_window(material: DataFrame, u: Units) -> DataFrame:
    """(anchor, content, at, count) of repeated windows by their fingerprints: an exact way for anchors with more than CROWD contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                size = x["bytes"].str.len().to_numpy(np.int64)
                which, k = ragged(x["count"].to_numpy(np.int64))
                values = TABLE[np.frombuffer(b"".join(x["bytes"]), np.uint8)]
                w1, w2 = windows(values, (np.cumsum(size) - size)[which] + k, u)
                yield pd.DataFrame({"w1": w1, "w2": w2, **{c: x[c].to_numpy()[which] for c in ("anchor", "content", "n")}, "at": k})

    each = material.select("bytes", "anchor", "content", "count", "n").mapInPandas(run, "w1 long, w2 long, anchor long, content long, n long, at int")
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    return each.join(again, ["w1", "w2"], "left_semi").select("anchor", "content", "at", F.lit(1).alias("count"))


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, doc_id, first, count) runs of starts of strings that start elsewhere too; docs has row, doc_id and text."""
    u = units(length)
    shared, classes = shared_segments(docs, u, across=False)
    material = kept(_material(docs, classes.where("n > 1 or variants > 1"), length))
    sparse = material.where(F.col("variants") <= CROWD)
    runs = sorted_runs(sparse, material.count() // RANGE + 1)
    found = merged_runs(runs, length, u.gram).union(_by_window(material.where(F.col("variants") > CROWD), u))
    spans = found.groupBy("anchor", "content").agg(F.collect_set(F.struct("at", "count")).alias("spans"))
    told = kept(classes.join(spans, ["anchor", "content"]).select("anchor", "content", "n", "spans"))
    members = joined(shared, told, ["anchor", "content"]).select(*ROW, "first", F.explode("spans").alias("lost"))
    return members.select(*ROW, (F.col("first") + F.col("lost.at")).alias("first"), "lost.count")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_bytes and kept_sha256 after its own columns.

    Every byte covered by a `length`-byte string that also starts anywhere else goes, the first
    occurrence included. Strings don't cross rows; null and empty texts have no bytes; a repeated row
    counts as one more text. A cut can fall inside a character, so what is kept is bytes.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256")
    columns = [c for c in docs.columns if c not in made]
    own = F.struct(*[c for c in columns if c != "text"], F.lit(1).alias("_")).alias("own")
    docs = docs.select(own, "text", text_hash(1).alias("row"), text_hash(2).alias("doc_id"))
    spans = repeated_strings(docs, length).distinct().groupBy(*ROW).agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    held = packed(docs.select(*ROW, "own", "text")).join(spans, ROW, "left").select("own", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = list(map(unpacked, batch["text"].to_pylist()))
            for text, spans in zip(texts, batch["spans"].to_pylist()):
                data = np.frombuffer(as_bytes(text), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if spans:
                    first = np.array([s["first"] for s in spans])
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + np.array([s["count"] for s in spans]) + length - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                left = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0, left, hashlib.sha256(left).hexdigest()))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["own"], pa.array(texts, pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["own", "text", *made])

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType())
    return held.mapInArrow(run, T.StructType([held.schema["own"], T.StructField("text", T.StringType()), *map(T.StructField, made, kinds)])).select(*[c if c == "text" else f"own.`{c}`" for c in columns], *made)
