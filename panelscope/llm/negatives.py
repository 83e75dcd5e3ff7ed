"""Hard negatives by product quantisation with stored residual norms.

A vector of whole numbers is kept as one code for each of its short pieces, the nearest of 256 centroids,
and the norms of what the centroids leave over. A table of an anchor's products with all centroids gives
its product with the coded vector by look-ups; the true product differs by no more than the sum over the
pieces of the anchor's norm times the residual's. What can't reach a window even so is passed over, and
the rest is scored in whole numbers, so that windows are exact however good the codes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept, stored


@dataclass(frozen=True)
class Mining:
    """positives, negatives: how many of each. low, high: a negative's score in percent of its positive's. scale: a
    component x becomes floor(scale * x). piece: components that share a code. centroids: of each piece, 256 at most.
    fitted: rows that the centroids are fitted on, in `rounds` rounds; values: numbers of a block of anchors that is sent
    out at once, and of those rows, so that neither grows with the corpus. rows: rows scored in a step."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    piece: int = 2
    centroids: int = 256
    fitted: int = 8192
    rounds: int = 6
    values: int = 1 << 22
    rows: int = 4096


#: Anchors whose tables of products are made at once.
TABLES = 128
#: Pairs scored one by one at once; if more than one in DENSE of a step's pairs are left, its rows are scored as a matrix.
PAIRS, DENSE = 1 << 14, 16
#: Components from which on a vector takes no part, since products could leave 64 bits.
LARGEST = 1 << 28

ROWS = "vec_id long, label long, vec binary, codes binary, norms binary"


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vec array<long>) of the rows that take part: vec_id, label and all components known and finite."""
    x = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / scale))
    known = rows.where("vec_id is not null and label is not null and embedding is not null").where(ok)
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("vec"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """One row for each list, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def bytes_of(x: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def rows_of(data: pa.ChunkedArray, dims: int, kind: type | None = None) -> np.ndarray:
    """The rows that bytes_of() stored; kind None: whole numbers, each row in the least width that its table needed."""
    data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    data = data.cast(pa.large_binary())
    if kind is not None:
        return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(len(data), dims)
    size = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]) // dims
    out = np.zeros((len(data), dims), np.int64)
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        out[at] = np.frombuffer(b"".join(data.take(pa.array(at)).to_pylist()), f"<i{width}").reshape(len(at), dims)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def pieces(x: np.ndarray, piece: int) -> np.ndarray:
    """(rows, pieces, piece), filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % piece))).reshape(len(x), -1, piece).astype(np.float64)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Of each row of x (rows, piece) the nearest row of book; |x|**2 is the same for all and left out."""
    near = np.empty(len(x), np.int64)
    for at in range(0, len(x), 8192):
        near[at : at + 8192] = np.argmin((book * book).sum(1) - 2 * (x[at : at + 8192] @ book.T), axis=1)
    return near


def codebooks(sample: np.ndarray, m: Mining) -> np.ndarray:
    """(pieces, centroids, piece): k-means of each piece, rounded to whole numbers, so that products with them are exact.
    It starts from rows of the sample; a centroid that nothing is near to stays where it is."""
    cut = pieces(sample, m.piece)
    start = cut[np.random.default_rng(0).permutation(len(cut))[: min(m.centroids, 256)]]
    books = []
    for k in range(cut.shape[1]):
        x, book = cut[:, k], start[:, k].copy()
        for _ in range(m.rounds):
            near = nearest(x, book)
            n = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, x[:, j], len(book)) for j in range(m.piece)], axis=1)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(np.rint(book))
    return np.stack(books)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms): for each piece the nearest centroid, and the norm of the rest, rounded up."""
    cut = pieces(x, books.shape[2])
    codes = np.stack([nearest(cut[:, k], books[k]) for k in range(len(books))], axis=1)
    rest = cut - books[np.arange(len(books)), codes]
    norms = np.nextafter(np.sqrt((rest * rest).sum(2)).astype(np.float32), np.float32(np.inf))
    return codes.astype(np.uint8), norms


def encode(vectors: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """vectors with codes and norms, and vec in few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["vec"], dims)
                codes, norms = coded(x, books)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], bytes_of(narrow(x)), bytes_of(codes), bytes_of(norms)], names=["vec_id", "label", "vec", "codes", "norms"])

    return vectors.select("vec_id", "label", "vec").mapInArrow(run, ROWS)


@dataclass
class Slots:
    """Windows of a block of anchors: for each the anchor's place in the block, the least and the greatest score, and how
    many it takes. vec and label are the anchors'; same tells whether a window is of rows of the anchor's label or of others."""

    vec_id: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    size: int
    same: bool


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact: in doubles where these hold them, else in 64-bit numbers."""
    bound = np.linalg.norm(a.astype(float), axis=1).max(initial=0) * np.linalg.norm(b.astype(float), axis=1).max(initial=0)
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if bound < 1 << 51 else a @ b.T


def pair_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of a and j of b."""
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]])


def first_of(slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, size: int) -> np.ndarray:
    """Which entries are the first `size` of their slot, by score and then the smaller vec_id; equal ones count once."""
    order = np.lexsort((vec_id, -score, slot))
    s, x, v = slot[order], score[order], vec_id[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (v[1:] != v[:-1])][: len(s)]
    order, s = order[new], s[new]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
    place = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)]))
    return order[place < size]


class Scan:
    """The best entries of all slots so far, over the rows that one task has seen."""

    def __init__(self, slots: Slots, books: np.ndarray):
        self.slots, self.books = slots, books
        self.slot = self.score = self.vec_id = np.zeros(0, np.int64)
        self.floor = slots.least.copy()
        cut = pieces(slots.vec, books.shape[2])
        self.cut, self.norms = cut, np.sqrt((cut * cut).sum(2))

    def bounds(self, codes: np.ndarray, norms: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """(score by look-up, bound of what it may be off by) for all rows and the anchors of the part."""
        tables = np.einsum("apj,pcj->pca", self.cut[part], self.books, optimize=True)
        guess = np.zeros((len(codes), tables.shape[2]))
        for k in range(len(tables)):
            guess += tables[k][codes[:, k]]
        off = norms.astype(float) @ self.norms[part].T
        return guess, off * (1 + 1e-9) + np.abs(guess) * 1e-9

    def see(self, vec_id: np.ndarray, label: np.ndarray, vec: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        s = self.slots
        for begin in range(0, len(s.vec_id), TABLES):
            part = slice(begin, begin + TABLES)
            mine = np.flatnonzero((s.anchor >= begin) & (s.anchor < begin + TABLES))
            width = len(s.vec_id[part])
            lowest, highest = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
            np.minimum.at(lowest, s.anchor[mine] - begin, self.floor[mine])
            np.maximum.at(highest, s.anchor[mine] - begin, s.most[mine])
            guess, off = self.bounds(codes, norms, part)
            able = (guess + off >= lowest) & (guess - off <= highest)
            able &= ((label[:, None] == s.label[part]) == s.same) & (vec_id[:, None] != s.vec_id[part])
            row, anchor = np.nonzero(able)
            if len(row) * DENSE > able.size:
                score = products(vec, s.vec[part])[row, anchor]
            else:
                score = pair_products(vec, row, s.vec[part], anchor)
            self.take(mine, anchor + begin, score, vec_id[row])

    def take(self, mine: np.ndarray, anchor: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Puts the pairs into those of the slots `mine` whose window they are in."""
        s = self.slots
        order = np.argsort(anchor, kind="stable")
        anchor, score, vec_id = anchor[order], score[order], vec_id[order]
        low, high = np.searchsorted(anchor, s.anchor[mine]), np.searchsorted(anchor, s.anchor[mine], side="right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = np.repeat(mine, n)
        ok = (score[at] >= self.floor[slot]) & (score[at] <= s.most[slot])
        if not ok.any():
            return
        slot, score, vec_id = (np.r_[x, y[ok]] for x, y in ((self.slot, slot), (self.score, score[at]), (self.vec_id, vec_id[at])))
        best = first_of(slot, score, vec_id, s.size)
        self.slot, self.score, self.vec_id = slot[best], score[best], vec_id[best]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.floor)) == s.size)
        least = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(least, self.slot, self.score)
        # an equal score may still come first by its vec_id
        self.floor[full] = np.maximum(self.floor[full], least[full])


def scanned(index: DataFrame, slots: Slots, books: np.ndarray, dims: int, rows: int) -> DataFrame:
    """(slot, score, vec_id): of each task's rows, the first of each slot's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held = Scan(slots, books), []

        def flush() -> None:
            t = pa.Table.from_batches(held)
            held.clear()
            scan.see(t["vec_id"].to_numpy(), t["label"].to_numpy(), rows_of(t["vec"], dims), rows_of(t["codes"], len(books), np.uint8), rows_of(t["norms"], len(books), np.float32))

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows:
                flush()
        if sum(map(len, held)):
            flush()
        if len(scan.slot):
            yield pa.RecordBatch.from_arrays([pa.array(scan.slot), pa.array(scan.score), pa.array(scan.vec_id)], names=["slot", "score", "vec_id"])

    return index.mapInArrow(run, "slot long, score long, vec_id long")


def ranked(found: DataFrame, size: int) -> DataFrame:
    """found with rank, its place in the slot over all tasks, up to size. A slot has `size` rows of each task at most."""
    first = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, size)
    best = found.groupBy("slot").agg(first.alias("best")).select("slot", F.posexplode("best").alias("rank", "x"))
    return best.select("slot", (F.col("rank") + 1).alias("rank"), (-F.col("x.minus")).alias("score"), F.col("x.vec_id").alias("vec_id"))


def mined(rows: DataFrame, is_anchor: Column, m: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    Scores are inner products of the whole-number vectors, higher first, ties by the smaller vec_id. An anchor's positives
    are the first `positives` other rows of its label; a positive's negatives the first `negatives` rows of other labels
    with a score of low to high percent of the positive's. Rows with a null vec_id, label, vector or component take no
    part, nor do those with a component that isn't finite or is beyond LARGEST. Shorter vectors are filled up with zeros.
    A row isn't compared with rows of its own vec_id; rows of one vec_id with the same score count once. Other columns
    are ignored, and an empty table gives an empty one.

    Anchors go out in blocks of a bounded size, one after another, each past all rows, of which every task keeps the first
    of each window; no anchor and row are paired in a shuffle.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, m.scale)
    dims, n_anchors = vectors.agg(F.max(F.size("vec")), F.count(F.when(is_anchor, 1))).first()
    made = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors or not dims:
        return spark.createDataFrame([], made)
    sample = vectors.orderBy(F.xxhash64("vec_id", "vec")).limit(max(1, min(m.fitted, m.values // dims))).select("vec").toArrow()
    books = codebooks(matrix(sample["vec"], dims), m)
    index = kept(encode(vectors, books, dims))
    blocks = -(-n_anchors * dims // m.values)
    anchors = kept(index.where(is_anchor).select("vec_id", "label", "vec").distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks))))
    paths = []
    for block in range(blocks):
        a = anchors.where(F.col("block") == block).select("vec_id", "label", "vec").orderBy("vec_id", "label", "vec").toArrow()
        if not len(a):
            continue
        ids, labels, vecs = a["vec_id"].to_numpy(), a["label"].to_numpy(), rows_of(a["vec"], dims)
        lowest, highest = np.full(len(a), -(1 << 62)), np.full(len(a), 1 << 62)
        close = Slots(ids, labels, vecs, np.arange(len(a)), lowest, highest, m.positives, True)
        found = ranked(scanned(index, close, books, dims, m.rows), m.positives).orderBy("slot", "rank").toArrow()
        if not len(found):
            continue
        anchor, score, positive = (found[c].to_numpy() for c in ("slot", "score", "vec_id"))
        # whole percentages of whole scores: low * positive <= 100 * negative <= high * positive
        windows = Slots(ids, labels, vecs, anchor, -(-m.low * score // 100), m.high * score // 100, m.negatives, False)
        best = ranked(scanned(index, windows, books, dims, m.rows), m.negatives)
        names = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}))
        told = best.join(F.broadcast(names), "slot")
        paths.append(stored(told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return spark.read.schema(made).parquet(*paths) if paths else spark.createDataFrame([], made)
