"""SimHash near-duplicates through deletion-variant signatures.

A signature of `width` bits is cut into segments so few that of two signatures at the distance
looked for one segment differs by one bit at most. Each segment is indexed once for each bit taken
as a wildcard; two segments that differ by one bit at most agree in the variant whose wildcard is
that bit, so candidates are found by an equality join, and are then verified on whole signatures.
Where links are said to have a similarity, candidates are also verified by the Jaccard similarity of
their shingle sets.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import kept, mixed
from panelscope.llm.components import roots


@dataclass(frozen=True)
class SimHash:
    """shingle: words in a shingle. width: bits, a multiple of 64. segments: how many the signature is cut into.
    distance: bits in which linked signatures may differ. wildcards: wildcards for each segment; 0 for every bit,
    else those bits whose majority was narrowest, which are the ones that a small edit can turn. similarity: least
    Jaccard similarity of linked texts' shingle sets, whose signature it then is; 0 to go by signatures alone, which
    then count repeated shingles."""

    shingle: int = 3
    width: int = 64
    segments: int = 2
    distance: int = 2
    wildcards: int = 0
    similarity: float = 0.0

    @property
    def exact(self) -> bool:
        return not self.wildcards and self.distance < 2 * self.segments


#: Three-word shingles, 64 bits and 2 differing bits: finds every link.
CONTRACT = SimHash()
#: Five-word shingles at a Jaccard similarity of 0.8, which is a cosine of 0.89 and so 15 % of the bits, or 117 on
#: average with a deviation of 10; candidates may differ in three deviations more.
NEAR = SimHash(shingle=5, width=768, segments=32, distance=148, wildcards=6, similarity=0.8)

#: Largest bucket whose pairs are all compared, with exact parameters.
PAIRS = 32
#: Columns of a signature's first words, which travel with its variants.
SKETCH = ("s0", "s1")
#: The same where only buckets of several components are compared, and many of them may hold the same signatures.
WIDE = tuple(f"s{k}" for k in range(6))
#: Signatures in a block of a crowded bucket, about; blocks are compared two by two.
BLOCK = 1024
SEED = 42


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the text with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    start, end = (ends - size)[:n].tolist(), (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end)), np.uint64, n)


def bit_counts(hashes: np.ndarray, width: int) -> np.ndarray:
    """How many of the hashes have each bit, most significant first. Beyond 64 bits, mixes of the hash go on."""
    out = np.zeros(width, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        for j in range(width // 64):
            h = mixed(part + np.uint64(j * 0x9E3779B97F4A7C15 & (2**64 - 1))) if j else part
            out[64 * j : 64 * j + 64] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(shingle_hashes(text, k))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets in order; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def signature(text: str | None, p: SimHash) -> tuple[np.ndarray, np.ndarray, int]:
    """The signature as 64-bit words, for each segment the bits to use as wildcards, and a hash of the shingle set if
    that decides links."""
    hashes = shingle_set(text, p.shingle) if p.similarity else shingle_hashes(text, p.shingle)
    known = int(mixed(hashes).sum(dtype=np.uint64).view(np.int64)) if p.similarity else 0
    counts = bit_counts(hashes, p.width)
    words = np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)
    if not p.wildcards:
        return words, np.zeros(0, np.uint8), known
    margin = np.abs(2 * counts - len(hashes)).reshape(p.segments, -1)
    return words, np.argsort(margin, axis=1, kind="stable")[:, : p.wildcards].astype(np.uint8).ravel(), known


def variant_keys(words: np.ndarray, at: np.ndarray | None, p: SimHash) -> np.ndarray:
    """(n, keys) of the signatures (n, width / 64): segment, wildcard and the segment's other bits, packed."""
    size = p.width // p.segments
    bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1).reshape(len(words), p.segments, size)
    value = bits.astype(np.int64) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int64))
    if at is None:
        at = np.broadcast_to(np.arange(size), (len(words), p.segments, size))
    at = at.reshape(len(words), p.segments, -1).astype(np.int64)
    masked = value[:, :, None] & ~(np.int64(1) << (size - 1 - at))
    head = (np.arange(p.segments)[None, :, None] * size + at) << size
    return (head | masked).reshape(len(words), -1)


def text_key(text: str = "text") -> list[Column]:
    """Two hashes that stand for a text; null has one of its own."""
    return [F.xxhash64(F.lit(seed), F.col(text).isNull(), text).alias(f"k{seed}") for seed in (1, 2)]


def fingerprints(docs: DataFrame, p: SimHash) -> DataFrame:
    """(doc_id, k1, k2, node, sig array<long>, at binary); node is the 64-bit fingerprint, or a hash of a wider signature
    and of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature(t, p) for t in batch["text"].to_pylist()]
            sig, at = pa.array([w for w, _, _ in made], pa.list_(pa.int64())), pa.array([a.tobytes() for _, a, _ in made], pa.binary())
            # ids don't pass through Python, where a null would make them floats
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "k1", "k2")), sig, at, pa.array([h for _, _, h in made], pa.int64())], names=["doc_id", "k1", "k2", "sig", "at", "known"])

    keyed = docs.select(F.col("doc_id").cast("long"), "text", *text_key())
    out = keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, sig array<long>, at binary, known long")
    node = F.col("sig")[0] if p.width == 64 else F.xxhash64("sig", "known")
    return out.select("doc_id", "k1", "k2", node.alias("node"), "sig", "at")


def shingle_sets(docs: DataFrame, nodes: DataFrame, p: SimHash) -> DataFrame:
    """(node, shingles binary) of the nodes, from one text of each."""
    of = nodes.select("node", "least.k1", "least.k2")
    texts = docs.select("text", *text_key()).join(of, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, p.shingle).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(made, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v, ...) whose shingle sets have at least that similarity."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=float)

    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "uv")
    return pairs.join(left, "u").join(right, "v").where(alike("set_u", "set_v") >= least).select(pairs.columns)


def sided_keys(words: np.ndarray, at: np.ndarray, p: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sides), (n, keys) each: variant_keys() with each wildcard's bit as side, and for each segment one more key,
    of the whole segment, with side -1. Segments that differ in the wildcard alone meet on its different sides, and
    equal ones in the whole segment's bucket, so that no wildcard's bucket need compare them again."""
    size = p.width // p.segments
    bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1).reshape(len(words), p.segments, size)
    value = bits.astype(np.int64) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int64))
    whole = (p.width + np.arange(p.segments))[None, :] << size | value
    sides = np.take_along_axis(bits, at.reshape(len(words), p.segments, -1).astype(np.int64), axis=2).reshape(len(words), -1)
    return np.c_[variant_keys(words, at, p), whole], np.c_[sides.astype(np.int8), np.full(whole.shape, -1, np.int8)]


def variants(nodes: DataFrame, p: SimHash, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, side, node, more ...) for each indexed segment variant; more are long columns of nodes that come along. Exact
    parameters, which index every wildcard, have no need of sides: they are all -1."""
    carried = ("node", *more)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                words = np.stack(batch["sig"].to_list())
                if p.wildcards:
                    keys, sides = sided_keys(words, np.stack([np.frombuffer(a, np.uint8) for a in batch["at"]]), p)
                else:
                    keys = variant_keys(words, None, p)
                    sides = np.full(keys.shape, -1, np.int8)
                yield pd.DataFrame({"key": keys.ravel(), "side": sides.ravel(), **{c: np.repeat(batch[c].to_numpy(), keys.shape[1]) for c in carried}})

    return nodes.select(*carried, "sig", "at").mapInPandas(run, ", ".join(["key long", "side byte", *(f"{c} long" for c in carried)]))


def _cliques(hot: DataFrame, p: SimHash) -> DataFrame:
    """Links among fingerprints of crowded buckets. All that agree once the same two bits are masked are linked
    (they differ in those bits alone), so a star of each such class loses no link and emits no pairs."""
    masks = [(1 << i | 1 << j) - (1 << 64 if j == 63 else 0) for i in range(p.width) for j in range(i + 1, p.width)]
    one = hot.select("node", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("mask"))
    table = hot.sparkSession.createDataFrame([(k, m) for k, m in enumerate(masks)], "mask int, bits long")
    one = one.join(F.broadcast(table), "mask").select("node", "mask", F.expr("node & ~bits").alias("rest"))
    least = one.groupBy("mask", "rest").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    return one.join(least, ["mask", "rest"]).where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _near_sketches(rows: pd.DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, apart): places of rows, in order of (key, i, j), of one group whose sketches differ in at most `most` bits, and
    by how many; they are of different roots, of different sides in a wildcard's bucket, and of different blocks between blocks."""
    keys = rows[["key", "i", "j"]].to_numpy()
    root, block, side = (rows[c].to_numpy() for c in ("root", "block", "side"))
    inner, sketch = keys[:, 1] == keys[:, 2], rows[list(WIDE)].to_numpy().view(np.uint64)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
    end = np.repeat(np.r_[first[1:], len(rows)], np.diff(np.r_[first, len(rows)]))
    after = end - np.arange(len(rows)) - 1
    pairs = np.cumsum(after)
    for k in range(0, int(pairs[-1]) if len(pairs) else 0, 1 << 21):
        low, high = np.searchsorted(pairs, [k, k + (1 << 21)], side="right")
        run = np.arange(low, min(high + 1, len(rows)))
        a = np.repeat(run, after[run])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[run]) - after[run], after[run])
        use = (root[a] != root[b]) & ((side[a] < 0) | (side[a] != side[b])) & (inner[a] | (block[a] != block[b]))
        a, b = a[use], b[use]
        apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
        near = apart <= most
        yield a[near], b[near], apart[near]


def _of_near(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The rows that are near another one, without sketches."""
    out = np.zeros(len(rows), bool)
    for a, b, _ in _near_sketches(rows, most):
        out[a] = out[b] = True
    return rows[out].drop(columns=list(WIDE))


def _nearest(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """(node, apart, u, root, root_u): for each node the one of the least sketch's distance among those that it is near in any
    group, and the roots of both."""
    node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
    found = [pd.DataFrame({c: [] for c in ("node", "apart", "u", "root", "root_u")}, dtype=np.int64)]
    for a, b, apart in _near_sketches(rows, most):
        a, b = np.r_[a, b], np.r_[b, a]
        each = pd.DataFrame({"node": node[a], "apart": np.r_[apart, apart], "u": node[b], "root": root[a], "root_u": root[b]})
        found.append(each.sort_values(["node", "apart", "u"]).drop_duplicates("node"))
    return pd.concat(found).sort_values(["node", "apart", "u"]).drop_duplicates("node")


def _met(named: DataFrame, p: SimHash, what: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """what() of the nodes in the buckets that hold several components (root), block by block: by some bits of the signatures,
    which travel with the variants."""
    of = Window.partitionBy("key")
    seen = variants(_sketched(named, p, WIDE), p, ("root", *WIDE)).select("*", F.min("root").over(of).alias("lo"), F.max("root").over(of).alias("hi"), F.count("*").over(of).alias("n"), F.min("side").over(of).alias("one"), F.max("side").over(of).alias("two"))
    rest = kept(seen.where("lo < hi and (side < 0 or one < two)").drop("lo", "hi", "one", "two"))
    blocks = F.ceil(F.col("n") / BLOCK)
    zero = F.lit(0).cast("long")
    alone = rest.where(F.col("n") <= BLOCK).withColumn("block", zero).withColumn("other", zero)
    several = rest.where(F.col("n") > BLOCK).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    dealt = alone.unionByName(several.withColumn("other", F.explode(F.sequence(zero, blocks - 1))))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "side", "node", "root", *WIDE)
    most = _most(p, WIDE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # the last group may go on in the next batch
            open_ = (rows[["key", "i", "j"]].to_numpy() == rows[["key", "i", "j"]].to_numpy()[-1]).all(1)
            held, rows = rows[open_], rows[~open_]
            yield what(rows, most)
        if held is not None:
            yield what(held, most)

    groups = ["key", "i", "j"]
    return dealt.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(run, schema)


def _joined_nearest(named: DataFrame, sets: DataFrame, p: SimHash) -> DataFrame:
    """named with the roots after each node is compared with the nearest of another component that it shares a bucket with,
    so that few are left to be compared with all."""
    near = _met(named, p, _nearest, "node long, apart long, u long, root long, root_u long").groupBy("node").agg(F.min(F.struct("apart", "u", "root", "root_u")).alias("best"))
    # which of a pair comes first says which root does, so that a pair met from both ends is one row
    ends = F.array_sort(F.array(F.struct("node", "best.root"), F.struct(F.col("best.u").alias("node"), F.col("best.root_u").alias("root"))))
    pairs = near.select(ends.alias("end")).select(*[F.col("end")[k][c].alias(name) for k, x in enumerate("uv") for c, name in (("node", x), ("root", f"root_{x}"))]).distinct()
    alike = similar(pairs, sets, p.similarity)
    top = roots(alike.select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return named.join(top, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def _across(named: DataFrame, sets: DataFrame, p: SimHash) -> DataFrame:
    """Verified links between different components (root) in the buckets of the nodes, enough to join all that a pair of
    any bucket joins. Buckets of a single component have nothing to add; in others every member is compared with all
    of other components, block by block: first by some bits of the signatures, which travel with the variants, and what
    may be near by that in whole."""
    near = _met(named, p, _of_near, "key long, i long, j long, block long, side byte, node long, root long")
    groups = ["key", "i", "j"]
    held = named.select("node", "sig").join(sets.select("node", "shingles"), "node") if p.similarity else named.select("node", "sig", F.lit(b"").alias("shingles"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        node, label, block, side = (x[c].to_numpy().copy() for c in ("node", "root", "block", "side"))
        sig = np.stack(x["sig"].to_list()).view(np.uint64)
        sets = [np.frombuffer(s, np.uint64) for s in x["shingles"]]
        inner, found = x["i"].iloc[0] == x["j"].iloc[0], []
        for a in range(len(node) - 1):
            at = a + 1 + np.flatnonzero((label[a + 1 :] != label[a]) & ((side[a] < 0) | (side[a + 1 :] != side[a])) & (inner | (block[a + 1 :] != block[a])))
            at = at[np.bitwise_count(sig[at] ^ sig[a]).sum(1, dtype=np.int64) <= p.distance]
            for b in at.tolist():
                # a link makes two labels one, so that one link for each pair of labels is enough
                if label[b] != label[a] and (not p.similarity or jaccard(sets[a], sets[b]) >= p.similarity):
                    found.append((node[a], node[b]))
                    label[label == label[b]] = label[a]
        return pd.DataFrame(found, columns=["u", "v"])

    linked = kept(near).join(held, "node").groupBy(*groups).applyInPandas(run, "u long, v long")
    return linked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _most(p: SimHash, names: tuple[str, ...] = SKETCH) -> int:
    """Bits in which the sketches of signatures within the distance can differ: three deviations over what those at the
    greatest distance differ by."""
    words, share = min(len(names), p.width // 64), p.distance / p.width
    return math.ceil((len(names) / words) * (64 * words * share + 3 * math.sqrt(64 * words * share * (1 - share))))


def _sketched(nodes: DataFrame, p: SimHash, names: tuple[str, ...] = SKETCH) -> DataFrame:
    words = min(len(names), p.width // 64)
    return nodes.select("*", *[F.col("sig")[k % words].alias(c) for k, c in enumerate(names)])


def _stars(nodes: DataFrame, p: SimHash) -> DataFrame:
    """(node, u, times): in how many buckets a node meets u, the least node of the other side, or of the whole segment's
    bucket (the greatest, if the least is the node itself); u is null where their sketches are too far apart. Two that are
    alone in a bucket and too far apart met by chance, and aren't told of."""
    of = Window.partitionBy("key")
    # dealt by key before the window, so that the columns the window adds stay out of the exchange
    dealt = variants(_sketched(nodes, p), p, SKETCH).repartition("key")
    side, one = F.col("side"), F.struct("node", *SKETCH)
    least = [F.min(F.when(side == k, one)).over(of) for k in (0, 1)]
    low, high = F.min(one).over(of), F.max(one).over(of)
    met = F.when(side == 0, least[1]).when(side == 1, least[0]).otherwise(F.when(low["node"] != F.col("node"), low).otherwise(high))
    seen = dealt.select("node", *SKETCH, met.alias("met"), F.count("*").over(of).alias("n")).where("met.node <> node")
    apart = reduce(operator.add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"met.{c}"))) for c in SKETCH])
    seen = seen.select("node", "n", F.when(apart <= _most(p), F.col("met.node")).alias("u")).where("n > 2 or u is not null")
    return seen.groupBy("node", "u").agg(F.count("*").alias("times"))


def _linked(nodes: DataFrame, p: SimHash, docs: DataFrame | None) -> DataFrame:
    """(u, v) of verified links whose components are those of all candidates. First each node is compared with the one
    that it shares most buckets with; then members of different components are, in all buckets."""
    stars = kept(_stars(nodes, p))
    # nodes that share no bucket have nothing to be compared with
    members = stars.select("node").distinct()
    known = kept(nodes.join(members, "node", "left_semi"))
    sets = kept(shingle_sets(docs, known, p)) if p.similarity else known
    best = stars.where("u is not null").groupBy("node").agg(F.max(F.struct("times", "u")).alias("best")).select("best.u", F.col("node").alias("v"))
    if p.similarity:
        first = similar(best, sets, p.similarity)
    else:
        left, right = (known.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "uv")
        differ = F.aggregate(F.zip_with("sig_u", "sig_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        first = best.join(left, "u").join(right, "v").where(differ <= p.distance).select("u", "v")
    named = kept(known.select("node", "sig", "at").join(roots(first), "node", "left").withColumn("root", F.coalesce("root", "node")))
    if p.similarity:
        named = kept(_joined_nearest(named, sets, p))
    # the roots say all that the links so far do
    return named.select(F.col("root").alias("u"), F.col("node").alias("v")).where("u <> v").union(_across(named, sets, p))


def links(nodes: DataFrame, p: SimHash, docs: DataFrame | None = None) -> DataFrame:
    """(u, v) of verified links between different signatures; their components are those of all links. docs: the texts,
    where links have a similarity.

    Exact parameters pair buckets of up to PAIRS signatures in full, and link larger ones by masked
    classes; the others link stars first, and then what stars haven't brought together.
    """
    if not p.exact:
        return _linked(nodes, p, docs)
    together = F.count("*").over(Window.partitionBy("key"))
    members = kept(variants(nodes, p).select("key", "node", together.alias("n")).where("n > 1"))
    some = members.where(F.col("n") <= PAIRS)
    mate = some.select("key", F.col("node").alias("v"))
    pairs = some.select("key", F.col("node").alias("u")).join(mate, "key").where("u < v").select("u", "v")
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= p.distance).distinct()
    return pairs.union(_cliques(members.where(F.col("n") > PAIRS).select("node").distinct(), p))


def _components(docs: DataFrame, p: SimHash) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and (node, root, least) of every node, least being (no_id, doc_id, k1, k2) of its first text."""
    fps = kept(fingerprints(docs, p))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("least")
    nodes = kept(fps.groupBy("node").agg(first, F.first("sig").alias("sig"), F.first("at").alias("at")))
    found = roots(links(nodes, p, docs))
    return fps, nodes.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, p: SimHash = CONTRACT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links, the document itself included. Equal
    signatures are one node, so a group of copies costs one row. A null or blank text has the
    fingerprint zero and is linked like any other; repeated rows give repeated rows; a null doc_id
    never becomes a component's id unless all of them are null; other columns are ignored.
    """
    fps, of = _components(docs, p)
    named = of.join(of.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", F.col("first.doc_id").alias("component_id"))
    digits = F.array_join(F.transform("sig", lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
    return fps.join(named, "node").select("doc_id", digits.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, p: SimHash = NEAR) -> DataFrame:
    """One row of docs, whole, for each group of near duplicates: that of the smallest doc_id, a null doc_id coming last.

    Groups go by texts, so different texts under one doc_id, or under a null one, are judged by
    themselves. Null and blank texts have no shingles and are one group. Of rows alike in doc_id and text
    the one whose columns have the least hash stays, so that reruns agree.
    """
    _, of = _components(docs, p)
    first = of.groupBy("root").agg(F.min("least").alias("first")).select(F.struct("first.doc_id", "first.k1", "first.k2").alias("key"))
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *text_key()).alias("key"), F.struct(*docs.columns).alias("own"))
    # nulls inside a struct are equal, so rows of the join lie as the grouping wants them
    one = keyed.join(first, "key", "left_semi").groupBy("key").agg(F.min_by("own", F.xxhash64("own")).alias("own"))
    return one.select("own.*")
