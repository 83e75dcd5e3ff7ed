"""Removal of passages that an earlier document has: seed and extend.

Documents are joined on winnowed anchors; each match is extended both ways from its anchor, and what
reaches the length threshold is a maximal repeat, of which the document with the larger doc_id loses
its words. Segments of equal content are one class, so that copies are compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm.common import hash_words, kept, packed, unpacked, words_of
from panelscope.llm.winnow import ROW, Units, joined, ragged, shared_segments, text_hash, windows, with_texts

LENGTH = 50
#: An anchor with at most so many classes has its matches extended pair by pair; beyond, by window fingerprints.
PAIRS = 8
SPANS = "anchor long, content long, at int, count int"


def units(length: int = LENGTH) -> Units:
    return Units(lambda text: hash_words(words_of(text)), length, max(1, length // 6))


def _common(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair, how many units agree from a[a_at] and b[b_at] on in the direction of step, at most `most`."""
    run, k = ragged(most)
    differ = a[a_at[run] + step * k] != b[b_at[run] + step * k]
    out = most.copy()
    np.minimum.at(out, run[differ], k[differ])
    return out


def _joined(units: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary columns of units as one array, with each row's start and length."""
    n = units.str.len().to_numpy(np.int64) // 8
    return np.frombuffer(b"".join(units), np.int64), np.cumsum(n) - n, n


def _extended(pairs: DataFrame, length: int) -> DataFrame:
    """(anchor, content, at, count): windows of the later class, from its first one on, that the earlier one has too, by
    extension from the anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            (a, a_start, a_n), (b, b_start, b_n) = _joined(x["units"]), _joined(x["units_b"])
            off, off_b, count = (x[c].to_numpy(np.int64) for c in ("off", "off_b", "count"))
            ahead = _common(a, a_start + off, b, b_start + off_b, np.minimum(a_n - off, b_n - off_b), 1)
            back = _common(a, a_start + off - 1, b, b_start + off_b - 1, np.minimum(off, off_b), -1)
            least, most = np.maximum(np.maximum(length - ahead, off - count + 1), 0), np.minimum(back, off)
            yield pd.DataFrame({"anchor": x["anchor"], "content": x["content"], "at": off - most, "count": most - least + 1})[least <= most]

    return pairs.mapInPandas(run, SPANS)


def _material(docs: DataFrame, classes: DataFrame, u: Units) -> DataFrame:
    """The unit hashes of each class's owner, as binary."""
    wanted = classes.select("owner.row", "owner.doc_id", "anchor", "content", "owner.first", "owner.count", "owner.off", "variants")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, text, items in zip(batch["doc_id"], batch["text"], batch["items"]):
                values = u.split(unpacked(text))
                found += [(doc_id, *i.values(), values[i["first"] : i["first"] + i["count"] + u.window - 1].tobytes()) for i in items]
            yield pd.DataFrame(found, columns=["doc_id", "anchor", "content", "first", "count", "off", "variants", "units"])

    return with_texts(docs, wanted).mapInPandas(run, "doc_id long, anchor long, content long, first int, count int, off int, variants long, units binary")


def _by_window(material: DataFrame, u: Units) -> DataFrame:
    """(anchor, content, at, count) by the fingerprints of all windows: an exact way for anchors with many classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            flat, start, _ = _joined(x["units"])
            which, k = ragged(x["count"].to_numpy(np.int64))
            w1, w2 = windows(flat.view(np.uint64), start[which] + k, u)
            yield pd.DataFrame({"w1": w1, "w2": w2, **{c: x[c].to_numpy()[which] for c in ("anchor", "content", "doc_id")}, "at": k})

    each = material.select("units", "anchor", "content", "doc_id", "count").mapInPandas(run, "w1 long, w2 long, anchor long, content long, doc_id long, at int")
    least = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return each.join(least.drop("most"), ["w1", "w2"]).where("least < doc_id").select("anchor", "content", "at", F.lit(1).alias("count"))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, doc_id, first, count) runs of windows that also start in a document with a smaller doc_id; docs has row,
    doc_id, text."""
    u = units(length)
    docs = docs.where("doc_id is not null")
    shared, classes = shared_segments(docs, u, across=True)
    material = kept(_material(docs, classes.where("variants > 1"), u))
    few = material.where(F.col("variants") <= PAIRS)
    other = few.select("anchor", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "off", "units")])
    pairs = few.join(other, "anchor").where("doc_id_b < doc_id")
    found = _extended(pairs, length).union(_by_window(material.where(F.col("variants") > PAIRS), u))
    spans = found.groupBy("anchor", "content").agg(F.collect_set(F.struct("at", "count")).alias("spans"))
    told = classes.join(spans, ["anchor", "content"], "left").where("n > 1 or spans is not null")
    told = kept(told.select("anchor", "content", "n", F.col("owner.doc_id").alias("least"), "spans"))
    # later documents lose the segment in whole; all that the owner's doc_id has of it lose what is earlier still
    lost = F.when(F.col("least") < F.col("doc_id"), F.array(F.struct(F.lit(0).alias("at"), "count"))).otherwise(F.col("spans"))
    members = joined(shared, told, ["anchor", "content"]).select(*ROW, "first", F.explode(lost).alias("lost"))
    return members.select(*ROW, (F.col("first") + F.col("lost.at")).alias("first"), "lost.count")


def without_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256 after its own columns.

    A window is `length` consecutive words of one document; each word covered by a window that also
    starts in a document with a smaller doc_id goes, judged on the input. Null and blank texts have
    no words. Repeated rows and rows of one doc_id keep what they have in common, as neither is
    smaller; rows with a null doc_id are kept whole and remove nothing.
    """
    made = ("n_words", "n_removed", "kept_text", "kept_sha256")
    columns = [c for c in docs.columns if c not in made]
    own = F.struct(*[c for c in columns if c != "text"], F.lit(1).alias("_")).alias("own")
    docs = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(1).alias("row"))
    spans = repeated_windows(docs, length).distinct().groupBy(*ROW).agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    held = packed(docs.select(*ROW, "own", "text")).join(spans, ROW, "left").select("own", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = list(map(unpacked, batch["text"].to_pylist()))
            for text, spans in zip(texts, batch["spans"].to_pylist()):
                words = words_of(text)
                left = words
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edge[s["first"]] += 1
                        edge[s["first"] + s["count"] + length - 1] -= 1
                    left = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
                joined = b" ".join(left)
                rows.append((len(words), len(words) - len(left), joined.decode("utf-8", "surrogatepass"), hashlib.sha256(joined).hexdigest()))
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["own"], pa.array(texts, pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["own", "text", *made])

    schema = T.StructType([held.schema["own"], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType() if c[1] == "_" and c[0] == "n" else T.StringType()) for c in made)])
    return held.mapInArrow(run, schema).select(*[c if c == "text" else f"own.`{c}`" for c in columns], *made)
