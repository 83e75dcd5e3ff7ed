"""What the corpus operators share: reading tables, tables kept between jobs, tokens and rolling hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts sent to a Python worker at once; whole texts can be long, so that batches are kept small.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """A setting of the session, for the operators read whole texts in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, and driver and executors are
    one process, a folder of our own; on a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelscope-"))
        found = context.getCheckpointDir()
    return found


#: Folders of the tables written inside each cleared(), innermost last.
_written: list[list[str]] = []


def kept(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage and survives lost executors.
    What is read later needs the table, so it stays until whoever asked is done: see cleared()."""
    small_batches(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def stored(df: DataFrame) -> str:
    """Writes df as a table in the shared folder, and says where."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators keep inside, at the end; results must have been written by then."""
    _written.append([])
    try:
        yield
    finally:
        java = spark.sparkContext._jvm
        for path in map(java.org.apache.hadoop.fs.Path, _written.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its text column compressed, for shuffles of whole texts; null stays null."""

    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _zstd()[0].compress(t.encode("utf-8", "surrogatepass")) for t in batch], dtype=object)

    return docs.withColumn(text, pack(text))


def unpacked(data: bytes | None) -> str | None:
    return None if data is None else _zstd()[1].decompress(data).decode("utf-8", "surrogatepass")


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words; bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of all runs of a given length at once: a polynomial in an odd base modulo 2**64, by prefix sums."""

    def __init__(self, base: int):
        self.bases = np.uint64(base | 1), np.uint64(pow(base | 1, -1, 1 << 64))
        self._powers = [np.ones(1, np.uint64)] * 2

    def powers(self, which: int, n: int) -> np.ndarray:
        if len(self._powers[which]) < n:
            grown = np.full(max(n, 1 << 16), self.bases[which], np.uint64)
            grown[0] = 1
            self._powers[which] = np.multiply.accumulate(grown)
        return self._powers[which][:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(1, len(values)), dtype=np.uint64, out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end], for each pair."""
        return mixed((sums[end] - sums[start]) * self.powers(0, len(sums))[start] + (end - start).astype(np.uint64))


def sliding_minimum(hashes: np.ndarray, width: int) -> np.ndarray:
    """The position of the least hash (by its upper 32 bits, then the leftmost) of each run of `width`."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    key = np.concatenate([key, np.full(-len(key) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
