"""URL filters: rules on hosts and paths, and a list of URLs behind a blocked Bloom filter. DataFrame functions only."""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept

#: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Query parameters that don't change what a URL shows.
TRACKING = r"(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*"
#: Bits for each listed URL, bits set for each, 64-bit words in a block, and the largest filter that is broadcast.
BITS, HASHES, WORDS, BROADCAST_MB = 16, 6, 4, 64


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without slashes at its end, and the query without tracking parameters; empty without ://."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), TRACKING, ""), "^&+", "")
    kept_query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    return F.coalesce(F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), kept_query), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _masks(key: Column) -> list[Column]:
    """The key's bits in each word of its block."""
    spots = [F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 8 * k).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for k in range(HASHES)]
    out = []
    for w in range(WORDS):
        bits = [F.when(F.shiftright(s, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for s in spots]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        out.append(mask.alias(f"m{w}"))
    return out


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 ...): the filter's blocks that have a bit set, of the column `canon`."""
    block = F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block")
    return listed.select(block, *_masks(F.col("canon"))).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def judged(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and listed.

    listed has a column url; its canonical forms are blocked where no rule fits, all else is allowed.
    rules come from configuration: their number is fixed before the job and doesn't grow with data.
    A URL that is null or has no :// has an empty host and path, fits no rule and is never on the
    list. The Bloom filter sends possible hits alone to an exact hash join, which removes false
    positives; it is broadcast up to BROADCAST_MB, and joined by block beyond. Other columns of both
    tables are ignored; repeated rows and repeated list entries change nothing for other rows.
    """
    listed = kept(listed.select(canonical(F.col("url")).alias("canon")).where("canon <> ''").distinct())
    n_blocks = max(1, math.ceil(listed.count() * BITS / (64 * WORDS)))
    bits = bloom_filter(listed, n_blocks)
    if n_blocks * 8 * (WORDS + 1) <= BROADCAST_MB << 20:
        bits = F.broadcast(bits)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canon"))
    probe = seen.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("best"), F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block"))
    probe = probe.select("*", *_masks(F.col("canon"))).join(bits, "block", "left")
    possible = F.lit(True)
    for w in range(WORDS):
        possible = possible & (F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"))
    probe = probe.select("page_id", "host", "path", "canon", "best", F.coalesce(possible, F.lit(False)).alias("possible"))
    hits = probe.where("possible").join(listed.withColumn("listed", F.lit(True)), "canon", "left")
    rest = probe.where("not possible").withColumn("listed", F.lit(False))
    told = hits.unionByName(rest, allowMissingColumns=True).withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")
