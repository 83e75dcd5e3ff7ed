"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text gives the longest match of a text at any
position. A text is parsed greedily into longest matches; the language whose automaton needs the
fewest phrases for each character wins. Automata are made where the labelled text is, one task for
each language, and keep their edges alone, so that neither letters nor languages need a limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import kept

UNKNOWN = "und"


@dataclass(frozen=True)
class Bounds:
    """The labelled sample: for each language `texts` whole texts at most, those of the least hash, as long as they have
    `chars` characters at most together; texts that don't fit are passed over for shorter ones, and if none does, the
    shortest is taken. This bounds a language's model (to some 6 MB), not what it is applied to."""

    texts: int = 200
    chars: int = 160_000


#: Characters between the places from which a text is parsed side by side; it changes nothing in the result.
STRIDE = 256
#: Characters parsed together, about, and languages whose models a worker holds at a time.
CHARS, TOGETHER = 1 << 20, 32

MODEL = "lang string, letters binary, base binary, cells binary"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def folded(text: str) -> np.ndarray:
    """Code points of the text in lower case."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, a dict for each state; 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def laid_out(edges: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, cells): the edge of state s by symbol c, 1 to `symbols`, is in cells[base[s] + c], as s and its target in
    32 bits each; a cell of another state or of none (-1) means that there is no such edge. Rows of states are laid
    over one another, those with many edges first."""
    total = sum(map(len, edges))
    taken = bytearray(2 * total + 3 * symbols + 64)
    base, cells = np.zeros(len(edges), np.int32), np.full(len(taken), -1, np.int64)
    low = end = symbols
    for s in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
        row = edges[s]
        if not row:
            continue
        while taken[low]:
            low += 1
        first, *rest = sorted(row)
        at = low
        # a row that doesn't fit after so many tries goes to the end
        for _ in range(256):
            if not any(taken[at - first + c] for c in rest):
                break
            at = taken.find(0, at + 1)
        else:
            at = end
        for c, to in row.items():
            cell = at - first + c
            if cell + symbols + 2 >= len(taken):
                grown = len(taken)
                taken.extend(bytes(grown))
                cells = np.concatenate([cells, np.full(grown, -1, np.int64)])
            taken[cell] = 1
            cells[cell] = s << 32 | to
            end = max(end, cell + 1)
        base[s] = at - first
    return base, cells[: end + symbols + 1].copy()


class Automaton:
    """A language's model, as it is applied."""

    def __init__(self, letters: np.ndarray, base: np.ndarray, cells: np.ndarray):
        # a state without edges stands for a character that the language doesn't have
        self.base, self.foreign = np.append(base, 0).astype(np.int32), len(base)
        self.owner, self.target = (cells >> 32).astype(np.int32), (cells & 0xFFFFFFFF).astype(np.uint32).astype(np.int32)
        self.symbol = np.zeros(int(letters[-1]) + 2 if len(letters) else 1, np.int32)
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        first = self.base[0] + np.arange(len(letters) + 1)
        self.start = np.where(self.owner[first] == 0, self.target[first], self.foreign).astype(np.int32)

    @staticmethod
    def made(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, base, cells) of the text."""
        letters, symbols = np.unique(folded(text), return_inverse=True)
        return letters, *laid_out(automaton((symbols + 1).tolist()), len(letters))

    def phrases(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of greedy longest matches that make up each of the texts, which follow one another in points.

        Parses begin at the start of each stride of each text. One that leaves its stride goes on as the parse that
        begins where it left; one that meets a place from which a phrase is known to begin is known from there on.
        """
        # each text ends with a symbol that nothing goes on with
        sizes = np.asarray(sizes, np.int64)
        last = np.cumsum(sizes + 1) - 1
        first = last - sizes
        c = np.zeros(len(points) + len(sizes), np.int32)
        inside = np.ones(len(c), bool)
        inside[last] = False
        c[inside] = self.symbol[np.minimum(points, len(self.symbol) - 1)]
        base, owner, target = self.base, self.owner, self.target
        # of known places: phrases until the stride is left, and where that is
        count, leaves = np.zeros(len(c), np.int32), np.zeros(len(c), np.int32)
        strides = -(-sizes // STRIDE)
        text = np.repeat(np.arange(len(sizes)), strides)
        begin = (first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(strides) - strides, strides))).astype(np.int32)
        left = self._from_strides(c, begin, np.minimum(begin + STRIDE, last[text]).astype(np.int32), count, leaves)
        while True:
            begin, which = np.unique(left, return_index=True)
            text = text[which]
            open_ = (begin < last[text]) & (count[begin] == 0)
            begin, text = begin[open_], text[open_]
            if not len(begin):
                break
            limit = np.minimum(begin - (begin - first[text]) % STRIDE + STRIDE, last[text]).astype(np.int32)
            left = self._from_places(c, begin, limit, count, leaves)
        out, at, live = np.zeros(len(sizes), np.int64), first.copy(), np.flatnonzero(sizes)
        while len(live):
            out[live] += count[at[live]]
            at[live] = leaves[at[live]]
            live = live[at[live] < last[live]]
        return out


    def _from_strides(self, c: np.ndarray, begin: np.ndarray, limit: np.ndarray, count: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Parses all strides in step, and says where each is left; count and leaves become known along the way."""
        base, owner, target, start = self.base, self.owner, self.target, self.start
        order = np.argsort(begin - limit, kind="stable")
        begin, size = begin[order], (limit - begin)[order]
        if not len(begin):
            return begin
        # a row for each step, longest strides first, so that those still in theirs are a prefix
        grid = c[np.minimum(begin[None, :] + np.arange(STRIDE, dtype=np.int32)[:, None], len(c) - 1)]
        running = np.searchsorted(-size, -np.arange(STRIDE), side="left").tolist()
        state = start[grid[0]]
        seen = []
        for t in range(1, STRIDE):
            n = running[t]
            if not n:
                break
            now, here = state[:n], grid[t, :n]
            edge = base[now] + here
            to = target[edge]
            miss = np.flatnonzero(owner[edge] != now)
            to[miss] = start[here[miss]]
            seen.append((t, miss))
            state[:n] = to
        # the phrases that go on over the end
        left, w, at = np.zeros(len(begin), np.int32), np.arange(len(begin)), begin + size
        while len(w):
            edge = base[state] + c[at]
            goes = owner[edge] == state
            over = ~goes
            left[w[over]] = at[over]
            w, at, state = w[goes], at[goes] + 1, target[edge[goes]]
        ahead = np.ones(len(begin), np.int32)
        for t, miss in reversed(seen):
            place = begin[miss] + t
            count[place] = n = ahead[miss]
            leaves[place] = left[miss]
            ahead[miss] = n + 1
        count[begin], leaves[begin] = ahead, left
        out = np.empty_like(left)
        out[order] = left
        return out

    def _from_places(self, c: np.ndarray, begin: np.ndarray, limit: np.ndarray, count: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Parses from these places until their stride is left or a known place is met, and says where each leaves."""
        base, owner, target = self.base, self.owner, self.target
        w = np.arange(len(begin), dtype=np.int32)
        total, left, k = np.zeros(len(w), np.int32), np.zeros(len(w), np.int32), np.zeros(len(w), np.int32)
        seen = [(w, begin, k)]
        k, at, state = k.copy(), begin + 1, self.start[c[begin]]
        while len(w):
            here = c[at]
            edge = base[state] + here
            to = target[edge]
            miss = np.flatnonzero(owner[edge] != state)
            if len(miss):
                place, n = at[miss], k[miss] + 1
                k[miss] = n
                known = count[place]
                out = place >= limit[miss]
                done = out | (known > 0)
                go = ~done
                more = miss[go]
                to[more] = self.start[here[more]]
                seen.append((w[more], place[go], n[go]))
                if len(more) < len(miss):
                    over, out, place = w[miss[done]], out[done], place[done]
                    total[over] = n[done] + np.where(out, 0, known[done])
                    left[over] = np.where(out, place, leaves[place])
                    live = np.ones(len(w), bool)
                    live[miss[done]] = False
                    w, at, k, to, limit = w[live], at[live], k[live], to[live], limit[live]
            state = to
            at += 1
        for which, place, before in seen:
            count[place] = total[which] - before
            leaves[place] = left[which]
        return left


def train(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The models (MODEL), one row for each language with labelled text, in the shared folder. Learns from text and
    non-null lang of the rows that aren't held out; the sample is found by a partial top-k."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    size = F.length("text")
    # texts of over twice the length that would let all fit come last, the shorter before the longer
    order = F.struct(F.when(size > 2 * bounds.chars // bounds.texts, size).otherwise(0).alias("late"), F.xxhash64("doc_id", "text").alias("h"))
    drawn = seen.where(F.col("text").rlike(r"\p{L}")).select("lang", order.alias("order"), size.alias("size"), "text")
    by_order = Window.partitionBy("lang").orderBy("order", "text")
    first = drawn.withColumn("rank", F.row_number().over(by_order)).where(F.col("rank") <= bounds.texts)
    total = F.sum("size").over(by_order.rowsBetween(Window.unboundedPreceding, 0))
    sample = first.withColumn("total", total).where((F.col("total") <= bounds.chars) | (F.col("rank") == 1)).select("lang", "rank", "text")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        letters, base, cells = Automaton.made(" ".join(rows.sort_values("rank")["text"]))
        return pd.DataFrame({"lang": rows["lang"][:1], "letters": [letters.tobytes()], "base": [base.tobytes()], "cells": [cells.tobytes()]})

    return kept(sample.groupBy("lang").applyInPandas(learn, MODEL))


def _told(models: DataFrame, names: list[str]):
    """A function of a text and of what other languages have told that tells the best language, its phrases and those
    of the next best."""
    found = {r["lang"]: (np.frombuffer(r["letters"], np.uint32), np.frombuffer(r["base"], np.int32), np.frombuffer(r["cells"], np.int64)) for r in models.where(F.col("lang").isin(names)).collect()}
    shared = models.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("lang string, best double, next double")
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        known = [(name, Automaton(*parts)) for name, parts in sorted(shared.value.items())]
        for texts, told in batches:
            lang = told["lang"].to_numpy(object, copy=True)
            best, after = (told[x].to_numpy(float, na_value=np.inf).copy() for x in ("best", "next"))
            best[np.isnan(best)] = after[np.isnan(after)] = np.inf
            group: list[int] = []
            points: list[np.ndarray] = []

            def judge() -> None:
                where, joined, sizes = np.array(group), np.concatenate(points), np.array(list(map(len, points)))
                for name, model in known:
                    n = model.phrases(joined, sizes).astype(float)
                    wins = n < best[where]
                    after[where] = np.where(wins, best[where], np.minimum(after[where], n))
                    best[where] = np.where(wins, n, best[where])
                    lang[where[wins]] = name
                group.clear(), points.clear()

            size = 0
            for i, t in enumerate(texts):
                if t is not None and any(map(str.isalpha, t)):
                    group.append(i)
                    points.append(folded(t))
                    size += len(points[-1])
                    if size > CHARS:
                        judge()
                        size = 0
            if group:
                judge()
            yield pd.DataFrame({"lang": lang, "best": best, "next": after})

    return run


def predicted(docs: DataFrame, models: DataFrame) -> DataFrame:
    """docs with lang_pred and score after its own columns; see identify(). TOGETHER languages at a time, each time one
    pass over docs, so that a worker's memory doesn't grow with the languages."""
    names = sorted(r["lang"] for r in models.select("lang").collect())
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*own, F.lit(None).cast("struct<lang:string,best:double,next:double>").alias("_told"))
    for k in range(0, len(names), TOGETHER):
        if k:
            out = kept(out)
        out = out.select(*own, _told(models, names[k : k + TOGETHER])("text", "_told").alias("_told"))
    score = F.when(F.col("_told.lang").isNull(), 0.0).otherwise(1 - F.col("_told.best") / F.col("_told.next"))
    return out.select(*own, F.coalesce("_told.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))


def identify(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """docs with held_out, lang_pred and score after its own columns.

    lang_pred is a learned value of lang, the first in order on ties; `und` with a score of 0 if the
    text is null or has no letter, or if there was nothing to learn from. The score is by how much of
    the next best language's phrases the winner needs fewer, 0 to 1, and 1 if there is one language
    alone; it doesn't depend on how many languages there are. Whole texts are parsed, however long; a
    null doc_id isn't held out; repeated rows are told the same. Columns named like the new ones are
    replaced.
    """
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    flagged = docs.select(*own, F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return predicted(flagged, train(docs, bounds))
