"""Filter audit, SetSketch near-duplicates and hard negatives against brute force."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.llm import audit, components, linking, negatives, setsketch
from panelscope.llm.simhash import shingle_set

WORDS = [f"w{k}" for k in range(400)]
CLASHING = ["A", "copy", "part", "n", "least", "node", "size", "key", "block", "k1", "score", "slot", "codes"]


def table(spark, rows, schema):
    """With columns beside, whose names the operators use inside."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASHING})


# -- filter audit


def audit_by_hand(docs, labels):
    flags = []
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {c for c, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
            ("D", re.search(r"[#$%&*|]", text) is not None), ("E", doc_id is not None and smallest[text] < doc_id)) if bad}
        said = [(q, t) for d, q, t in labels if d == doc_id and d is not None]
        flags.append((source or "", failed, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    out = set()
    for part in {p for p, *_ in flags}:
        own = [f for f in flags if f[0] == part]
        removed = {}
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                here = [f for f in own if x in f[1] and not f[1] & before]
                removed[order, x] = here
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                before, here = set(order[:step]), removed[order, x]
                out.add((
                    part, "".join(order), step + 1, sum(not f[1] & (before | {x}) for f in own), len(here), sum(x in f[1] and bool(f[1] & before) for f in own),
                    sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here), sum(len(removed[o, x]) for o in permutations("ABCDE")),
                ))
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS[: rng.choice([20, 400])], k=rng.choice([50, 199, 200, 300]))) + rng.choice(["", " #", " " + "ABC" * 20]) for _ in range(14)]
    texts += [None, "", " \t", "It costs $5", "Ünï cödé 😀 ÄÖ", "A" * 3 + " b" * 200]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["web", "book", "", None])) for _ in range(120)]
    docs += docs[:5]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 30, 2)] + [(2, 1, 1), (None, 1, 1)]
    got = audit.audited(table(spark, docs, "doc_id long, text string, source string"), table(spark, labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == audit_by_hand(docs, labels) and got.count() == 120 * 5 * 3


def test_audit_of_nothing_and_of_other_filters(spark):
    docs = table(spark, [(1, "a b", "s"), (2, "a b", "s"), (3, "#", None)], "doc_id long, text string, source string")
    labels = table(spark, [], "doc_id long, quality int, toxic int")
    assert audit.audited(docs.limit(0), labels).count() == 0
    two = audit.Filters({"S": audit.odd_symbols, "X": audit.COPY})
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audited(docs, labels, two).collect()}
    assert len(got) == 8 and got["s", "SX", 2]["removed"] == 1 and got["", "XS", 2]["removed"] == 1 and got["s", "SX", 1]["shapley"] == 0 and got["s", "XS", 1]["shapley"] == 2
    no_copies = audit.Filters({"S": audit.odd_symbols})
    assert {r["removed"] for r in audit.audited(docs, labels, no_copies).collect()} == {0, 1}


# -- SetSketch


P = setsketch.CONTRACT


def test_registers_merge_and_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for n, shared in ((3, 2), (150, 120), (3000, 1500)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - shared :])
            s, t, both = P.sketches([a, b, np.union1d(a, b)])
            assert (np.maximum(s, t) == both).all()
            agree.append((s == t).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 4 * 0.5 / math.sqrt(60 * P.registers) + 0.02
    alone = P.sketches([a])[0]
    assert (P.sketches([b, a, np.zeros(0, np.uint64)])[1] == alone).all() and not P.sketches([np.zeros(0, np.uint64)]).any()


def test_the_likelihood_tells_similar_sets():
    """The estimate is the likelihood's maximum, links are never left out, and sets far from similar are."""
    rng = np.random.default_rng(2)
    for n_a, n_b, shared, least, most in ((100, 100, 89, 1.0, 1.0), (100, 90, 85, 1.0, 1.0), (200, 200, 120, 0.0, 0.05), (100, 79, 79, 0.0, 0.0)):
        near, gaps = [], []
        for _ in range(100):
            x = rng.integers(0, 2**63, n_a + n_b - shared).astype(np.uint64)
            s, t = P.sketches([np.sort(x[:n_a]), np.sort(x[n_a - shared :])])
            near.append(P.near(s.view(np.uint8)[None], np.array([n_a]), t.view(np.uint8)[None], np.array([n_b]))[0])
            u, above, equal = np.array([n_a / (n_a + n_b)]), np.array([(s > t).sum()], float), np.array([(s == t).sum()], float)
            counts = (above, P.registers - above - equal, equal)
            grid = np.linspace(0.01, min(n_a / n_b, n_b / n_a) - 0.01, 400)
            best = grid[np.argmax(P.likelihood(grid, np.full(400, u[0]), *(np.full(400, c[0]) for c in counts)))]
            gaps.append(abs(best - min(P.estimate(u, counts)[0], grid[-1])))
        assert least <= np.mean(near) <= most and max(gaps) < 0.01


def near_by_hand(docs, percent=80):
    sets = [frozenset(shingle_set(t, 4).tolist()) for _, t in docs]
    parent = list(range(len(docs)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                parent[top(i)] = top(j)
    out = []
    for k, (doc_id, _) in enumerate(docs):
        ids = [docs[i][0] for i in range(len(docs)) if top(i) == top(k) and docs[i][0] is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[k]), least if sets[k] else doc_id, doc_id == (least if sets[k] else doc_id)))
    return sorted(map(repr, out))


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    """Copies, chains, near misses of one template in crowded buckets, short texts, nulls, repeated rows."""
    monkeypatch.setattr(linking, "BLOCK", 4)  # of the driver's plan; tasks hold what they are given
    rng = random.Random(3)
    docs = []
    for _ in range(6):
        base = [rng.choice(WORDS) for _ in range(rng.choice([5, 30, 120]))]
        docs += [" ".join(edited(rng, base, s)) for s in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1)]
    template = [rng.choice(WORDS) for _ in range(100)]
    docs += [" ".join(edited(rng, template, 0.025)) for _ in range(60)]
    docs += [None, None, "", " \n", "one", "One", "one two three", "ONE two  three", "one two three four", "a b c d e", "a b c d e f", "ß ẞ é x y"]
    docs += [" ".join(["same"] * 20000), " ".join(["same"] * 19000), " ".join(template * 150)]
    rows = [(k * 7 % 401, t) for k, t in enumerate(docs)]
    rows += rows[:4] + [(None, docs[0]), (None, "nobody else says this at all"), (None, None), (5, "another text under one id that is long")]
    got = setsketch.near_duplicates(table(spark, rows, "doc_id long, text string").repartition(5))
    assert sorted(repr(tuple(r)) for r in got.collect()) == near_by_hand(rows)


def test_no_near_duplicates(spark):
    docs = table(spark, [(1, "a b c d e"), (2, None)], "doc_id long, text string")
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(tuple(r) for r in setsketch.near_duplicates(docs).collect()) == [(1, 2, 1, True), (2, 0, 2, True)]


# -- hard negatives


def mined_by_hand(rows, every, m):
    """Whole scores of all pairs of distinct rows."""
    known = []
    for vec_id, label, x in rows:
        if vec_id is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            known.append((vec_id, label, tuple(math.floor(m.scale * v) for v in x)))
    known = sorted(set(known))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in known:
        if a[0] % every:
            continue
        ranked = sorted({(-score(a, b), b[0], b[1] == a[1]) for b in known if b[0] != a[0]})
        for minus, positive, _ in [r for r in ranked if r[2]][: m.positives]:
            fit = [r for r in ranked if not r[2] and m.low * -minus <= 100 * -r[0] <= m.high * -minus][: m.negatives]
            out += [(a[0], positive, k, r[1], -minus, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("m", [negatives.Mining(), negatives.Mining(3, 2, 50, 95, 64, 3, 16, 64, 3, 1 << 8, 50)])
def test_hard_negatives_against_all_pairs(spark, m):
    """The second with three-component pieces, few centroids, many blocks of anchors and small steps."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (300, 11))
    x[:40] = x[0]  # ties
    x[100:130] = np.abs(x[100:130])
    rows = [(k, int(rng.integers(0, 4)), x[k].tolist()) for k in range(300)]
    bad = [(10, None, [1.0] * 11), (20, 1, None), (30, 1, [None] * 11), (40, 1, [float("nan")] * 11), (50, 2, [float("inf")] * 11), (None, 1, [0.1] * 11)]
    rows += bad + rows[:25] + [(7, 1, [5.0]), (11, 2, []), (13, 3, [30.0] * 11), (17, 3, [-30.0] * 11)]
    got = negatives.mined(table(spark, rows, "vec_id long, label int, embedding array<float>").repartition(6), F.col("vec_id") % 10 == 0, m)
    as_float = [(v, lab, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for v, lab, e in rows]
    assert sorted(tuple(r) for r in got.collect()) == mined_by_hand(as_float, 10, m)


def test_no_anchors_and_no_rows(spark):
    df = table(spark, [(1, 1, [1.0]), (2, 1, [2.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mined(df, F.col("vec_id") == 9).count() == 0 and negatives.mined(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mined(df, F.lit(True)).count() == 0  # no other label


def test_bounds_hold_whatever_the_codes():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 200, (500, 10))).astype(np.int64)
    m = negatives.Mining(piece=3, centroids=4)
    books = negatives.codebooks(x, m)
    codes, norms = negatives.coded(x, books)
    scan = negatives.Scan(negatives.Slots(np.arange(20), np.zeros(20), x[:20], np.arange(20), np.zeros(20), np.zeros(20), 5, True), books)
    guess, off = scan.bounds(codes, norms, slice(0, 20))
    exact = x @ x[:20].T
    assert (np.abs(exact - guess) <= off).all() and np.abs(exact - guess).max() > 0
    large = np.full((3, 10), 1 << 27)
    assert (negatives.products(large, large) == 10 << 54).all()


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Rounds end once stars are left, without one more that only confirms it."""
    rounds, large_star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or large_star(edges))
    found = lambda edges: {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found([(2, 1), (1, 3), (9, 8)]) == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)} and not rounds
    assert found([(1, 2), (2, 3)]) == {(1, 1), (2, 1), (3, 1)} and len(rounds) == 1
