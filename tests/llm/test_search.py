"""Ranked search, whitening and nearest labelled examples against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rankfit.llm import op11_lexical as O11, op12_whitening as O12, op13_toxicity as O13
from rankfit.llm import words as W

from .conftest import EDGES, LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# ---- words


def test_words_are_the_matches(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(chr(c) for c in range(1, 0x250)), LONG, "", " é\x00É a_b", *["".join(rng.choice("aZ0 /:@[`{\x7f\x80É日🙂_'\n") for _ in range(60)) for _ in range(200)]]
    for piece in (W.PIECE, 7):
        monkeypatch.setattr(W, "PIECE", piece)
        for t in texts:
            assert [w.decode() for part in W.words(t) for w in part] == terms_of(t)


# ---- 11


def _ranking(docs, items, top):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n_docs, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in bags:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top, block, rows, bucket", [(5, 10**9, 16_384, 1024), (3, 150, 16, 8), (1000, 10**9, 50, 64)])
def test_ranking(spark, monkeypatch, top, block, rows, bucket):
    rng = random.Random(top)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, odds, k=rng.choice((1, 3, 10, 50, 400)))) for _ in range(150)]
    docs = [(i * 3 - 100, t) for i, t in enumerate(texts)] + [(1000 + i, texts[7]) for i in range(12)] + [(-5000, texts[7]), (None, texts[7]), (None, texts[7]), (5, texts[7]), (5, texts[7])]
    docs += [(2000, None), (2001, ""), (2002, " -- "), (2003, " ".join(vocabulary).upper())]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)] + [(3, "w1 w59"), (50, "absent words"), (51, None), (None, "w3, W4"), (3, "w1 w59"), (52, "")]
    monkeypatch.setattr(O11, "ROWS", rows)
    monkeypatch.setattr(O11, "BUCKET", bucket)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, terms string")
    got = O11.ranked(*frames, top=top, block=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _ranking(docs, items, top)


def test_pruning_keeps_what_reaches_the_threshold():
    """Buckets against all inner products, for thresholds up to the best score."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 30, 500)
    terms = np.concatenate([rng.choice(80, n, replace=False) for n in sizes]).astype(np.int32)
    impact = rng.integers(1, 10**6, len(terms))
    v = O11.Vectors(np.arange(500), np.zeros(500, bool), sizes, terms, impact)
    assert (np.diff(v.squares) <= 0).all()
    buckets = O11.Buckets(v, 80)
    asked = rng.choice(80, 9, replace=False)
    weights = np.sort(rng.integers(0, 9000, 9))[::-1]
    dense = np.zeros(80, np.int64)
    dense[asked] = weights
    starts = v.ends - v.sizes
    truth = np.array([(dense[v.terms[s:e]] * v.impact[s:e]).sum() for s, e in zip(starts, v.ends)])
    visited = 0
    for threshold in (0, *np.quantile(truth, [0.5, 0.9, 0.99, 1]).astype(int)):
        found = {}
        for b in range(len(buckets.bounds)):
            rows, scores = buckets.reaching(b, asked, weights, dense, threshold)
            found |= dict(zip(rows.tolist(), scores.tolist()))
        assert found == {i: s for i, s in enumerate(truth.tolist()) if s >= threshold and s > 0}
        visited += len(found)
    assert visited


# ---- 12


def _whitening(rows, k):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**56 for c in v)]
    most = Counter(len(x) for _, x in good)
    d = max(most, key=lambda s: (most[s], -s))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, s = len(fit), fit.sum(axis=0)
    y = ((fit * n - s) / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > e.max() * d * 1e-15).sum()))
    out = []
    for i, x in good:
        z = np.array(x, object) * n - s
        out.append((i, int((z * z).sum()), (z / n).astype(float) @ u[:, :k] / np.sqrt(e[:k])))
    return out, n, e[:k] / e.sum()


@pytest.mark.parametrize("dimension, rank, scale", [(7, 7, 1.0), (12, 4, 3.0), (1, 1, 1.0), (6, 6, 3e9)])
def test_whitening(spark, dimension, rank, scale):
    rng = np.random.default_rng(dimension)
    base = rng.normal(size=(300, rank)) * np.arange(1, rank + 1) @ rng.normal(size=(rank, dimension)) * scale
    if rank < dimension:
        base = np.round(rng.integers(-9, 9, (300, rank)) @ rng.integers(-3, 4, (rank, dimension))).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(200)] + [(None, base[4].tolist())]
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * dimension), (2003, [None] * dimension), (2004, [float("inf")] * dimension), (2005, [1.0] * (dimension + 1)), (2006, [1e300] * dimension)]
    df = spark.createDataFrame([(i, v, "n") for i, v in rows], "vec_id long, embedding array<double>, deviation string").repartition(5)
    got = O12.whitened(df, 5).collect()
    want, n, explained = _whitening(rows, 5)
    assert len(got) == len(want) * len(explained) and {r["n"] for r in got} == {n}
    k = len(explained)
    plain = {}
    for i, deviation, w in want:
        plain.setdefault(i, []).append((deviation, w))
    mine = np.zeros((len(want), k))
    own = {}
    for r in got:
        fits = plain[r["vec_id"]][0][0] < 2**63
        assert r["deviation"] == (plain[r["vec_id"]][0][0] if fits else None)
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
        own.setdefault(r["component"], {}).setdefault(r["vec_id"], r["whitened"])
    for c in range(1, k + 1):
        a = np.array([own[c][i] for i in plain])
        b = np.array([v[0][1][c - 1] for v in plain.values()])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert mine.shape[1] == len(own)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert O12.whitened(spark.createDataFrame([], schema)).count() == 0
    assert O12.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], schema)).count() == 0
    got = O12.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 12)), r["explained"], r["deviation"]) for r in got) == [(1, 1, 1.0, 1.0, 64**2), (2, 1, 1.0, 1.0, 64**2)]


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 16, 33):
        a = rng.normal(size=(d + 2, d)) * np.logspace(0, -6, d)
        v = a.T @ a
        low = O12.pivoted_cholesky(v)
        assert np.abs(low @ low.T - v).max() < 1e-12 * v.max()
        values, vectors = O12.jacobi(low)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs((vectors * values) @ vectors.T - v).max() < 1e-12 * v.max()
        assert (np.diff(values) <= 0).all() and np.allclose(values, np.linalg.svd(a)[1] ** 2, rtol=1e-9)


def test_centring_is_exact():
    for low, high, n in ((-50, 50, 7), (10**17, 10**17 + 9, 10**6), (-2**61, 2**61, 3)):
        x = np.array([[low, high], [high, low], [low + 1, high]], np.int64)
        sums = [int(low) * n + 5, int(high) * n - 3]
        assert O12.centred(x, n, sums).tolist() == [[n * int(c) - s for c, s in zip(r, sums)] for r in x]


# ---- 13


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(4)
    idf = rng.uniform(0.5, 6, 40)
    vectors = []
    blank = O13.Index(idf, [])
    for i in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 9), replace=False))
        vectors.append((t, blank.unit(t, rng.integers(1, 9, len(t)).astype(float))))
    vectors[77] = vectors[5]
    index = O13.Index(idf, vectors)
    dense = np.zeros((500, 40))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    for _ in range(60):
        t = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        q = index.unit(t, rng.integers(1, 4, len(t)).astype(float))
        cosines = dense[:, t] @ q
        for k, without in ((1, -1), (21, 5), (600, -1)):
            found, got = index.nearest(t, q, k, without)
            order = [i for i in np.lexsort((np.arange(500), -np.round(cosines, 12))) if cosines[i] > 0 and i != without][:k]
            assert np.abs(got - cosines[order]).max() < 1e-12 and np.abs(cosines[found] - got).max() < 1e-12
            assert len(set(found.tolist())) == len(found) == len(order)


def test_toxicity_against_plain_votes(spark):
    rng = random.Random(6)
    plain, marked = [f"w{i}" for i in range(300)], ["foo", "bar", "baz", "qux"]
    rows = []
    for i in range(700):
        w = rng.choices(plain, k=rng.randint(3, 60))
        if i % 5 == 0:
            w += rng.choices(marked, k=rng.randint(1, 4))
        rng.shuffle(w)
        rows.append((i, " ".join(w).title()))
    rows += [(900 + i, rows[0][1]) for i in range(300)] + [(2000, None), (2001, ""), (2002, "unknown only"), (None, "foo bar"), (2003, " ".join(["w1"] * 9000 + ["foo"]))]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(700)] + [(None, 1, 1), (3, 0, None), (99_999, 0, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = O13.scored(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    held = [i for i in range(700) if by_id[i]["held_out"]]
    assert held and np.mean([by_id[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.98
    assert by_id[2000]["score"] == by_id[2001]["score"] == by_id[2002]["score"] < 0.5 and not by_id[2001]["evidence"]
    assert by_id[None]["predicted"] == by_id[2003]["predicted"] == 1
    # the same vectors, votes and neighbours from the words of all documents
    telling = sorted({e for e in marked})
    bags = {i: Counter(t for t in terms_of(text) if t in telling) for i, text in rows}
    n, df = len(rows), Counter(t for _, text in rows for t in set(terms_of(text)) if t in telling)

    def unit(bag):
        v = {t: (1 + math.log(c)) * math.log((n + 1) / (df[t] + 0.5)) for t, c in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else {}

    units = {i: unit(b) for i, b in bags.items()}
    trained = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5]
    for i in held:
        cosines = sorted((sum(x * units[j].get(t, 0) for t, x in units[i].items()) for j in trained), reverse=True)[:len(by_id[i]["evidence"])]
        assert np.allclose([e["cosine"] for e in by_id[i]["evidence"]], cosines, atol=1e-9)
        assert all(e["label"] == int(e["doc_id"] % 5 == 0) and zlib.crc32(str(e["doc_id"]).encode()) % 5 for e in by_id[i]["evidence"])
    none = O13.scored(docs, known.filter("false")).collect()
    assert len(none) == len(rows) and len({r["score"] for r in none}) == 1


# ---- edges


def test_edges(spark, edges):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[500:540]), "x"), (2, None, None), (None, "SAME id", "y")], "item_id long, text string, doc_id string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, None, None), (8, 0, 1), (8, 1, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    want = _ranking([(r[0], r[1]) for r in EDGES], [(1, " ".join(LONG.split()[500:540])), (None, "SAME id")], 50)
    assert sorted((tuple(r) for r in O11.ranked(edges, items).collect()), key=repr) == want
    assert len(O13.scored(edges, labels).collect()) == len(EDGES)
    assert O11.ranked(edges.limit(0), items).count() == O11.ranked(edges, items.limit(0)).count() == 0
    assert O13.scored(edges.limit(0), labels).count() == 0
    assert len(O13.scored(edges, labels.limit(0)).collect()) == len(EDGES)
