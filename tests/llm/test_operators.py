"""The operators against brute force, on small tables."""

import os
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankfit.llm import op1_decontamination as O1, op2_lines as O2, op3_language as O3, op4_packing as O4, op5_simhash as O5
from rankfit.llm import op6_html as O6, op7_secrets as O7, op8_quality as O8, op9_forest as O9, op10_chat as O10
from rankfit.llm.common import components, segment_sums

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- 1


def test_masks_hit_every_overlap():
    for size, gone in [(O1.WITHIN, 2), *[(n, 0) for n in range(O1.SPAN, O1.NEEDED + 1)], (12, 1)]:
        for out in combinations(range(size), gone):
            there = [i not in out for i in range(size)]
            assert any(all(there[o + p] for p in mask) for mask in O1.MASKS for o in range(size - O1.SPAN + 1)), (size, out)


def _overlaps(docs, items):
    found = {}
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for d, text in docs:
        w = tok(text)
        for item, b in items:
            b = tok(b)
            if not b:
                continue
            for s in range(-len(b) + 1, len(w)):
                eq = [0 <= s + j < len(w) and w[s + j] == b[j] for j in range(len(b))]
                if any(eq[j] and sum(eq[j:j + O1.WITHIN]) >= min(O1.NEEDED, len(b)) for j in range(len(b))):
                    found[d, item] = max(found.get((d, item), (0, 0, -10**9)), (sum(eq), len(b), -s))
    return {(d, i, n, m, -s) for (d, i), (n, m, s) in found.items()}


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_overlaps(spark, broadcast):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate((5, 8, 9, 11, 12, 13, 20, 40))] + [(50, prose(rng, 2)), (51, prose(rng, 2)), (52, "zzz"), (53, prose(rng, 7))] + [(99, None), (98, "")]
    docs = [(i, prose(rng, 60)) for i in range(20)]
    for i, (_, text) in enumerate(items[:8]):
        w = text.split()
        for gone in (0, 1, 2, 3, 6):
            v = list(w)
            for p in rng.sample(range(len(v)), min(gone, len(v))):
                v[p] = "zzz"
            docs.append((len(docs), prose(rng, rng.randint(0, 9)) + " " + " ".join(v).upper() + ", " + prose(rng, 3)))
        docs.append((len(docs), " ".join(w[3:]) + " tail"))
    docs += [(None, items[7][1]), (5, items[6][1]), (500, None), (501, "")]
    got = O1.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast)
    assert {tuple(r) for r in got.collect()} == _overlaps(docs, items)


# ---- 2


def _repeats(docs, least):
    """Lines to delete by comparing all windows with all earlier ones."""
    seen, gone = {"f": {}, "b": {}}, {}
    for d, text in sorted(docs):
        lines = [(i, x.strip(" "), x.strip(" ").count(" ") + 1) for i, x in enumerate(text.split("\n")) if x.strip(" ")]
        for way in "fb":
            for a in range(len(lines)):
                own, total = [], 0
                for x in lines[a:] if way == "f" else lines[a::-1]:
                    own.append(x)
                    total += x[2]
                    if total >= least:
                        break
                if total < least:
                    continue
                own = sorted(own)
                key, place = tuple(x[1] for x in own), (d, own[0][0], own[-1][0])
                first = seen[way].setdefault(key, place)
                if first != place and (first[0] != d or first[2] < own[0][0]):
                    gone.setdefault(d, set()).update(range(own[0][0], own[-1][0] + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs}


def test_repeated_runs(spark):
    rng = random.Random(5)
    pool = [prose(rng, rng.choice((1, 3, 8, 20, 60))) for _ in range(30)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice((x, f" {x} ")) for x in rng.choices(pool, k=rng.randint(1, 30)))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in O2.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 20).collect()}
    assert got == _repeats(docs, 20)
    assert any(got[d] != t for d, t in docs) and got[0] != ""


def test_a_run_that_repeats_itself_keeps_its_first_words(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, "\n".join([ten] * 10)), (2, "\n".join(["x", *[ten] * 5, "y"])), (3, "\n".join([ten] * 7))] + [(9, f"{ten}\nz\n{ten}")] * 50
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in O2.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("\n".join([ten] * 5), 5), 2: ("x\ny", 5), 3: ("", 7), 9: (f"{ten}\nz\n{ten}", 0)}


def test_lines_with_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x", "y")], "doc_id long, text string, n_chars long, `a``b` string, `c.d` string")
    assert O2.cleaned(df).columns == df.columns and O2.without_repeats(df).first()["a`b"] == "x"


# ---- 3 and 8


def test_language_learns(spark):
    rng = random.Random(1)
    sets = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sets))
        rows.append((i, " ".join("".join(rng.choice(sets[lang]) for _ in range(5)) for _ in range(rng.randint(2, 40))), lang))
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "abcde", None)]
    got = {r["doc_id"]: r for r in O3.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, x in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in got.items() if r["held_out"] and i < 300) == held
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_ngrams_do_not_depend_on_the_batch():
    docs = ["Ab, c", "", "ÉÀ x  9y", "é", "z" * 50]
    together, counts, _ = O3._ngrams(docs)
    bounds = [np.concatenate(([0], np.cumsum(c))) for c in counts]
    for i, d in enumerate(docs):
        alone, _, _ = O3._ngrams([d])
        for k, g in enumerate(alone):
            assert together[k][bounds[k][i]:bounds[k][i + 1]].tolist() == g.tolist()
    words, n = zip(*O8._features(["a b", "B c! d", ""]))
    alone = O8._features(["B c! d"])
    assert [w[m[0]:m[0] + m[1]].tolist() for w, m in zip(words, n)] == [a.tolist() for a, _ in alone]


def test_quality_learns(spark):
    rng = random.Random(2)
    good = lambda: prose(rng, 30) + "."
    bad = lambda: " ".join(rng.choice((w.upper() + "!!", w + "###")) for w in prose(rng, 30).split())
    docs = [(i, good() if i % 3 else bad()) for i in range(400)] + [(1000, None), (1001, "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (7, None, None)]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in O8.scored(*args).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.97
    assert got[1000]["score"] == got[1001]["score"] and all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    none = O8.scored(args[0], args[1].filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def _plain_features(text):
    """Feature numbers of a text, one at a time."""
    data = text.encode()
    kind = lambda c: 0 if c in b"\t\n\v\f\r " else 1 if chr(c).islower() and c < 128 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4
    group = lambda c: 0 if kind(c) == 0 else 2 if kind(c) == 4 else 1
    mask = (1 << 64) - 1
    powers = [1]
    for _ in range(255):
        powers.append((powers[-1] * O8._R + 0x9E37) & mask)
    tokens, at = [], 0
    while at < len(data):
        end = at + 1
        while end < len(data) and group(data[end]) == group(data[at]):
            end += 1
        if group(data[at]):
            tokens.append(data[at:end])
        at = end
    hashes, forms = [], []
    for t in tokens:
        hashes.append(sum((c + 32 * (65 <= c <= 90) + 7) * powers[i & 255] for i, c in enumerate(t)) & mask)
        upper, digit = sum(kind(c) == 2 for c in t), sum(kind(c) == 3 for c in t)
        form = O8.SIGNS if group(t[0]) == 2 else O8.DIGIT if digit else O8.LOWER if not upper else O8.TITLE if upper == 1 and len(t) > 1 else O8.UPPER
        forms.append(O8.AGAIN if hashes[:-1] and hashes[-2] == hashes[-1] else form)

    def bucket(h):
        h &= mask
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask
        return h >> 46

    salt = lambda x: x * 0x9E3779B97F4A7C15 & mask
    out = [bucket(h ^ salt(1)) for h in hashes] + [bucket((a * 0xD6E8FEB86659FD93 + b & mask) ^ salt(2)) for a, b in zip(hashes, hashes[1:])]
    out += [bucket(f + salt(3)) for f in forms] + [bucket(8 * a + b + salt(4)) for a, b in zip(forms, forms[1:])]
    return out + [bucket(64 * a + 8 * b + c + salt(5)) for a, b, c in zip(forms, forms[1:], forms[2:])]


def test_quality_against_a_plain_model(spark):
    """Features, training and scores with dictionaries and one coordinate at a time."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice((w, w.title(), w.upper(), f"{w},", f"{w}{rng.randint(0, 9)}!", "é" + w, w + " " + w)) for w in prose(rng, rng.randint(1, 25)).split()) for _ in range(60)]
    docs = list(enumerate(texts)) + [(100, None), (101, ""), (102, " \n")]
    labels = [(i, int(sum(c.isupper() for c in t) * 5 > len(t))) for i, t in enumerate(texts)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in O8.scored(*frames).collect()}
    p = O8.PENALTIES
    rows = []
    for i, y in sorted(((i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda x: (str(x[0]), x[1])):
        found = _plain_features(texts[i])
        rows.append(({f: np.float32(np.float32(found.count(f) / len(found)) * O8.SCALE) for f in sorted(set(found))} | {O8.BIAS: np.float32(1)}, y))
    z, n = ({}, {}), ({}, {})

    def weight(m, f):
        at = z[m].get(f, 0.0)
        return 0.0 if abs(at) <= p.l1 else -(at - np.sign(at) * p.l1) / ((p.beta + np.sqrt(n[m].get(f, 0.0))) / p.alpha + p.l2)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            w = [{f: weight(m, f) for f in x} for m in (0, 1)]
            s = np.array([sum(float(v) * w[m][f] for f, v in x.items()) for m in (0, 1)])
            e = np.exp(s - s.max())
            for m in (0, 1):
                for f, v in x.items():
                    g, old = float(v) * (e[m] / e.sum() - (y == m)), n[m].get(f, 0.0)
                    z[m][f] = z[m].get(f, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / p.alpha * w[m][f]
                    n[m][f] = old + g * g
    for i, text in docs:
        found = _plain_features(text or "")
        s = weight(1, O8.BIAS) - weight(0, O8.BIAS) + O8.SCALE * sum(weight(1, f) - weight(0, f) for f in found) / max(len(found), 1)
        assert abs(got[i] - 1 / (1 + np.exp(-s))) < 1e-5, i


# ---- 4


def test_packing(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [prose(rng, rng.choice((0, 1, 5, 50, 400, 3000))) + rng.choice(("", " é, İx", " <|endoftext|>")) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    rows = O4.packed(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for pieces in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in v) == len(ids[d]) for d, v in by_doc.items())
    fills = [sum(n for _, n in v) for v in by_seq.values()]
    assert max(fills) <= 2048 and len(fills) == -(-sum(fills) // 2048)


def test_words_equal_the_tokenizer():
    import public_tokenizers

    words = O4.Words.of(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["Don't x's l'été É ſtraße İstanbul ΑΣ wh### wh,%%% a1b2 <|endoftext|> abc<|endoftext|>, a|b| é́ \x1c a\x1cb 日本語 ǅ ŉa º ẞ 🙂"]
    texts += ["".join(rng.choice("aAéÉ'sS.,#1_日 İſ́\t|<>ßΣ") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for t, got in zip(texts, words.ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


# ---- 5


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_triples_cover_every_four_positions():
    triples = O5.covering_triples()
    assert len(triples) == 20 == len(set(triples))
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_duplicates(spark):
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 5, 40, 200)] + [None, "\n", "É b c D e"]
    base = prose(rng, 300).split()
    for _ in range(40):
        v = list(base)
        for p in rng.sample(range(300), rng.randint(0, 12)):
            v[p] = rng.choice(WORDS)
        texts.append(" ".join(v))
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in O5.near_duplicates(docs).collect()}
    fps = {i * 3 + 1: _fingerprint(t) for i, t in enumerate(texts)}
    root = {i: i for i in fps}
    for _ in fps:
        for i, j in combinations(fps, 2):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[i] = root[j] = min(root[i], root[j])
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert len(set(root.values())) < len(root) - 10
    kept = [r["doc_id"] for r in O5.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(root.values()))


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_large_lists(spark, block):
    """Many fingerprints that share bytes: lists longer than a block give the same components as all pairs."""
    rng = random.Random(8)
    fps = list({(0x1122334455667788 ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 6)))) for _ in range(150)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r["node"]: r["root"] for r in components(O5.links(df, block)).collect()}
    want = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for i, j in combinations(fps, 2):
            if (i ^ j).bit_count() <= 4 and want[i] != want[j]:
                want[i] = want[j] = min(want[i], want[j])
                changed = True
    assert {f: root.get(f, f) for f in fps} == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in want:
        for u, v in edges:
            want[u] = want[v] = min(want[u], want[v])
    assert root == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


# ---- 6


def _article(rng, n):
    return "".join(f"<p>{prose(rng, rng.randint(5, 60))}, {prose(rng, 4)}.</p>" for _ in range(n))


def test_html(spark):
    rng = random.Random(10)
    pages, want = [], {}
    for i in range(60):
        body = _article(rng, rng.randint(1, 6))
        pages.append((i, "u", f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>one</a></li></ul></nav><div class=ad>Buy, now.</div>"
                      f"<article><h1>Head &amp; {i}</h1>{body}</article><footer>&copy; us. All of it, too.</footer></body></html>"))
        want[i] = "\n\n".join([f"Head & {i}", *re.findall("<p>(.*?)</p>", body)])
    more = {900: ("", ""), 901: (None, ""), 902: ("<p>a <b>b\n</b>c<br>d<p>e", None), 903: ("<article><p>Text, &eacute;&nbsp;x.<script>var t='</p>';</script><div class='comments'><p>Nice, really.</p></div></article>", "Text, é x."),
            904: ("<" * 2000, None), 905: ("<div><article><p>unclosed, text", "unclosed, text"), 906: ("<article>" + "<div>" * 3000 + "deep", "deep"),
            907: ("<!-- <article>x</article> --><main><p>One.</p><form><p>Name, please.</p></form></main>", "One.")}
    rows = pages + [(k, None, v[0]) for k, v in more.items()]
    got = {r["page_id"]: r for r in O6.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i]["text"] for i in want} == want
    for k, (_, text) in more.items():
        assert text is None or got[k]["text"] == text, k
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_marginals_equal_enumeration():
    page = O6.Page("<div><p>one</p><ul><li>two</li></ul></div>")
    rng = np.random.default_rng(0)
    model = O6.Model(rng.normal(size=O6.BUCKETS), rng.normal(size=(2, 2, 2)))
    n = len(page.parent)
    own = [sum(model.weights[list(f)]) for f in page.features]
    total, each = 0.0, np.zeros(n)
    for state in range(1 << n):
        x = [state >> i & 1 for i in range(n)]
        s = np.exp(sum(o for o, y in zip(own, x) if y) + sum(model.pairs[int(i in page.leaf)][x[page.parent[i]]][x[i]] for i in range(1, n)))
        total += s
        each += s * np.array(x)
    assert np.allclose(model.marginals([page]), each / total)


# ---- 7

BASE = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)}


def test_secrets(spark):
    import hashlib

    rng = random.Random(12)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "apikey", ":", "=", " = ", '"', "'", "AKIA", "ABCDEF0123", "deadbeef" * 4, "0123abcd", "hunter2", "é🙂", " ", "\n", "x.y-z_1", "token: token: "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)] + [None, "", "ghp_" + "xy" * 20]
    texts += texts[:20]
    got = {r["doc_id"]: r for r in O7.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(t or "") if ok(m)]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(f[2] == k for f in found) for k in BASE]
        assert set(base.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert got[402]["spans"] == "provider:0:44"


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "token=abcdefgh1"), ("c", None)], "path string, text string")
    paths, ledger = O7.scan(one, O7.RULES[:2])
    ledger = ledger.cache()
    assert ledger.count() == 4 and paths.count() == 3
    marked = ledger.withColumn("spans", F.array(F.struct(F.lit("kept").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"))))
    two = spark.createDataFrame([("a", "token=abcdefgh1"), ("d", "secret=12345678")], "path string, text string")
    _, after = O7.scan(two, O7.RULES[:3], marked)
    by = {(r["blob"][:6], r["kind"]): r["spans"] for r in after.collect()}
    assert len(by) == 4 + 1 + 3 and sum(bool(s) and s[0]["kind"] == "kept" for s in by.values()) == 4


# ---- 9


def test_nearest(spark):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(1200, 16)).astype(np.float32)
    v[50:90] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(100, None), (2000, []), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15), (2400, [1.0] * 5), (None, [1.0] * 16), (0, rows[0][1])]
    rows = [r for r in rows if r[0] != 100] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = O9.nearest(df, leaf=32).collect()
    ids = np.array([i for i in range(1200) if i != 100])
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v[ids].astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        best = [(d[i], ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - d[ids == i][0]) < 1e-12 for _, i, s in own)
        hit += len({i for _, i in best} & {i for _, i, _ in own})
        total += 10
    assert hit / total >= 0.9 and {r["query_id"] for r in got} == set(ids[ids % 100 == 0].tolist())
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(50, 60))


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_given_tables(spark, sf):
    """The query's own set against exact search."""
    path = f"/root/testdata/sf{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("given tables absent")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(path).collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    hit = total = 0
    found = {}
    for r in O9.nearest(spark.read.parquet(path)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        best = [ids[i] for i in np.lexsort((ids, d)) if i != q][:10]
        hit, total = hit + len(set(best) & found[ids[q]]), total + len(best)
    assert hit / total >= 0.9, hit / total


def test_groups_of_bounded_size(spark, monkeypatch):
    """Dealt vectors and dealt queries give the same result."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(tuple(r) for r in O9.nearest(df, leaf=16).collect())
    monkeypatch.setattr(O9, "CHUNK", 40)
    monkeypatch.setattr(O9, "ASKED", 2)
    assert sorted(tuple(r) for r in O9.nearest(df, leaf=16).collect()) == plain


# ---- 10


def _cheapest(roles):
    best = {O10.START: 0}
    for r in roles:
        now = {}
        for s, c in best.items():
            for t in (1, 2, 3):
                if O10.STEPS[r, s, t] < O10.NEVER:
                    now[t] = min(now.get(t, 10**9), c + int(O10.STEPS[r, s, t] // O10.UNIT))
        best = now
    return min(c + int(O10.LAST[s] // O10.UNIT) for s, c in best.items())


@pytest.mark.parametrize("stretch", [3, 1024])
def test_chat(spark, monkeypatch, stretch):
    monkeypatch.setattr(O10, "STRETCH", stretch)
    rng = random.Random(14)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "User ", None, "tool"]), rng.choice([f"t{t}", "", None])) for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (70, None, None, None)]
    got = O10.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    convs = {}
    for r in sorted(got, key=lambda r: (r["segment"], r["n"])):
        convs.setdefault(r["conv_id"], []).append(r)
    assert sum(map(len, convs.values())) == len(set(rows))
    for c, own in convs.items():
        order = sorted({r for r in rows if r[0] == c}, key=lambda r: [(x is not None, x) for x in r[1:]])
        assert own[0]["cost"] == _cheapest([O10.role_number(r[2]) for r in order])
        whole = "".join(r["rendered"] for r in own)
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
        assert re.fullmatch("(s)?(ua)+", "".join(x[0] for x in roles)), roles
        assert whole.count("<|end|>\n") == len(roles) and whole.endswith("<|end|>\n")


def test_chat_does_not_depend_on_stretches(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), f"t{rng.random()}") for c in range(30) for t in range(rng.randint(1, 40))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = []
    for stretch in (4, 7, 1024):
        monkeypatch.setattr(O10, "STRETCH", stretch)
        told.append(sorted((r["conv_id"], r["turn"], r["role"], r["rendered"], r["cost"]) for r in O10.formatted(turns).collect()))
    assert told[0] == told[1] == told[2]


def test_segment_sums():
    assert segment_sums(np.array([1, 2, 3, 4]), np.array([0, 2, 0, 1, 1, 0])).tolist() == [0, 3, 0, 3, 4, 0]
