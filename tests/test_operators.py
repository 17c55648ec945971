import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfit.functions.names import norm_query
from rankfit.operators import anchors as A, assets as OA, bests as B, coverage as C, keyed as K, matching as M, ranking as R, robust as RB, sets as ST, tiers as T


def _places(spark, groups):
    rows = [(g, p, 20.0 + p) for g, places in groups.items() for p in places]
    return spark.createDataFrame(rows, "g string, place int, sec double")


def test_nth_anchors(spark):
    d = _places(spark, {"full": range(1, 17), "gap": [*range(1, 8), *range(9, 18)], "short11": range(1, 12), "short8": range(1, 9), "seven": range(1, 8), "late": [5, 6, 7], "hole": [1, 2, 3, 5, 6, 7, 8, 9]})
    got = {r["g"]: (r["first"], r["eighth"], r["sixteenth"]) for r in A.nth_anchors(d, ["g"]).collect()}
    assert got == {"full": (21, 28, 36), "gap": (21, 28, 36), "short11": (21, 28, 31), "short8": (21, 28, 28)}


def test_consecutive_depth(spark):
    d = _places(spark, {"a": [*range(1, 12), 25, 26], "b": [5, 6, 7], "c": range(1, 41)})
    got = {r["g"]: (r["swimmer_count"], r["deepest_place"], r["consecutive_depth"]) for r in A.consecutive_depth(d, ["g"]).collect()}
    assert got == {"a": (13, 26, 11), "b": (3, 7, 0), "c": (40, 40, 40)}


def _fold(versions):
    state, score = dict(versions[0][1]), versions[0][0]
    full = lambda p: sum(x in p for x in (1, 8, 16))
    for s, places in versions[1:]:
        if len(set(state) & set(places)) <= 3:
            state, score = {**places, **state}, max(score, s)
        elif s > score or (s == score and full(places) > full(state)):
            state, score = dict(places), s
    return state


def test_smart_merge_folds_in_order(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(25):
        versions = []
        for v in range(rng.randint(1, 6)):
            places = {p: round(rng.uniform(20, 60), 2) for p in rng.sample(range(1, 25), rng.randint(1, 14))}
            versions.append((rng.choice([0, 1, 3]), places))
            rows += [(g, v, p, t, versions[-1][0]) for p, t in places.items()]
        want[g] = _fold(versions)
    d = spark.createDataFrame(rows, "g int, v int, place int, sec double, session_score int")
    got = {}
    for r in A.smart_merge(d, ["g"], "v").collect():
        got.setdefault(r["g"], {})[r["place"]] = r["sec"]
    assert got == want


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    data = {"hot": np.round(rng.lognormal(3, 1.5, 4000), 2), "tiny": np.array([1.0, 2.0]), "flat": np.full(50, 7.0), "far": np.append(np.arange(3000.0), 1e300)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    d = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.05, "m": 0.5, "z": 0.95}
    stats = K.order_statistics(K.value_counts(d, ["k"], "v"), ["k"], "v", probs)
    got = {r["k"]: [r[p] for p in probs] for r in stats.select("k", *[K.interpolated(p).alias(p) for p in probs]).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, list(probs.values())).tolist())


def test_quantiles_of_a_million_values(spark):
    """One group of many values with an outlier: its ranges are of like size."""
    n = 1_000_000
    d = spark.range(n).select(F.lit("k").alias("k"), F.when(F.col("id") == n - 1, 1e300).otherwise(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")).alias("v"))
    counts = K.value_counts(d, ["k"], "v")
    got = K.order_statistics(counts, ["k"], "v", {"a": 0.25, "m": 0.5}).select(K.interpolated("a").alias("a"), K.interpolated("m").alias("m")).first()
    values = np.append(np.array([(i * 7919) % n for i in range(n - 1)], float), 1e300)
    assert tuple(got) == pytest.approx(np.quantile(values, [0.25, 0.5]).tolist())


def test_first_wins_counts_copies(spark):
    rng = random.Random(5)
    rows = [(rng.choice(("a", "b", None)), rng.choice((1, 2, None)), rng.choice(("x", "y"))) for _ in range(200)]
    kept, dropped = A.first_wins(spark.createDataFrame(rows, "k string, pos int, v string"), ["k"], ["pos"])
    low = lambda r: tuple((x is not None, x) for x in (r[1], r[0], r[2]))
    first = {k: min((r for r in rows if r[0] == k), key=low) for k in ("a", "b", None)}
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(first.values(), key=repr)
    rest = list(rows)
    for r in first.values():
        rest.remove(r)
    assert sorted((tuple(r)[:3] for r in dropped.collect()), key=repr) == sorted(rest, key=repr)


def test_grid_of_many_values(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    dim = spark.range(3000).select((F.col("id") % 2500).cast("string").alias("v")).unionByName(spark.createDataFrame([(None,)], "v string"))
    d = C.expected_grid_of(groups, {"v": dim})
    assert d.count() == 5000 and d.distinct().count() == 5000


def test_robust_profile_winsorizes_first(spark):
    rng = np.random.default_rng(2)
    sw = np.round(rng.normal(50, 3, 30), 2)
    sw[0] = 200.0
    rows = [("men", "100 Back", float(x), float(x) + 5) for x in sw] + [("men", "50 Free", 20.0, 21.0)] * 7
    got = {r["event"]: r for r in RB.robust_profile(spark.createDataFrame(rows, "gender string, event string, sw double, deep double")).collect()}
    lo, hi = np.quantile(sw, [0.05, 0.95])
    w = np.clip(sw, lo, hi)
    r = got["100 back"]
    assert r["sw_n"] == 30 and r["sw_median"] == pytest.approx(np.median(w)) and r["sw_p95"] == pytest.approx(np.quantile(w, 0.95))
    assert r["sw_mad"] == pytest.approx(np.median(np.abs(w - np.median(w))))
    assert r["spread_mad"] == pytest.approx(0.0, abs=1e-9)
    assert got["50 free"]["sw_n"] is None


@pytest.mark.parametrize("chunk", [1000, 3])
def test_carry_and_total_in_chunks(spark, chunk):
    rng = random.Random(3)
    rows = [(f, i, rng.choice([None, None, "x", "y"]), rng.randint(0, 4)) for f in "ab" for i in range(20)]
    d = spark.createDataFrame(rows, "f string, i int, v string, n int")
    got = {(r["f"], r["i"]): (r["v"], r["t"]) for r in K.running_total(
        K.carry_forward(d, ["f"], "i", ["v"], chunk=chunk), ["f"], "i", F.col("n"), "t", chunk=chunk).collect()}
    for f in "ab":
        last, total = None, 0
        for ff, i, v, n in rows:
            if ff == f:
                last, total = v or last, total + n
                assert got[(f, i)] == (last, total)


WORDS = ["north", "state", "college", "river", "stone", "harbor", "valley", "saint", "mary", "tech", "ford", "ridge"]


def _names(n, seed):
    rng = random.Random(seed)
    return sorted({" ".join(rng.sample(WORDS, rng.randint(1, 3))) for _ in range(n)})


def _typo(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1:], s[:i] + "q" + s[i:], s[:i] + "z" + s[i + 1:]]) or "q"


def test_fuzzy_pairs_match_difflib(spark):
    rng = random.Random(9)
    names = _names(120, 1) + ["ab", "abc", "a", "aaaaaaaaaaaa"]
    queries = sorted({_typo(rng, rng.choice(names)) for _ in range(150)} | {"ab", "aaaaaaaaaaaab", "b"})
    got = {(r["q"], r["s"]) for r in M.fuzzy_pairs(spark.createDataFrame([(q,) for q in queries], "q string"), "q", spark.createDataFrame([(s,) for s in names], "s string"), "s").collect()}
    want = {(q, h) for q in queries for h in difflib.get_close_matches(q, names, n=6, cutoff=0.80)}
    assert got == want


def test_contained_and_jaccard_pairs(spark):
    needles, hays = _names(40, 2) + ["ton", "st", "o"], _names(80, 3)
    n, h = spark.createDataFrame([(x,) for x in needles], "n string"), spark.createDataFrame([(x,) for x in hays], "h string")
    got = {(r["n"], r["h"]) for r in M.contained_pairs(n, "n", h, "h", 1).collect()}
    assert got == {(x, y) for x in needles for y in hays if x in y}
    toks = lambda d, c: d.withColumn("toks", F.array_distinct(F.split(c, " ")))
    got = {(r["n"], r["h"]) for r in M.jaccard_pairs(toks(n, "n"), "n", toks(h, "h"), "h").collect()}
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    assert got == {(x, y) for x in needles for y in hays if jac(x, y) >= 0.5}


def test_resolve_entities_rungs(spark):
    names = spark.createDataFrame([("Penn State", "penn state x pa"), ("Pennsylvania State University", "y"), ("Emory", "emory atlanta ga georgia"), ("Vanderbilt University", "vanderbilt university nashville tn")], "school string, surface string")
    acr = spark.createDataFrame([("vu", "Vanderbilt University"), ("zz", "Nowhere")], "short string, canonical string")
    q = spark.createDataFrame([("VU",), ("emory",), ("Penn State",), ("nashville",), ("Vanderbildt University",), ("at Emory campus",)], "query string")
    got = {(r["query"], r["school"]): round(r["score"], 2) for r in M.resolve_entities(q, names, acr).collect()}
    assert got[("VU", "Vanderbilt University")] == 1.0 and got[("emory", "Emory")] == 1.0
    assert got[("Penn State", "Pennsylvania State University")] == 0.78
    assert got[("nashville", "Vanderbilt University")] == 0.65
    assert 0.7 < got[("Vanderbildt University", "Vanderbilt University")] < 0.8
    assert got[("at Emory campus", "Emory")] == 0.80
    assert q.select(norm_query("query")).count() == 6


def test_cascade_rungs(spark):
    right = spark.createDataFrame([("X", "Alpha", 1), ("Y", "Alpha", 2), ("X", "Beta", 3), ("Z", "Long Name", 4)], "conference string, school string, pos int")
    left = spark.createDataFrame([(1, "x", "alpha", "q"), (2, "W", "Beta", "q"), (3, "W", "Alpha", "q"), (4, "W", "ln", "q"), (5, "W", "none", "Beta")], "id int, conference string, school string, raw_name string")
    short = spark.createDataFrame([("ln", "long name")], "short string, full string")
    got = {r["id"]: (r["hit"], r["rung"]) for r in M.cascade_lookup(left, right, short, "id").collect()}
    assert got == {1: (1, 1), 2: (3, 4), 3: (None, None), 4: (4, 2), 5: (3, 8)}


def test_global_exclusive_pick_is_greedy(spark):
    rng = random.Random(4)
    rows = [(e, e, f"u{rng.randint(0, 14)}", rng.randint(-10, 20)) for e in range(20) for _ in range(6)]
    best = {}
    for e, _, u, s in rows:
        best[(e, u)] = max(s, best.get((e, u), -99))
    want, used = {}, set()
    for e in range(20):
        offers = sorted((-s, u) for (x, u), s in best.items() if x == e and s >= -5 and u not in used)
        if offers:
            want[e] = offers[0][1]
            used.add(offers[0][1])
    got = OA.global_exclusive_pick(spark.createDataFrame(rows, "e int, o int, url string, score int"), "e", "o")
    assert {r["e"]: r["url"] for r in got.collect()} == want


def test_similar_entities_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["D1", "D3"]), rng.randint(5, 90), rng.choice([None, 1250, 1350, 1450]), rng.choice(["1A", "2", ""])) for i in range(60)]
    d = spark.createDataFrame(rows, "school int, division string, accept int, sat_median int, tier_short string")
    got = {}
    for r in R.similar_entities(d, limit=5).collect():
        got.setdefault(r["target"], []).append((r["rank"], r["candidate"]))

    def sel(a, s):
        return 0 if a <= 15 or (s or 0) >= 1500 else 1 if a <= 30 or (s or 0) >= 1400 else 2 if a <= 50 or (s or 0) >= 1300 else 3

    tier = {"1A": 0, "2": 2, "": 99}

    def dist(t, c):
        gap = abs(tier[t[4]] - tier[c[4]]) if tier[t[4]] != 99 and tier[c[4]] != 99 else 0
        return (0 if t[1] == c[1] else 4) + 3 * abs(sel(t[2], t[3]) - sel(c[2], c[3])) + gap

    for t in rows:
        want = sorted((dist(t, c), c[0]) for c in rows if c[0] != t[0])[:5]
        assert [c for _, c in sorted(got[t[0]])] == [c for _, c in want]


def test_share_tier_limits(spark):
    rows = [("b", "c", "men", t, s) for t, s in (("a", 100.0), ("b", 85.0), ("c", 60.0), ("d", 35.0), ("e", 34.9))]
    got = {r["team"]: r["base_tier"] for r in T.share_tiers(spark.createDataFrame(rows, "bundle_id string, conference string, gender string, team string, score_f double")).collect()}
    assert got == {"a": "Tier 1", "b": "Tier 1", "c": "Tier 2", "d": "Tier 3", "e": "Tier 4"}


def test_validate_table_issues(spark):
    rows = [("b", "c", "men", "1", "Yale", "100", 0), ("b", "c", "men", "1", "Brown", "90", 1), ("b", "c", "men", "", "MIT", "n/a", 2), ("b", "c", "men", "3", " yale ", "80", 3), ("b", "c", "men", "4", "NYU", "-1", 4), ("z", "c", "men", "1", "Zero", "0", 5)]
    clean, qa = T.validate_table(spark.createDataFrame(rows, "bundle_id string, conference string, gender string, rank string, team string, score string, pos int"))
    assert sorted(r["team"] for r in clean.collect()) == ["Brown", "Yale"]
    kinds = sorted(r["issue_type"] for r in qa.collect())
    assert kinds == ["duplicate_rank", "duplicate_team_row", "invalid_table", "malformed_score", "negative_score", "skipped_table"]


def test_seed_filter_and_gate(spark):
    base = dict(eventcourse="Y", legal=True, eventdistance=100, eventstroke="1")
    cases = {"placeholder00": ("50.10", "49.00"), "placeholder50": ("50.10", "49.50"), "small": ("50.10", "49.96"), "good": ("50.10", "49.94"), "above_cap": ("50.10", "48.85"), "slower": ("50.10", "51.11")}
    rows = [(k, *base.values(), *v) for k, v in cases.items()]
    d = spark.createDataFrame(rows, "swimmer_id string, eventcourse string, legal boolean, eventdistance int, eventstroke string, eventtime string, seedtime string")
    assert [r["swimmer_id"] for r in B.seed_pr_filter(d).collect()] == ["good"]
    g = spark.createDataFrame([("2024-01-08T01:00:00Z",), ("2024-01-08T00:00:00Z",), (None,), ("bad",)], "t string")
    assert [r[0] for r in g.select(B.freshness_gate("t", F.lit("2024-01-10 00:00:00").cast("timestamp"))).collect()] == [False, True, True, True]


def test_coverage_status_and_rollup(spark):
    grid = C.expected_grid(spark.createDataFrame([("b", "b")], "bundle_id string, conference string"), {"gender": ["men"], "event": ["50 Free", "1000 Free", "200 IM", "100 Fly"]})
    keys = ["bundle_id", "gender", "event"]
    got = spark.createDataFrame([("b", "men", "50 Free", "finals")], "bundle_id string, gender string, event string, data_quality string")
    depth = spark.createDataFrame([("b", "men", "50 Free", 20, 20, 20), ("b", "men", "200 IM", 9, 9, 9)], "bundle_id string, gender string, event string, swimmer_count long, deepest_place int, consecutive_depth int")
    cov = C.coverage_status(grid, got, depth, keys)
    assert {r["event"]: r["coverage_status"] for r in cov.collect()} == {"50 Free": "captured", "1000 Free": "missing_optional_1000", "200 IM": "missing_data_ceiling", "100 Fly": "missing_true_parser_miss"}
    roll = C.coverage_rollup(cov).first()
    assert (roll["anchors_captured"], roll["total_possible"], roll["conference_status"]) == (1, 3, "Gaps")


def test_patch_columns(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, text string, cost int")
    patch = spark.createDataFrame([("b", 9), ("c", 7)], "k string, cost int")
    got = sorted(tuple(r) for r in ST.patch_columns(base, patch, "k", ["cost"], {"text": ""}).collect())
    assert got == [("a", "x", 1), ("b", "y", 9), ("c", "", 7)]
