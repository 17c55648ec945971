"""Faults that only larger tables showed."""

import random
import re

from pyspark.sql import functions as F

from rankfit.functions import scoring as SC, text as TX
from rankfit.operators import assets as OA, extraction as X, matching as M, topscore as S
from rankfit.queries import all_queries
from rankfit.queries.base import Tables
from rankfit.queries.plans import universe


def test_ranks_of_more_than_three_digits(spark, one):
    assert one(TX.score_line("x"), "1000. Yale   1010")["team"] == "Yale"
    assert one(TX.score_line("x"), "2024  Yale   1010") is None
    texts = ["Men's Team Scores", *[f"{i}. Yale {i}   {10 + i}" for i in range(980, 1030)]]
    lines = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(texts)], "source_file string, page_no int, line_no int, text string")
    rows = X.wide_score_rows(lines).agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
    assert (rows["n"], rows["top"]) == (50, 1039.0)


def test_similar_sets_are_verified_where_they_lie(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    some = lambda n: [(i, sorted(set(rng.choices(words, k=rng.randint(0, 12))))) for i in range(n)]
    a, b = some(60), some(300)
    left, right = (spark.createDataFrame(d, f"{k} int, toks array<string>") for d, k in ((a, "l"), (b, "r")))
    for threshold in (0.3, 0.5, 1.0):
        want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in a for j, y in b if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold}
        for small in (1 << 21, 0):
            monkeypatch.setattr(M, "SMALL_POSTINGS", small)
            got = M.jaccard_pairs(left, "l", right, "r", threshold=threshold)
            assert [tuple(x) for x in sorted(got.collect())] == [(*k, v) for k, v in sorted(want.items())]
            if small:
                # neither rows of the right nor candidates are dealt out by their token lists
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert not re.search(r"hashpartitioning\(_setr", plan)


def _times(spark):
    rng = random.Random(3)
    times = spark.createDataFrame([(s, f"e{e}", 20.0 + rng.random() * 30) for s in range(30) for e in range(7)], "swimmer int, event string, sec double")
    anchors = spark.createDataFrame([(c, f"e{e}", 22.0 + i, 26.0 + i, 31.0 + i, 0.6) for i, c in enumerate("AB") for e in range(7)], "conference string, event string, first double, eighth double, sixteenth double, sec_per_place double")
    return times, anchors


def test_scores_are_dealt_out_once(spark):
    times, anchors = _times(spark)
    for sums in (S.top_k_sum, lambda d: S.weighted_top_k_sum(d, [1.0, 0.5])):
        d = sums(S.score_events(S.dealt(times), anchors))
        assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, d.collect())) == sorted(map(tuple, sums(S.score_events(times, anchors)).collect()))


def test_variants_meet_before_the_teams(spark):
    times, anchors = _times(spark)
    anchors = anchors.withColumns({"fifth": F.col("first") + 2, "fourteenth": F.col("eighth") + 3})
    teams = spark.createDataFrame([("A", "x", 1.1), ("A", "y", 0.8), ("B", "z", 1.0)], "conference string, school string, psf double")
    scored = S.score_variants(times, anchors, {"prod": (SC.estimate_place("sec", "first", "eighth", "sixteenth", "sec_per_place"), SC.confidence_weight), "exp": (SC.estimate_place_5_14("sec", "first", "fifth", "fourteenth"), SC.confidence_5_14)})
    a, b = (S.top_k_sum(S.variant_scores(scored, v)) for v in ("prod", "exp"))
    shifts = S.event_shifts(scored, "prod", "exp")
    cols = ["swimmer", "school", "delta_raw", "delta_adj", "tier_change", "place_shifts", "n_shifts"]
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    got = rows(S.compare_sums(a, b, shifts, teams))
    assert got and got == rows(S.variant_compare(S.spread_to_teams(a, teams), S.spread_to_teams(b, teams), shifts))
    assert all(n == len([x for x in text.split("; ") if x]) for *_, text, n in got) and any(x[-1] for x in got)


def test_missing_values_are_not_one_key(spark):
    rows = spark.range(400).select(F.col("id").alias("school"), F.when(F.col("id") % 4 == 0, F.lit("shared")).when(F.col("id") % 4 == 1, F.col("id").cast("string")).alias("hero"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = OA.null_shared(rows, ["hero"], "school")
        plan = d._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["school"], r["hero"], r["hero_fallback"]) for r in d.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(hero#", plan)
    assert [(i, h, f) for i, h, f in got] == [(i, str(i) if i % 4 == 1 else None, i % 4 != 1) for i in range(400)]


def test_categories_search_what_holds_the_key(spark):
    rng = random.Random(5)
    pairs = [*TX.CONFERENCE_MAP, *TX.CONFERENCE_BUILTIN]
    texts = ["".join(rng.choice([rng.choice(pairs)[0], "_", "-", " ", "\t", "2024", "x", "."]) for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def first(text):
        low = text.lower()
        bare = re.sub(r"[_\-\s]", "", low)
        return next((label for key, label in pairs if any(re.search(rf"(?<![a-z0-9]){key}(?![a-z0-9])", x) for x in (low, bare))), "Unknown")

    d = spark.createDataFrame([(x,) for x in texts], "x string").select("x", TX.first_match_category("x", pairs).alias("y"))
    assert "regexp_replace" not in d._jdf.queryExecution().analyzed().toString()
    assert [(r["x"], r["y"]) for r in d.collect()] == [(x, first(x)) for x in texts]


def test_only_who_searches_is_scored(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    some = t.swimmers.filter("swimmer % 10 = 3").select("swimmer")
    cols = ["swimmer", "school", "raw_pts", "adj_pts", "top_events", "label"]
    got = sorted(map(tuple, universe(t, some).select(*cols).collect()))
    assert got and got == sorted(map(tuple, universe(t).filter("swimmer % 10 = 3").select(*cols).collect()))


def test_texts_are_looked_up_by_number(spark, monkeypatch):
    rng = random.Random(11)
    words = ["nation", "na", "3", "x", "tion 3", "ation", "zz", "on"]
    hays = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(200)] + [None, ""]
    needles = ["n", "on", "ion", "tion", "nation 3", "ation zz", "nowhere", "zz" * 40, "", None]
    h, n = spark.createDataFrame([(x,) for x in hays], "hay string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    for least in (1, 4):
        want = sorted({(x, y) for x in needles for y in hays if x and y and len(x) >= least and x in y})
        for most in (1 << 21, 100, 0):
            monkeypatch.setattr(M, "SMALL_POSTINGS", most)
            got = M.contained_pairs(n, "needle", h, "hay", least)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            # no text goes along with its grams
            assert "Generate explode(" in plan and not re.search(r"Generate explode\(.*hay#.*\), false", plan)
            assert sorted(map(tuple, got.collect())) == want


def test_only_orders_of_who_searches_are_read(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    some = t.swimmers.filter("swimmer % 10 = 3").select("swimmer")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = universe(t, some)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\(l_orderkey", plan)


def test_every_shift_is_written(spark):
    rows = [("e4", 3.0, 20.0, 3.5, 20.0), ("e1", 1.0, 20.0, 2.25, 17.0), ("e2", 3.0, 16.0, 3.4, 16.4), ("e3", 18.62, 0.0, 17.25, 0.0), ("e0", 2.0, 1.0, None, None), ("e5", 14.0, 3.9, 14.0, 6.0)]
    scored = spark.createDataFrame([(1, "A", *r) for r in rows] + [(2, "A", "e2", 3.0, 16.0, 3.0, 16.0)], "swimmer int, conference string, event string, place_prod double, pts_prod double, place_exp double, pts_exp double")
    got = {r["swimmer"]: (r["place_shifts"], r["n_shifts"]) for r in S.shift_texts(S.event_shifts(scored, "prod", "exp"), ["swimmer", "conference"]).collect()}
    assert got == {2: ("", 0), 1: ("; ".join([
        "e1: prod pl=1.0/pts=20.0 → exp pl=2.3/pts=17.0 (Δplace=+1.3, Δpts=-3.0)", "e4: prod pl=3.0/pts=20.0 → exp pl=3.5/pts=20.0 (Δplace=+0.5, Δpts=+0.0)",
        "e5: prod pl=14.0/pts=3.9 → exp pl=14.0/pts=6.0 (Δplace=+0.0, Δpts=+2.1)", "e3: prod pl=18.6/pts=0.0 → exp pl=17.3/pts=0.0 (Δplace=-1.4, Δpts=+0.0)"]), 4)}
    out = all_queries()["variant_compare"](spark, "/root/testdata/sf0.001").select("shifts", "place_shifts").collect()
    assert any(r["shifts"] for r in out) and all(r["shifts"] == r["place_shifts"].count(" → exp pl=") for r in out)
