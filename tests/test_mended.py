"""Cases of long groups, contended pools, odd ids and plans without cross joins."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfit.functions import assets as AS, text as TX
from rankfit.operators import anchors as A, assets as OA, extraction as X, matching as M, ranking as R, robust as RB
from rankfit.operators.keyed import global_rank
from rankfit.queries import all_queries
from rankfit.session import short_values
from rankfit.sources import staging as ST, tables as TB


def _fold(versions):
    """The rule of the merge, version by version: (places, session score)."""
    state = None
    for places, score in versions:
        if state is None:
            state = (dict(places), score)
            continue
        own, best = state
        full = lambda d: sum(p in d for p in (1, 8, 16))
        if len(own.keys() & places.keys()) <= 3:
            state = ({**places, **own}, max(best, score))
        elif (score, full(places)) > (best, full(own)):
            state = (dict(places), score)
    return state[0]


def test_smart_merge_of_many_versions(spark):
    rng = random.Random(1)
    groups = {"hot": 1500, "b": 7, "c": 1}
    rows, want = [], {}
    for g, n in groups.items():
        versions = [({p: rng.random() for p in rng.sample(range(1, 30), rng.randint(1, 6))}, rng.randint(0, 3)) for _ in range(n)]
        rows += [(g, v, p, s, score) for v, (places, score) in enumerate(versions) for p, s in places.items()]
        want[g] = _fold(versions)
    df = spark.createDataFrame(rows, "grp string, version int, place int, sec double, session_score int").repartition(7)
    got = {}
    for r in A.smart_merge(df, ["grp"], "version").collect():
        got.setdefault(r["grp"], {})[r["place"]] = r["sec"]
    assert got == want


@pytest.mark.parametrize("n,block", [(2000, 512), (60, 7)])
def test_contended_pool(spark, n, block):
    """Entities that all want the same urls choose one by one."""
    rng = random.Random(2)
    few = 25
    rows = [(e, e, f"u{u:04d}", 50 - u) for e in range(n) for u in range(few)] + [(e, e, f"own{e}", rng.choice((-9, 1))) for e in range(n)]
    taken, want = set(), {}
    offers = {}
    for e, _, u, s in rows:
        if s >= -5:
            offers.setdefault(e, []).append((-s, u))
    for e in sorted(offers):
        for s, u in sorted(offers[e]):
            if u not in taken:
                taken.add(u)
                want[e] = u
                break
    df = spark.createDataFrame(rows, "entity int, ord int, url string, score int")
    got = {r["entity"]: r["url"] for r in OA.global_exclusive_pick(df, "entity", "ord", block=block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_exclusive_pick_of_random_pools(spark, block):
    rng = random.Random(block)
    rows = [(e, rng.choice((None, e // 3)) if e % 5 == 0 else e // 3, f"u{rng.randint(0, 40)}", rng.randint(-9, 9)) for e in range(40) for _ in range(5)]
    first = {}
    for e, o, _, s in rows:
        if s >= -5:
            first[e] = min(first.get(e, (2, 0)), (o is not None, o or 0))
    taken, want = set(), {}
    for e in sorted(first, key=lambda e: (first[e], e)):
        best = {}
        for x, _, u, s in rows:
            if x == e and s >= -5 and u not in taken:
                best[u] = max(s, best.get(u, -99))
        if best:
            want[e] = min(best, key=lambda u: (-best[u], u))
            taken.add(want[e])
    df = spark.createDataFrame(rows, "entity int, ord int, url string, score int")
    assert {r["entity"]: r["url"] for r in OA.global_exclusive_pick(df, "entity", "ord", block=block).collect()} == want


def test_contended_pool_takes_few_rounds(spark, monkeypatch):
    """20,000 entities after the same urls."""
    rounds = []
    one = OA._block_round
    monkeypatch.setattr(OA, "_block_round", lambda *a: rounds.append(1) or one(*a))
    n, few = 20_000, 12
    d = spark.range(n).select(F.col("id").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(few))).alias("i"))
    d = d.select("entity", F.col("entity").alias("ord"), F.when(F.col("i") < few, F.concat(F.lit("u"), (F.floor(F.col("entity") / 2000) * few + F.col("i")).cast("string")))
                 .otherwise(F.concat(F.lit("own"), F.col("entity").cast("string"))).alias("url"), (100 - F.col("i")).cast("int").alias("score"))
    got = {r["entity"]: r["url"] for r in OA.global_exclusive_pick(d, "entity", "ord").collect()}
    assert len(rounds) <= 40
    assert got == {e: f"u{e // 2000 * few + e % 2000}" if e % 2000 < few else f"own{e}" for e in range(n)}


def test_similar_entities_of_many_divisions(spark):
    rng = random.Random(8)
    rows = [(f"s{i:05d}", f"d{i % 10_000}" if i % 7 else None, rng.randint(5, 90), rng.choice([None, 1250, 1350, 1450, 1550]), rng.choice(["1A", "1B", "2", "3", ""])) for i in range(12_000)]
    d = spark.createDataFrame(rows, "school string, division string, accept int, sat_median int, tier_short string")
    asked = {r[0]: r for r in rng.sample(rows, 25)}
    got = {}
    for r in R.similar_entities(d, limit=7).filter(F.col("target").isin(list(asked))).collect():
        got.setdefault(r["target"], []).append((r["rank"], r["distance"], r["candidate"]))
    sel = lambda a, s: 0 if a <= 15 or (s or 0) >= 1500 else 1 if a <= 30 or (s or 0) >= 1400 else 2 if a <= 50 or (s or 0) >= 1300 else 3
    tier = {"1A": 0, "1B": 1, "2": 2, "3": 3, "": 99}
    for name, t in asked.items():
        gap = lambda c: abs(tier[t[4]] - tier[c[4]]) if 99 not in (tier[t[4]], tier[c[4]]) else 0
        far = sorted(((0 if (t[1] or "") == (c[1] or "") else 4) + 3 * abs(sel(t[2], t[3]) - sel(c[2], c[3])) + gap(c), c[0]) for c in rows if c[0] != name)[:7]
        assert [(a, b) for _, a, b in sorted(got[name])] == far


def test_global_rank(spark):
    rng = random.Random(9)
    rows = [(rng.choice(("hot", "hot", "b", None)), rng.choice((None, rng.randint(0, 30))), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    order = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    got = {r["id"]: r["position"] for r in global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=order))}
    got = {r["id"]: r["at"] for r in global_rank(df, [F.desc("v"), F.asc("id")], "at", ["k"]).collect()}
    for k in ("hot", "b", None):
        assert {r[2]: got[r[2]] for r in rows if r[0] == k} == {r[2]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=order))}
    assert global_rank(df.limit(0), [F.asc("id")]).count() == 0


def test_first_wins_keeps_one_row(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 1, "a"), ("k", 2, "c"), (None, 1, "x")], "k string, pos int, v string")
    kept, dropped = A.first_wins(df, ["k"], ["pos"])
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([("k", 1, "a"), (None, 1, "x")], key=str)
    assert sorted(r["v"] for r in dropped.collect()) == ["a", "b", "c"]


def test_last_anchor_row_wins(spark):
    cols = "Conference string, Gender string, Event string, `1st` string, `8th` string, `16th` string"
    raw = spark.createDataFrame([("C", "men", "50 Free", "20", "21", "22"), ("C", "men", "50 Free", "19", "21", "22")], cols).coalesce(1)
    assert [r["first"] for r in TB.scan_anchors(raw).collect()] == [19.0]


def test_stage_ids_keep_their_type(spark, tmp_path):
    rows = spark.createDataFrame([("007", 1), ("7", 2)], "bundle_id string, v int")
    marks = ST.stage_partitions(rows, spark.createDataFrame([("007",), ("7",), ("x",)], "bundle_id string"), f"{tmp_path}/s")
    assert sorted(map(tuple, marks.collect())) == [("007", "staged"), ("7", "staged"), ("x", "empty")]
    assert sorted(map(tuple, ST.read_stages(spark, f"{tmp_path}/s").select("bundle_id", "v").collect())) == [("007", 1), ("7", 2)]


def test_missing_category_joins_the_campus(spark):
    rows = [("s", c, f"u{i}{c}", float(i)) for i in range(30) for c in ("campus", None)]
    df = spark.createDataFrame(rows, "school string, category string, url string, score double")
    assert OA.trim_per_category(df).count() == 24


def test_images_once_per_page(spark):
    html = "<img src='/a.png'><img src='b/../a.png'><img src='/b.png'>"
    got = AS.extract_images(spark.createDataFrame([(1, "http://h.x/", html)], "page_id int, url string, html string")).collect()
    assert [r["image_url"] for r in got] == ["http://h.x/a.png", "http://h.x/b.png"]


@pytest.mark.parametrize("raw,want", [("../" * 7 + "x.png", "http://h/x.png"), ("../x?a=../b", "http://h/a/x?a=../b"), ("./y/./z", "http://h/a/b/y/z"), ("..", "http://h/a/"), ("", "http://h/a/b/c")])
def test_urls_of_any_depth(one, raw, want):
    assert one(AS.resolve_url("x", F.lit("http://h/a/b/c")), raw) == want


def test_broken_json_is_a_reject(one):
    good, bad = '```json {"k": 3}```', "x {broken"
    assert one(TX.json_in_text("x", "k int"), good)["k"] == 3
    assert one(TX.json_in_text("x", "k int"), bad + "}") is None
    assert one(TX.json_or_reject("x", "k int"), bad + "}")["reject"] == "{broken}"


def test_section_slugs(one):
    assert one(TX.section_slug("x"), "More: Academic life") == "more_going_deeper"
    assert one(TX.section_slug("x"), "My academic program") == "unknown"


def test_merged_lines_are_numbered_anew(spark):
    line = " ".join(f"{1 + i % 60} Pere, Al 4:19.73" for i in range(1500))
    lines = spark.createDataFrame([("f", 1, 0, line), ("f", 1, 1, "end")], "source_file string, page_no int, line_no int, text string")
    got = X.split_merged(lines).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == list(range(1501)) and got[-1]["text"] == "end"


def test_failed_stages_are_recorded_and_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", -1), ("c", 3)], "bundle_id string, v int").repartition(3)
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "bundle_id string")

    def work(part):
        if (part["v"] < 0).any():
            raise ValueError("below zero")
        return part.assign(v=part["v"] * 10)

    args = dict(schema="bundle_id string, v int")
    marks = ST.stage_partitions(rows, ids, f"{tmp_path}/s", work=work, **args)
    assert sorted(map(tuple, marks.collect())) == [("a", "staged"), ("b", "failed"), ("c", "staged"), ("none", "empty")]
    assert {tuple(r) for r in ST.staged_ids(spark, f"{tmp_path}/s").filter("error is not null").select("bundle_id", "error").collect()} == {("b", "ValueError: below zero")}
    assert sorted((r["bundle_id"], r["v"]) for r in ST.read_stages(spark, f"{tmp_path}/s").collect()) == [("a", 10), ("c", 30)]
    # only the failed one is tried again
    marks = ST.stage_partitions(rows, ids, f"{tmp_path}/s", work=lambda part: part.assign(v=part["v"] + 1), **args)
    assert sorted(map(tuple, marks.collect())) == [("a", "staged"), ("b", "staged"), ("c", "staged"), ("none", "empty")]
    assert sorted((r["bundle_id"], r["v"]) for r in ST.read_stages(spark, f"{tmp_path}/s").collect()) == [("a", 10), ("b", 0), ("b", 3), ("c", 30)]


def _score_lines(spark, path):
    """Three files stored by file: both genders in the tail, one in the tail, none in the tail."""
    rows = []
    for name, men_page, women_page in (("both", 14, 15), ("one", 2, 15), ("none", 1, 2)):
        at = 0
        for page in range(1, 17):
            texts = ["filler"] * 3
            if page == men_page:
                texts = ["Scores - Men", "1. Yale 200", "2. Brown 100"]
            if page == women_page:
                texts = ["Scores - Women", "1. MIT 150"]
            for t in texts:
                rows.append((name, page, at, t))
                at += 1
    spark.createDataFrame(rows, "source_file string, page_no int, line_no int, text string").write.partitionBy("source_file").parquet(path)
    lines = spark.read.parquet(path).select("source_file", "page_no", "line_no", "text")
    return lines, lines.groupBy("source_file").agg(F.max("page_no").alias("pages")).withColumn("is_auxiliary", F.lit(False))


def test_tail_is_read_before_the_whole_file(spark, tmp_path, monkeypatch):
    lines, pages = _score_lines(spark, f"{tmp_path}/lines")
    read = []
    whole = X.extract_score_rows
    monkeypatch.setattr(X, "extract_score_rows", lambda d: read.append(d) or whole(d))
    out = X.tail_then_full(lines, pages)
    got = sorted((r["source_file"], r["gender"], r["team"]) for r in out.collect())
    want = [("both", "men", "Brown"), ("both", "men", "Yale"), ("both", "women", "MIT")]
    assert got == sorted(want + [(f, g, t) for f in ("one", "none") for _, g, t in want])
    tails, rest = read
    assert tails.groupBy("source_file").agg(F.min("page_no").alias("p")).select("p").distinct().collect()[0]["p"] == 7
    assert {r["source_file"] for r in rest.select("source_file").distinct().collect()} == {"one", "none"} and rest.agg(F.max("page_no")).first()[0] == 6
    # the second scan is pruned at run time to the folders of the files that need it
    assert "dynamicpruning" in rest._jdf.queryExecution().executedPlan().toString().lower()


def test_standings_block_switches_and_ends(spark):
    def rows(gender, *texts):
        lines = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(texts)], "source_file string, page_no int, line_no int, text string")
        return [r["team"] for r in X.wide_score_rows(lines, gender).orderBy("line_no").collect()]

    text = ["1  Early   9", "Men's Team Scores", "Rank", "1  Yale   200", *["no entry"] * 11, "2  Brown   150", "Women Team Final", "1  Smith   90", *[""] * 12, "2  Late   80", "Team Scores", "1  Again   70"]
    assert rows("men", *text) == ["Yale", "Brown", "Again"]
    # for the other flag eleven misses and an entry of the first one end the block before its switch
    assert rows("women", *text) == ["Again"]
    assert rows("women", "Team Scores", "1  A College   10", *[""] * 12, "Women Standings", "2  B College   9") == ["A College", "B College"]
    assert rows("men", "Team Scores", *["x"] * 12, "1  A College   10") == []


def test_short_needles_read_one_row(spark):
    names = spark.range(20_000).select(F.col("id").alias("pos"), F.concat(F.lit("name "), F.conv(F.col("id").cast("string"), 10, 36)).alias("n"))
    needles = spark.createDataFrame([("e",), ("n",), ("7Z",), ("me 1",), ("zz9",), ("Q",)], "c string")
    got = {r["c"]: r["n"] for r in M.first_containing(needles, "c", names, "n", "pos").collect()}
    texts = ["name " + np.base_repr(i, 36) for i in range(20_000)]
    assert got == {c: hit for (c,) in (("e",), ("n",), ("7Z",), ("me 1",), ("zz9",), ("Q",)) if (hit := next((t for t in texts if c in t), None))}


def test_heavy_grams_are_dealt_out(spark, monkeypatch):
    """A word that a third of all names hold: the same pairs, in parts of like size."""
    rng = random.Random(4)
    words = ["small", "ring", "blue", "bolt", "hot", "gear"]
    names = sorted({" ".join(rng.choices(words, k=4)) + (" widget" if i % 3 == 0 else f" {i}") for i in range(900)})
    queries = ["widget", "blue widget", "hot hot", "smal rin blue bolt widget", "ring gear"]
    n, q = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in queries], "q string")
    monkeypatch.setattr(M.heavy_split, "__defaults__", (10,))
    pairs = {tuple(r) for r in M.contained_pairs(q, "q", n, "n").collect()}
    assert pairs == {(a, b) for a in queries for b in names if a in b}
    got = sorted((r["q"], r["n"]) for r in M.fuzzy_pairs(q, "q", n, "n", hits=10**6).collect())
    assert got == sorted((a, b) for a in queries for b in names if difflib.SequenceMatcher(None, b, a).ratio() >= M.FUZZY_CUTOFF)
    posting = n.select("n", F.explode(M.grams(F.col("n"), 4)).alias("g"))
    df = posting.groupBy("g").agg(F.count("*").alias("_df"))
    probe = spark.createDataFrame([("widg",)], "g string")
    parts = -(-df.filter("g = 'widg'").first()["_df"] // 10)
    sizes = [r["count"] for r in M.heavy_split(posting, probe, "g", "n", df).groupBy(F.pmod(F.hash("n"), F.lit(parts)).alias("p")).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]


def test_values_of_many_groups_become_null(spark):
    df = spark.createDataFrame([("a", "u", "v"), ("b", "u", None), ("c", "x", "u"), ("d", "y", "v"), ("d", None, "v")], "school string, hero string, pool string")
    got = sorted((tuple(r) for r in OA.null_shared(df, ["hero", "pool"], "school").select("school", "hero", "hero_fallback", "pool", "pool_fallback").collect()), key=repr)
    assert got == sorted([("a", None, True, "v", False), ("b", None, True, None, True), ("c", "x", False, None, True), ("d", "y", False, "v", False), ("d", None, True, "v", False)], key=repr)


def test_prestige_limit_column(spark):
    rows = spark.createDataFrame([(1, f"s{i:02d}", "Possible", 50, float(i)) for i in range(40)], "q int, school string, label string, accept int, adj_pts double")
    assert R.prestige_sort(rows, "q", F.lit(30)).count() == 30


def test_dimension_bound(spark):
    with pytest.raises(ValueError):
        short_values(spark.range(20), ["id"], most=10)


@pytest.mark.parametrize("name", ["score_all", "score_one", "expected_grid", "similar_entities", "nearest_other"])
def test_no_cross_join(spark, name):
    df = all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_paths(spark):
    """One case for each way a query is answered."""
    from rankfit.plans import explore as EX

    cols = ("swimmer long, conference string, school string, location string, division string, accept int, sat_median int, tier_short string, adj_pts double, "
            "has_swim boolean, adj_tier string, label string, stem boolean, merit string, hidden_ivy boolean, ivy_league boolean")
    names = ["Alder College", "Birch College", "Cedar University", "Dogwood Institute", "Elm State"]
    rows = [(1, "C", n, "Boston, MA", "D3", 10 + 20 * i, 1500 - 100 * i, "2", 50.0 - i, True, "Recruitable", "Possible", True, "high", False, False)
            for i, n in enumerate(names)]
    queries = spark.createDataFrame([
        (1, "college", 1, True, 1300), (2, "elm state", 1, True, 1300), (3, "HYU quux", 1, True, 1300), (4, "quux zork", 1, True, 1300),
        (5, "all schools where I can make the team", 1, True, 1300), (6, "which program is the nicest of all in the land?", 1, True, 1300),
        (7, "which program is the cheapest of all in the land?", 1, True, 1300)], "query_id long, query string, swimmer long, has_times boolean, sat int")
    cands = spark.createDataFrame([(6, f"{n} at Town", i) for i, n in enumerate(names[::-1])], "query_id long, candidate string, pos int")
    outside = spark.createDataFrame([("Quux Zork", 20, 1250)], "name string, accept int, sat_median int")
    none = spark.createDataFrame([], "raw string, canonical string")
    short = spark.createDataFrame([("zz", "Elm State")], "short string, canonical string")
    out = spark.createDataFrame([(5, "Birch College")], "query_id long, school string")
    got = EX.search(queries, spark.createDataFrame(rows, cols), short, cands, none, out, outside).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["position"])):
        by.setdefault(r["query_id"], []).append(r)
    paths = {k: {r["path"] for r in v} for k, v in by.items()}
    assert paths == {1: {"multi_match"}, 2: {"direct_match"}, 3: {"unknown_name"}, 4: {"unknown_name"}, 5: {"broad_pool"}, 6: {"candidates"}, 7: {"fallback"}}
    schools = {k: [r["school"] for r in v] for k, v in by.items()}
    assert schools[1] == ["Alder College", "Birch College"] and schools[2][0] == "Elm State" and len(schools[2]) == 5
    assert schools[3][0] == "HYU Quux" and by[3][0]["label"] == "" and sorted(schools[3][1:]) == names
    assert schools[4][0] == "Quux Zork" and by[4][0]["label"] == "Realistic Shot" and len(schools[4]) == 6
    assert schools[5] == [n for n in names if n != "Birch College"]
    assert schools[6] == names[::-1] and schools[7] == names


def test_profiles_are_searched_once_a_row_where_the_rows_lie(spark):
    prof = spark.createDataFrame([("men", e, *[float(x) for x in (b, 1, b + 4, 1, 4, 1, 1.1, 0.1)], b + 3.0) for e, b in (("50 free", 20), ("100 free", 45), ("200 im", 110))],
                                 "gender string, event string, sw_median double, sw_mad double, deep_median double, deep_mad double, spread_median double, spread_mad double, shape_median double, shape_mad double, sw_p95 double")
    rows = spark.createDataFrame([(1, "men", "100 Free", 20.0, 24.0), (2, "men", "50 Free", 20.0, 24.0), (3, "other", "50 Free", 20.0, 24.0), (4, None, "x", None, 1.0)], "id int, gender string, event string, sw double, deep double")
    out = RB.validate_rows(rows, prof)
    got = {r["id"]: (r["validation_label"], r["closest_other_event"], r["confidence_score"]) for r in out.collect()}
    assert got[1][:2] == ("likely_wrong_event", "50 free") and got[2] == ("valid", "100 free", 100.0)
    # a gender without profiles and a row without values keep their rows
    assert got[3] == ("valid", "", 100.0) and got[4] == ("review", None, 50.0)
    flagged = RB.validation_report(out)
    assert [r["id"] for r in flagged.collect()] == [1]
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    # the search is written once in the plan, not again in the filter; rows meet the profiles without a shuffle
    assert plan.count("array_min") == 1
    assert "SortMergeJoin" not in flagged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block, head", [(1, 1), (3, 2), (8, 1), (8, 5), (1024, 3), (1024, 32)])
def test_exclusive_pick_past_the_heads(spark, block, head):
    """Entities whose best offers are gone go on with the rest of them; an empty pool and null urls choose nothing."""
    rng = random.Random(block * 100 + head)
    rows = [(e, e, f"u{u:02d}", 90 - u) for e in range(30) for u in range(24)] + [(e, e, f"v{rng.randint(0, 25):02d}", rng.randint(1, 60)) for e in range(30, 60) for _ in range(20)]
    rows += [(e, e, None, 99) for e in range(0, 60, 7)]
    offers, taken, want = {}, set(), {}
    for e, _, u, s in rows:
        if u is not None:
            offers.setdefault(e, {})[u] = max(s, offers.get(e, {}).get(u, -99))
    for e in sorted(offers):
        free = [(-s, u) for u, s in offers[e].items() if u not in taken]
        if free:
            want[e] = min(free)[1]
            taken.add(want[e])
    df = spark.createDataFrame(rows, "entity int, ord int, url string, score int")
    assert {r["entity"]: r["url"] for r in OA.global_exclusive_pick(df, "entity", "ord", block=block, head=head).collect()} == want
    assert OA.global_exclusive_pick(df.filter("score < 0"), "entity", "ord", block=block, head=head).isEmpty()


def test_exclusive_pick_rounds_read_the_heads(spark, monkeypatch):
    """A pool without long conflicts is settled from the best offers of each entity."""
    seen = []
    one = OA._block_round
    monkeypatch.setattr(OA, "_block_round", lambda *a: seen.append((a[0].count(), a[1])) or one(*a))
    rows = spark.range(3000).select(F.col("id").alias("entity"), F.col("id").alias("ord"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"))
    rows = rows.select("entity", "ord", F.concat_ws("_", (F.col("entity") / 2).cast("int"), "i").alias("url"), (F.lit(200) - F.col("i")).cast("int").alias("score"))
    got = {r["entity"]: r["url"] for r in OA.global_exclusive_pick(rows, "entity", "ord").collect()}
    assert got == {e: f"{e // 2}_{e % 2}" for e in range(3000)}
    assert all(n <= 33 * 1024 and whole is None for n, whole in seen)


def test_school_terms_are_worked_out_once_a_school(spark):
    plan = all_queries()["score_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    for each_row, each_school in ((plan[:join], False), (plan[join:], True)):
        assert any("ultra_selective" in line for line in each_row) == each_school


def test_prepared_schools_give_the_same_decision(spark):
    from rankfit.functions import admission as AD
    from rankfit.queries.base import Tables

    d = Tables(spark, "/root/testdata/sf0.001").applicants
    plain, prepared = AD.admission_label(d), AD.admission_label(AD.school_terms(d), prepared=True)
    assert plain.columns == [*d.columns, "sel_tier", "acad_band", "swim_band", "label", "color"] == prepared.columns
    rows = plain.collect()
    assert len(rows) == d.count() and len({r["label"] for r in rows}) > 6
    assert sorted(rows, key=lambda r: r["id"]) == sorted(prepared.collect(), key=lambda r: r["id"])
