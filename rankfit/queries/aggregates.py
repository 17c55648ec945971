"""Aggregations: anchors, depth, tiers, profiles, top-k sums, coverage, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import events as EV, scoring as SC
from ..operators import anchors as A, assets as OA, bests as B, coverage as C, robust as RB, tiers as T, topscore as S
from .base import query, rnd, role
from .filters import LEGAL_SQL
from .scalars import CONF_SQL, EXP_SQL, TIER_SQL, ladder_sql, place_sql

# ---- anchors ---------------------------------------------------------------------------------------------


def anchors_sql(src: str, keys: str) -> str:
    def at(p):
        return f"coalesce(p{p}, (p{p - 1} + p{p + 1}) / 2.0, CASE WHEN mn = 1 AND n = mx AND mx >= 8 AND mx < {p} THEN last_sec END)"

    cols = ", ".join(f"max(CASE WHEN place = {q} THEN sec END) AS p{q}" for q in (0, 1, 2, 7, 8, 9, 15, 16, 17))
    return f"""SELECT {keys}, {rnd('t1', 3)} AS first, {rnd('t8', 3)} AS eighth, {rnd('t16', 3)} AS sixteenth, CASE WHEN t16 <> t1 THEN {rnd('(t16 - t1) / 15', 4)} ELSE 0.0::DOUBLE END AS sec_per_place
FROM (SELECT *, {at(1)} AS t1, {at(8)} AS t8, {at(16)} AS t16 FROM (SELECT {keys}, {cols}, count(*) AS n, min(place) AS mn, max(place) AS mx, arg_max(sec, place) AS last_sec FROM {src} GROUP BY {keys}) a) b
WHERE t1 IS NOT NULL AND t8 IS NOT NULL AND t16 IS NOT NULL"""


@query("nth_anchors", anchors_sql("{ranked_places}", "conference, event"))
def _(t):
    return A.nth_anchors(t.ranked_places, ["conference", "event"])


@query("nth_anchors_sparse", anchors_sql("{sparse_places}", "grp"))
def _(t):
    return A.nth_anchors(t.sparse_places, ["grp"])


@query("consecutive_depth", """WITH r AS (SELECT grp, place, row_number() OVER (PARTITION BY grp ORDER BY place) AS rn FROM {sparse_places})
SELECT grp, count(*) AS swimmer_count, max(place) AS deepest_place, CAST(count(*) FILTER (place = rn) AS INTEGER) AS consecutive_depth FROM r GROUP BY grp""")
def _(t):
    return A.consecutive_depth(t.sparse_places, ["grp"])


# ---- tiers -----------------------------------------------------------------------------------------------

# supplier revenue within the nation, exact to the cent
role("revenue", """
SELECT n_name AS bundle_id, r_name AS conference, l_returnflag AS gender, s_name AS team, s_suppkey AS pos, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS score_f
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4, 5
""")


def tiers_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN base_tier = 'Tier 1' THEN CASE WHEN meet_share >= 0.24 THEN 'Super Powerhouse' ELSE 'Powerhouse' END ELSE '' END AS power_class,
  CASE WHEN base_tier = 'Tier 1' THEN CASE WHEN meet_share >= 0.24 THEN 'Tier 1A' ELSE 'Tier 1B' END ELSE base_tier END AS final_tier
 FROM (SELECT *, CASE WHEN champion_ratio >= 0.85 THEN 'Tier 1' WHEN champion_ratio >= 0.6 THEN 'Tier 2' WHEN champion_ratio >= 0.35 THEN 'Tier 3' ELSE 'Tier 4' END AS base_tier
 FROM (SELECT *, coalesce({rnd('score_f / nullif(champion_score, 0)', 6)}, 0.0) AS champion_ratio, coalesce({rnd('score_f / nullif(total_meet_points, 0)', 6)}, 0.0) AS meet_share
 FROM (SELECT *, max(score_f) OVER w AS champion_score, CAST(sum(CAST(score_f AS DECIMAL(28,4))) OVER w AS DOUBLE) AS total_meet_points FROM {src} WINDOW w AS (PARTITION BY bundle_id, conference, gender)) a) b) c"""


_TIER_COLS = "bundle_id, conference, gender, team, score_f, champion_score, total_meet_points, champion_ratio, meet_share, base_tier, power_class, final_tier"


@query("share_tiers", f"SELECT {_TIER_COLS} FROM ({tiers_sql('{revenue}')}) t")
def _(t):
    return T.share_tiers(t.revenue).select(*_TIER_COLS.split(", "))


def summary_sql(src: str) -> str:
    counts = ", ".join(f"count(*) FILTER (final_tier = '{x}') AS {x.lower().replace(' ', '_')}_count" for x in ("Tier 1A", "Tier 1B", "Tier 2", "Tier 3", "Tier 4"))
    return f"""SELECT bundle_id, conference, gender, count(*) AS number_of_teams, trim(coalesce(arg_min(team, (-score_f, team)) FILTER (rank_i = 1), arg_min(team, (-score_f, coalesce(rank_i, 9999), team)))) AS winner,
 max(champion_score) AS champion_score, max(total_meet_points) AS total_meet_points, {counts} FROM ({tiers_sql(src)}) t GROUP BY bundle_id, conference, gender"""


role("ranked_revenue", "SELECT *, CAST(CASE WHEN pos % 4 = 3 THEN NULL ELSE 1 + pos % 6 END AS INT) AS rank_i FROM {revenue}")


@query("tier_summary", summary_sql("{ranked_revenue}"))
def _(t):
    return T.tier_summary(T.share_tiers(t.ranked_revenue))


# ---- robust profile --------------------------------------------------------------------------------------


def profile_ctes() -> str:
    """Reference profile: one row per (gender, event, metric), winsorized before every statistic."""
    q = lambda p, c: f"quantile_cont({c}, {p})"
    return f"""base AS (SELECT lower(gender) AS gender, lower(event) AS event, sw, deep, deep - sw AS spread, deep / sw AS shape FROM {{pairs}} WHERE sw > 0 AND deep > 0 AND deep >= sw),
lng AS (SELECT gender, event, 'sw' AS metric, sw AS v FROM base UNION ALL SELECT gender, event, 'deep', deep FROM base UNION ALL SELECT gender, event, 'spread', spread FROM base UNION ALL SELECT gender, event, 'shape', shape FROM base),
pos AS (SELECT * FROM lng WHERE v > 0), lim AS (SELECT gender, event, metric, count(*) AS n, {q(0.05, 'v')} AS lo, {q(0.95, 'v')} AS hi FROM pos GROUP BY ALL HAVING count(*) >= 8),
win AS (SELECT p.gender, p.event, p.metric, n, greatest(lo, least(hi, v)) AS w FROM pos p JOIN lim l ON p.gender = l.gender AND p.event = l.event AND p.metric = l.metric),
med AS (SELECT gender, event, metric, any_value(n) AS n, {q(0.5, 'w')} AS median, {q(0.05, 'w')} AS p05, {q(0.25, 'w')} AS p25, {q(0.75, 'w')} AS p75, {q(0.95, 'w')} AS p95 FROM win GROUP BY ALL),
mad AS (SELECT w.gender, w.event, w.metric, {q(0.5, 'abs(w.w - m.median)')} AS mad FROM win w JOIN med m ON w.gender = m.gender AND w.event = m.event AND w.metric = m.metric GROUP BY ALL),
prof AS (SELECT m.*, d.mad FROM med m JOIN mad d ON m.gender = d.gender AND m.event = d.event AND m.metric = d.metric)"""


_STATS = [s for s in RB.STATS if s != "n"]


def wide_profile_sql() -> str:
    parts = [f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {m}_{s}" for m in RB.METRICS for s in RB.STATS]
    return f"wide AS (SELECT b.gender, b.event, {', '.join(parts)} FROM (SELECT DISTINCT gender, event FROM base) b LEFT JOIN prof p ON b.gender = p.gender AND b.event = p.event GROUP BY b.gender, b.event)"


_PROFILE_OUT = ", ".join(["gender", "event"] + [f"{m}_n" for m in RB.METRICS] + [f"{rnd(f'{m}_{s}', 6)} AS {m}_{s}" for m in RB.METRICS for s in _STATS])


def profile_rounded(d):
    from ..functions.numeric import round_to

    return d.select("gender", "event", *[f"{m}_n" for m in RB.METRICS], *[round_to(f"{m}_{s}", 6).alias(f"{m}_{s}") for m in RB.METRICS for s in _STATS])


@query("robust_profile", f"WITH {profile_ctes()}, {wide_profile_sql()} SELECT {_PROFILE_OUT} FROM wide")
def _(t):
    return profile_rounded(RB.robust_profile(t.pairs))


# ---- scores ----------------------------------------------------------------------------------------------

role("mens_places", "SELECT conference, event, place, min(sec) AS sec FROM {places} GROUP BY conference, event, place")
ANCHOR_CTE = f"anch AS ({anchors_sql('{mens_places}', 'conference, event')})"
SCORED_CTE = f"""{ANCHOR_CTE}, sp AS (SELECT swimmer, a.conference, t.event, sec, {place_sql(s='sec_per_place')} AS p FROM {{times}} t JOIN anch a ON t.event = a.event),
sc AS (SELECT swimmer, conference, event, {rnd('sec', 3)} AS sec, {rnd('p', 2)} AS place, {rnd(f'{EXP_SQL} * ({CONF_SQL})', 2)} AS pts, {rnd(EXP_SQL, 2)} AS exp_pts, {CONF_SQL} AS confidence, {ladder_sql('p', SC.PLACE_STEPS, 'Out of range', '<=')} AS place_label FROM sp)"""


def mens_anchors(t):
    return A.nth_anchors(t.mens_places, ["conference", "event"])


def scored(t):
    return S.score_events(S.dealt(t.times), mens_anchors(t))


TOPK_CTE = f"""{SCORED_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY swimmer, conference ORDER BY pts DESC, event) AS rn FROM sc),
tk AS (SELECT swimmer, conference, sum(CAST(floor(pts * 100 + 0.5) AS BIGINT)) FILTER (rn <= 4) / 100.0::DOUBLE AS raw_pts, string_agg(event, ', ' ORDER BY rn) FILTER (rn <= 4) AS top_events, count(*) FILTER (pts > 0) >= 4 AS has_depth FROM rk GROUP BY swimmer, conference HAVING sum(pts) FILTER (rn <= 4) <> 0)"""


@query("top_k_sum", f"WITH {TOPK_CTE} SELECT tk.swimmer, s.school, raw_pts, top_events, has_depth, {rnd('raw_pts * psf', 2)} AS adj_pts, {TIER_SQL(rnd('raw_pts * psf', 2))} AS adj_tier FROM tk JOIN {{schools}} s ON tk.conference = s.conference")
def _(t):
    d = S.spread_to_teams(S.top_k_sum(scored(t)), t.schools)
    return d.select("swimmer", "school", "raw_pts", "top_events", "has_depth", "adj_pts", "adj_tier")


WEIGHTS = [1.0, 1.0, 1.0, 0.7, 0.5]


@query("weighted_top_k_sum", f"""WITH {SCORED_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY swimmer, conference ORDER BY pts DESC, event) AS rn FROM sc)
SELECT swimmer, conference, {rnd("sum(CAST(floor(pts * CASE rn WHEN 4 THEN 0.7::DOUBLE WHEN 5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * 10000 + 0.5) AS BIGINT)) / 10000.0::DOUBLE", 2)} AS raw_pts FROM rk WHERE rn <= 5 GROUP BY swimmer, conference""")
def _(t):
    return S.weighted_top_k_sum(scored(t), WEIGHTS)


@query("min_per_key", f"""WITH {LEGAL_SQL} SELECT swimmer_id, event, min(sec) AS time_sec FROM (SELECT *, TRY_CAST(coalesce(nullif(eventtime, ''), nullif(seedtime, '')) AS DOUBLE) AS sec FROM legal_rows WHERE event IS NOT NULL) x WHERE sec > 0 GROUP BY 1, 2""")
def _(t):
    return B.min_per_key(t.raw_results)


@query("first_nonnull", "SELECT swimmer_id, CASE arg_min(upper(trim(eventgender)), (pos, upper(trim(eventgender)))) WHEN 'M' THEN 'men' ELSE 'women' END AS gender FROM {raw_results} WHERE upper(trim(eventgender)) IN ('M', 'F') GROUP BY 1")
def _(t):
    return B.first_nonnull(t.raw_results)


# ---- coverage --------------------------------------------------------------------------------------------

# results per (nation, status, event) with the real event names
role("event_places", """
SELECT n_name AS bundle_id, r_name AS conference, gender, event, place, min(price) AS sec FROM (
 SELECT n_name, r_name, CASE WHEN l_linestatus = 'O' THEN 'men' ELSE 'women' END AS gender, l_extendedprice AS price, 1 + CAST(floor(l_extendedprice / 4000) AS INT) AS place,
  CASE l_partkey % 15 WHEN 0 THEN '50 Free' WHEN 1 THEN '100 Free' WHEN 2 THEN '200 Free' WHEN 3 THEN '500 Free' WHEN 4 THEN '1000 Free' WHEN 5 THEN '1650 Free' WHEN 6 THEN '100 Back' WHEN 7 THEN '200 Back'
   WHEN 8 THEN '100 Breast' WHEN 9 THEN '200 Breast' WHEN 10 THEN '100 Fly' WHEN 11 THEN '200 Fly' WHEN 12 THEN '200 IM' WHEN 13 THEN '400 IM' ELSE '75 Free' END AS event
 FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) x
GROUP BY 1, 2, 3, 4, 5
""", once=True)
_EV_VALUES = ", ".join(f"('{e}')" for e in EV.TARGET_EVENTS)
COVER_CTE = f"""anch AS ({anchors_sql('{event_places}', 'bundle_id, gender, event')}), rr AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, gender, event ORDER BY place) AS rn FROM {{event_places}}),
dep AS (SELECT bundle_id, gender, event, count(*) AS swimmer_count, max(place) AS deepest_place, count(*) FILTER (place = rn) AS consecutive_depth FROM rr GROUP BY 1, 2, 3),
grid AS (SELECT n_name AS bundle_id, r_name AS conference, g.gender, e.event FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('men'), ('women')) g(gender) CROSS JOIN (VALUES {_EV_VALUES}) e(event)),
cov0 AS (SELECT g.*, a.first IS NOT NULL AS got, d.swimmer_count IS NOT NULL AS seen, coalesce(d.swimmer_count, 0) AS swimmer_count, coalesce(d.deepest_place, 0) AS deepest_place, CAST(coalesce(d.consecutive_depth, 0) AS INTEGER) AS consecutive_depth
 FROM grid g LEFT JOIN anch a ON g.bundle_id = a.bundle_id AND g.gender = a.gender AND g.event = a.event LEFT JOIN dep d ON g.bundle_id = d.bundle_id AND g.gender = d.gender AND g.event = d.event),
cov1 AS (SELECT *, seen AND consecutive_depth < 16 AND deepest_place < 16 AND swimmer_count < 16 AS ceiling FROM cov0),
cov AS (SELECT bundle_id, conference, gender, event, swimmer_count, deepest_place, consecutive_depth, CASE WHEN got THEN 'yes' ELSE 'no' END AS detected,
 CASE WHEN got THEN 'captured' WHEN event = '1000 Free' THEN 'missing_optional_1000' WHEN ceiling THEN 'missing_data_ceiling' ELSE 'missing_true_parser_miss' END AS coverage_status,
 CASE WHEN got THEN '' WHEN event = '1000 Free' THEN 'optional_not_required' WHEN ceiling THEN 'data_ceiling — consecutive_depth: ' || consecutive_depth || ', swimmers: ' || swimmer_count || ', target: 16' WHEN seen THEN 'event_detected_but_incomplete' ELSE 'not_detected' END AS notes,
 CASE WHEN got THEN 'finals' WHEN event = '1000 Free' THEN 'not_required' ELSE 'missing' END AS source_type,
 CASE WHEN got THEN 'yes' WHEN event = '1000 Free' THEN 'na' WHEN ceiling THEN 'no' WHEN consecutive_depth >= 16 OR deepest_place >= 16 OR swimmer_count >= 16 THEN 'yes' WHEN consecutive_depth > 0 OR swimmer_count > 0 THEN 'no' ELSE 'na' END AS anchor_depth_achievable_yn FROM cov1)"""
COVER_COLS = "bundle_id, conference, gender, event, swimmer_count, deepest_place, consecutive_depth, detected, coverage_status, notes, source_type, anchor_depth_achievable_yn"
GROUP = ["bundle_id", "gender", "event"]


def coverage(t):
    bundles = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("bundle_id"), F.col("r_name").alias("conference"))
    grid = C.expected_grid(bundles, {"gender": ["men", "women"], "event": EV.TARGET_EVENTS})
    anchors = A.nth_anchors(t.event_places, GROUP).withColumn("data_quality", F.lit("finals"))
    return C.coverage_status(grid, anchors, A.consecutive_depth(t.event_places, GROUP), GROUP).select(*COVER_COLS.split(", "))


ROLLUP_SQL = """SELECT *, CASE WHEN anchors_captured = total_possible OR unexcused = 0 THEN 'Perfect' WHEN anchors_captured >= 18 THEN 'Strong' ELSE 'Gaps' END AS conference_status FROM (
 SELECT bundle_id, count(*) FILTER (event <> '1000 Free' AND detected = 'yes') AS anchors_captured, count(*) FILTER (event <> '1000 Free') AS total_possible, count(*) FILTER (detected = 'yes' AND gender = 'men') AS men_anchors,
  count(*) FILTER (detected = 'yes' AND gender = 'women') AS women_anchors, count(*) FILTER (event <> '1000 Free' AND detected <> 'yes') AS missing_events_count,
  coalesce(string_agg(gender || ' ' || event || ' (' || coverage_status || ')', '; ' ORDER BY gender || ' ' || event || ' (' || coverage_status || ')') FILTER (event <> '1000 Free' AND detected <> 'yes'), '') AS missing_events_list,
  count(*) FILTER (event <> '1000 Free' AND detected <> 'yes' AND coverage_status NOT IN ('missing_optional_1000', 'missing_data_ceiling', 'missing_likely_not_contested')) AS unexcused FROM cov GROUP BY bundle_id) x"""


@query("coverage_rollup", f"WITH {COVER_CTE} SELECT * EXCLUDE (unexcused) FROM ({ROLLUP_SQL}) y")
def _(t):
    return C.coverage_rollup(coverage(t), by="bundle_id")


@query("overall_coverage", f"""WITH {COVER_CTE} SELECT count(*) AS conferences, {', '.join(f"count(*) FILTER (conference_status = '{s}') AS {s.lower()}, CAST(floor(100 * count(*) FILTER (conference_status = '{s}') / count(*)) AS BIGINT) AS {s.lower()}_pct" for s in ('Perfect', 'Strong', 'Gaps'))} FROM ({ROLLUP_SQL}) y""")
def _(t):
    return C.overall_coverage(C.coverage_rollup(coverage(t), by="bundle_id"))


@query("missing_classification_counts", f"WITH {COVER_CTE} SELECT coverage_status, count(*) AS n FROM cov WHERE detected <> 'yes' AND event <> '1000 Free' GROUP BY 1")
def _(t):
    return C.missing_classification_counts(coverage(t))


# documents and conversations as results text with session words put in
role("session_text", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Championship Final B-Final finals ' WHEN 1 THEN 'Preliminaries heats ' WHEN 2 THEN 'Finals prelims ' WHEN 3 THEN 'Men''s 100 Free Women 200 Fly ' WHEN 4 THEN 'Women''s Results women 50 ' ELSE 'Mens 400 IM ' END || text AS t FROM {documents}
""")


@query("signal_vote", """SELECT doc_id, score, CASE WHEN score > 0 THEN 'finals' WHEN score < 0 THEN 'prelims' ELSE 'unknown' END AS session, CASE WHEN m > 0 AND w > 0 THEN 'combined' WHEN w > 0 THEN 'women' WHEN m > 0 THEN 'men' ELSE 'unknown' END AS gender FROM (
 SELECT doc_id, 3 * len(regexp_extract_all(low, 'championship\\s+final|consolation\\s+final|b[-\\s]?final|c[-\\s]?final')) + len(regexp_extract_all(low, '\\bfinals?\\b')) - 3 * len(regexp_extract_all(low, '\\bpreliminar(y|ies)\\b')) - len(regexp_extract_all(low, '\\bprelims?\\b|\\bheats?\\b')) AS score,
  len(regexp_extract_all(low, '\\bmen''?s?\\s+[0-9]+')) + 3 * len(regexp_extract_all(low, '\\bmen''?s?\\s+(swimming|results|individual|championship)')) AS m,
  len(regexp_extract_all(low, '\\bwomen''?s?\\s+[0-9]+')) + 3 * len(regexp_extract_all(low, '\\bwomen''?s?\\s+(swimming|results|individual|championship)')) AS w FROM (SELECT doc_id, lower(t) AS low FROM {session_text}) x) y""")
def _(t):
    score = EV.session_score("t").cast("bigint")
    vote = EV.gender_vote(EV.gender_signals("t", "men"), EV.gender_signals("t", "women"))
    return t.session_text.select("doc_id", score.alias("score"), EV.session_vote(score).alias("session"), vote.alias("gender"))


# ---- counts ----------------------------------------------------------------------------------------------


@query("category_counts", "SELECT c_nationkey AS school, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n_MACHINERY FROM customer GROUP BY 1")
def _(t):
    return C.category_counts(t.customer.withColumnRenamed("c_nationkey", "school"), "school", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("curation_progress", """SELECT n_regionkey AS conference, count(*) AS school_count, count(*) FILTER (n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) AS curated_count,
 count(*) FILTER (n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)) AS has_candidates_count FROM nation GROUP BY 1""")
def _(t):
    schools = t.nation.select(F.col("n_nationkey").alias("school"), F.col("n_regionkey").alias("conference"))
    cand = t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("school"))
    cur = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("school"))
    return C.curation_progress(schools, cand, cur)


HISTOGRAM = ["High-Point Contender", "Conference Star", "Top Recruit", "Priority Recruit", "Recruitable", "Below Roster Level"]


@query("tier_histogram", f"""SELECT *, concat_ws(', ', {', '.join(f"CASE WHEN n{i} > 0 THEN n{i} || ' {x}' END" for i, x in enumerate(HISTOGRAM))}) AS summary FROM (
 SELECT id % 20 AS grp, {', '.join(f"count(*) FILTER (adj_tier = '{x}') AS n{i}" for i, x in enumerate(HISTOGRAM))} FROM {{applicants}} GROUP BY 1) x""")
def _(t):
    return C.tier_histogram(t.applicants.withColumn("grp", F.col("id") % 20), "adj_tier", HISTOGRAM, ["grp"])


@query("population_counts", "SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS with_data, count(*) FILTER (NOT l_discount > 0.05) AS without_data FROM lineitem GROUP BY 1")
def _(t):
    return C.population_counts(t.lineitem, F.col("l_discount") > 0.05, ["l_returnflag"])


@query("conference_members", "SELECT conference, school, min(coalesce(nullif(finish, 0), 99)) AS finish_order FROM {schools} GROUP BY 1, 2")
def _(t):
    return C.conference_members(t.schools)


# score rows and scanned pages per bundle
role("final_rows", "SELECT bundle_id, gender, CAST(1 + pos % 5 AS INT) AS rank, 'file' || CAST(pos % 3 AS STRING) AS source, team, score_f AS score, pos FROM {revenue}")
role("scan_log", "SELECT n_name AS bundle_id, CAST(1 + s_suppkey % 9 AS INT) AS pages_scanned, s_suppkey % 2 = 0 AS section_found FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey")


@query("source_coverage", """WITH g AS (SELECT bundle_id, count(*) AS rows_captured, string_agg(DISTINCT gender, '|' ORDER BY gender) AS genders_found, arg_min(source, (gender, rank, source)) AS selected_source FROM {final_rows} GROUP BY 1)
SELECT p.bundle_id, coalesce(selected_source, '') AS selected_source, candidate_pages_scanned, rows_captured IS NOT NULL AS section_found, coalesce(rows_captured, 0) AS rows_captured, coalesce(genders_found, '') AS genders_found,
 CASE WHEN rows_captured IS NOT NULL THEN 'captured_partial' WHEN heading THEN 'section_found_no_rows' ELSE 'section_not_found' END AS parse_status
FROM (SELECT bundle_id, CAST(sum(pages_scanned) AS BIGINT) AS candidate_pages_scanned, bool_or(section_found) AS heading FROM {scan_log} GROUP BY 1) p LEFT JOIN g ON p.bundle_id = g.bundle_id""")
def _(t):
    return C.source_coverage(t.final_rows, t.scan_log)


@query("cross_group_frequency", "SELECT l_partkey, l_suppkey, l_orderkey, n AS group_count, n > 4 AS is_generic FROM lineitem JOIN (SELECT l_partkey AS pk, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) x ON l_partkey = pk")
def _(t):
    return OA.cross_group_frequency(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey"), "l_partkey", "l_suppkey")


@query("null_shared", """WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_partkey AS VARCHAR) AS hero, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_partkey + 1 AS VARCHAR) END AS pool FROM lineitem),
u AS (SELECT v, count(DISTINCT l_suppkey) AS n FROM (SELECT l_suppkey, hero AS v FROM p UNION ALL SELECT l_suppkey, pool FROM p WHERE pool IS NOT NULL) x GROUP BY 1), s AS (SELECT v FROM u WHERE n - 1 >= 20)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN hero NOT IN (SELECT v FROM s) THEN hero END AS hero, hero IN (SELECT v FROM s) AS hero_fallback,
 CASE WHEN pool NOT IN (SELECT v FROM s) THEN pool END AS pool, pool IS NULL OR pool IN (SELECT v FROM s) AS pool_fallback FROM p""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").cast("string").alias("hero"), F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_partkey") + 1).cast("string")).alias("pool"))
    return OA.null_shared(d, ["hero", "pool"], "l_suppkey", others=20)


@query("dominant_domain", """WITH d AS (SELECT split_part(split_part(url, '//', 2), '/', 1) AS host, regexp_extract(url, '/(fr|en|de|es)/', 1) AS lang FROM pages),
c AS (SELECT lang, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(*) AS n FROM d GROUP BY 1, 2) SELECT lang AS entity, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, domain) AS rn FROM c) x WHERE rn = 1""")
def _(t):
    links = t.pages.select("url", F.regexp_extract("url", "/(fr|en|de|es)/", 1).alias("entity"))
    return C.dominant_domain(links, "entity")


