"""Window-shaped operators, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import assets as AS, events as EV, intent as IN, numeric as NU, scoring as SC, text as TX
from ..operators import anchors as A, assets as OA, coverage as C, extraction as X, keyed as K, ranking as R, sets as ST, tiers as T, topscore as S
from ..sources import tables as TB
from .aggregates import anchors_sql
from .base import query, rnd, role
from .filters import SCORE_SQL
from .scalars import CATEGORY_SQL, IMAGE_SCORE_SQL, a_score_sql, any_phrase, image_score, plausible_sql, slot_scores, slot_sql

# ---- versions and duplicates -----------------------------------------------------------------------------


@query("best_source_per_group", """WITH r AS (SELECT bundle_id, gender, arg_min(source, (-score, source)) AS best FROM {final_rows} WHERE rank = 1 GROUP BY 1, 2),
k AS (SELECT f.* FROM {final_rows} f LEFT JOIN r USING (bundle_id, gender) WHERE best IS NULL OR source = best)
SELECT bundle_id, gender, rank, team, source, score FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, gender, rank, team ORDER BY score DESC, source) AS rn FROM k) x WHERE rn = 1""")
def _(t):
    return T.best_source_per_group(t.final_rows, ["bundle_id", "gender"]).select("bundle_id", "gender", "rank", "team", "source", "score")


# versions of an event: the order priority plays the source file
role("versions", """
SELECT n_name AS bundle_id, gender, event, version, session_score, place, min(sec) AS sec FROM (
 SELECT n_name, CASE WHEN l_linestatus = 'O' THEN 'men' ELSE 'women' END AS gender, o_orderpriority AS version, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS session_score,
  CASE l_partkey % 4 WHEN 0 THEN '50 Free' WHEN 1 THEN '100 Free' WHEN 2 THEN '200 IM' ELSE '100 Fly' END AS event, 1 + CAST(floor(l_extendedprice / 5000) AS INT) AS place, l_extendedprice / 1000 + 15 AS sec
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey) x
GROUP BY 1, 2, 3, 4, 5, 6
""")
_G = "bundle_id, gender, event"
_VS = f"""vs AS (SELECT {_G}, version, session_score, count(*) FILTER (place IN (1, 8, 16)) AS completeness, count(*) AS size, max(CASE WHEN place = 1 THEN sec END) AS first_sec FROM {{versions}} GROUP BY {_G}, version, session_score),
va AS ({anchors_sql('{versions}', _G + ', version')}), vv AS (SELECT vs.*, va.first IS NOT NULL AS has_anchor, coalesce({plausible_sql('vs.event', 'first_sec', 'vs.gender')}, false) AND first_sec IS NOT NULL AND va.first IS NOT NULL AS ok FROM vs LEFT JOIN va USING (bundle_id, gender, event, version))"""


@query("pick_best_version", f"""WITH {_VS}, o AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY session_score DESC, completeness DESC, size DESC, version) AS rn, row_number() OVER (PARTITION BY {_G}, ok ORDER BY session_score DESC, completeness DESC, size DESC, version) AS rk FROM vv),
b AS (SELECT * FROM o WHERE rn = 1), a AS (SELECT {_G}, version AS alt FROM o WHERE ok AND rk = 1),
f AS (SELECT {_G}, max(session_score) AS top, count(*) FILTER (session_score >= 2 AND first_sec IS NOT NULL) AS finals, min({rnd('first_sec', 2)}) FILTER (session_score >= 2) AS lo, max({rnd('first_sec', 2)}) FILTER (session_score >= 2) AS hi FROM vv GROUP BY {_G})
SELECT b.bundle_id, b.gender, b.event, CASE WHEN has_anchor AND first_sec IS NOT NULL AND NOT ok THEN coalesce(alt, version) ELSE version END AS version,
 array_to_string([x for x in [CASE WHEN top = 0 THEN 'only_prelims' END, CASE WHEN finals > 1 AND lo <> hi THEN 'conflicting_finals' END, CASE WHEN has_anchor AND first_sec IS NOT NULL AND NOT ok THEN CASE WHEN alt IS NOT NULL THEN 'implausible_replaced' ELSE 'implausible_kept' END END] if x IS NOT NULL], '; ') AS flags
FROM b LEFT JOIN a USING (bundle_id, gender, event) JOIN f USING (bundle_id, gender, event)""")
def _(t):
    keys = ["bundle_id", "gender", "event"]
    summary = A.version_summary(t.versions, keys, "version")
    return A.pick_best_version(summary, keys, "version", EV.plausible_range("event", "first_sec", "gender"))


# two versions per part: early and late half of its price bands, overlapping in some parts only
role("two_versions", """
SELECT grp, version, session_score, place, min(sec) AS sec FROM (SELECT l_partkey AS grp, CASE WHEN l_extendedprice < 40000 + 1000 * (l_partkey % 13) THEN 1 ELSE 2 END AS v0, CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 1 ELSE 2 END AS v1,
  CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_extendedprice < 40000 THEN 1 ELSE 2 END ELSE CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 1 ELSE 2 END END AS version,
  CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 3 END AS s1, CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_extendedprice < 40000 THEN 1 ELSE 3 END ELSE CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 3 ELSE CAST(l_partkey % 3 AS INT) END END AS session_score,
  1 + CAST(floor(l_extendedprice / 6000) AS INT) AS place, l_extendedprice AS sec FROM {lineitem}) x GROUP BY 1, 2, 3, 4
""")


@query("smart_merge", """WITH s AS (SELECT grp, version, max(session_score) AS score, count(*) FILTER (place IN (1, 8, 16)) AS full_n FROM {two_versions} GROUP BY 1, 2),
o AS (SELECT a.grp, count(*) AS n FROM {two_versions} a JOIN {two_versions} b ON a.grp = b.grp AND a.place = b.place AND a.version = 1 AND b.version = 2 GROUP BY 1),
v AS (SELECT g.grp, coalesce(o.n, 0) <= 3 AS is_union, coalesce(o.n, 0) > 3 AND (s2.score > s1.score OR (s2.score = s1.score AND s2.full_n > s1.full_n)) AS is_replace FROM (SELECT DISTINCT grp FROM {two_versions}) g LEFT JOIN o ON o.grp = g.grp LEFT JOIN s s1 ON s1.grp = g.grp AND s1.version = 1 LEFT JOIN s s2 ON s2.grp = g.grp AND s2.version = 2)
SELECT grp, place, sec FROM (SELECT t.grp, place, sec, row_number() OVER (PARTITION BY t.grp, place ORDER BY version) AS rn FROM {two_versions} t JOIN v ON v.grp = t.grp WHERE is_union OR is_replace IS NULL OR (is_replace AND version = 2) OR (NOT is_replace AND version = 1)) x WHERE rn = 1""")
def _(t):
    d = t.two_versions.withColumn("session_score", F.col("session_score").cast("int"))
    return A.smart_merge(d, ["grp"], "version").select("grp", "place", "sec")


@query("dedupe_resolve", """WITH d AS (SELECT *, TRY_CAST(replace(trim(score), ',', '') AS DOUBLE) AS score_f, lower(regexp_replace(trim(team), '\\s+', ' ', 'g')) AS k FROM (SELECT bundle_id, conference, gender, rank, CASE WHEN pos % 3 = 0 THEN 'Team  One' ELSE team END AS team, score, pos FROM {score_text}) y), v AS (SELECT * FROM d WHERE score_f >= 0)
SELECT bundle_id, gender, k AS team_key, score_f, pos, first_pos, n, differ FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, conference, gender, k ORDER BY score_f DESC, pos) AS rn, min(pos) OVER (PARTITION BY bundle_id, conference, gender, k) AS first_pos, count(*) OVER (PARTITION BY bundle_id, conference, gender, k) AS n,
 min(score_f) OVER (PARTITION BY bundle_id, conference, gender, k) <> max(score_f) OVER (PARTITION BY bundle_id, conference, gender, k) OR min(rank) OVER (PARTITION BY bundle_id, conference, gender, k) <> max(rank) OVER (PARTITION BY bundle_id, conference, gender, k) AS differ FROM v) x WHERE rn = 1""")
def _(t):
    raw = t.score_text.withColumn("team", F.when(F.col("pos") % 3 == 0, "Team  One").otherwise(F.col("team")))
    valid = T.parse_scores(raw).filter("score_f >= 0")
    rows, qa = T.dedupe_resolve(valid)
    n = F.regexp_extract("detail", r"^n=(\d+)", 1).cast("bigint")
    notes = qa.select("bundle_id", "conference", "gender", n.alias("n"), F.contains("detail", F.lit("differing")).alias("differ"), F.regexp_replace(F.lower(F.trim("team")), r"\s+", " ").alias("team_key"))
    d = rows.join(notes, ["bundle_id", "conference", "gender", "team_key"], "left")
    return d.select("bundle_id", "gender", "team_key", "score_f", "pos", "first_pos", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("differ", F.lit(False)).alias("differ"))


@query("first_wins", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN rk = 1 THEN '' ELSE 'duplicate_suppressed' END AS issue FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rk FROM lineitem) x""")
def _(t):
    kept, dropped = A.first_wins(t.lineitem, ["l_orderkey"], ["l_partkey", "l_suppkey"])
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "issue"]
    return kept.withColumn("issue", F.lit("")).select(*cols).unionByName(dropped.select(*cols))


@query("duplicate_rank", """WITH h AS (SELECT *, min(pos) OVER (PARTITION BY bundle_id, conference, gender, rank_i) AS head, arg_min(team, pos) OVER (PARTITION BY bundle_id, conference, gender, rank_i) AS holder FROM {ranked_revenue} WHERE rank_i IS NOT NULL)
SELECT bundle_id, conference, gender, 'duplicate_rank' AS issue_type, team, 'rank=' || rank_i || ' also assigned to ' || holder AS detail FROM h WHERE pos > head""")
def _(t):
    return T.duplicate_rank(t.ranked_revenue.withColumn("first_pos", F.col("pos")))


@query("top_n_per_key", f"""SELECT user_id, event, a_score, CAST(rn AS INTEGER) AS rn, rn <= 5 AS top5 FROM (SELECT user_id, event, a_score, row_number() OVER (PARTITION BY user_id ORDER BY a_score DESC, event, k) AS rn FROM (SELECT user_id, event, k, {rnd(a_score_sql(False), 3)} AS a_score FROM {{standards_wide}}) x) y WHERE rn <= 10""")
def _(t):
    d = t.standards_wide.withColumn("a_score", NU.round_to(SC.a_score("sec", "b", "a", "aa", "aaa", "aaaa"), 3))
    d = K.top_k_per_key(d, ["user_id"], [F.desc("a_score"), F.asc("event"), F.asc("k")], 10)
    return d.select("user_id", "event", "a_score", "rn", (F.col("rn") <= 5).alias("top5"))


@query("unranked", "SELECT id, event, sec FROM (SELECT event_id AS id, event_type AS event, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE value END AS sec FROM events) x WHERE sec <= 0 OR event NOT IN (SELECT event FROM {levels} WHERE event <> 'view')")
def _(t):
    times = t.event_values.withColumn("sec", F.when(F.col("id") % 9 == 0, 0.0).otherwise(F.col("sec")))
    return S.unranked(times, t.levels.filter("event <> 'view'")).select("id", "event", "sec")


# ---- image pools -----------------------------------------------------------------------------------------

# candidates with score and category; several pages of one host share urls
_SC = f"sc AS (SELECT page_id, i, school, url, {CATEGORY_SQL} AS category, {rnd(IMAGE_SCORE_SQL, 3)} AS score FROM {{candidates}})"


def pool(t):
    c = t.candidates
    return c.select("page_id", "i", "school", "url", AS.assign_category("page_type", "url", "page_url", "alt", "context").alias("category"), NU.round_to(image_score(), 3).alias("score"))


@query("trim_per_category", f"""WITH {_SC}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY school, url ORDER BY score DESC, category) AS rn FROM sc) x WHERE rn = 1)
SELECT school, category, url, score FROM (SELECT *, row_number() OVER (PARTITION BY school, category ORDER BY score DESC, url) AS rk FROM d) y WHERE rk <= 24""")
def _(t):
    return OA.trim_per_category(pool(t)).select("school", "category", "url", "score")


_SLOTS = f"ss AS (SELECT school, url, max({slot_sql('hero')}) AS hero_s, max({slot_sql('student')}) AS student_s, max({slot_sql('swim')}) AS swim_s FROM {{candidates}} GROUP BY 1, 2)"


@query("exclusive_slot_pick", f"""WITH {_SLOTS}, h AS (SELECT school, url AS hero, hero_s < 0 AS hero_fallback FROM (SELECT *, row_number() OVER (PARTITION BY school ORDER BY hero_s DESC, url) AS rn FROM ss WHERE hero_s >= -20) x WHERE rn = 1),
s AS (SELECT school, url AS student, student_s < 0 AS student_fallback FROM (SELECT ss.*, row_number() OVER (PARTITION BY ss.school ORDER BY student_s DESC, url) AS rn FROM ss LEFT JOIN h ON h.school = ss.school WHERE student_s >= -20 AND url IS DISTINCT FROM hero) x WHERE rn = 1),
w AS (SELECT school, url AS swim, swim_s < -5 AS swim_fallback FROM (SELECT ss.*, row_number() OVER (PARTITION BY ss.school ORDER BY swim_s DESC, url) AS rn FROM ss LEFT JOIN h ON h.school = ss.school LEFT JOIN s ON s.school = ss.school WHERE swim_s >= -20 AND url IS DISTINCT FROM hero AND url IS DISTINCT FROM student) x WHERE rn = 1)
SELECT a.school, hero, coalesce(hero_fallback, true) AS hero_fallback, student, coalesce(student_fallback, true) AS student_fallback, swim, coalesce(swim_fallback, true) AS swim_fallback
FROM (SELECT DISTINCT school FROM ss) a LEFT JOIN h USING (school) LEFT JOIN s USING (school) LEFT JOIN w USING (school)""")
def _(t):
    d = slot_scores(t.candidates).groupBy("school", "url").agg(F.max("hero").alias("hero_s"), F.max("student").alias("student_s"), F.max("swim").alias("swim_s"))
    return OA.exclusive_slot_pick(d, "school", [("hero", "hero_s", 0), ("student", "student_s", 0), ("swim", "swim_s", -5)])


@query("best_per_slot", f"WITH {_SC} SELECT school, category, arg_min(url, (-score, url)) AS url, max(score) AS score FROM sc WHERE score > 0 GROUP BY 1, 2")
def _(t):
    return OA.best_per_slot(pool(t), "school", "category")


# suppliers choose parts in key order; a part is used once
role("offers", "SELECT l_suppkey AS entity, l_suppkey AS ord, CAST(l_partkey AS STRING) AS url, CAST(max(l_quantity) AS INT) AS score FROM {lineitem} GROUP BY 1, 2, 3")


@query("global_exclusive_pick", """WITH RECURSIVE o AS (SELECT entity, ord, url, max(score) AS score FROM {offers} WHERE score >= 10 GROUP BY 1, 2, 3), en AS (SELECT entity, row_number() OVER (ORDER BY ord) AS k FROM (SELECT DISTINCT entity, ord FROM o) x),
l AS (SELECT k, entity, list(url ORDER BY score DESC, url) AS urls, list(score ORDER BY score DESC, url) AS scores FROM o JOIN en USING (entity) GROUP BY 1, 2),
r AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::BIGINT AS entity, NULL::VARCHAR AS url, NULL::INTEGER AS score
 UNION ALL SELECT k, CASE WHEN p > 0 THEN list_append(taken, urls[p]) ELSE taken END, entity, CASE WHEN p > 0 THEN urls[p] END, CASE WHEN p > 0 THEN scores[p] END
 FROM (SELECT l.*, taken, list_position([NOT list_contains(taken, u) for u in urls], true) AS p FROM r JOIN l ON l.k = r.k + 1) y)
SELECT entity, url, score FROM r WHERE url IS NOT NULL""")
def _(t):
    return OA.global_exclusive_pick(t.offers, "entity", "ord", minimum=10)


# ---- state over ordered lines ----------------------------------------------------------------------------

# lines of a result file per customer: orders as headers, line items as results
role("state_lines", """
SELECT CAST(o_custkey AS STRING) AS source_file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line_no, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS header,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS section, o_orderkey, o_totalprice FROM {orders}
""")


@query("carry_forward_state", """SELECT o_orderkey, last_value(header IGNORE NULLS) OVER w AS header, last_value(section IGNORE NULLS) OVER w AS section FROM {state_lines} WINDOW w AS (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return X.carry_state(t.state_lines, ["header", "section"]).select("o_orderkey", "header", "section")


@query("pending_pair", """WITH s AS (SELECT *, o_orderkey % 4 = 0 AS is_rank, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS has_time FROM {state_lines}), i AS (SELECT *, sum(is_rank::INT) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT source_file, max(CASE WHEN is_rank THEN line_no END) AS rank_line, arg_min(o_totalprice, line_no) FILTER (has_time) AS time FROM i WHERE island > 0 GROUP BY source_file, island""")
def _(t):
    s = t.state_lines.withColumns({"is_rank": F.col("o_orderkey") % 4 == 0, "has_time": (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 4 != 0)})
    i = K.running_total(s, ["source_file"], "line_no", F.col("is_rank").cast("int"), "island").filter("island > 0")
    return i.groupBy("source_file", "island").agg(
        F.max(F.when(F.col("is_rank"), F.col("line_no"))).alias("rank_line"),
        F.min_by("o_totalprice", F.when(F.col("has_time"), F.col("line_no"))).alias("time")).drop("island")


@query("running_miss_cutoff", """WITH s AS (SELECT *, o_orderkey % 4 = 0 AS hit, max(CASE WHEN o_orderkey % 4 = 0 THEN line_no END) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS last_hit FROM {state_lines})
SELECT o_orderkey, CAST(line_no - coalesce(last_hit, 0) AS BIGINT) AS misses FROM s WHERE line_no - coalesce(last_hit, 0) < 5""")
def _(t):
    d = X.running_miss_cutoff(t.state_lines.withColumn("hit", F.col("o_orderkey") % 4 == 0), ["source_file"], "hit")
    return d.select("o_orderkey", "misses")


# ---- sorts and limits ------------------------------------------------------------------------------------


@query("rank_results", "SELECT school, adj_pts FROM {search_rows}")
def _(t):
    return R.rank_results(t.search_rows).select("school", "adj_pts")


@query("tier_order_sort", "SELECT school, tier_short, finish, CAST(row_number() OVER (PARTITION BY conference ORDER BY CASE tier_short WHEN '1A' THEN 0 WHEN '1B' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 ELSE 5 END, coalesce(nullif(finish, 0), 99), school) AS INTEGER) AS position FROM {schools}")
def _(t):
    w = Window.partitionBy("conference").orderBy(*R.tier_order_sort(t.schools))
    d = t.schools.withColumn("position", F.row_number().over(w))
    return d.select("school", "tier_short", "finish", "position")


@query("tier_rows_sort", "SELECT bundle_id, gender, team, rank_i, score_f FROM {ranked_revenue}")
def _(t):
    return T.tier_rows_sort(t.ranked_revenue).select("bundle_id", "gender", "team", "rank_i", "score_f")


def kind_sql(low: str) -> str:
    return f"CASE WHEN {any_phrase(low, [k for k, _ in IN.REGIONS])} THEN 'region' " + " ".join(f"WHEN {any_phrase(low, p)} THEN '{k}'" for k, p in IN.SORTS) + " ELSE 'strength' END"


_REGION = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN [{', '.join(repr(x) for x in v)}]" for k, v in IN.REGIONS) + " END"
_STR = "(CASE WHEN adj_pts > 0 THEN adj_pts ELSE CASE tier_short WHEN '1A' THEN 120 WHEN '1B' THEN 95 WHEN '2' THEN 70 WHEN '3' THEN 45 WHEN '4' THEN 20 ELSE 0 END END)"
_STATE = "CASE WHEN contains(location, ', ') THEN trim(list_extract(string_split(location, ', '), -1)) ELSE '' END"
role("pool_rows", "SELECT s.*, CASE WHEN pos % 4 = 1 THEN 0.0e0 ELSE CAST(pos AS DOUBLE) * 7 END AS adj_pts FROM {schools} s")
role("short_queries", "SELECT conv_id * 100 + turn AS query_id, query FROM {query_text}")
PRE_SORT_SQL = f"""WITH x AS (SELECT query_id, {kind_sql('low')} AS kind, {_REGION} AS states FROM (SELECT query_id, lower(query) AS low FROM {{short_queries}}) a), y AS (SELECT *, {_STR} AS st FROM x CROSS JOIN {{pool_rows}}),
z AS (SELECT *, CASE kind WHEN 'region' THEN CASE WHEN list_contains(states, {_STATE}) THEN 0 ELSE 1 END WHEN 'selective' THEN coalesce(nullif(accept, 0), 999) WHEN 'stem' THEN CASE WHEN stem THEN 0 ELSE 1 END WHEN 'money' THEN CASE merit WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 WHEN 'none' THEN 2 ELSE 3 END
 WHEN 'social' THEN -coalesce(accept, 0) WHEN 'ivy' THEN CASE WHEN hidden_ivy OR ivy_league THEN 0 ELSE 1 END WHEN 'd1' THEN CASE WHEN division = 'D1' THEN 0 ELSE 1 END WHEN 'd3' THEN CASE WHEN division = 'D3' THEN 0 ELSE 1 END ELSE -st END::DOUBLE AS k1, CASE WHEN kind IN ('region', 'stem', 'd1', 'd3') THEN -st ELSE 0 END AS k2 FROM y)
SELECT query_id, school, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k1, k2, adj_pts DESC, school) AS INTEGER) AS position FROM z QUALIFY position <= 150"""


@query("intent_sort", PRE_SORT_SQL)
def _(t):
    return R.intent_rank(t.short_queries, t.pool_rows)


@query("prestige_sort", f"""SELECT grp, school, CAST(row_number() OVER (PARTITION BY grp ORDER BY {SCORE_SQL('label')}, adj_pts DESC, school) AS INTEGER) AS position FROM (SELECT *, school % 40 AS grp FROM {{search_rows}}) x QUALIFY position <= CASE WHEN grp % 2 = 0 THEN 12 ELSE 6 END""")
def _(t):
    d = t.search_rows.withColumn("grp", F.col("school") % 40)
    return R.prestige_sort(d, "grp", F.when(F.col("grp") % 2 == 0, 12).otherwise(6)).select("grp", "school", "position")


_LS = SCORE_SQL("label")


@query("composite_rank", f"""SELECT school, {rnd(f"CASE WHEN mode IN ('GUIDED', 'CONSTRAINED') THEN ({_LS})::DOUBLE * 0.60::DOUBLE + least(greatest(adj_pts, 0.0) / 130.0, 1.0) * 100 * 0.40::DOUBLE + least(coalesce(nullif(accept, 0), 50) / 100.0, 1.0) * 3 ELSE least(CASE WHEN adj_pts > 0 THEN adj_pts ELSE 0 END / 130.0, 1.0) * 100 * 0.65::DOUBLE + ({_LS})::DOUBLE * 0.35::DOUBLE END", 6)} AS score
FROM (SELECT *, CASE school % 3 WHEN 0 THEN 'GUIDED' WHEN 1 THEN 'CONSTRAINED' ELSE 'OBJECTIVE' END AS mode FROM {{search_rows}}) x""")
def _(t):
    mode = F.when(F.col("school") % 3 == 0, "GUIDED").when(F.col("school") % 3 == 1, "CONSTRAINED").otherwise("OBJECTIVE")
    s = IN.composite_rank(mode, "label", "adj_pts", "has_swim", F.lit(""), "accept")
    return t.search_rows.select("school", NU.round_to(s, 6).alias("score"))


_DAYS = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN {v}" for k, v in TX.DAY_POINTS) + " ELSE 0 END"
_FINALS = " + ".join(f"CASE WHEN contains(low, '{k}') THEN {v} ELSE 0 END" for k, v in TX.FINAL_POINTS)


@query("source_priority", f"""SELECT k, CASE WHEN regexp_matches(low, 'team\\s*score|team\\s*result|team\\s*rank|team\\s*standing|score\\s*sheet|score\\s*summary|standings') THEN 200 ELSE 0 END + {_DAYS} + {_FINALS} AS priority FROM (SELECT k, lower(replace(file_name, '_team_scores', '_team scores')) AS low FROM {{file_text}}) x""")
def _(t):
    name = F.replace("file_name", F.lit("_team_scores"), F.lit("_team scores"))
    return t.file_text.select("k", TX.source_priority(name).alias("priority"))


@query("last_day_first", """SELECT grp, k, CAST(row_number() OVER (PARTITION BY grp ORDER BY d DESC NULLS LAST, file_name, k) AS INTEGER) AS position FROM (
 SELECT k % 50 AS grp, k, file_name, TRY_CAST(coalesce(nullif(regexp_extract(lower(file_name), '_day_([1-9])', 1), ''), nullif(regexp_extract(lower(file_name), '_(?:day|d)([1-9])', 1), '')) AS INTEGER) AS d FROM {file_text}) x""")
def _(t):
    d = t.file_text.withColumn("day", TB.file_metadata("file_name")["day"]).withColumn("grp", F.col("k") % 50)
    d = K.global_rank(d, [*TB.last_day_first(d), F.asc("k")], "position", ["grp"])
    return d.select("grp", "k", F.col("position").cast("int").alias("position"))


# ---- set operations --------------------------------------------------------------------------------------


@query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer")
def _(t):
    return ST.union_all([t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")), t.supplier.select(F.col("s_name").alias("name")), t.customer.select(F.col("c_name").alias("name"))])


@query("union_dedupe", """WITH u AS (SELECT l_suppkey AS g, l_partkey AS k, l_extendedprice AS score, 0 AS src FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, l_partkey, l_extendedprice, 1 FROM lineitem WHERE l_returnflag <> 'A'),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY src, score DESC) AS rn FROM u) x WHERE rn = 1) SELECT g, k, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, k) AS rk FROM d) y WHERE rk <= 80""")
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("score"), "l_returnflag")
    parts = [d.filter("l_returnflag = 'A'").drop("l_returnflag"), d.filter("l_returnflag <> 'A'").drop("l_returnflag")]
    return ST.union_dedupe(parts, ["g", "k"], "g", [F.desc("score"), F.asc("k")], cap=80)


@query("except_anti", "SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("id")).distinct().join(t.events.select(F.col("user_id").alias("id")), "id", "left_anti")


@query("token_set_operations", """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ' || p_name || ' red', ' ') AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS either FROM t""")
def _(t):
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lit("red")), " ")
    return t.part.select("p_partkey", F.size(F.array_intersect(a, b)).cast("bigint").alias("common"), F.size(F.array_union(a, b)).cast("bigint").alias("either"))


role("base_entries", "SELECT c_custkey AS school, c_name AS hero, CASE WHEN c_acctbal < 0 THEN CAST(NULL AS STRING) ELSE c_mktsegment END AS swim FROM {customer} WHERE c_mktsegment <> 'MACHINERY'")
role("curated_entries", "SELECT c_custkey AS school, CASE WHEN c_custkey % 4 = 0 THEN 'curated ' || c_name END AS hero, CASE WHEN c_nationkey % 5 = 0 THEN 'pool' END AS swim FROM {customer} WHERE c_acctbal > 1000")


@query("merge_curated", """SELECT coalesce(b.school, c.school) AS school, coalesce(c.hero, b.hero) AS hero, coalesce(c.swim, b.swim) AS swim, CASE WHEN c.hero IS NOT NULL THEN 'curated' WHEN b.school IS NOT NULL THEN 'web' END AS hero_source, CASE WHEN c.hero IS NOT NULL THEN false WHEN b.school IS NOT NULL THEN true END AS hero_fallback
FROM {base_entries} b FULL JOIN (SELECT * FROM {curated_entries} WHERE hero IS NOT NULL OR swim IS NOT NULL) c ON b.school = c.school""")
def _(t):
    base = t.base_entries.withColumns({"is_fallback": F.create_map(F.lit("hero"), F.lit(True)), "source_pages": F.create_map(F.lit("hero"), F.lit("web"))})
    d = ST.merge_curated(base, t.curated_entries, "school", ["hero", "swim"])
    at = lambda c: F.try_element_at(c, F.lit("hero"))
    return d.select("school", "hero", "swim", at(F.col("source_pages")).alias("hero_source"), at(F.col("is_fallback")).alias("hero_fallback"))


_SLICE = "CASE l_returnflag WHEN 'A' THEN 'campus' WHEN 'N' THEN 'pool' ELSE 'student_life' END"


@query("replace_slice", f"""WITH b AS (SELECT l_suppkey AS school, {_SLICE} AS category, l_partkey AS url, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3), fresh AS (SELECT school, category, url + 100000 AS url, score / 2 AS score FROM b WHERE category = 'campus' AND score > 50000),
u AS (SELECT school, category, url, score FROM b WHERE NOT (category = 'campus' AND school IN (SELECT school FROM fresh)) UNION ALL SELECT school, category, url, score FROM fresh WHERE url NOT IN (SELECT p_partkey + 100000 FROM part WHERE p_size = 1))
SELECT school, category, url, score FROM u QUALIFY row_number() OVER (PARTITION BY school, category ORDER BY score DESC, category || '|' || url) <= 32""")
def _(t):
    category = F.when(F.col("l_returnflag") == "A", "campus").when(F.col("l_returnflag") == "N", "pool").otherwise("student_life")
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("school"), category.alias("category"), F.col("l_partkey").alias("url")).agg(F.max("l_extendedprice").alias("score"))
    # a url is unique per category here, so the category is part of it
    key = lambda d: d.withColumn("url", F.concat_ws("|", "category", F.col("url").cast("string")))
    fresh = b.filter("category = 'campus' AND score > 50000").select("school", "category", (F.col("url") + 100000).alias("url"), (F.col("score") / 2).alias("score"))
    blocked = t.part.filter("p_size = 1").select(F.concat_ws("|", F.lit("campus"), (F.col("p_partkey") + 100000).cast("string")).alias("url"))
    d = ST.replace_slice(key(b), key(fresh), "school", "category", blocked=blocked)
    return d.withColumn("url", F.substring_index("url", "|", -1).cast("bigint")).select("school", "category", "url", "score")


@query("patch_columns", "SELECT coalesce(c.c_custkey, o.o_custkey) AS id, CASE WHEN c.c_custkey IS NULL THEN '' ELSE c_name END AS name, CASE WHEN o.o_custkey IS NOT NULL THEN total ELSE c_acctbal END AS amount FROM (SELECT * FROM customer WHERE c_acctbal >= 0) c FULL JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o_custkey")
def _(t):
    base = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    patch = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("amount"))
    return ST.patch_columns(base, patch, "id", ["amount"], {"name": ""})
