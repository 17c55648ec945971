"""End-to-end operators and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bests as B
from ..operators.keyed import near
from ..plans import explore as EX, results as P, scoring as PS
from ..sources import tables as TB
from ..session import cut_lineage, scratch_path
from ..streaming import streams as SM
from .aggregates import COVER_COLS, COVER_CTE, TOPK_CTE, SCORED_CTE, anchors_sql, mens_anchors
from .base import query, rnd, role
from .filters import LEGAL_SQL
from .joins import _NK
from .scalars import SC, TIER_SQL, a_score_sql, admission_sql, division_sql, ladder_sql, plausible_sql
from .sources import TEAMS_SQL
from .texts import files_of, text_lines

# ---- scoring ---------------------------------------------------------------------------------------------

# rows up to which those who search, and their orders, are broadcast
FEW = 1 << 20

_GRID = f"""{TOPK_CTE}, ga AS (SELECT s.*, w.swimmer, w.sat, w.gpa, CASE WHEN has_swim AND tk.raw_pts IS NOT NULL THEN tk.raw_pts ELSE 0.0 END AS raw_pts, has_swim AND tk.raw_pts IS NOT NULL AS is_scored, CASE WHEN has_swim AND tk.raw_pts IS NOT NULL THEN tk.top_events ELSE '' END AS top_events
 FROM {{swimmers}} w CROSS JOIN {{schools}} s LEFT JOIN tk ON tk.swimmer = w.swimmer AND tk.conference = s.conference), gb AS (SELECT * REPLACE (CASE WHEN has_swim THEN psf ELSE 1.0 END AS psf), {rnd('raw_pts * CASE WHEN has_swim THEN psf ELSE 1.0 END', 2)} AS adj_pts FROM ga),
 gc AS (SELECT *, CASE WHEN is_scored THEN {TIER_SQL('adj_pts')} ELSE '' END AS adj_tier FROM gb),"""
_OUT = ["swimmer", "school", "conference", "raw_pts", "adj_pts", "adj_tier", "top_events", "label", "acad_band", "swim_band", "division"]
SCORE_ALL_SQL = f"WITH {_GRID} " + "zz AS (WITH " + admission_sql("gc", "swimmer, school, conference, raw_pts, adj_pts, adj_tier, top_events") + f") SELECT swimmer, school, conference, raw_pts, adj_pts, adj_tier, top_events, CASE WHEN label = 'Unknown' THEN '' ELSE label END AS label, acad_band, swim_band, {division_sql('conference')} AS division FROM zz"


def universe(t, of=None):
    """Every swimmer at every school, or only those of `of` (swimmer), for whose times their own orders are read."""
    swimmers, times = t.swimmers, t.times
    if of is not None:
        of = near(of.distinct(), FEW)
        swimmers = swimmers.join(of, "swimmer", "left_semi")
        own = t.orders.join(of.withColumnRenamed("swimmer", "o_custkey"), "o_custkey", "left_semi")
        times = t.of(orders=near(own.select("o_orderkey", "o_custkey"), FEW)).times
    return PS.score_all(swimmers, times, mens_anchors(t), t.schools.drop("division"))


@query("score_all", SCORE_ALL_SQL)
def _(t):
    return universe(t).select(*_OUT)


@query("score_one", f"""WITH {SCORED_CTE}, one AS (SELECT * FROM {{schools}} WHERE school = 'NATION_3') SELECT t.swimmer, one.school, t.event, t.sec, sc.place, sc.pts, sc.place_label, sc.pts IS NOT NULL AS benchmarked FROM {{times}} t CROSS JOIN one LEFT JOIN sc ON sc.swimmer = t.swimmer AND sc.conference = one.conference AND sc.event = t.event""")
def _(t):
    return PS.score_one(t.times, mens_anchors(t), t.schools.filter("school = 'NATION_3'"))


# ---- results ---------------------------------------------------------------------------------------------

role("extracted_places", "SELECT bundle_id, bundle_id AS conference, gender, event, place, CAST(CAST(floor(sec / 5) AS BIGINT) + 1000 AS DOUBLE) / 100 AS sec FROM {event_places} WHERE event <> '75 Free'")


def built(t):
    lines = cut_lineage(text_lines(t.result_lines))
    return P.build_anchors(lines, files_of(lines))


@query("build_anchors", f"SELECT bundle_id, gender, event, first, eighth, sixteenth, sec_per_place, 'finals' AS data_quality FROM ({anchors_sql('{extracted_places}', 'bundle_id, gender, event')}) x")
def _(t):
    return built(t)["anchors"].select("bundle_id", "gender", "event", "first", "eighth", "sixteenth", "sec_per_place", "data_quality")


_VKEYS = "bundle_id, gender, event, version"


@query("build_anchors_by_votes", f"""WITH h AS ({anchors_sql('{session_places}', _VKEYS)}), f AS (SELECT {_VKEYS}, max(CASE WHEN place = 1 THEN sec END) AS sec FROM {{session_places}} GROUP BY ALL),
v AS (SELECT f.*, h.first IS NOT NULL AS full, {plausible_sql('f.event', 'f.sec', 'f.gender')} AS ok FROM f LEFT JOIN h USING ({_VKEYS})),
c AS (SELECT bundle_id, gender, event, CASE WHEN a.version IS NULL OR (a.full AND a.sec IS NOT NULL AND NOT a.ok AND b.full AND b.sec IS NOT NULL AND b.ok) THEN 'b' ELSE 'a' END AS version
  FROM (SELECT * FROM v WHERE version = 'a') a FULL JOIN (SELECT * FROM v WHERE version = 'b') b USING (bundle_id, gender, event))
SELECT h.* EXCLUDE (version), CASE version WHEN 'a' THEN 'finals' ELSE 'prelim_fallback' END AS data_quality FROM h JOIN c USING ({_VKEYS})""")
def _(t):
    lines = cut_lineage(t.session_lines)
    files = lines.select("source_file", "bundle_id").distinct().withColumns({"conference": F.col("bundle_id"), "year": F.lit("2026"), "file_order": F.when(F.endswith("source_file", F.lit("_a")), 1).otherwise(2)})
    lines = text_lines(lines)
    return P.build_anchors(lines, P.classify_files(lines, files))["anchors"].select("bundle_id", "gender", "event", "first", "eighth", "sixteenth", "sec_per_place", "data_quality")


@query("classify_files", """SELECT source_file, CASE WHEN count(DISTINCT gender) = 2 THEN 'combined' ELSE min(gender) END AS file_gender, CASE version WHEN 'a' THEN 3 ELSE 0 END AS session_score
FROM (SELECT bundle_id || '_' || version AS source_file, gender, version FROM {session_places}) x GROUP BY source_file, version""")
def _(t):
    lines = cut_lineage(t.session_lines)
    return P.classify_files(text_lines(lines), lines.select("source_file").distinct()).select("source_file", "file_gender", "session_score")


@query("coverage_report", f"WITH {COVER_CTE.replace('{event_places}', '{extracted_places}')} SELECT {COVER_COLS} FROM cov".replace("r_name AS conference", "n_name AS conference"))
def _(t):
    b = built(t)
    bundles = t.nation.select(F.col("n_name").alias("bundle_id"), F.col("n_name").alias("conference"))
    return P.coverage_report(b["anchors"], b["chosen"], bundles)["coverage"].select(*COVER_COLS.split(", "))


@query("build_team_scores", """WITH f AS (SELECT source_file, count(DISTINCT CASE WHEN flag <> 'A' THEN flag END) AS tail_genders FROM {standings} GROUP BY 1)
SELECT s.source_file AS bundle_id, gender, rank, team, score, s.source_file AS source FROM {standings} s JOIN f ON f.source_file = s.source_file WHERE rank <= 60 AND (flag <> 'A' OR tail_genders < 2)""")
def _(t):
    files = t.score_lines.select("source_file").distinct().withColumns({"bundle_id": F.col("source_file"), "conference": F.col("source_file"), "file_name": F.concat("source_file", F.lit("_results.pdf"))})
    return P.build_team_scores(t.score_lines, files)["scores"].select("bundle_id", "gender", "rank", "team", "score", "source")


# ---- bests and universe ----------------------------------------------------------------------------------

role("best_standards", """
SELECT DISTINCT g AS gender, event, 260 + CAST(length(event) AS DOUBLE) AS std_b, 200 + CAST(length(event) AS DOUBLE) AS std_a, 150 + CAST(length(event) AS DOUBLE) AS std_aa, CAST(90 AS DOUBLE) AS std_aaa, CAST(30 AS DOUBLE) AS std_aaaa
FROM (SELECT DISTINCT event FROM {event_times} WHERE event <> '1000 Free') e JOIN (SELECT 'men' AS g UNION ALL SELECT 'women') x ON 1 = 1
""")
_AS = a_score_sql(False).replace("sec", "time_sec")


@query("swimmer_bests", f"""WITH {LEGAL_SQL}, m AS (SELECT swimmer_id, event, min(x) AS time_sec FROM (SELECT *, TRY_CAST(coalesce(nullif(eventtime, ''), nullif(seedtime, '')) AS DOUBLE) AS x FROM legal_rows WHERE event IS NOT NULL) y WHERE x > 0 GROUP BY 1, 2),
g AS (SELECT swimmer_id, CASE arg_min(upper(trim(eventgender)), (pos, upper(trim(eventgender)))) WHEN 'M' THEN 'men' ELSE 'women' END AS gender FROM {{raw_results}} WHERE upper(trim(eventgender)) IN ('M', 'F') GROUP BY 1),
s AS (SELECT m.swimmer_id, coalesce(g.gender, 'men') AS gender, m.event, time_sec FROM m LEFT JOIN g USING (swimmer_id)), j AS (SELECT s.*, std_b AS b, std_a AS a, std_aa AS aa, std_aaa AS aaa, std_aaaa AS aaaa FROM s JOIN {{best_standards}} d ON d.gender = s.gender AND d.event = s.event),
k AS (SELECT swimmer_id, gender, event, time_sec, {rnd(_AS, 3)} AS a_score FROM j)
SELECT swimmer_id, gender, event, time_sec, a_score, {ladder_sql('a_score', SC.STANDARD_STEPS, 'AAAA+', '<')} AS a_tier, CAST(row_number() OVER (PARTITION BY swimmer_id ORDER BY a_score DESC, event) AS INTEGER) AS rn FROM k QUALIFY rn <= 10""")
def _(t):
    return EX.swimmer_bests(t.raw_results, t.best_standards)


role("school_meta", "SELECT n_name || ' ' || CAST(s_suppkey % 7 AS STRING) AS name, min(s_suppkey) % 60 AS accept, max(s_suppkey) + 1000 AS sat_median FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1")


@query("explore_universe", f"""WITH tm AS ({TEAMS_SQL}), s AS (SELECT coalesce(a.canonical, Team) AS school, lower(gender) AS g, x.* FROM {{snapshot}} x LEFT JOIN {{team_aliases}} a ON Team = a.raw),
u AS (SELECT school, count(*) FILTER (g = 'men') > 0 AS m, arg_max(Conference, pos) FILTER (g = 'men') AS mc, arg_max(Conference, pos) FILTER (g = 'women') AS wc, arg_max(tier_short, pos) FILTER (g = 'men') AS mt, arg_max(tier_short, pos) FILTER (g = 'women') AS wt,
 arg_max(coalesce(TRY_CAST(Finish AS INTEGER), -1), pos) FILTER (g = 'men') AS mf, arg_max(coalesce(TRY_CAST(Finish AS INTEGER), -1), pos) FILTER (g = 'women') AS wf, string_agg(DISTINCT g, ',' ORDER BY g) AS gender_coverage FROM s GROUP BY 1),
ix AS (SELECT * FROM (SELECT k, school AS ts, conference AS tc, psf, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM (SELECT {_NK('school')} AS k, * FROM tm UNION ALL SELECT {_NK('raw_name')} AS k, * FROM tm) z) y WHERE rn = 1),
j AS (SELECT u.*, ix.ts, ix.tc, ix.psf FROM u LEFT JOIN ix ON ix.k = {_NK('u.school')})
SELECT school, CASE WHEN ts IS NOT NULL AND CASE WHEN m THEN mc ELSE wc END = 'Unknown' THEN tc ELSE CASE WHEN m THEN mc ELSE wc END END AS conference, coalesce(psf, 1.0) AS psf, CASE WHEN ts IS NOT NULL THEN 'modeled_school' ELSE 'snapshot_only' END AS row_type,
 coalesce(nullif(mt, ''), nullif(wt, ''), '') AS tier_short, coalesce(nullif(nullif(mf, -1), 0), nullif(wf, -1)) AS finish, gender_coverage, CAST(coalesce(m1.accept, m2.accept) AS INTEGER) AS accept, m1.name IS NOT NULL OR m2.name IS NOT NULL AS has_meta
FROM j LEFT JOIN {{school_meta}} m1 ON m1.name = j.school LEFT JOIN {{school_meta}} m2 ON m2.name = j.ts""")
def _(t):
    teams = TB.scan_teams(t.snapshot, t.team_aliases)
    d = EX.explore_universe(t.snapshot, teams, t.team_aliases, t.cas_short, t.school_meta)
    return d.select("school", "conference", "psf", "row_type", "tier_short", "finish", "gender_coverage", F.col("accept").cast("int").alias("accept"), "has_meta")


# ---- search ----------------------------------------------------------------------------------------------

role("search_queries", """
SELECT conv_id * 100 + turn AS query_id, query, CAST(c_custkey AS BIGINT) AS swimmer, true AS has_times FROM {query_text} JOIN {customer} ON c_custkey = conv_id
UNION ALL SELECT 1000000 + n_nationkey, n_name, CAST(n_nationkey AS BIGINT), true FROM {nation} UNION ALL SELECT 2000000 + n_nationkey, 'nation ' || CAST(n_nationkey % 10 AS STRING), CAST(n_nationkey AS BIGINT), true FROM {nation}
""")


@query("search")
def _(t):
    q = t.search_queries
    u = universe(t, q.select("swimmer"))
    cands = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos")).withColumn("candidate", F.concat(F.lit("Nation "), ((F.col("query_id") + F.col("pos") * 3) % 25).cast("string")))
    cands = cands.withColumn("candidate", F.replace("candidate", F.lit("Nation "), F.lit("NATION_")))
    none = t.spark.createDataFrame([], "raw string, canonical string")
    acronyms = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("short"), F.col("n_name").alias("canonical"))
    out = t.customer.filter("c_acctbal < 0").select((F.col("c_custkey") * 100).alias("query_id"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("school"))
    outside = t.part.select(F.initcap("p_name").alias("name"), F.col("p_size").alias("accept"), (1000 + F.col("p_size") * 10).alias("sat_median")).groupBy("name").agg(
        F.min("accept").alias("accept"), F.min("sat_median").alias("sat_median"))
    q = q.join(t.swimmers.select("swimmer", "sat"), "swimmer", "left")
    return EX.search(q, u, acronyms, cands, none, out, outside)


# ---- streams ---------------------------------------------------------------------------------------------

role("event_order", "SELECT user_id, event_type AS event, CAST(ts AS TIMESTAMP) AS ts, value AS time_sec, event_id FROM {events}")
_RUN = "SELECT *, min(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_best FROM events"


@query("pr_detect", f"SELECT user_id, event_type AS event, value AS time_sec, old_best FROM ({_RUN}) x WHERE old_best IS NULL OR value < old_best")
def _(t):
    d = B.running_bests(t.event_order, ["user_id", "event"], ["ts", "time_sec"], "time_sec")
    return d.select("user_id", "event", "time_sec", "old_best")


def event_stream(t, batches: int = 3):
    """The events as a stream of several micro-batches, one file of a stretch of time each."""
    path = scratch_path(t.spark, "event-files")
    d = t.event_order
    low, high = d.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = ((high or 0) - (low or 0)) // batches + 1
    for i in range(batches):
        d.filter(F.unix_micros("ts").between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)


def found_bests(t, **options):
    path = scratch_path(t.spark, "new-bests")
    found = SM.pr_detect_stream(event_stream(t).drop("event_id"), **options)
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return t.spark.read.parquet(path).select("user_id", "event", "time_sec", "old_best")


@query("pr_detect_stream", f"SELECT user_id, event_type AS event, value AS time_sec, old_best FROM ({_RUN}) x WHERE old_best IS NULL OR value < old_best")
def _(t):
    return found_bests(t)


@query("pr_detect_gated_stream", f"""WITH RECURSIVE b AS (SELECT user_id, event_type AS event, ts, value AS time_sec, old_best, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, value) AS i FROM ({_RUN}) x WHERE old_best IS NULL OR value < old_best),
nx AS (SELECT b.user_id, b.event, b.i, min(c.i) AS j FROM b JOIN b c ON c.user_id = b.user_id AND c.event = b.event AND c.ts >= b.ts + INTERVAL 48 HOUR GROUP BY 1, 2, 3),
e AS (SELECT user_id, event, i FROM b WHERE i = 1 UNION ALL SELECT nx.user_id, nx.event, nx.j FROM e JOIN nx ON nx.user_id = e.user_id AND nx.event = e.event AND nx.i = e.i)
SELECT b.user_id, b.event, b.time_sec, b.old_best FROM e JOIN b USING (user_id, event, i)""")
def _(t):
    return found_bests(t, gate_hours=48.0)


@query("upsert_stream", "SELECT user_id, event_type AS event, value AS time_sec, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    log = scratch_path(t.spark, "latest")
    SM.upsert_stream(event_stream(t), ["user_id", "event"], "ts", "event_id", log).trigger(availableNow=True).start().awaitTermination()
    return SM.read_upserted(t.spark, log).select("user_id", "event", "time_sec", "event_id")
