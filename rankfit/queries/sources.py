"""Scans, staging, sinks and upserts over data written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import staging as ST, tables as TB
from .base import query, role
from .scalars import stop_sql

# anchors as a text file would hold them
role("anchor_text", """
SELECT conference AS Conference, gender AS Gender, event AS Event, CAST(min(sec) AS DECIMAL(12,2)) AS v1, CAST(avg(place) AS DECIMAL(12,2)) AS v8, CAST(max(sec) AS DECIMAL(12,2)) AS v16, count(*) AS n
FROM {places} GROUP BY conference, gender, event
""")
role("anchor_csv", """
SELECT ' ' || Conference AS Conference, upper(Gender) AS Gender, Event, CASE WHEN n % 3 = 0 THEN '' ELSE CAST(v1 AS STRING) END AS `1st_seconds`, CAST(v1 AS STRING) AS `1st`,
  CASE WHEN n % 5 = 0 THEN 'x' ELSE CAST(v8 AS STRING) END AS `8th`, CAST(v16 AS STRING) AS `16th`, CASE WHEN n % 2 = 0 THEN '0.5' ELSE '' END AS Sec_per_place
FROM {anchor_text}
""")


@query("scan_anchors", """SELECT conference, event, first, eighth, sixteenth, sec_per_place, coalesce(NOT (first <= eighth AND eighth <= sixteenth), false) AS out_of_order
FROM (SELECT Conference AS conference, Event AS event, CAST(v1 AS DOUBLE) AS first, CASE WHEN n % 5 <> 0 THEN CAST(v8 AS DOUBLE) END AS eighth, CAST(v16 AS DOUBLE) AS sixteenth,
  CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE END AS sec_per_place FROM {anchor_text} WHERE Gender = 'men') x""")
def _(t):
    path = scratch_path(t.spark, "anchors")
    columns = ["Conference", "Gender", "Event", "1st", "8th", "16th", "1st_seconds", "Sec_per_place"]
    ST.write_table(t.anchor_csv, path, columns)
    return TB.scan_anchors(TB.read_text_csv(t.spark, path))


# a team snapshot: suppliers as teams of their nation, with repeated and unknown rows
role("snapshot", """
SELECT CASE WHEN s_suppkey % 23 = 22 THEN 'Unknown' ELSE r_name END AS Conference, CASE WHEN s_suppkey % 10 = 9 THEN n_name || ' Team' ELSE n_name || ' ' || CAST(s_suppkey % 7 AS STRING) END AS Team,
  CASE WHEN s_suppkey % 4 = 3 THEN 'women' ELSE 'Men' END AS gender, CASE s_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE '0.' || CAST(70 + s_suppkey % 20 AS STRING) END AS PSF, 'T' AS Tier,
  CASE WHEN s_suppkey % 6 = 5 THEN '' ELSE CAST(s_suppkey % 12 AS STRING) END AS Finish, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS STRING) AS MenPoints,
  CASE s_suppkey % 6 WHEN 0 THEN '1A' WHEN 1 THEN '1B' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE '' END AS tier_short, 'Tier ' || CAST(s_suppkey % 4 AS STRING) AS final_tier, '' AS PowerClass, s_suppkey AS pos
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""")
role("team_aliases", "SELECT n_name || ' Team' AS raw, n_name || ' 0' AS canonical, 'trailing qualifier' AS reason FROM {nation}")
TEAMS_SQL = """SELECT conference, school, raw_name, normalized, psf, tier, finish, points, tier_short, final_tier, power_class, pos FROM (
 SELECT Conference AS conference, coalesce(a.canonical, Team) AS school, Team AS raw_name, a.canonical IS NOT NULL AS normalized, coalesce(nullif(TRY_CAST(PSF AS DOUBLE), 0), 1.0::DOUBLE) AS psf, Tier AS tier,
  nullif(TRY_CAST(Finish AS INTEGER), 0) AS finish, TRY_CAST(MenPoints AS DOUBLE) AS points, tier_short, final_tier, PowerClass AS power_class, pos,
  row_number() OVER (PARTITION BY Conference, coalesce(a.canonical, Team) ORDER BY pos) AS rn
 FROM {snapshot} LEFT JOIN {team_aliases} a ON Team = a.raw WHERE lower(gender) = 'men' AND Conference <> 'Unknown') x WHERE rn = 1"""


@query("scan_teams", TEAMS_SQL)
def _(t):
    return TB.scan_teams(t.snapshot, t.team_aliases)


@query("scan_scores", "SELECT bundle_id, conference, gender, coalesce(rank, '') AS rank, trim(team) AS team, score, CAST(pos AS VARCHAR) AS pos FROM {score_text}")
def _(t):
    path = scratch_path(t.spark, "scores")
    ST.write_table(t.score_text, path, ["bundle_id", "conference", "gender", "rank", "team", "score", "pos"])
    d = TB.scan_scores(t.spark, path)
    return d.withColumns({"rank": F.coalesce("rank", F.lit("")), "team": F.trim("team")})


role("long_text", """
SELECT r_name AS Conference, p_brand AS Event, CASE WHEN l_linestatus = 'O' THEN 'Men' ELSE 'WOMEN' END AS Gender,
  CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS Place, CASE WHEN l_tax = 0 THEN 'DNS' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS Time_Sec
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""")


@query("scan_long_places", """SELECT Conference AS conference, Event AS event, lower(Gender) AS gender, TRY_CAST(Place AS INTEGER) AS place, min(TRY_CAST(Time_Sec AS DOUBLE)) AS sec FROM {long_text}
WHERE TRY_CAST(Place AS INTEGER) IS NOT NULL AND TRY_CAST(Time_Sec AS DOUBLE) IS NOT NULL GROUP BY ALL""")
def _(t):
    return TB.scan_long_places(t.long_text)


# one nested JSON document per order status: gender -> event -> level -> seconds, from the orders
role("standards_json", """
SELECT g, event, level, CAST(CAST(min(o_totalprice) AS DECIMAL(18,2)) AS STRING) AS sec FROM (
 SELECT CASE o_orderstatus WHEN 'F' THEN 'boys' ELSE 'girls' END AS g, o_orderpriority AS event, CASE o_custkey % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'AA' WHEN 3 THEN 'AAA' ELSE 'AAAA' END AS level, o_totalprice
 FROM {orders}) x GROUP BY 1, 2, 3
""")


@query("scan_standards", "SELECT CASE g WHEN 'boys' THEN 'men' ELSE 'women' END AS gender, event, level, CAST(sec AS DOUBLE) AS sec FROM {standards_json}")
def _(t):
    levels = t.standards_json.groupBy("g", "event").agg(F.map_from_entries(F.collect_list(F.struct("level", F.col("sec").cast("double")))).alias("m"))
    genders = levels.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("event", "m"))).alias("m"))
    path = scratch_path(t.spark, "standards")
    docs = genders.select(F.to_json(F.map_from_entries(F.array(F.struct("g", "m")))).alias("value"))
    docs.write.text(path)
    return TB.scan_standards(t.spark.read.text(path))


@query("stage_partitions", """SELECT b.bundle_id, CASE WHEN b.bundle_id = 'NATION_7' THEN 'failed' WHEN b.bundle_id IN (SELECT DISTINCT bundle_id FROM {score_text}) THEN 'staged' ELSE 'empty' END AS status,
  (SELECT count(*) FROM {score_text} s WHERE s.bundle_id = b.bundle_id AND b.bundle_id <> 'NATION_7') AS n_rows FROM (SELECT n_name AS bundle_id FROM nation UNION ALL SELECT r_name FROM region) b""")
def _(t):
    root = scratch_path(t.spark, "stages")
    rows = t.score_text
    nations = t.nation.select(F.col("n_name").alias("bundle_id"))
    half = nations.filter("substring(bundle_id, -1) IN ('0', '1', '2', '3', '4')")

    def raising(*bad):
        def work(part):
            if part["bundle_id"].iloc[0] in bad:
                raise ValueError("unreadable")
            return part

        return work

    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    ST.stage_partitions(rows, half, root, work=raising("NATION_3", "NATION_7"), schema=schema)
    # the second run stages what is missing and tries again what failed, with the regions as bundles that have no rows
    marks = ST.stage_partitions(rows, nations.unionByName(t.region.select(F.col("r_name").alias("bundle_id"))), root, work=raising("NATION_7"), schema=schema)
    counts = ST.read_stages(t.spark, root).groupBy("bundle_id").agg(F.count("*").alias("n_rows"))
    return marks.join(counts, "bundle_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@query("write_tables", "SELECT conference, gender, event, CAST(place AS VARCHAR) AS place, CAST(sec AS DOUBLE) AS sec, CAST(NULL AS VARCHAR) AS data_quality FROM {places}")
def _(t):
    path = scratch_path(t.spark, "places")
    ST.write_table(t.places.withColumn("extra", F.lit("ignored")), path, ["conference", "gender", "event", "place", "sec", "data_quality"])
    return TB.read_text_csv(t.spark, path).withColumn("sec", F.col("sec").cast("double"))


_STEM = "lower(regexp_replace(regexp_replace(file_name, '(\\.pdf)+$', '.pdf'), '\\.[^.]*$', ''))"
META_SQL = f"""meta AS (SELECT k, file_name, toks, [x for x in [regexp_extract(t, '20[0-9][0-9]') for t in toks] if x <> ''][1] AS year,
  coalesce([x for x in [CASE WHEN t IN ('women', 'womens', 'woman', 'w') THEN 'women' WHEN t IN ('men', 'mens', 'man') THEN 'men' WHEN t IN ('combined', 'full', 'complete', 'both', 'coed') THEN 'combined' END for t in toks] if x IS NOT NULL][1], 'combined') AS gender,
  list_has_any(toks, ['prelim', 'prelims', 'preliminary', 'preliminaries', 'heats', 'heat']) AS is_prelim,
  list_has_any(toks, ['final', 'finals']) AND NOT list_has_any(toks, ['prelim', 'prelims', 'preliminary', 'preliminaries', 'heats', 'heat']) AS is_final,
  CASE WHEN regexp_matches(stem, '_day_([1-9])') THEN 'day' || regexp_extract(stem, '_day_([1-9])', 1) ELSE [t for t in toks if regexp_matches(t, '^(day|d)[1-9]$') OR t IN {stop_sql(TB.DAY_TOKENS)}][1] END AS day,
  array_to_string([t for t in toks if t NOT IN {stop_sql([*TB.WOMEN_TOKENS, *TB.MEN_TOKENS, *TB.COMBINED_TOKENS, *TB.PRELIM_TOKENS, *TB.FINAL_TOKENS, *TB.DAY_TOKENS, *TB.OTHER_TOKENS])} AND NOT regexp_matches(t, '^(20[0-9][0-9]|day[1-9]|d[1-9]|[0-9])$')], '_') AS conference_hint
 FROM (SELECT k, file_name, {_STEM} AS stem, regexp_split_to_array({_STEM}, '[_\\s\\-]+') AS toks FROM {{file_text}}) x)"""


@query("file_metadata", f"WITH {META_SQL} SELECT k, year, gender, is_prelim, is_final, day, conference_hint FROM meta")
def _(t):
    return t.file_text.select("k", TB.file_metadata("file_name").alias("m")).select("k", "m.*")


# documents as files: one line per supplier, in folders by region; suppliers of one name share a file
role("file_docs", """
SELECT s_suppkey AS k, 'region_' || CAST(s_nationkey % 5 AS STRING) AS folder, s_name AS line, CASE s_suppkey % 9 WHEN 0 THEN 'NESCAC' WHEN 1 THEN 'liberty_league' WHEN 2 THEN 'Big-12' WHEN 3 THEN 'IvyLeague' WHEN 4 THEN 'unknown' WHEN 5 THEN 'acc' ELSE 'uaa' END
  || CASE (s_suppkey * 3) % 4 WHEN 0 THEN '_Women' WHEN 1 THEN '_mens' WHEN 2 THEN '_combined' ELSE '' END || CASE (s_suppkey * 5) % 7 WHEN 0 THEN '_Day_3' WHEN 1 THEN '_d2' WHEN 2 THEN '_saturday' ELSE '' END
  || CASE (s_suppkey * 7) % 5 WHEN 0 THEN '_prelims' WHEN 1 THEN '_finals' WHEN 2 THEN '_results' ELSE '' END || CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE '_20' || CAST(10 + s_suppkey % 4 AS STRING) END || '.pdf' AS file_name
FROM {supplier}
""")


@query("scan_files", f"""WITH {META_SQL.replace('{file_text}', '{file_docs}')} SELECT file_name, n_bytes, any_value(year) AS year, any_value(gender) AS gender, any_value(is_prelim) AS is_prelim, any_value(is_final) AS is_final, any_value(day) AS day, any_value(conference_hint) AS conference_hint
FROM meta JOIN (SELECT file_name, CAST(sum(length(line) + 1) AS BIGINT) AS n_bytes FROM {{file_docs}} GROUP BY 1) b USING (file_name) GROUP BY 1, 2""")
def _(t):
    root = scratch_path(t.spark, "files")
    t.file_docs.select("folder", "file_name", "line").repartition("folder").write.partitionBy("folder", "file_name").text(root)
    return TB.scan_files(t.spark, root).drop("modified")


def _bundle_sql() -> str:
    from .scalars import _category_sql

    return f"""WITH {META_SQL}, c AS (SELECT *, {_category_sql("lower(file_name || ' ' || conference_hint)")} AS conference FROM meta)
SELECT regexp_replace(lower(conference), '[^a-z0-9]', '', 'g') || '_' || coalesce(year, 'unknown') AS bundle_id, conference, count(*) AS files FROM c GROUP BY ALL"""


@query("bundle_key", _bundle_sql())
def _(t):
    return TB.bundle_key(t.file_text).groupBy("bundle_id", "conference").agg(F.count("*").alias("files"))


# user documents: the events as writes of (user, key)
role("kv_writes", """
SELECT user_id, CASE event_type WHEN 'click' THEN 'my_list' WHEN 'view' THEN 'swimmer' WHEN 'error' THEN 'not_allowed' WHEN 'signup' THEN 'preferences' ELSE 'crm_data' END AS data_key,
  props AS data_value, ts AS updated_at, event_id AS seq FROM {events}
""")
_ALLOWED = stop_sql(ST.ALLOWED_KEYS)
_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, data_key ORDER BY updated_at DESC, seq DESC) AS rn FROM {{kv_writes}} WHERE data_key IN {_ALLOWED}) x WHERE rn = 1"


@query("kv_upsert", f"SELECT user_id, data_key, data_value, seq FROM ({_LATEST}) y")
def _(t):
    w = t.kv_writes
    # the first half of the month, then the second half on top of it
    later = F.col("updated_at") >= F.lit("2024-01-15").cast("timestamp_ntz")
    first = ST.kv_upsert(w.limit(0), w.filter(~later))
    return ST.kv_upsert(first, w.filter(later)).select("user_id", "data_key", "data_value", "seq")


@query("kv_load", f"SELECT user_id, data_key, CAST(json_extract_string(data_value, '$.k') AS BIGINT) AS k FROM ({_LATEST}) y")
def _(t):
    table = ST.kv_upsert(t.kv_writes.limit(0), t.kv_writes)
    return ST.kv_load(table, "k bigint").select("user_id", "data_key", F.col("doc.k").alias("k"))


# cached texts: one write per turn, with cost-only rows that must count as a miss
role("cache_writes", """
SELECT conv_id AS school, CASE turn % 2 WHEN 0 THEN 'art' ELSE 'math' END AS major, CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE text END AS known_for,
  CASE WHEN turn % 4 = 0 THEN 'life' ELSE '' END AS campus_life_main, turn AS updated FROM {conversations}
""")


@query("cache_upsert", """SELECT school, major, known_for, length(known_for) > 0 OR length(campus_life_main) > 0 AS is_hit FROM (SELECT *, row_number() OVER (PARTITION BY school, major ORDER BY updated DESC) AS rn FROM {cache_writes}) x WHERE rn = 1""")
def _(t):
    d = ST.cache_upsert(t.cache_writes.limit(0), t.cache_writes, ["school", "major"], "updated", "updated")
    return d.select("school", "major", "known_for", ST.cache_hit().alias("is_hit"))


@query("cache_upsert_school", """SELECT school, known_for, campus_life_main, length(known_for) > 0 OR length(campus_life_main) > 0 AS is_hit FROM (SELECT *, row_number() OVER (PARTITION BY school ORDER BY updated DESC) AS rn FROM {cache_writes}) x WHERE rn = 1""")
def _(t):
    w = t.cache_writes.select("school", "known_for", "campus_life_main", "updated")
    # the early turns first, then the later ones on top of them
    first = ST.cache_upsert(w.limit(0), w.filter("updated < 3"), ["school"], "updated", "updated")
    d = ST.cache_upsert(first, w.filter("updated >= 3"), ["school"], "updated", "updated")
    return d.select("school", "known_for", "campus_life_main", ST.cache_hit().alias("is_hit"))


@query("cache_upsert_minor", """SELECT school, major, minor, known_for FROM (SELECT *, row_number() OVER (PARTITION BY school, major, minor ORDER BY updated DESC) AS rn FROM (SELECT *, CASE WHEN updated % 3 = 0 THEN 'music' END AS minor FROM {cache_writes}) y) x WHERE rn = 1
UNION ALL SELECT school, NULL, minor, known_for FROM (SELECT *, row_number() OVER (PARTITION BY school, minor ORDER BY updated DESC) AS rn FROM (SELECT *, 'music' AS minor FROM {cache_writes} WHERE updated % 3 = 0) y) x WHERE rn = 1""")
def _(t):
    w = t.cache_writes.select("school", "major", F.when(F.col("updated") % 3 == 0, "music").alias("minor"), "known_for", "updated")
    both = ST.cache_upsert(w.limit(0), w, ["school", "major", "minor"], "updated", "updated")
    minor = w.filter("minor is not null").drop("major")
    alone = ST.cache_upsert(minor.limit(0), minor, ["school", "minor"], "updated", "updated").withColumn("major", F.lit(None).cast("string"))
    cols = ["school", "major", "minor", "known_for"]
    return both.select(*cols).unionByName(alone.select(*cols))


@query("additive_schema", "SELECT user_id, event_type, value, CAST(NULL AS VARCHAR) AS note FROM events UNION ALL SELECT o_custkey, o_orderstatus, CAST(NULL AS DOUBLE), o_orderpriority FROM orders")
def _(t):
    old = t.events.select("user_id", "event_type", "value")
    new = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderpriority").alias("note"))
    return ST.additive_schema(old, new)


