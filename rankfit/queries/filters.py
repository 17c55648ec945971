"""Filters, predicates and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets as AS, events as EV
from ..operators import bests as B, coverage as C, ranking as R, sets as S
from ..sources.tables import group_filter
from .base import query, rnd, role
from .scalars import BAD_SQL, _KW
from ..functions import intent as IN

# scored rows with the intent of a query text in front of them
role("search_rows", """
SELECT id AS school, adj_tier, id % 5 <> 4 AS has_swim, CASE id % 6 WHEN 0 THEN 'Moonshot' WHEN 1 THEN 'Major Reach' WHEN 2 THEN 'Possible' WHEN 3 THEN 'Realistic Shot' WHEN 4 THEN 'Strong Chance' ELSE 'Very Strong Chance' END AS label,
  id % 10 <> 9 AS has_any_times, id % 4 <> 3 AS is_swim, id % 7 = 6 AS is_explicit_reach, CASE id % 3 WHEN 0 THEN 80 WHEN 1 THEN 60 END AS adm_threshold, accept, psf * 60 AS adj_pts
FROM (SELECT *, CASE WHEN id % 13 = 12 THEN '' ELSE adj_tier END AS t2 FROM {applicants}) x
""")
SCORE_SQL = lambda c: f"""CASE {c} WHEN 'Very Strong Chance' THEN 100 WHEN 'Strong Chance' THEN 80 WHEN 'Realistic Shot' THEN 60 WHEN 'Possible' THEN 40 WHEN 'Major Reach' THEN 15
  WHEN 'Moonshot' THEN 5 WHEN 'Moonshot — Apply for Fun' THEN 2 ELSE 25 END"""  # noqa: E731
_REASONS = f"""SELECT school, array_to_string([x for x in [CASE WHEN is_swim AND NOT is_explicit_reach THEN CASE WHEN NOT has_swim THEN 'no swim data' WHEN adj_tier = '' AND has_any_times THEN 'no scorable events at this school'
   WHEN adj_tier IN ('Below Roster Level', 'Not Competitive') THEN 'not competitive — ' || adj_tier END END,
  CASE WHEN {SCORE_SQL('label')} < adm_threshold THEN 'below threshold (' || label || ', need ' || CASE WHEN adm_threshold >= 80 THEN 'Strong Chance' ELSE 'Realistic Shot' END || '+)' END] if x IS NOT NULL], '; ') AS reason FROM {{search_rows}}"""


@query("hard_filter", f"SELECT school, reason FROM ({_REASONS}) x")
def _(t):
    kept, removed = R.hard_filter(t.search_rows)
    return removed.select("school", "reason").unionByName(kept.select("school", F.lit("").alias("reason")))


@query("exclude_list", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def _(t):
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    mine = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return R.exclude_list(t.orders, gone, mine, keys=["o_custkey"]).select("o_orderkey", "o_custkey")


@query("viable_pool", "SELECT school, adj_tier FROM {search_rows} WHERE has_swim AND adj_tier NOT IN ('', 'Not Competitive')")
def _(t):
    return R.viable_pool(t.search_rows).select("school", "adj_tier")


_JUNK = "logo|seal|flag|map|icon|coat|shield|wordmark|crest|badge|insignia|monogram|mascot|patch|\\.gif|svg|avatar|thumb|placeholder|spinner|blank|social|twitter|facebook|instagram|linkedin|youtube|portrait|headshot|locator|chart|graphic|lockup|tile[-_]|bullet|question|default|vector|signature|letterhead"
_OLD = "\\b(ca\\.?\\s*1[5-9][0-9][0-9]|1[5-9][0-9][0-9]|histor|archiv|vintage|antique|sepia|black.?white|b&w|bw_)\\b"


@query("bad_asset_filter", f"""WITH f AS (SELECT *, list_extract(string_split(lower(url), '/'), -1) AS file FROM {{candidates}}),
g AS (SELECT *, CASE WHEN contains(file, '.') THEN list_extract(string_split(file, '.'), -1) ELSE '' END AS ext, file || ' ' || lower(alt) || ' ' || lower(url) AS body FROM f)
SELECT page_id, i, {BAD_SQL('url')} AS bad, CASE WHEN ext IN ('svg', 'gif', 'ico') THEN 'bad extension: ' || ext WHEN ext <> '' AND ext NOT IN ('jpg', 'jpeg', 'png', 'webp') THEN 'unsupported extension: ' || ext WHEN regexp_matches(body, '{_JUNK}') THEN 'junk/logo pattern'
 WHEN regexp_matches(file, '{_OLD}') OR regexp_matches(lower(alt), '{_OLD}') THEN 'historical/B&W (year token in filename/alt)' WHEN width > 0 AND width < 700 AND false THEN '' WHEN width > 0 AND width < 500 THEN 'too small: ' || width || 'px wide'
 WHEN source IN ('wikimedia', 'wikipedia') AND NOT contains(body, 'hall') THEN 'no school name match' END AS reason FROM g""".replace("WHEN width > 0 AND width < 700 AND false THEN '' ", ""))
def _(t):
    reason = AS.reject_reason("url", "alt", "width", "source", F.array(F.lit("hall")), F.lit(False))
    return t.candidates.select("page_id", "i", AS.is_bad_url("url").alias("bad"), reason.alias("reason"))


@query("blocklist_filter", "SELECT page_id, i, url FROM {candidates} WHERE url NOT IN (SELECT url FROM {candidates} WHERE height > 1000)")
def _(t):
    c = t.candidates
    return S.blocklist_filter(c, c.filter("height > 1000")).select("page_id", "i", "url")


@query("name_evidence_filter", f"""SELECT page_id, i, len({_KW}) = 0 OR len([w for w in {_KW} if contains(lower(url || ' ' || alt), w)]) > 0 AS any_word,
  len([w for w in {_KW} if NOT contains(translate(lower(url_decode(list_extract(string_split(url, '/'), -1))), '_-', '  '), w)]) = 0 AS all_words FROM {{candidates}}""")
def _(t):
    return t.candidates.select("page_id", "i", AS.mentions_name("entity", "url", "alt").alias("any_word"), AS.file_matches_name("entity", "url").alias("all_words"))


# results of swimmers: the line items as raw records with a verified and a declared time
role("raw_results", """
SELECT o_custkey AS swimmer_id, CASE WHEN l_linenumber = 6 THEN 'L' ELSE 'Y' END AS eventcourse, CASE WHEN l_tax = 0.08 THEN false WHEN l_tax = 0.07 THEN CAST(NULL AS BOOLEAN) ELSE true END AS legal,
  CASE l_partkey % 8 WHEN 0 THEN 50 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 400 WHEN 4 THEN 500 WHEN 5 THEN 1000 WHEN 6 THEN 1650 ELSE 75 END AS eventdistance, CAST(1 + l_suppkey % 6 AS STRING) AS eventstroke,
  CASE WHEN l_linenumber = 5 THEN CAST(NULL AS STRING) WHEN l_linenumber = 7 THEN 'NT' ELSE CAST(CAST(c AS DECIMAL(12,2)) AS STRING) END AS eventtime,
  CASE WHEN l_discount = 0.1 THEN CAST(NULL AS STRING) ELSE CAST(CAST(c - l_quantity / 20 AS DECIMAL(12,2)) AS STRING) END AS seedtime,
  CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'N' THEN ' f' ELSE '' END AS eventgender, l_orderkey * 100 + l_linenumber AS pos
FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 30000 / 100.0 AS c FROM {lineitem}) x JOIN {orders} ON l_orderkey = o_orderkey
""")


def event_code_sql() -> str:
    return """CASE WHEN eventstroke = '1' AND eventdistance IN (50, 100, 200, 500, 1000, 1650) THEN eventdistance || ' Free' WHEN eventstroke = '2' AND eventdistance IN (100, 200) THEN eventdistance || ' Back'
      WHEN eventstroke = '3' AND eventdistance IN (100, 200) THEN eventdistance || ' Breast' WHEN eventstroke = '4' AND eventdistance IN (100, 200) THEN eventdistance || ' Fly'
      WHEN eventstroke = '5' AND eventdistance IN (200, 400) THEN eventdistance || ' IM' END"""


LEGAL_SQL = f"legal_rows AS (SELECT *, {event_code_sql()} AS event FROM {{raw_results}} WHERE eventcourse = 'Y' AND coalesce(legal, true))"
_DROP = "CASE event " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in B.MAX_DROP.items()) + " END"


@query("seed_pr_filter", f"""WITH {LEGAL_SQL}, s AS (SELECT *, TRY_CAST(eventtime AS DOUBLE) AS verified_sec, TRY_CAST(seedtime AS DOUBLE) AS seed_sec FROM legal_rows WHERE event IS NOT NULL AND contains(seedtime, '.') AND list_extract(string_split(seedtime, '.'), -1) NOT IN ('00', '50'))
SELECT swimmer_id, event, verified_sec, seed_sec, {rnd('verified_sec - seed_sec', 2)} AS improvement FROM s WHERE verified_sec > 0 AND seed_sec > 0 AND seed_sec < verified_sec AND verified_sec - seed_sec >= 0.15::DOUBLE AND verified_sec - seed_sec <= {_DROP}""")
def _(t):
    return B.seed_pr_filter(t.raw_results).select("swimmer_id", "event", "verified_sec", "seed_sec", "improvement")


role("syncs", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'yesterday' ELSE replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' END AS last_sync FROM {events}
""")


@query("freshness_gate", "SELECT event_id, coalesce(TIMESTAMP '2024-01-20 00:00:00' - TRY_CAST(replace(last_sync, 'Z', '') AS TIMESTAMP) >= INTERVAL 48 HOUR, true) AS pass FROM {syncs}")
def _(t):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return t.syncs.select("event_id", B.freshness_gate("last_sync", now).alias("pass"))


# chosen pictures per school; slots may be empty or fallback
role("entries", """
SELECT c_custkey AS school, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE c_name END AS hero, CASE WHEN c_acctbal < 0 THEN CAST(NULL AS STRING) ELSE c_mktsegment END AS swim,
  c_nationkey % 6 = 2 AS hero_fallback FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
""")


@query("needs_refresh", "SELECT c_custkey AS school FROM customer LEFT JOIN {entries} e ON c_custkey = e.school WHERE coalesce(hero, '') = '' OR coalesce(swim, '') = '' OR coalesce(hero_fallback, false)")
def _(t):
    return C.needs_refresh(t.customer.select(F.col("c_custkey").alias("school")), t.entries, "school", ["hero", "swim"], ["hero_fallback"])


@query("under_quota", """SELECT s.school, c.category, coalesce(n, 0) AS n FROM (SELECT DISTINCT n_nationkey AS school FROM nation) s CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) c(category)
LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) x ON s.school = x.c_nationkey AND c.category = x.c_mktsegment WHERE coalesce(n, 0) < 16""")
def _(t):
    rows = t.customer.select(F.col("c_nationkey").alias("school"), F.col("c_mktsegment").alias("category"))
    schools = t.nation.select(F.col("n_nationkey").alias("school"))
    return C.under_quota(schools, rows, "school", "category", ["BUILDING", "MACHINERY", "NONE"])


role("sheet_text", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' 1:02.33 NT NT ns' WHEN 1 THEN 'Psych Sheet ' || text WHEN 2 THEN text || ' NT 58.20 1:00.10 2:01.11' ELSE text END AS t FROM {documents}
""")


@query("is_document_type", """SELECT doc_id, regexp_matches(low, 'psych sheet|heat sheet|time trial') OR (m > 0 AND n > 0 AND m > n * 0.5) AS is_entry FROM (
  SELECT doc_id, low, len(regexp_extract_all(low, '\\b(nt|ns)\\b')) AS m, len(regexp_extract_all(low, '[0-9]:[0-9][0-9]\\.[0-9][0-9]|\\b[0-9][0-9]\\.[0-9][0-9]\\b')) AS n FROM (SELECT doc_id, lower(t) AS low FROM {sheet_text}) x) y""")
def _(t):
    return t.sheet_text.select("doc_id", EV.looks_like_entry_sheet("t").alias("is_entry"))


@query("group_filter", "SELECT k, file_name FROM {file_text} WHERE contains(lower(file_name), 'nescac') OR contains(lower(file_name), 'ivy')")
def _(t):
    return group_filter(t.file_text, ["nescac", "Ivy"], "file_name").select("k", "file_name")


