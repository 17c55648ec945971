"""Projections: time and number parsing, names, labels, formulas, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import admission as AD, assets as AS, events as EV, intent as IN, names as N, numeric as NU, scoring as SC, text as TX, times as TI
from ..operators.robust import family_bounds
from .base import query, rnd, role

# ---- times and numbers -----------------------------------------------------------------------------------

_P1 = """SELECT k, CASE WHEN instr(s, ':') > 0 THEN TRY_CAST(split_part(s, ':', 1) AS {m}) * 60 + TRY_CAST({tail} AS DOUBLE)
  ELSE TRY_CAST(s AS DOUBLE) END AS sec FROM (SELECT k, trim(t) AS s FROM {{time_text}}) x"""
_AFTER = "substr(s, instr(s, ':') + 1)"


@query("parse_time", _P1.format(m="DOUBLE", tail=_AFTER))
def _(t):
    return t.time_text.select("k", TI.parse_time("t").alias("sec"))


@query("parse_time_int_minutes", _P1.format(m="INT", tail=_AFTER))
def _(t):
    return t.time_text.select("k", TI.parse_time("t", minutes="int").alias("sec"))


@query("parse_time_first_parts", _P1.format(m="DOUBLE", tail="split_part(s, ':', 2)"))
def _(t):
    return t.time_text.select("k", TI.parse_time("t", extra_parts="ignore").alias("sec"))


_HMS = """SELECT k, CASE WHEN u IN ('DQ', 'NS', 'NT', 'SCR', 'X', '---', '--', '') THEN NULL WHEN len(p) = 1 THEN TRY_CAST(p[1] AS DOUBLE)
  WHEN len(p) = 2 THEN TRY_CAST(p[1] AS BIGINT) * 60 + TRY_CAST(p[2] AS DOUBLE)
  WHEN len(p) = 3 THEN TRY_CAST(p[1] AS BIGINT) * 3600 + TRY_CAST(p[2] AS BIGINT) * 60 + TRY_CAST(p[3] AS DOUBLE) END AS sec
FROM (SELECT k, upper(trim(t)) AS u, string_split(regexp_replace(upper(trim(t)), '[^0-9:.]', '', 'g'), ':') AS p FROM {time_text}) x"""


@query("parse_time_hms", _HMS)
def _(t):
    return t.time_text.select("k", TI.parse_time_hms("t").alias("sec"))


# seconds with two decimals, up to several hours
role("seconds", "SELECT o_orderkey AS k, CAST(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 2000000 AS DOUBLE) / 100 AS sec FROM {orders}")
_CENTS = "CAST(floor(sec * 100 + 0.5) AS BIGINT)"
_PAD = "lpad(CAST({0} AS VARCHAR), 2, '0')"


@query("format_time", f"""SELECT k, CASE WHEN sec < 60 THEN CAST(c // 100 AS VARCHAR) || '.' || {_PAD.format('c % 100')}
  WHEN c < 360000 THEN CAST(c // 6000 AS VARCHAR) || ':' || {_PAD.format('(c // 100) % 60')} || '.' || {_PAD.format('c % 100')}
  ELSE CAST(c // 360000 AS VARCHAR) || ':' || {_PAD.format('(c // 6000) % 60')} || ':' || {_PAD.format('(c // 100) % 60')} || '.' || {_PAD.format('c % 100')} END AS text
FROM (SELECT k, sec, {_CENTS} AS c FROM {{seconds}}) x""")
def _(t):
    return t.seconds.select("k", TI.format_time("sec").alias("text"))


@query("format_time_rounded", f"""SELECT k, CASE WHEN c < 6000 THEN CAST(c // 100 AS VARCHAR) || '.' || {_PAD.format('c % 100')}
  ELSE CAST(c // 6000 AS VARCHAR) || ':' || {_PAD.format('(c // 100) % 60')} || '.' || {_PAD.format('c % 100')} END AS text
FROM (SELECT k, {_CENTS} AS c FROM {{seconds}}) x""")
def _(t):
    return t.seconds.select("k", TI.format_time_rounded("sec").alias("text"))


role("number_text", """
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN CAST(w AS STRING) || ',' || lpad(CAST(f AS STRING), 3, '0')
  WHEN 1 THEN CAST(w AS STRING) || '. ' || CAST(f AS STRING) WHEN 2 THEN 'n/a' WHEN 3 THEN ' ' || CAST(w AS STRING) || ' '
  ELSE CAST(w AS STRING) || 'x' END AS t
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS w, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS f FROM {orders}) x
""")


@query("safe_number", "SELECT k, TRY_CAST(regexp_replace(t, '[,\\s]', '', 'g') AS DOUBLE) AS num FROM {number_text}")
def _(t):
    return t.number_text.select("k", NU.safe_number("t").alias("num"))


_SUFFIX = "^((?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}\\.[0-9]{2}|[0-9]{1,3}\\.[0-9]{2})([ \\t]*[*!@#A-Za-z()\\[\\]][^\\n]*)?$"


@query("split_time_suffix", f"""SELECT k, CASE WHEN regexp_matches(s, '{_SUFFIX}') THEN regexp_extract(s, '{_SUFFIX}', 1) ELSE s END AS num,
  trim(regexp_extract(s, '{_SUFFIX}', 2)) AS suffix FROM (SELECT k, trim(t) AS s FROM {{time_text}}) x""")
def _(t):
    return t.time_text.select("k", TI.time_numeric("t").alias("num"), TI.time_suffix("t").alias("suffix"))


@query("is_placeholder_time", """SELECT k, NOT contains(s, '.') OR list_extract(string_split(s, '.'), -1) IN ('00', '50') AS placeholder
FROM (SELECT k, trim(t) AS s FROM {time_text}) x""")
def _(t):
    return t.time_text.select("k", TI.is_placeholder_time("t").alias("placeholder"))


# ---- names -----------------------------------------------------------------------------------------------

# names in many spellings, built from the part names
role("name_text", """
SELECT p_partkey AS k, p_name AS plain, CASE p_partkey % 9
  WHEN 0 THEN 'University of ' || p_name WHEN 1 THEN p_name || ', University of' WHEN 2 THEN p_name || ', University of, ' || p_type
  WHEN 3 THEN p_name || ' ' || p_name WHEN 4 THEN 'St. ' || p_name || '''s  Coll & ' || p_type WHEN 5 THEN p_name || ' Univ'
  WHEN 6 THEN upper(p_name) || '-' || p_brand WHEN 7 THEN '  The ' || p_name || ' Institute (MA)' ELSE p_name || ' ' || p_type || ' ' || p_name END AS t,
  CASE p_partkey % 6 WHEN 0 THEN 'Santa Barbara, CA' WHEN 1 THEN 'Boston, MA' WHEN 2 THEN 'Paris' WHEN 3 THEN 'St. Paul, mn' WHEN 4 THEN 'X, Y, TX' ELSE '' END AS location
FROM {part}
""")


@query("norm_key", "SELECT k, regexp_replace(lower(trim(t)), '[^a-z0-9]', '', 'g') AS key FROM {name_text}")
def _(t):
    return t.name_text.select("k", N.norm_key("t").alias("key"))


@query("norm_ws", "SELECT k, lower(regexp_replace(trim(t), '\\s+', ' ', 'g')) AS key FROM {name_text}")
def _(t):
    return t.name_text.select("k", N.norm_ws("t").alias("key"))


def qnorm_sql(c: str) -> str:
    s = f"regexp_replace(replace(lower(trim({c})), '&', ' and '), '[''’`.-]', '', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9 ]', ' ', 'g')"
    for short, full in (("st", "saint"), ("univ", "university"), ("coll", "college")):
        s = f"regexp_replace({s}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


@query("norm_query", f"SELECT k, {qnorm_sql('t')} AS q FROM {{name_text}}")
def _(t):
    return t.name_text.select("k", N.norm_query("t").alias("q"))


NNAME_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"


def stop_sql(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("norm_name", f"SELECT k, {NNAME_SQL.format('t')} AS n FROM {{name_text}}")
def _(t):
    return t.name_text.select("k", N.norm_name("t").alias("n"))


@query("name_tokens", f"""SELECT k, array_to_string(list_sort(list_distinct(list_filter(string_split({NNAME_SQL.format('t')}, ' '),
  lambda x: len(x) > 1 AND x NOT IN {stop_sql(N.NAME_STOP)}))), ',') AS toks FROM {{name_text}}""")
def _(t):
    return t.name_text.select("k", F.array_join(F.array_sort(N.name_tokens("t")), ",").alias("toks"))


_INV = "^(.+?),\\s*University\\s+of(?:,\\s*(.+))?$"


@query("uninvert_name", f"""SELECT k, CASE WHEN regexp_matches(t, '{_INV}', 'i') THEN 'University of ' || trim(regexp_extract(t, '{_INV}', 1, 'i'))
  || CASE WHEN trim(regexp_extract(t, '{_INV}', 2, 'i')) <> '' THEN ' ' || trim(regexp_extract(t, '{_INV}', 2, 'i')) ELSE '' END ELSE t END AS n FROM {{name_text}}""")
def _(t):
    return t.name_text.select("k", N.uninvert_name("t").alias("n"))


@query("key_words", f"""SELECT k, array_to_string(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(trim(t), '\\s+'),
  lambda w: trim(w, '.,;:''"()[]')), lambda w: len(w) > 1), lambda w: lower(w)), lambda w: w NOT IN {stop_sql(N.KEY_STOP)}), ',') AS words FROM {{name_text}}""")
def _(t):
    return t.name_text.select("k", F.array_join(N.key_words("t"), ",").alias("words"))


@query("undouble_name", """WITH w AS (SELECT k, t, regexp_split_to_array(trim(t), '\\s+') AS p FROM {name_text}),
h AS (SELECT k, t, p, len(p) AS n, list_filter(range(1, len(p) // 2 + 1), lambda h: len(p) % h = 0 AND p[1:h] = p[len(p) - h + 1:len(p)])[1] AS a,
  list_filter(list_reverse(range(1, len(p) // 2 + 1)), lambda h: p[1:h] = p[h + 1:2 * h])[1] AS b FROM w)
SELECT k, CASE WHEN n < 2 THEN t WHEN a IS NOT NULL THEN array_to_string(p[1:n - a], ' ') WHEN b IS NOT NULL THEN array_to_string(p[1:b], ' ') ELSE t END AS name FROM h""")
def _(t):
    return t.name_text.select("k", N.undouble_name("t").alias("name"))


# event headers as text: every pairing of label, distance and stroke
role("header_text", """
SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Men ' WHEN 1 THEN 'Women''s ' WHEN 2 THEN 'Event ' || CAST(p_size AS STRING) || ' Mens ' WHEN 3 THEN '' ELSE 'Womens ' END
  || CASE (p_partkey * 7) % 8 WHEN 0 THEN '50' WHEN 1 THEN '100' WHEN 2 THEN '200' WHEN 3 THEN '400' WHEN 4 THEN '500' WHEN 5 THEN '1000' WHEN 6 THEN '1650' ELSE '75' END
  || CASE p_partkey % 3 WHEN 0 THEN ' Yard ' ELSE ' ' END
  || CASE (p_partkey * 11) % 7 WHEN 0 THEN 'Freestyle' WHEN 1 THEN 'Back' WHEN 2 THEN 'BREASTSTROKE' WHEN 3 THEN 'fly' WHEN 4 THEN 'Individual Medley' WHEN 5 THEN 'Free Relay' ELSE 'Diving' END
  || CASE (p_partkey * 13) % 6 WHEN 0 THEN ' - B Final' WHEN 1 THEN ' - Championship Final' WHEN 2 THEN ' C - Final' WHEN 3 THEN ' Consolation Final' WHEN 4 THEN ' Finals' ELSE '' END AS t
FROM {part}
""")
_STROKE_SQL = """CASE WHEN regexp_matches(low, 'freestyle|(^|\\W)free(\\W|$)') THEN 'Free' WHEN regexp_matches(low, 'backstroke|(^|\\W)back(\\W|$)') THEN 'Back'
  WHEN regexp_matches(low, 'breaststroke|(^|\\W)breast(\\W|$)') THEN 'Breast' WHEN regexp_matches(low, 'butterfly|(^|\\W)fly(\\W|$)') THEN 'Fly'
  WHEN regexp_matches(low, 'individual\\s+medley|\\bim\\b') THEN 'IM' END"""
_EVENT_LIST = stop_sql(EV.TARGET_EVENTS)


@query("norm_event", f"""WITH a AS (SELECT k, lower(t) AS low FROM {{header_text}}),
b AS (SELECT k, low, {_STROKE_SQL} AS stroke, list_filter(regexp_extract_all(low, '\\b([0-9]+)\\b', 1), lambda x: x IN ('50','100','200','400','500','1000','1650'))[-1] AS dist FROM a),
c AS (SELECT k, low, CASE WHEN NOT regexp_matches(low, '\\brelay\\b|\\bdiv(ing|e)?\\b') AND dist || ' ' || stroke IN {_EVENT_LIST} THEN dist || ' ' || stroke END AS event FROM b)
SELECT k, event, CASE WHEN event IS NULL THEN 'none' WHEN regexp_matches(low, '\\bwomen') THEN 'women' WHEN regexp_matches(low, '\\bmen') THEN 'men' ELSE 'either' END AS gender FROM c""")
def _(t):
    return t.header_text.select("k", EV.norm_event("t").alias("e")).select("k", "e.event", "e.gender")


role("file_text", """
SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'NESCAC' WHEN 1 THEN 'liberty_league' WHEN 2 THEN 'Big-12' WHEN 3 THEN 'IvyLeague' WHEN 4 THEN 'unknown'
    WHEN 5 THEN 'acc' WHEN 6 THEN 'horizon' WHEN 7 THEN 'uaa' ELSE 'pcsc' END
  || CASE (o_orderkey * 3) % 4 WHEN 0 THEN '_Women' WHEN 1 THEN '_mens' WHEN 2 THEN '_combined' ELSE '' END
  || CASE (o_orderkey * 5) % 7 WHEN 0 THEN '_Day_3' WHEN 1 THEN '_d2' WHEN 2 THEN '_saturday' WHEN 3 THEN '_day4' ELSE '' END
  || CASE (o_orderkey * 7) % 5 WHEN 0 THEN '_prelims' WHEN 1 THEN '_finals' WHEN 2 THEN '_results' WHEN 3 THEN '_team_scores' ELSE '' END
  || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '_20' || CAST(10 + o_orderkey % 17 AS STRING) END || CASE WHEN o_orderkey % 13 = 0 THEN '.pdf.pdf' ELSE '.pdf' END AS file_name
FROM {orders}
""")


def _category_sql(text: str) -> str:
    whens = []
    for key, label in [*TX.CONFERENCE_MAP, *TX.CONFERENCE_BUILTIN]:
        pat = f"(^|[^a-z0-9]){key}([^a-z0-9]|$)"
        whens.append(f"WHEN regexp_matches({text}, '{pat}') OR regexp_matches(regexp_replace({text}, '[_\\-\\s]', '', 'g'), '{pat}') THEN '{label}'")
    return "CASE " + " ".join(whens) + " ELSE 'Unknown' END"


@query("first_match_category", f"SELECT k, {_category_sql('lower(file_name)')} AS conference FROM {{file_text}}")
def _(t):
    return t.file_text.select("k", TX.detect_conference("file_name").alias("conference"))


def division_sql(c: str) -> str:
    return f"""CASE WHEN {c} IN ('ACC', 'ASUN', 'America East', 'Atlantic 10', 'Big 12', 'Big East', 'Big Ten', 'Big West', 'CAA', 'Horizon League', 'Ivy League',
      'MAAC', 'MPSF', 'Patriot', 'SEC', 'Summit League', 'WAC') THEN 'D1' WHEN {c} IN ('GLIAC', 'PSAC', 'SAC') THEN 'D2' WHEN {c} = 'PCSC' THEN 'NAIA' ELSE 'D3' END"""


@query("map_with_default", f"SELECT k, conference, {division_sql('conference')} AS division FROM (SELECT k, {_category_sql('lower(file_name)')} AS conference FROM {{file_text}}) x")
def _(t):
    d = t.file_text.select("k", TX.detect_conference("file_name").alias("conference"))
    return d.withColumn("division", TX.division_of("conference"))


_STATE_CASE = "CASE upper(trim(list_extract(string_split(location, ','), -1))) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.STATES.items()) + " ELSE '' END"
_STATE_SQL = f"CASE WHEN contains(location, ',') THEN {_STATE_CASE} ELSE '' END"


@query("city_state", f"""SELECT k, trim(split_part(location, ',', 1)) AS city, CASE WHEN contains(location, ', ') THEN trim(list_extract(string_split(location, ', '), -1)) ELSE '' END AS state,
  {_STATE_SQL} AS state_name FROM {{name_text}}""")
def _(t):
    return t.name_text.select("k", N.city("location").alias("city"), N.state_code("location").alias("state"),
                              N.state_name("location").alias("state_name"))


@query("search_surface", f"""SELECT k, concat_ws(' ', {qnorm_sql('t')}, CASE WHEN location <> '' THEN {qnorm_sql("regexp_replace(location, '[,.]', ' ', 'g')")} END,
  CASE WHEN sn <> '' THEN {qnorm_sql('sn')} END) AS surface FROM (SELECT *, {_STATE_SQL} AS sn FROM {{name_text}}) x""")
def _(t):
    return t.name_text.select("k", N.search_surface("t", "location").alias("surface"))


# document text with glyph codes put in for two letters
role("glyph_text", """
SELECT doc_id AS k, replace(replace(replace(text, 'ff', '(cid:980)'), 'f', '(cid:976)'), 'q', '(cid:123)') AS t FROM {documents}
""")


@query("fix_ligatures", """SELECT k, md5(regexp_replace(replace(replace(t, '(cid:976)', 'f'), '(cid:980)', 'ff'), '\\(cid:[0-9]+\\)', '', 'g')) AS h FROM {glyph_text}""")
def _(t):
    return t.glyph_text.select("k", F.md5(TX.fix_ligatures("t")).alias("h"))


role("narrated", """
SELECT conv_id AS k, turn, CASE WHEN turn % 3 = 0 THEN '  Let me search for it.' || chr(10) || text || chr(10) || 'I''ve found more' ELSE text END AS t FROM {conversations}
""")


@query("strip_narration", f"""SELECT k, turn, trim(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT ({' OR '.join("starts_with(lower(trim(x)), '" + p.replace("'", "''") + "')" for p in TX.NARRATION)})), chr(10)), ' ' || chr(10) || chr(9)) AS clean FROM {{narrated}}""")
def _(t):
    return t.narrated.select("k", "turn", TX.strip_narration("t").alias("clean"))


# conversations as sectioned text: the role becomes a heading
role("sectioned", """
SELECT conv_id AS k, turn, '## ' || CASE turn % 5 WHEN 0 THEN 'Bottom Line' WHEN 1 THEN 'Academic Program' WHEN 2 THEN 'Outcomes' WHEN 3 THEN 'Minor in Art' ELSE 'Notes' END
  || chr(10) || text || chr(10) || '## ' || upper(role) || chr(10) || '## Campus Life' || chr(10) || 'x ' || CAST(turn AS STRING) AS t
FROM {conversations}
""")


@query("split_on_heading", """SELECT k, turn, CASE WHEN i > 0 THEN trim(substr(t, 1, i - 1), ' ' || chr(10) || chr(9)) ELSE trim(t, ' ' || chr(10) || chr(9)) END AS before, CASE WHEN i > 0 THEN trim(substr(t, i), ' ' || chr(10) || chr(9)) ELSE '' END AS after
FROM (SELECT *, instr(t, '## Campus') AS i FROM {sectioned}) x""")
def _(t):
    s = TX.split_on_heading("t", F.lit("## Campus"))
    return t.sectioned.select("k", "turn", s["before"].alias("before"), s["after"].alias("after"))


def _section_sql(c: str) -> str:
    return f"""CASE WHEN contains({c}, 'bottom line') THEN 'bottom_line' WHEN contains({c}, 'in the pool') THEN 'in_the_pool' WHEN contains({c}, 'coach interest') THEN 'coach_interest'
      WHEN contains({c}, 'is known for') THEN 'known_for' WHEN {c} = 'academic program' THEN 'academic_program' WHEN contains({c}, 'are you admissible') THEN 'are_you_admissible'
      WHEN contains({c}, 'what it costs') THEN 'what_it_costs' WHEN {c} = 'campus life' THEN 'campus_life' WHEN {c} = 'outcomes' THEN 'outcomes'
      WHEN contains({c}, 'how it compares') THEN 'how_it_compares' WHEN contains({c}, 'more: going deeper') OR contains({c}, 'more: academic') THEN 'more_going_deeper'
      WHEN contains({c}, 'more: student experience') OR contains({c}, 'life outside the pool') THEN 'more_student_experience' WHEN contains({c}, 'more: career paths') THEN 'more_career_paths'
      WHEN contains({c}, 'minor') THEN 'minor' ELSE 'unknown' END"""


@query("split_sections", f"""WITH p AS (SELECT k, turn, unnest(range(0, len(a))) AS position, a FROM (SELECT k, turn, string_split(chr(10) || t, chr(10) || '## ') AS a FROM {{sectioned}}) x),
q AS (SELECT k, turn, CAST(position AS INTEGER) AS position, trim(a[position + 1], ' ' || chr(10)) AS part FROM p),
r AS (SELECT k, turn, position, trim(split_part(part, chr(10), 1)) AS title, CASE WHEN contains(part, chr(10)) THEN trim(substr(part, instr(part, chr(10)) + 1), ' ' || chr(10)) ELSE '' END AS body FROM q WHERE part <> '')
SELECT *, CASE WHEN slug IN ('bottom_line', 'academic_program', 'outcomes', 'more_student_experience', 'more_career_paths', 'minor') THEN slug WHEN slug = 'campus_life' THEN 'student_experience'
  WHEN slug = 'more_going_deeper' THEN 'more_academic' ELSE 'content' END AS type
FROM (SELECT k, turn, position, title, md5(body) AS body, {_section_sql('lower(title)')} AS slug FROM r) x""")
def _(t):
    return TX.split_sections(t.sectioned, "t").select("k", "turn", "position", "title", F.md5("body").alias("body"), "slug", "type")


role("json_text", """
SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN 'Here: ```json' || chr(10) || props || '```' WHEN 1 THEN props WHEN 2 THEN 'no object' ELSE 'x ' || chr(123) || 'broken ' || props END AS t FROM {events}
""")


@query("json_in_text", """SELECT k, CASE WHEN k % 4 IN (0, 1) THEN CAST(json_extract_string(regexp_extract(t, '\\{.*\\}'), '$.k') AS BIGINT) END AS value, contains(t, '{') AS has_object, CASE WHEN k % 4 = 3 THEN regexp_extract(t, '\\{.*\\}') END AS reject FROM {json_text}""")
def _(t):
    got = TX.json_or_reject("t", "k bigint")
    return t.json_text.select("k", got["value"]["k"].alias("value"), F.contains("t", F.lit("{")).alias("has_object"), got["reject"].alias("reject"))


# image candidates from the pages: one srcset, one lazy image and one plain image per page
role("srcsets", """
SELECT page_id AS k, url, CASE page_id % 4 WHEN 0 THEN 'a' || CAST(page_id AS STRING) || '.jpg 300w, b.jpg ' || CAST(500 + page_id % 900 AS STRING) || 'w, c.jpg 640w'
  WHEN 1 THEN 'x.jpg 1x, y.jpg 2x' WHEN 2 THEN 'only.jpg' ELSE 'm.jpg 10w, n.jpg 10w' END AS srcset FROM {pages}
""")


@query("best_srcset", """WITH e AS (SELECT k, unnest(string_split(srcset, ',')) AS p, generate_subscripts(string_split(srcset, ','), 1) AS i FROM {srcsets}),
f AS (SELECT k, i, split_part(trim(p), ' ', 1) AS u, split_part(trim(p), ' ', 2) AS d FROM e),
g AS (SELECT k, i, u, d, CASE WHEN regexp_matches(d, '^[0-9]+w$') THEN CAST(regexp_replace(d, 'w$', '') AS INTEGER) END AS w FROM f),
h AS (SELECT k, arg_min(u, i) FILTER (w IS NOT NULL AND w = m) AS widest, max(w) AS w, arg_min(u, i) FILTER (d = '') AS bare FROM (SELECT *, max(w) OVER (PARTITION BY k) AS m FROM g) x GROUP BY k)
SELECT s.k, coalesce(h.widest, h.bare) AS best, coalesce(h.w, CASE WHEN h.bare IS NOT NULL THEN 0 END) AS width FROM {srcsets} s JOIN h ON s.k = h.k""")
def _(t):
    b = AS.best_srcset("srcset")
    return t.srcsets.select("k", b["url"].alias("best"), b["w"].alias("width"))


# ---- formulas --------------------------------------------------------------------------------------------

role("bands", """
SELECT l_orderkey AS k, l_linenumber AS ln, l_extendedprice AS sec, l_quantity * 400 AS first, l_quantity * 400 + 8000 * (l_linenumber % 3) AS eighth,
  l_quantity * 400 + 8000 * (l_linenumber % 3) + 20000 AS sixteenth, CASE l_linenumber WHEN 4 THEN 0.0 WHEN 5 THEN NULL ELSE l_quantity * 20 END AS step
FROM {lineitem}
""")


def place_sql(sec="sec", a="first", b="eighth", c="sixteenth", s="step") -> str:
    w = lambda x, y: f"coalesce(nullif({x} - {y}, 0), 1)"
    return (f"CASE WHEN {sec} <= {a} THEN 1.0::DOUBLE WHEN {sec} <= {b} THEN 1.0 + ({sec} - {a}) / {w(b, a)} * 7 "
            f"WHEN {sec} <= {c} THEN 8.0 + ({sec} - {b}) / {w(c, b)} * 8 ELSE 16.0 + ({sec} - {c}) / coalesce(nullif({s}, 0), 1) END")


EXP_SQL = "greatest(0.0::DOUBLE, least(20.0::DOUBLE, 21.0 - p))"
CONF_SQL = "CASE WHEN p <= 12 THEN 1.0::DOUBLE WHEN p <= 14 THEN 0.85::DOUBLE WHEN p <= 16 THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END"
_BANDS_P = f"(SELECT k, ln, {place_sql()} AS p FROM {{bands}}) x"


@query("estimate_place", f"SELECT k, ln, {rnd('p', 6)} AS place FROM {_BANDS_P}")
def _(t):
    return t.bands.select("k", "ln", NU.round_to(_place(), 6).alias("place"))


def _place():
    return SC.estimate_place("sec", "first", "eighth", "sixteenth", "step")


@query("exp_points", f"SELECT k, ln, {rnd(EXP_SQL, 6)} AS pts FROM {_BANDS_P}")
def _(t):
    return t.bands.select("k", "ln", NU.round_to(SC.exp_points(_place()), 6).alias("pts"))


@query("confidence_weight", f"SELECT k, ln, {CONF_SQL} AS w FROM {_BANDS_P}")
def _(t):
    return t.bands.withColumn("p", _place()).select("k", "ln", SC.confidence_weight("p").alias("w"))


def ladder_sql(c, steps, last, op) -> str:
    return "CASE " + " ".join(f"WHEN {c} {op} {lim} THEN '{lab}'" for lim, lab in steps) + f" ELSE '{last}' END"


TIER_SQL = lambda c: ladder_sql(c, SC.TIER_STEPS, "High-Point Contender", "<")


@query("place_label", f"SELECT k, ln, {ladder_sql('p', SC.PLACE_STEPS, 'Out of range', '<=')} AS label FROM {_BANDS_P}")
def _(t):
    return t.bands.withColumn("p", _place()).select("k", "ln", SC.place_label("p").alias("label"))


@query("tier_label", f"SELECT o_orderkey AS k, {TIER_SQL('o_totalprice / 8000')} AS label FROM orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), SC.tier_label(F.col("o_totalprice") / 8000).alias("label"))


@query("a_tier_label", f"SELECT event_id AS k, {ladder_sql('(value / 20 - 1)', SC.STANDARD_STEPS, 'AAAA+', '<')} AS label FROM events")
def _(t):
    return t.events.select(F.col("event_id").alias("k"), SC.a_tier_label(F.col("value") / 20 - 1).alias("label"))


@query("program_strength", "SELECT id, CASE tier WHEN '1A' THEN 'Super Powerhouse' WHEN '1B' THEN 'Powerhouse' WHEN '2' THEN 'Strong' WHEN '3' THEN 'Mid-pack' WHEN '4' THEN 'Developing' ELSE adj_tier END AS label FROM (SELECT *, CASE id % 6 WHEN 0 THEN '1A' WHEN 1 THEN '1B' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE '' END AS tier FROM {applicants}) x")
def _(t):
    tier = F.element_at(F.array(*[F.lit(v) for v in ("1A", "1B", "2", "3", "4", "")]), (F.col("id") % 6 + 1).cast("int"))
    return t.applicants.select("id", SC.strength_label(tier, "adj_tier").alias("label"))


_D5 = "(first + 4.0::DOUBLE / 7.0 * (eighth - first))"
_D14 = "(eighth + 6.0::DOUBLE / 8.0 * (sixteenth - eighth))"


@query("estimate_place_5_14", f"""SELECT k, ln, {rnd('p', 6)} AS place, CASE WHEN p <= 14 THEN 1.0::DOUBLE WHEN p <= 16 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS w FROM (
  SELECT k, ln, CASE WHEN sec <= first THEN 1.0::DOUBLE WHEN sec <= f THEN 1.0 + (sec - first) / greatest(f - first, 0.001) * 4.0 WHEN sec <= n THEN 5.0 + (sec - f) / greatest(n - f, 0.001) * 9.0
    ELSE 14.0 + (sec - n) / greatest((n - f) / 9.0, 0.001) END AS p FROM (SELECT *, {_D5} AS f, {_D14} AS n FROM {{bands}}) y) x""")
def _(t):
    p = SC.estimate_place_5_14("sec", "first", SC.derived_fifth("first", "eighth"), SC.derived_fourteenth("eighth", "sixteenth"))
    return t.bands.withColumn("p", p).select("k", "ln", NU.round_to("p", 6).alias("place"), SC.confidence_5_14("p").alias("w"))


# five standards per event type and a time to score
role("standards_wide", """
SELECT event_id AS k, user_id, event_type AS event, value AS sec, CAST(200 + length(event_type) AS DOUBLE) AS b, CAST(120 + length(event_type) AS DOUBLE) AS a,
  CAST(70 AS DOUBLE) AS aa, CAST(40 AS DOUBLE) AS aaa, CAST(20 AS DOUBLE) AS aaaa FROM {events}
""")


def a_score_sql(clamped: bool) -> str:
    below = "greatest(-1.0::DOUBLE, (b - sec) / (b - a))" if clamped else "-(sec - b) / (b - a)"
    mid = " ".join(f"WHEN {hi} <= sec AND sec <= {lo} THEN {i}.0 + ({lo} - sec) / ({lo} - {hi})" for i, (lo, hi) in enumerate(
        [("b", "a"), ("a", "aa"), ("aa", "aaa"), ("aaa", "aaaa")]))
    return f"CASE WHEN sec <= aaaa THEN 4.0 + (aaaa - sec) / (aaa - aaaa) WHEN sec >= b THEN {below} {mid} END"


@query("a_score", f"SELECT k, {rnd(a_score_sql(False), 3)} AS score FROM {{standards_wide}}")
def _(t):
    return t.standards_wide.select("k", NU.round_to(SC.a_score("sec", "b", "a", "aa", "aaa", "aaaa"), 3).alias("score"))


@query("a_score_clamped", f"SELECT k, {rnd(a_score_sql(True), 2)} AS score FROM {{standards_wide}}")
def _(t):
    return t.standards_wide.select("k", NU.round_to(SC.a_score_clamped("sec", "b", "a", "aa", "aaa", "aaaa"), 2).alias("score"))


def selectivity_sql(acc="accept", sat="sat_median") -> str:
    return "CASE " + " ".join(f"WHEN coalesce({acc} / 100.0 <= {a}, false) OR coalesce({sat} >= {s}, false) THEN '{n}'" for n, a, s in AD.SELECTIVITY) + " ELSE 'broader_admit' END"


@query("selectivity_tier", f"SELECT id, {selectivity_sql()} AS tier FROM {{applicants}}")
def _(t):
    return t.applicants.select("id", AD.selectivity_tier("accept", "sat_median").alias("tier"))


def admission_sql(src: str, keep: str) -> str:
    """Reference decision over a relation with the applicant columns; `keep` names the columns to carry."""
    # 5 is the best label; rows are academic bands 4 to 0, columns swim bands 4 to 0
    rank = "list_extract(list_extract([[5, 4, 4, 3, 2], [4, 4, 3, 2, 2], [4, 3, 2, 2, 1], [3, 2, 2, 1, 0], [1, 1, 0, 0, 0]], 5 - acad), 5 - swim)"
    labels = """CASE r6 WHEN 5 THEN 'Very Strong Chance' WHEN 4 THEN 'Strong Chance' WHEN 3 THEN 'Realistic Shot' WHEN 2 THEN 'Possible' WHEN 1 THEN 'Major Reach' WHEN 0 THEN 'Moonshot' END"""
    bands = "CASE adj_tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in AD.SWIM_BANDS.items()) + " ELSE 0 END"
    colors = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AD.LABEL_COLORS.items()) + " ELSE '#94A3B8' END"
    return f"""
 a1 AS (SELECT *, CASE WHEN sat >= 400 THEN sat END AS s, CASE WHEN gpa > 0 THEN gpa END AS g, coalesce(nullif(sat25, 0), sat_median - 60) AS lo, coalesce(nullif(sat75, 0), sat_median + 60) AS hi,
   {selectivity_sql()} AS sel FROM {src}),
 a2 AS (SELECT *, greatest(800, lo - CASE sel WHEN 'ultra_selective' THEN 60 WHEN 'highly_selective' THEN 80 WHEN 'selective' THEN 100 ELSE 120 END) AS flo0, coalesce(g < 2.0, false) AS gpa_low FROM a1),
 a3 AS (SELECT *, coalesce(s < CASE WHEN lo IS NOT NULL THEN flo0 END, false) AND (gpa_low OR hi IS NOT NULL) AS sat_low, coalesce(s - sat_median <= -120, false) OR coalesce(g < 3.4, false) AS weak, coalesce(hidden_ivy, false) AS elite,
   greatest(0, least(4, {bands} + CASE WHEN psf > 1.0 THEN 1 WHEN psf <= 0.78 THEN -1 ELSE 0 END)) AS sw0 FROM a2),
 a4 AS (SELECT *, CASE WHEN s IS NULL OR lo IS NULL OR hi IS NULL THEN 0 WHEN s > hi THEN 2 WHEN s >= lo THEN 1 WHEN NOT sat_low THEN 0 ELSE -2 END
   + CASE WHEN coalesce(g > gpa_mean + 0.10, false) THEN 1 WHEN coalesce(g < gpa_mean - 0.15, false) THEN -1 ELSE 0 END AS raw, CASE WHEN weak THEN 0 WHEN elite THEN least(sw0, 2) ELSE sw0 END AS swim FROM a3),
 a5 AS (SELECT *, CASE WHEN gpa_low THEN 0 WHEN raw = 4 THEN 4 WHEN raw >= 2 THEN 3 WHEN raw >= 0 THEN 2 WHEN raw >= -2 THEN 1 ELSE 0 END AS acad FROM a4),
 a6 AS (SELECT *, {rank} AS r1 FROM a5),
 a7 AS (SELECT *, CASE WHEN sat_low AND gpa_low THEN 0 WHEN gpa_low THEN CASE WHEN swim = 4 THEN 1 ELSE 0 END WHEN sat_low AND acad = 0 THEN least(r1, 1) ELSE r1 END AS r2 FROM a6),
 a8 AS (SELECT *, CASE WHEN sel IN ('highly_selective', 'ultra_selective') AND coalesce(g < 3.5, false) THEN 0 ELSE r2 END AS r3 FROM a7),
 a9 AS (SELECT *, CASE WHEN swim = 0 THEN CASE WHEN acad >= 3 AND NOT elite AND NOT weak THEN 4 ELSE least(r3, 2) END ELSE r3 END AS r4 FROM a8),
 a10 AS (SELECT *, CASE WHEN sel = 'ultra_selective' THEN CASE WHEN acad = 0 OR swim = 0 THEN 0 WHEN acad = 1 AND swim = 4 THEN least(r4, 2) ELSE r4 END
   WHEN sel = 'highly_selective' AND acad = 0 THEN CASE WHEN swim >= 3 THEN least(r4, 1) ELSE 0 END ELSE r4 END AS r5 FROM a9),
 a11 AS (SELECT *, CASE WHEN weak THEN least(r5, 1) ELSE r5 END AS r6 FROM a10),
 a12 AS (SELECT *, CASE WHEN NOT has_meta THEN 'Unknown' WHEN coalesce(moonshot, false) THEN 'Moonshot — Apply for Fun' ELSE {labels} END AS label, has_meta AND NOT coalesce(moonshot, false) AS decided FROM a11)
 SELECT {keep}, label, CAST(CASE WHEN decided THEN acad END AS INTEGER) AS acad_band, CAST(CASE WHEN decided THEN swim END AS INTEGER) AS swim_band, {colors} AS color FROM a12"""


@query("admission_label", "WITH " + admission_sql("{applicants}", "id"))
def _(t):
    return AD.admission_label(t.applicants).select("id", "label", "acad_band", "swim_band", "color")


@query("admission_label_simple", """SELECT id, CASE WHEN acc <= 7 THEN 'Moonshot' WHEN acc <= 15 THEN CASE WHEN d >= -30 THEN 'Major Reach' ELSE 'Moonshot' END
  WHEN acc <= 25 THEN CASE WHEN d >= 0 THEN 'Realistic Shot' WHEN d >= -60 THEN 'Major Reach' ELSE 'Moonshot' END
  ELSE CASE WHEN d >= 0 THEN 'Strong Chance' WHEN d >= -80 THEN 'Realistic Shot' ELSE 'Major Reach' END END AS label
FROM (SELECT id, coalesce(accept, 50) AS acc, CASE WHEN sat >= 400 THEN sat END - coalesce(sat_median, 1200) AS d FROM {applicants}) x""")
def _(t):
    return t.applicants.select("id", AD.admission_label_simple("accept", "sat_median", "sat").alias("label"))


@query("act_to_sat", """SELECT id, CASE WHEN act BETWEEN 15 AND 36 THEN list_extract([850, 890, 930, 970, 1010, 1040, 1080, 1110, 1140, 1180, 1210, 1240, 1280, 1310, 1340, 1370, 1400, 1430,
  1460, 1500, 1540, 1590], act - 14) ELSE CAST(round(act / 36.0 * 1200 + 400) AS INTEGER) END AS sat FROM {applicants}""")
def _(t):
    return t.applicants.select("id", AD.act_to_sat("act").alias("sat"))


_COA = "CASE " + " ".join(f"WHEN accept <= {a} THEN {c}" if a else f"ELSE {c}" for a, c in AD.COST_SIX) + " END"
_K = lambda pct: f"CAST(round_even(CASE WHEN merit = 'high' THEN 25 ELSE 15 END * {pct} / 100.0, 0) AS INTEGER) * 1000"
_M = lambda c: f"format('{{:,}}', {c})"


@query("merit_estimate", f"""WITH m1 AS (SELECT id, merit, gpa >= 3.9 AS elite, coalesce(nullif(sat, 0), 1000) - coalesce(nullif(sat_median, 0), 1200) AS gap, {_COA} AS coa FROM {{applicants}}),
m2 AS (SELECT *, CASE WHEN gap < -50 THEN 0 WHEN gap <= 50 AND NOT elite THEN 25 WHEN gap <= 120 AND NOT elite THEN 50 ELSE 65 END AS lp, CASE WHEN gap < -50 THEN 0 WHEN gap <= 50 AND NOT elite THEN 40 WHEN gap <= 120 AND NOT elite THEN 65 ELSE 75 END AS hp FROM m1),
m3 AS (SELECT *, {_K('lp')} AS lo, {_K('hp')} AS hi FROM m2)
SELECT id, coa, merit <> 'none' AND lp <> 0 AS has_merit, CASE WHEN merit = 'none' THEN 'None' WHEN lp = 0 THEN '$0' ELSE '~$' || {_M('lo')} || '–$' || {_M('hi')} END AS merit,
 CASE WHEN merit = 'none' THEN '~$' || {_M('coa')} || ' before need-based aid' WHEN lp = 0 THEN '~$' || {_M('coa')} ELSE '~$' || {_M('greatest(0, coa - hi)')} || '–$' || {_M('greatest(0, coa - lo)')} END AS net FROM m3""")
def _(t):
    d = t.applicants.withColumn("m", AD.merit_estimate("merit", "sat", "gpa", "sat_median", "accept"))
    return d.select("id", "m.coa", "m.has_merit", "m.merit", "m.net")


@query("merit_projection", """WITH p AS (SELECT id, 5000 + CAST(id AS INTEGER) % 9 * 700 AS lo, 15000 + CAST(id AS INTEGER) % 7 * 900 AS hi,
  CASE WHEN coalesce(nullif(sat, 0) > sat75, false) THEN 'above_75th' WHEN coalesce(nullif(sat, 0) > sat25, false) THEN 'above_median' WHEN nullif(sat, 0) IS NOT NULL AND sat25 IS NOT NULL THEN 'at_or_below_median'
   WHEN coalesce(nullif(gpa, 0) > gpa_mean, false) THEN 'above_median' WHEN nullif(gpa, 0) IS NOT NULL AND gpa_mean IS NOT NULL THEN 'at_or_below_median' ELSE 'unknown' END AS signal FROM {applicants})
SELECT id, signal, CASE signal WHEN 'above_75th' THEN lo + CAST(floor((hi - lo) * 0.55::DOUBLE) AS INTEGER) WHEN 'above_median' THEN lo + CAST(floor((hi - lo) * 0.25::DOUBLE) AS INTEGER) END AS proj_low,
 CASE signal WHEN 'above_75th' THEN hi WHEN 'above_median' THEN lo + CAST(floor((hi - lo) * 0.60::DOUBLE) AS INTEGER) END AS proj_high FROM p""")
def _(t):
    k = F.col("id").cast("int")
    d = t.applicants.withColumns({"lo": 5000 + k % 9 * 700, "hi": 15000 + k % 7 * 900, "signal": AD.merit_signal("sat", "sat25", "sat75", "gpa", "gpa_mean")})
    return d.withColumn("p", AD.merit_projection("signal", "lo", "hi")).select("id", "signal", "p.proj_low", "p.proj_high")


# part sizes and prices as event times
role("event_times", """
SELECT l_orderkey AS k, l_linenumber AS ln, CASE l_linestatus WHEN 'O' THEN 'men' ELSE 'women' END AS gender, l_extendedprice / 500 AS sec,
  CASE l_partkey % 15 WHEN 0 THEN '50 Free' WHEN 1 THEN '100 Free' WHEN 2 THEN '200 Free' WHEN 3 THEN '500 Free' WHEN 4 THEN '1000 Free' WHEN 5 THEN '1650 Free' WHEN 6 THEN '100 Back' WHEN 7 THEN '200 Back'
    WHEN 8 THEN '100 Breast' WHEN 9 THEN '200 Breast' WHEN 10 THEN '100 Fly' WHEN 11 THEN '200 Fly' WHEN 12 THEN '200 IM' WHEN 13 THEN '400 IM' ELSE '75 Free' END AS event
FROM {lineitem}
""")


def plausible_sql(e="event", s="sec", g="gender") -> str:
    out = []
    for name in EV.TARGET_EVENTS:
        (ml, mh), (wl, wh) = EV.WINNING_RANGE["men"][name], EV.WINNING_RANGE["women"][name]
        out.append(f"WHEN {e} = '{name}' THEN CASE WHEN {g} = 'women' THEN {s} BETWEEN {wl} AND {wh} ELSE {s} BETWEEN {ml} AND {mh} END")
    return "CASE " + " ".join(out) + " ELSE true END"


@query("plausible_range", f"SELECT k, ln, {plausible_sql()} AS ok FROM {{event_times}}")
def _(t):
    return t.event_times.select("k", "ln", EV.plausible_range("event", "sec", "gender").alias("ok"))


@query("family_bounds", "SELECT k, ln, CASE " + " ".join(f"WHEN contains(lower(event), '{e}') THEN {lo}::DOUBLE" for e, lo, _, _ in __import__("rankfit.operators.robust", fromlist=["EVENT_BOUNDS"]).EVENT_BOUNDS) + " END AS floor, CASE " + " ".join(f"WHEN contains(lower(event), '{e}') THEN {hi}::DOUBLE" for e, _, _, hi in __import__("rankfit.operators.robust", fromlist=["EVENT_BOUNDS"]).EVENT_BOUNDS) + " END AS ceiling FROM {event_times}")
def _(t):
    d = t.event_times.withColumn("b", family_bounds(F.col("event")))
    return d.select("k", "ln", F.col("b.floor").alias("floor"), F.col("b.deep_ceiling").alias("ceiling"))


# ---- image candidates ------------------------------------------------------------------------------------

# two candidates per page with sizes, alt text and provenance derived from the page
role("candidates", """
SELECT page_id, i, split_part(split_part(url, '//', 2), '/', 1) AS school, 'https://' || split_part(split_part(url, '//', 2), '/', 1) || '/img/'
    || CASE (page_id + i) % 9 WHEN 0 THEN 'campus-aerial' WHEN 1 THEN 'logo' WHEN 2 THEN 'swim_pool' WHEN 3 THEN 'student-life' WHEN 4 THEN 'hall_1905' WHEN 5 THEN 'team-photo' WHEN 6 THEN 'quad%20view' WHEN 7 THEN 'shared' ELSE 'x' END
    || CASE WHEN (page_id + i) % 9 = 7 THEN '' ELSE CAST(page_id AS STRING) END || CASE page_id % 10 WHEN 3 THEN '.svg' ELSE '.jpg' END AS url,
  CASE i WHEN 0 THEN 'Aquatic Center' WHEN 1 THEN 'Main Hall building' ELSE '' END AS alt, CAST(600 + (page_id * 37 + i * 411) % 1500 AS INT) AS width, CAST(350 + (page_id * 53 + i * 97) % 900 AS INT) AS height,
  CASE (page_id + i) % 6 WHEN 0 THEN 'swim' WHEN 1 THEN 'visit' WHEN 2 THEN 'campus' WHEN 3 THEN 'student_life' WHEN 4 THEN 'home' ELSE 'general' END AS page_type, url AS page_url,
  CAST((page_id + i) % 6 AS INT) AS prominence, CASE i WHEN 0 THEN 'site:' || split_part(url, '//', 2) WHEN 1 THEN 'campus life' ELSE 'web' END AS context,
  CASE (page_id + i) % 5 WHEN 0 THEN 'wikimedia' WHEN 1 THEN 'official' WHEN 2 THEN 'official_og' WHEN 3 THEN 'wikipedia' ELSE 'wiki_commons' END AS source,
  'the ' || split_part(split_part(url, '//', 2), '.', 1) || ' College' AS entity
FROM (SELECT page_id, url, 0 AS i FROM {pages} UNION ALL SELECT page_id, url, 1 AS i FROM {pages} UNION ALL SELECT page_id, url, 2 AS i FROM {pages}) x
""")


def _any_sql(c, toks):
    return "(" + " OR ".join(f"contains({c}, '{x}')" for x in toks) + ")"


def _count_sql(c, toks):
    return "(" + " + ".join(f"contains({c}, '{x}')::INT" for x in toks) + ")"


BAD_SQL = lambda c: "(" + " OR ".join([f"ends_with(lower({c}), '{e}')" for e in AS.BAD_EXTENSIONS]) + " OR " + _any_sql(f"lower({c})", AS.BAD_TOKENS) + ")"
_DEC = "lower(url_decode(replace({0}, '+', '%2B')))"
_PAGE = "CASE page_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in AS.PAGE_SCORES.items()) + " ELSE 1.0::DOUBLE END"
IMAGE_SCORE_SQL = f"""CASE WHEN {BAD_SQL('url')} OR width < 800 OR height < 400 OR height > width * 1.15 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {_PAGE} + CASE WHEN prominence > 0 THEN least(prominence * 0.5::DOUBLE, 4.0) ELSE 0.0 END
  + least(width::DOUBLE * height / 1500000.0, 2.5) + CASE WHEN width::DOUBLE / height >= 1.7 THEN 1.2::DOUBLE WHEN width::DOUBLE / height >= 1.3 THEN 0.6 ELSE 0.0 END
  + {_count_sql("(translate(lower(url), '/-_', '   ') || ' ' || lower(alt))", AS.BOOST_IMAGE)} * 0.4::DOUBLE - {_count_sql("(translate(lower(url), '/-_', '   ') || ' ' || lower(alt))", AS.PENALTY_IMAGE)} * 1.0::DOUBLE
  - CASE WHEN {_any_sql(_DEC.format('url'), AS.HISTORICAL)} OR regexp_matches({_DEC.format('url')}, '(^|[^0-9])(1[89][0-9][0-9]|1[0-5][0-9][0-9])([^0-9]|$)') THEN 4.0::DOUBLE ELSE 0.0 END
  + {_count_sql('lower(page_url)', AS.BOOST_PAGE)} * 0.3::DOUBLE - {_count_sql('lower(page_url)', AS.PENALTY_PAGE)} * 0.6::DOUBLE) END"""


def image_score():
    return AS.image_score("url", "alt", "page_type", "page_url", "width", "height", "prominence")


@query("image_score", f"SELECT page_id, i, {rnd(IMAGE_SCORE_SQL, 3)} AS score FROM {{candidates}}")
def _(t):
    return t.candidates.select("page_id", "i", NU.round_to(image_score(), 3).alias("score"))


def slot_sql(slot: str) -> str:
    c = "lower(url || ' ' || alt)"
    if slot == "swim":
        c = "lower(url || ' ' || alt || ' ' || page_url)"
        return f"CASE WHEN {_any_sql(c, AS.SWIM_REJECT)} THEN -50 ELSE CASE WHEN {_any_sql(c, AS.SWIM_STRONG)} THEN 20 ELSE 0 END + CASE WHEN {_any_sql(c, AS.SWIM_OK)} THEN 5 ELSE 0 END + CASE page_type WHEN 'swim' THEN 15 WHEN 'athletics' THEN 3 ELSE -15 END END"
    plus, minus = (AS.HERO_PLUS, AS.HERO_MINUS) if slot == "hero" else (AS.STUDENT_PLUS, AS.STUDENT_MINUS)
    pts = "CASE page_type WHEN 'homepage' THEN 8 WHEN 'admissions' THEN 8 WHEN 'student_life' THEN 4 WHEN 'swim' THEN -10 ELSE 0 END" if slot == "hero" else "CASE page_type WHEN 'student_life' THEN 10 WHEN 'swim' THEN -10 ELSE 0 END"
    return f"CASE WHEN source = 'official_og' THEN -10 ELSE {_count_sql(c, plus)} * 6 - {_count_sql(c, minus)} * 5 + {pts} END"


def slot_scores(d):
    text, og = F.concat_ws(" ", "url", "alt"), F.col("source") == "official_og"
    return d.withColumns({
        "hero": AS.slot_score("hero", text, "page_type", og), "student": AS.slot_score("student_life", text, "page_type", og),
        "swim": AS.slot_score("swim", text, "page_type", og, "page_url")})


def _size_sql(steps):
    return "CASE " + " ".join(f"WHEN width >= {w} THEN {p}" for w, p in steps) + " ELSE 0 END + CASE WHEN width > height THEN 5 ELSE 0 END"


_LOWTEXT = "lower(url || ' ' || alt)"
_FIRSTWORD = "split_part(school, '.', 1)"


@query("image_score_variants", f"""SELECT page_id, i, {rnd(f"CASE WHEN NOT {BAD_SQL('url')} AND width >= 800 AND height >= 400 THEN width::DOUBLE * height / 1000000.0 + CASE WHEN contains(school, '.edu') THEN 2.0 ELSE 0.0 END ELSE 0.0 END", 3)} AS megapixels,
 {slot_sql('hero')} AS hero, {slot_sql('student')} AS student, {slot_sql('swim')} AS swim,
 contains({_LOWTEXT}, 'hall')::INT * 12 + contains({_LOWTEXT}, {_FIRSTWORD})::INT * 6 + {_size_sql([(1200, 8), (800, 4)])} + {_count_sql(_LOWTEXT, AS.SCENIC_PLUS)} * 4 - {_count_sql(_LOWTEXT, AS.SCENIC_MINUS)} * 5 AS anchor_score,
 CASE source WHEN 'official_og' THEN 15 WHEN 'official' THEN 12 WHEN 'wikimedia' THEN 4 WHEN 'wikipedia' THEN 2 ELSE 0 END + contains({_LOWTEXT}, 'hall')::INT * 10 + {_size_sql([(1200, 8), (800, 5), (600, 2)])} + {_count_sql(_LOWTEXT, AS.REPAIR_PLUS)} * 3 - {_count_sql(_LOWTEXT, AS.REPAIR_MINUS)} * 4 AS source_score
FROM {{candidates}}""")
def _(t):
    text = F.concat_ws(" ", "url", "alt")
    d = slot_scores(t.candidates)
    mega = AS.megapixel_score("width", "height", "url", "school")
    anchor = AS.anchor_term_score(text, F.array(F.lit("hall")), F.array(F.substring_index("school", ".", 1)), "width", "height")
    source = AS.source_priority_score(text, "source", F.array(F.lit("hall")), "width", "height")
    return d.select("page_id", "i", NU.round_to(mega, 3).alias("megapixels"), "hero", "student", "swim",
                    anchor.alias("anchor_score"), source.alias("source_score"))


_U, _PU = _DEC.format("url"), _DEC.format("page_url")
_POOLURL = [*AS.POOL_TOKENS, "aquatics"]
CATEGORY_SQL = f"""CASE WHEN page_type = 'swim' OR {_any_sql(_U, _POOLURL)} OR {_any_sql(_PU, _POOLURL)} OR {_any_sql('lower(alt)', AS.POOL_TOKENS)} OR {_any_sql('lower(context)', AS.POOL_TOKENS)} THEN 'pool'
  WHEN page_type = 'student_life' OR {_any_sql(_U, AS.STUDENT_URL_TOKENS)} OR {_any_sql(_PU, AS.STUDENT_URL_TOKENS)} OR {_any_sql('lower(alt)', AS.STUDENT_URL_TOKENS)} OR {_any_sql('lower(context)', AS.STUDENT_CONTEXT)} THEN 'student_life' ELSE 'campus' END"""


@query("assign_category", f"""SELECT page_id, i, {CATEGORY_SQL} AS category, CASE WHEN i = 1 THEN 'kept' WHEN page_type = 'swim' OR {_any_sql('lower(url)', AS.POOL_TOKENS)} THEN 'pool'
  WHEN page_type = 'student_life' OR {_any_sql('lower(url)', AS.STUDENT_BACKFILL)} OR {_any_sql('lower(context)', AS.STUDENT_CONTEXT)} THEN 'student_life' ELSE 'campus' END AS backfilled FROM {{candidates}}""")
def _(t):
    return t.candidates.select(
        "page_id", "i", AS.assign_category("page_type", "url", "page_url", "alt", "context").alias("category"),
        AS.backfill_category(F.when(F.col("i") == 1, "kept"), "page_type", "url", "context").alias("backfilled"))


_KW = f"""list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(trim(entity), '\\s+'), lambda w: trim(w, '.,;:''"()[]')), lambda w: len(w) > 1), lambda w: lower(w)), lambda w: w NOT IN {stop_sql(N.KEY_STOP)})"""
_ALL = f"({_U} || ' ' || {_PU} || ' ' || lower(alt) || ' ' || lower(context))"


@query("pool_confidence", f"""SELECT page_id, i, {rnd('least(c, 1.0::DOUBLE)', 2)} AS confidence FROM (SELECT page_id, i, CASE WHEN page_type = 'swim' THEN 0.5::DOUBLE ELSE 0.0 END + CASE WHEN {_any_sql(_U, AS.POOL_TOKENS)} THEN 0.2::DOUBLE ELSE 0.0 END
  + CASE WHEN {_any_sql('lower(alt)', AS.POOL_TOKENS)} THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN {_any_sql(_PU, AS.POOL_TOKENS)} THEN 0.15::DOUBLE ELSE 0.0 END
  + CASE WHEN len({_KW}) = 0 THEN 0.0::DOUBLE ELSE 0.4::DOUBLE * (len(list_filter({_KW}, lambda w: contains({_ALL}, w)))::DOUBLE / len({_KW})) END + CASE WHEN contains(lower(context), 'site:') THEN 0.25::DOUBLE ELSE 0.0 END AS c FROM {{candidates}}) x""")
def _(t):
    c = AS.pool_confidence("page_type", "url", "page_url", "alt", "context", "entity")
    return t.candidates.select("page_id", "i", NU.round_to(c, 2).alias("confidence"))


@query("attribution_label", """SELECT page_id, i, array_to_string(list_filter([host, CASE WHEN second <> host THEN second END], lambda x: x IS NOT NULL AND x <> ''), ' · ') AS label FROM (
 SELECT page_id, i, replace(lower(split_part(split_part(page_url, '//', 2), '/', 1)), 'www.', '') AS host,
  CASE WHEN fac <> '' THEN fac WHEN alt <> '' THEN alt ELSE '' END AS second FROM (SELECT *, substr(trim(regexp_extract(alt || ' ' || context, '(?i)([\\w\\s]+(natatorium|aquatic\\s+center)[\\w\\s]*)', 1)), 1, 60) AS fac FROM {candidates}) x) y""")
def _(t):
    return t.candidates.select("page_id", "i", AS.attribution_label("page_url", "alt", "context", "source").alias("label"))


@query("source_adjust", f"""SELECT page_id, i, {rnd("CASE i WHEN 0 THEN 3.5::DOUBLE WHEN 1 THEN CASE WHEN m THEN 2.0::DOUBLE ELSE 1.0 END ELSE CASE WHEN m THEN 2.0::DOUBLE ELSE 1.0 END END", 3)} AS score FROM (
  SELECT page_id, i, len({_KW}) = 0 OR len(list_filter({_KW}, lambda w: contains(lower(url || ' ' || alt), w))) > 0 AS m FROM {{candidates}}) x""")
def _(t):
    kind = F.element_at(F.array(F.lit("site"), F.lit("search"), F.lit("wiki")), F.col("i") + 1)
    named = AS.mentions_name("entity", "url", "alt")
    return t.candidates.select("page_id", "i", NU.round_to(AS.source_adjust(F.lit(2.0), kind, named), 3).alias("score"))


@query("fit_label", """SELECT id, array_to_string(list_filter([CASE WHEN id % 4 = 0 THEN 'Unknown' WHEN id % 4 = 1 THEN '' ELSE 'Possible' END, adj_tier], lambda x: x IS NOT NULL AND x NOT IN ('Unknown', '', 'Not Competitive', 'Below Roster Level'))[1:2], ' · ') AS label FROM {applicants}""")
def _(t):
    first = F.when(F.col("id") % 4 == 0, "Unknown").when(F.col("id") % 4 == 1, "").otherwise("Possible")
    return t.applicants.select("id", IN.fit_label(first, "adj_tier", ["Unknown", "", *IN.NOT_COMPETITIVE]).alias("label"))


# ---- query texts -----------------------------------------------------------------------------------------

# search texts: conversation openings with a phrase of each intent in front
role("query_text", """
SELECT conv_id, turn, CASE (conv_id + turn) % 14 WHEN 0 THEN 'Best swim teams I can get into ' WHEN 1 THEN 'hardest schools where I could swim ' WHEN 2 THEN 'dream school on the West Coast ' WHEN 3 THEN 'STEM programs in New England '
  WHEN 4 THEN 'affordable with merit money ' WHEN 5 THEN 'all schools where I can make the team ' WHEN 6 THEN 'fun social vibe ' WHEN 7 THEN 'hidden ivy ' WHEN 8 THEN 'd1 big school ' WHEN 9 THEN 'small college d3 '
  WHEN 10 THEN 'which will definitely get me in, safety ' WHEN 11 THEN 'show me more options like me ' WHEN 12 THEN 'podium star ' ELSE 'red ring' END || text AS query
FROM {conversations}
""")


def any_phrase(c, phrases):
    return "(" + " OR ".join("contains(" + c + ", '" + p.replace("'", "''") + "')" for p in dict.fromkeys(phrases)) + ")"


INTENT_SQL = f"""{any_phrase('low', IN.PERSONAL)} AS is_personal, {any_phrase('low', IN.SWIM)} AS is_swim, {any_phrase('low', IN.REACH)} AS is_explicit_reach,
  CASE WHEN {any_phrase('low', IN.HIGH_BAR)} THEN 80 WHEN {any_phrase('low', IN.STANDARD_BAR)} THEN 60 END AS adm_threshold, {any_phrase('low', IN.PERSONAL)} AND {any_phrase('low', IN.PRESTIGE)} AS is_prestige_sort"""


@query("query_intent", f"SELECT conv_id, turn, {INTENT_SQL} FROM (SELECT *, lower(query) AS low FROM {{query_text}}) x")
def _(t):
    return t.query_text.select("conv_id", "turn", IN.query_intent("query").alias("i")).select("conv_id", "turn", "i.*")


@query("region_of_query", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(query), '{k}') THEN '{','.join(v)}'" for k, v in IN.REGIONS) + " END AS states FROM {query_text}")
def _(t):
    return t.query_text.select("conv_id", "turn", F.array_join(IN.region_of_query("query"), ",").alias("states"))


@query("looks_like_name", f"""SELECT conv_id, turn, len(w) BETWEEN 1 AND 5 AND NOT list_has_any(w, [{', '.join("'" + x + "'" for x in N.NOT_A_NAME)}]) AND NOT ends_with(low, '?') AS is_name FROM (
  SELECT conv_id, turn, lower(q) AS low, list_filter(regexp_split_to_array(trim(lower(q)), '\\s+'), lambda x: x <> '') AS w FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN query ELSE regexp_extract(query, '^\\S+ \\S+') END AS q FROM {{query_text}}) x) y""")
def _(t):
    q = F.when(F.col("turn") % 2 == 0, F.col("query")).otherwise(F.regexp_extract("query", r"^\S+ \S+", 0))
    return t.query_text.select("conv_id", "turn", N.looks_like_name(q).alias("is_name"))


@query("student_context", """SELECT id, 'Student: the swimmer' || CASE WHEN gpa > 0 THEN ', GPA ' || format('{:.1f}', gpa) ELSE '' END || CASE WHEN sat > 0 THEN ', SAT ' || sat WHEN act > 0 THEN ', ACT ' || act ELSE '' END
  || ', events: ' || adj_tier || CASE WHEN id % 3 = 0 THEN ', preferences: urban' ELSE '' END AS line FROM {applicants}""")
def _(t):
    from ..operators.ranking import student_context

    vibe = F.create_map(F.lit("campus"), F.when(F.col("id") % 3 == 0, "urban").otherwise("Not sure yet"))
    d = t.applicants.withColumns({"nm": F.lit(""), "notes": F.lit("")})
    return d.select("id", student_context("nm", "gpa", "sat", "act", F.array("adj_tier"), vibe, "notes").alias("line"))
