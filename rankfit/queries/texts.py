"""Extraction from lines of text. The lines are written from the structured tables, so the reference SQL is the
structure the text was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets as AS, events as EV, numeric as NU, text as TX
from ..operators import extraction as X
from ..plans import results as P
from .base import query, role

_STROKE = "CASE split_part(event, ' ', 2) WHEN 'Free' THEN 'Freestyle' WHEN 'Back' THEN 'Backstroke' WHEN 'Breast' THEN 'Breaststroke' WHEN 'Fly' THEN 'Butterfly' ELSE 'IM' END"
_SHOWN = "CASE WHEN place <= 8 THEN place WHEN place <= 16 THEN place - 8 WHEN place <= 24 THEN place - 16 ELSE place END"
# a time of ten seconds and more in whole hundredths
_CS = "CAST(floor(sec / 5) AS BIGINT) + 1000"
_TIME = "CASE WHEN c >= 6000 THEN CAST(CAST(floor(c / 6000) AS BIGINT) AS STRING) || ':' || lpad(CAST(CAST(floor(c / 100) AS BIGINT) % 60 AS STRING), 2, '0') ELSE CAST(CAST(floor(c / 100) AS BIGINT) AS STRING) END || '.' || lpad(CAST(c % 100 AS STRING), 2, '0')"


def _file(header: str, where: str, extra: str = "") -> str:
    return f"""SELECT bundle_id AS source_file, 1 + CAST(floor((rn - 1) / 50) AS INT) AS page_no, rn AS line_no, kind, gender, event, place, c, text FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY gender, event, place, part) AS INT) AS rn FROM (
  SELECT bundle_id, gender, event, 0 AS place, 0 AS part, 'header' AS kind, CAST(0 AS BIGINT) AS c, {header} AS text FROM (SELECT DISTINCT bundle_id, gender, event FROM {{event_places}} WHERE {where}) h
  UNION ALL SELECT DISTINCT bundle_id, gender, event, CASE WHEN place > 16 THEN 17 ELSE 9 END, -1, 'label', CAST(0 AS BIGINT), CASE WHEN place > 16 THEN 'C - Final' ELSE 'Consolation Final' END FROM {{event_places}} WHERE place > 8 AND {where}
  UNION ALL SELECT bundle_id, gender, event, place, 1, 'result', c, CAST({_SHOWN} AS STRING) || ' Lane, ' || gender || ' SO ' || bundle_id || CASE WHEN place % 5 = 3 THEN '' ELSE ' ' || {_TIME} || CASE WHEN place % 4 = 1 THEN ' q' ELSE '' END END
   FROM (SELECT *, {_CS} AS c FROM {{event_places}} WHERE {where}) r
  UNION ALL SELECT bundle_id, gender, event, place, 2, 'late', c, '   ' || {_TIME} || '* @' FROM (SELECT *, {_CS} AS c FROM {{event_places}} WHERE place % 5 = 3 AND {where}) s{extra}) u) v"""


_GENDERED = "CASE gender WHEN 'men' THEN 'Men''s ' ELSE 'Women ' END"
role("result_lines", _file(f"'Event 12 ' || {_GENDERED} || split_part(event, ' ', 1) || ' Yard ' || {_STROKE}", "true"))
# headers the strict pattern cannot read: the stroke comes first
role("loose_lines", _file(f"{_GENDERED} || {_STROKE} || ' - ' || split_part(event, ' ', 1)", "event <> '75 Free'",
    # a header of no known event ends each half of the file
    " UNION ALL SELECT DISTINCT bundle_id, gender, 'zz', 0, 0, 'close', CAST(0 AS BIGINT), 'Event 9 Men 75 Yard Free' FROM {event_places}"))


# two files of every bundle, told apart by their text only: finals with all women's events first, and prelims of one flag
# for odd bundles, whose places run on without labels. One bundle has no finals
_EVENT_HEAD = f"'Event 12 ' || {_GENDERED} || split_part(event, ' ', 1) || ' Yard ' || {_STROKE}"
_FINALS_IN, _PRELIMS_IN = "bundle_id <> 'NATION_7' AND event <> '75 Free'", "(substr(bundle_id, -1) NOT IN ('1', '3', '5', '9') OR gender = 'women') AND event <> '75 Free'"
role("session_lines", f"""
SELECT bundle_id, source_file, 1 + CAST(floor((rn - 1) / 50) AS INT) AS page_no, rn AS line_no, text FROM (
 SELECT bundle_id, source_file, text, CAST(row_number() OVER (PARTITION BY source_file ORDER BY g, event, place, part) AS INT) AS rn FROM (
  SELECT DISTINCT bundle_id, bundle_id || '_a' AS source_file, '' AS g, '' AS event, 0 AS place, 0 AS part, 'Championship Finals' AS text FROM {{event_places}} WHERE {_FINALS_IN}
  UNION ALL SELECT DISTINCT bundle_id, bundle_id || '_b', '', '', 0, 0, 'Preliminaries and heats' FROM {{event_places}} WHERE {_PRELIMS_IN}
  UNION ALL SELECT DISTINCT bundle_id, bundle_id || '_a', CASE gender WHEN 'women' THEN 'a' ELSE 'b' END, event, 0, 0, {_EVENT_HEAD} FROM {{event_places}} WHERE {_FINALS_IN}
  UNION ALL SELECT DISTINCT bundle_id, bundle_id || '_b', gender, event, 0, 0, {_EVENT_HEAD} FROM {{event_places}} WHERE {_PRELIMS_IN}
  UNION ALL SELECT DISTINCT bundle_id, bundle_id || '_a', CASE gender WHEN 'women' THEN 'a' ELSE 'b' END, event, CASE WHEN place > 16 THEN 17 ELSE 9 END, -1, CASE WHEN place > 16 THEN 'C - Final' ELSE 'Consolation Final' END FROM {{event_places}} WHERE place > 8 AND {_FINALS_IN}
  UNION ALL SELECT bundle_id, bundle_id || '_a', CASE gender WHEN 'women' THEN 'a' ELSE 'b' END, event, place, 1, CAST({_SHOWN} AS STRING) || ' Lane, ' || gender || ' SO ' || bundle_id || ' ' || {_TIME} FROM (SELECT *, {_CS} AS c FROM {{event_places}} WHERE {_FINALS_IN}) r
  UNION ALL SELECT bundle_id, bundle_id || '_b', gender, event, place, 1, CAST(place AS STRING) || ' Lane, ' || gender || ' SO ' || bundle_id || ' ' || {_TIME} FROM (SELECT *, 100 + {_CS} AS c FROM {{event_places}} WHERE {_PRELIMS_IN}) s) u) v
""")
role("session_places", f"""
SELECT bundle_id, gender, event, 'a' AS version, place, CAST({_CS} AS DOUBLE) / 100 AS sec FROM {{event_places}} WHERE {_FINALS_IN}
UNION ALL SELECT bundle_id, gender, event, 'b', place, CAST(100 + {_CS} AS DOUBLE) / 100 FROM {{event_places}} WHERE {_PRELIMS_IN}
""")


# titles of sections before the lines of every file
role("titled_lines", """
SELECT source_file, line_no, kind, text FROM {result_lines} UNION ALL SELECT source_file, -2, 'section_men', 'Men''s Results' FROM {result_files} UNION ALL SELECT source_file, -1, 'section_women', 'Women''s Results' FROM {result_files}
""")
role("result_files", "SELECT DISTINCT source_file FROM {result_lines}")


@query("classify_line", """SELECT source_file, line_no, CASE kind WHEN 'header' THEN 'event' WHEN 'label' THEN 'final' WHEN 'late' THEN 'other' ELSE kind END AS kind FROM {titled_lines}""")
def _(t):
    return t.titled_lines.select("source_file", "line_no", EV.classify_line("text").alias("kind"))


@query("parse_result_line", f"""SELECT source_file, line_no, CASE WHEN kind = 'result' THEN CAST({_SHOWN} AS INTEGER) END AS place, CASE WHEN kind = 'result' AND place % 5 <> 3 THEN {_TIME.replace('STRING', 'VARCHAR')} END AS time, CASE WHEN kind = 'result' AND place % 5 <> 3 AND place % 4 = 1 THEN 'q' ELSE '' END AS suffix FROM {{result_lines}} WHERE kind <> 'header'""")
def _(t):
    d = t.result_lines.filter("kind <> 'header'").withColumn("r", EV.parse_result_line("text"))
    return d.select("source_file", "line_no", "r.place", "r.time", "r.suffix")


@query("final_offset", f"SELECT source_file, line_no, CAST(place AS INTEGER) AS place FROM {{result_lines}} WHERE kind = 'result'")
def _(t):
    shown = EV.parse_result_line("text")["place"]
    label = F.when(F.col("place") > 16, "C").when(F.col("place") > 8, "B").otherwise("unknown")
    d = t.result_lines.filter("kind = 'result'").withColumns({"shown": shown, "label": label})
    return d.select("source_file", "line_no", EV.final_offset("shown", "label").alias("place"))


EXTRACTED = "SELECT source_file, gender, event, CAST(place AS INTEGER) AS place, c / 100.0::DOUBLE AS sec, CASE WHEN place % 5 = 3 THEN '* @' WHEN place % 4 = 1 THEN 'q' ELSE '' END AS suffix FROM {result_lines} WHERE kind = 'result' AND event <> '75 Free'"
_COLS = ["source_file", "gender", "event", "place", "sec", "suffix"]


def files_of(lines):
    return lines.select("source_file").distinct().withColumns({
        "bundle_id": F.col("source_file"), "file_gender": F.lit("combined"), "name_gender": F.lit("combined"),
        "session_score": F.lit(3), "file_order": F.lit(1), "conference": F.col("source_file"), "year": F.lit("2026")})


def text_lines(d):
    return d.select("source_file", "page_no", "line_no", "text")


@query("extract_results", EXTRACTED)
def _(t):
    lines = text_lines(t.result_lines)
    d = X.extract_results(lines, files_of(lines).select("source_file", "file_gender", "name_gender"))
    return d.withColumn("sec", NU.round_to("sec", 2)).select(*_COLS)


@query("second_pass", """WITH l AS (SELECT * FROM {loose_lines}), h AS (SELECT source_file, gender, event, min(page_no) FILTER (kind = 'header') AS hp, min(page_no) FILTER ((kind = 'result' AND place % 5 <> 3) OR kind = 'late') AS fp FROM l GROUP BY 1, 2, 3)
SELECT l.source_file, l.gender, l.event, CAST(place AS INTEGER) AS place, c / 100.0::DOUBLE AS sec, CASE WHEN place % 5 = 3 THEN '* @' WHEN place % 4 = 1 THEN 'q' ELSE '' END AS suffix FROM l JOIN h USING (source_file, gender, event) WHERE kind = 'result' AND hp = fp""")
def _(t):
    lines = text_lines(t.loose_lines)
    files = files_of(lines)
    strict = X.extract_results(lines, files.select("source_file", "file_gender", "name_gender"))
    v = strict.join(files.select("source_file", "bundle_id", "session_score"), "source_file")
    missing = P.incomplete_groups(v, P.C.expected_grid(files.select("bundle_id"), {"gender": ["men", "women"]}))
    d = X.second_pass(lines, files.select("source_file", "bundle_id", "file_gender"), missing)
    return d.withColumn("sec", NU.round_to("sec", 2)).select(*_COLS)


# two entries and a label on one line
role("merged_lines", """
SELECT o_orderkey AS k, p1, p2, lab, lead, p1 || ' Alder, ' || o_orderstatus || ' 19AB-CD 1:02.33' AS e1, p2 || ' Birch, ' || o_orderpriority || ' SCH 58.11' AS e2,
 CASE WHEN lead = 1 THEN 'Splits 24.36 27.51 ' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE '' END || p1 || ' Alder, ' || o_orderstatus || ' 19AB-CD 1:02.33 ' || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE p2 || ' Birch, ' || o_orderpriority || ' SCH 58.11' END || CASE WHEN lab = 1 THEN '  B - Final' ELSE '' END AS text,
 CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 2 END AS entries
FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(1 + o_orderkey % 20 AS STRING) AS p1, CAST(21 + o_orderkey % 40 AS STRING) AS p2, CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS lab, CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END AS lead FROM {orders}) x
""")


@query("split_merged_line", """WITH a AS (SELECT k, array_to_string([x for x in [CASE WHEN lead = 1 THEN 'Splits 24.36 27.51' END, CASE WHEN entries = 1 AND lab = 1 THEN e1 || '   B - Final' ELSE e1 END, CASE WHEN entries = 2 THEN CASE WHEN lab = 1 THEN e2 || '  B - Final' ELSE e2 END END] if x IS NOT NULL], '|') AS pieces FROM {merged_lines}) SELECT * FROM a""")
def _(t):
    return t.merged_lines.select("k", F.array_join(EV.split_merged_line("text"), "|").alias("pieces"))


# ---- score tables ----------------------------------------------------------------------------------------

# one score file per nation: a list for one flag, a table with doubled names for another, two entries a line for the third
role("standings", """
SELECT bundle_id AS source_file, CASE gender WHEN 'A' THEN 'men' WHEN 'N' THEN 'women' ELSE 'combined' END AS gender, gender AS flag, replace(team, '#', ' ') AS team, score_f AS score,
 CAST(row_number() OVER (PARTITION BY bundle_id, gender ORDER BY score_f DESC, pos) AS INT) AS rank, CAST(CAST(score_f AS DECIMAL(18,2)) AS STRING) AS score_text FROM {revenue}
""")
role("score_lines", """
SELECT source_file, CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 12 ELSE 14 END AS page_no, CAST(row_number() OVER (PARTITION BY source_file ORDER BY flag, ord, part) AS INT) AS line_no, text FROM (
 SELECT DISTINCT source_file, flag, 0 AS ord, 0 AS part, CASE flag WHEN 'A' THEN 'Scores - Men' WHEN 'N' THEN 'Women - Team Rankings' ELSE 'Combined Team Scores' END AS text FROM {standings}
 UNION ALL SELECT DISTINCT source_file, flag, 0, 1, 'Place School Points' FROM {standings} WHERE flag = 'N'
 UNION ALL SELECT source_file, flag, rank, 0, CASE flag WHEN 'N' THEN CAST(rank AS STRING) || ' ' || team || ' ' || team || ' ' || score_text ELSE CAST(rank AS STRING) || '. ' || team || ', ' || score_text END FROM {standings}
 UNION ALL SELECT source_file, flag, rank, 1, 'continued on the next page' FROM {standings} WHERE flag = 'A'
 UNION ALL SELECT DISTINCT source_file, flag, 10000, 0, 'Total 99,999.00' FROM {standings}
 UNION ALL SELECT DISTINCT source_file, flag, 10001, 0, 'Event 12 Men 200 Free' FROM {standings} WHERE flag = 'R'
 UNION ALL SELECT DISTINCT source_file, flag, 10002, 0, '1. Not A Team 55' FROM {standings} WHERE flag = 'R') x
""")
_ENTRY_COLS = ["source_file", "gender", "rank", "team", "score"]


@query("extract_score_rows", "SELECT source_file, gender, rank, team, score FROM {standings} WHERE rank <= 60")
def _(t):
    return X.extract_score_rows(t.score_lines).select(*_ENTRY_COLS)


@query("extract_table_rows", "SELECT source_file, rank, team, score FROM {standings} WHERE flag = 'N' AND rank <= 60")
def _(t):
    d = X.score_sections(t.score_lines).filter("is_table").select("source_file", F.inline("entries"))
    return d.select("source_file", "rank", "team", "score")


@query("score_sections", "SELECT source_file, gender, flag = 'N' AS is_table, count(*) AS entries FROM {standings} WHERE rank <= 60 GROUP BY 1, 2, 3")
def _(t):
    d = X.score_sections(t.score_lines)
    return d.groupBy("source_file", "gender", "is_table").agg(F.sum(F.size("entries")).alias("entries")).filter("entries > 0")


@query("tail_then_full", """WITH f AS (SELECT source_file, max(CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 12 ELSE 14 END) AS pages, count(DISTINCT CASE WHEN flag <> 'A' THEN flag END) AS tail_genders FROM {standings} GROUP BY 1)
SELECT s.source_file, gender, rank, team, score FROM {standings} s JOIN f ON f.source_file = s.source_file WHERE rank <= 60 AND (flag <> 'A' OR tail_genders < 2)""")
def _(t):
    lines = t.score_lines
    pages = lines.groupBy("source_file").agg(F.max("page_no").alias("pages")).withColumn("is_auxiliary", F.lit(False))
    return X.tail_then_full(lines, pages).select(*_ENTRY_COLS)


# a block of one flag, three other lines, a switch to the other flag, and entries that come after twelve other lines
_FILLERS = lambda part, texts: "".join(f" UNION ALL SELECT source_file, {part}, {i}, '{x}' FROM {{score_files}}" for i, x in enumerate(texts))
role("score_files", "SELECT DISTINCT source_file FROM {standings}")
role("wide_blocks", f"""
SELECT source_file, 1 AS page_no, CAST(row_number() OVER (PARTITION BY source_file ORDER BY part, ord) AS INT) AS line_no, text FROM (
 SELECT source_file, CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 6 END AS part, rank AS ord, CAST(rank AS STRING) || '. ' || team || '   ' || CAST(10 + rank AS STRING) AS text FROM {{standings}}
 {_FILLERS(0, ["Men''s Team Scores", "Team"])}{_FILLERS(2, ["", "ab", "ab"])}{_FILLERS(3, ["Women Team Final"])}{_FILLERS(5, ["ab"] * 12)}) x
""")


@query("wide_score_rows", """WITH n AS (SELECT source_file, count(*) FILTER (flag = 'A') AS n FROM {standings} GROUP BY 1)
SELECT source_file, 'men' AS gender, team, 10.0::DOUBLE + rank AS score FROM {standings} WHERE flag = 'A' UNION ALL SELECT source_file, 'women', team, 10.0::DOUBLE + rank FROM {standings} JOIN n USING (source_file) WHERE flag = 'N' AND n < 10""")
def _(t):
    # both flags: the switch is reached only where the first flag's entries are fewer than the misses that end a block
    lines = t.wide_blocks
    return X.wide_score_rows(lines, "men").unionByName(X.wide_score_rows(lines, "women")).select("source_file", "gender", "team", "score")


role("wide_lines", """
SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN CAST(1 + s_suppkey % 90 AS STRING) || '. North Valley   ' || CAST(100 + s_suppkey AS STRING) || '.5' WHEN 1 THEN CAST(1 + s_suppkey % 9 AS STRING) || ' East' || chr(9) || CAST(10 + s_suppkey AS STRING)
  WHEN 2 THEN CAST(3 + s_suppkey % 9 AS STRING) || ' West Ridge ' || CAST(20 + s_suppkey AS STRING) WHEN 3 THEN 'Team Score   ' || CAST(s_suppkey AS STRING) ELSE 'ab' END AS text FROM {supplier}
""")


@query("score_line_patterns", """SELECT k, CASE k % 5 WHEN 0 THEN 'North Valley' WHEN 1 THEN 'East' WHEN 2 THEN 'West Ridge' END AS team, CASE k % 5 WHEN 0 THEN CAST(100 + k AS VARCHAR) || '.5' WHEN 1 THEN CAST(10 + k AS VARCHAR) WHEN 2 THEN CAST(20 + k AS VARCHAR) END AS score_text FROM {wide_lines}""")
def _(t):
    return t.wide_lines.select("k", TX.score_line("text").alias("r")).select("k", "r.team", "r.score_text")


# ---- html ------------------------------------------------------------------------------------------------

# the pages with images put in: one meta image, a lazy one, a srcset, one inside navigation
role("image_pages", """
SELECT page_id, url, replace(replace(html, '<nav>', '<nav><img src="/nav.png">'), '</article>', '<img data-src="pics/' || CAST(page_id AS STRING) || '.jpg" alt="Quad &amp; hall" width="900" height="600"><img src="data:image/png;base64,x"><img srcset="/s.jpg 300w, /l' || CAST(page_id AS STRING) || '.jpg 1400w" alt=''Pool''></article>')
 || '<meta property="og:image" content="https://cdn.example.org/' || CAST(page_id AS STRING) || '.jpg">' AS html FROM {pages}
""")
_BASE = "regexp_extract(url, '^https?://[^/?#]*')"
_DIR = f"{_BASE} || regexp_replace(regexp_replace(substr(url, len({_BASE}) + 1), '[?#].*$', ''), '[^/]*$', '')"


@query("extract_images", f"""SELECT page_id, 'https://cdn.example.org/' || page_id || '.jpg' AS image_url, '' AS alt, 1200 AS width, 630 AS height, 10 AS prominence FROM pages
UNION ALL SELECT page_id, {_DIR} || 'pics/' || page_id || '.jpg', 'Quad & hall', 900, 600, 4 FROM pages WHERE contains(html, '</article>')
UNION ALL SELECT page_id, {_BASE} || '/l' || page_id || '.jpg', 'Pool', 1400, 0, 3 FROM pages WHERE contains(html, '</article>')""")
def _(t):
    return AS.extract_images(t.image_pages).select("page_id", "image_url", "alt", "width", "height", "prominence")


@query("resolve_url", f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://a.b/c.png' WHEN 1 THEN {_BASE} || '/x/y.png' WHEN 2 THEN {_DIR} || 'z.png' WHEN 3 THEN split_part(url, ':', 1) || '://cdn.example.org/q.png' WHEN 4 THEN {_DIR} || 'w.png' ELSE {_DIR} || 'v.png' END AS link FROM pages""")
def _(t):
    raw = F.element_at(F.array(*[F.lit(v) for v in ("https://a.b/c.png?k=1", "/x/y.png?w=2", "z.png", "//cdn.example.org/q.png", "./w.png", "sub/../v.png?x=/y")]), (F.col("page_id") % 6 + 1).cast("int"))
    return t.pages.select("page_id", AS.resolve_url(raw, "url", drop_query=True).alias("link"))


# lines of the documents themselves
@query("document_lines", """SELECT doc_id, CAST(i AS INTEGER) AS line_no, len(lines[i + 1]) AS n FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) x) y""")
def _(t):
    d = X.lines_of(t.documents, "doc_id", "text")
    return d.select(F.col("source_file").cast("bigint").alias("doc_id"), "line_no", F.length("text").cast("bigint").alias("n"))

