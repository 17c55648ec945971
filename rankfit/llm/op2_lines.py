"""Removal of repeated line runs by winnowing over line hashes, with DataFrame functions only.

A window is the shortest run of lines from a line on (or up to a line) with at least 50 words. The smallest line hash in a
window is its fingerprint, so any run of 50 words or more that two places share has a fingerprint in common. Positions are
joined by fingerprint: a window meets the first place of the corpus where the same fingerprint was taken from equal
lines. Such a match goes on to the right through the forward windows and to the left through the backward windows of the
lines beside it, each with the first place of its own; what they cover is the whole repeated run. (Line by line from one
first place would fall short where that place shares less of the run than a later one does, and trying all places is
quadratic; so a line is extended over exactly as far as some earlier place has it. README says the same.) The later run is
deleted, the first occurrence stays: within a document only a window that begins behind the end of the first one counts,
so a run that repeats itself keeps its first 50 words.

A line is compared without the blanks around it; its words are its inner spaces plus one. Lines without words never match,
but go with the run around them. Null texts count as empty and stay null; repeated rows count as one document (all rows
of it get its result) and are taken together before their lines are; rows with equal ids and other texts are documents of
their own in the order of their hash; rows without an id come last. Further columns pass through, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import written

MIN_WORDS = 50


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Complete windows: direction, fingerprint (the smallest line hash) and its line, content key, document and extent."""
    line = lambda x: F.trim(x)
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    whole = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(line(x) != "", F.struct(F.xxhash64(line(x)).alias("h"), words(line(x)).cast("bigint").alias("words"))))
    # copies of a row become one where they are read, before any line of theirs is a row
    once = docs.select("doc_id", "row", whole.alias("lines")).groupBy("doc_id", "row").agg(F.first("lines").alias("lines"))
    lines = once.select("doc_id", "row", F.posexplode("lines").alias("pos", "line")).filter("line is not null").select("doc_id", "row", "pos", "line.h", "line.words")
    doc = Window.partitionBy("doc_id", "row")
    lines = lines.withColumn("till", F.sum("words").over(doc.orderBy("pos"))).withColumn("since", F.col("till") - F.col("words"))
    made = lines
    for way, frame in (("f", doc.orderBy("since").rangeBetween(0, min_words - 1)), ("b", doc.orderBy("till").rangeBetween(-min_words + 1, 0))):
        made = made.withColumns({
            f"{way}_words": F.sum("words").over(frame), f"{way}_least": F.min(F.struct("h", "pos")).over(frame),
            f"{way}_key": F.xxhash64(F.collect_list("h").over(frame)),
            f"{way}_end": (F.max("pos") if way == "f" else F.min("pos")).over(frame)})
    sides = [F.struct(F.lit(way).alias("way"), F.col(f"{way}_words").alias("n"), F.col(f"{way}_least.h").alias("print"), F.col(f"{way}_least.pos").alias("at"),
                      F.col(f"{way}_key").alias("key"), F.least("pos", f"{way}_end").alias("start"), F.greatest("pos", f"{way}_end").alias("end"))
             for way in ("f", "b")]
    return made.select("doc_id", "row", F.inline(F.array(*sides))).filter(F.col("n") >= min_words).drop("n")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start, end): line ranges of `docs` (doc_id, row, text) that occurred before, merged where they meet."""
    windows = written(_windows(docs, min_words), "windows")
    where = F.struct("doc_id", "row", "at")
    shared = windows.groupBy("print").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("not (a <=> b)").select("print")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "start", "end")
    first = windows.join(shared, "print", "left_semi").groupBy("way", "print", "key").agg(
        F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    inside = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row") == F.col("row"))
    later = windows.join(first, ["way", "print", "key"]).filter((place > F.col("first")) & ~(inside & (F.col("first.end") >= F.col("start"))))
    ranges = later.select("doc_id", "row", "start", "end").distinct()
    doc = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(before < F.col("start") - 1, F.lit(True)), 1).otherwise(0)
    runs = ranges.withColumn("new", new).withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, text, n_lines, n_removed): every row of `docs` as a struct, its text without the repeated runs, and the counts."""
    whole = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("d")).withColumn("row", F.xxhash64(whole))
    runs = repeated_runs(keyed.select(F.col("d.doc_id").alias("doc_id"), "row", F.col("d.text").cast("string").alias("text")), min_words)
    cuts = runs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")).select(
        F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row"), "cuts")
    out = keyed.join(cuts.hint("shuffle_hash"), F.col("d.doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left")
    out = out.select("d", "cuts", F.split(whole, "\n").alias("lines"))
    # what lies between the cuts, from the end of one to the start of the next
    kept = F.expr("""array_join(transform(filter(transform(sequence(0, size(cuts)), k -> named_struct(
        'a', coalesce(get(cuts, k - 1).end + 1, 0), 'b', coalesce(get(cuts, k).start, size(lines)))), r -> r.b > r.a),
        r -> array_join(slice(lines, r.a + 1, r.b - r.a), '\\n')), '\\n')""")
    removed = F.expr("coalesce(aggregate(cuts, 0, (n, c) -> n + c.end - c.start + 1), 0)")
    text = F.when(F.col("cuts").isNull(), F.col("d.text").cast("string")).otherwise(kept)
    return out.select("d", text.alias("text"), F.size("lines").alias("n_lines"), removed.alias("n_removed"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of `docs`, the text without the repeated runs, and `n_lines`, `n_removed` (in place of columns of these names)."""
    kept = [F.col("text") if c == "text" else F.col("d").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _cut(docs, min_words).select(*kept, "n_lines", "n_removed")


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of `docs` with the same columns: the text without the repeated runs, and n_chars, where there is one, of the shortened texts."""
    cols = {c: F.col("d").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(cols["n_chars"])
    kinds = {f.name: f.dataType for f in docs.schema}
    return _cut(docs, min_words).select(*[c.cast(kinds[name]).alias(name) for name, c in cols.items()])


ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
a AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM d),
l AS (SELECT doc_id, text, pos, trim(raw, ' ') AS line, length(trim(raw, ' ')) - length(replace(trim(raw, ' '), ' ', '')) + 1 AS words
  FROM a WHERE trim(raw, ' ') <> ''),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS till FROM l),
w AS (SELECT doc_id, text, pos, sum(words) OVER f AS fw, list(line) OVER f AS fk, max(pos) OVER f AS fe,
    sum(words) OVER b AS bw, list(line) OVER b AS bk, min(pos) OVER b AS be
  FROM (SELECT *, till - words AS since FROM c) x
  WINDOW f AS (PARTITION BY doc_id, text ORDER BY since RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING),
    b AS (PARTITION BY doc_id, text ORDER BY till RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
s AS (SELECT 'f' AS way, doc_id, text, fk AS k, pos AS s, fe AS e FROM w WHERE fw >= {MIN_WORDS}
  UNION ALL SELECT 'b', doc_id, text, bk, be, pos FROM w WHERE bw >= {MIN_WORDS}),
r AS (SELECT doc_id, text, unnest(range(s, e + 1)) AS pos FROM (
  SELECT *, row_number() OVER o AS rn, first_value(doc_id) OVER o AS d0, first_value(text) OVER o AS t0, first_value(e) OVER o AS e0 FROM s WINDOW o AS (PARTITION BY way, k ORDER BY doc_id, s)) x
  WHERE rn > 1 AND NOT (doc_id = d0 AND text = t0 AND e0 >= s)),
g AS (SELECT DISTINCT doc_id, text, pos FROM r),
k AS (SELECT a.doc_id, a.text, string_agg(a.raw, chr(10) ORDER BY a.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(*) AS n, count(g.pos) AS gone
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.text = g.text AND a.pos = g.pos GROUP BY a.doc_id, a.text)
SELECT d.doc_id, CASE WHEN k.gone = 0 THEN d.text ELSE coalesce(k.kept, '') END AS text, CAST(k.n AS INT) AS n_lines, CAST(k.gone AS INT) AS n_removed
FROM documents d JOIN k ON d.doc_id = k.doc_id AND d.text IS NOT DISTINCT FROM k.text
"""
