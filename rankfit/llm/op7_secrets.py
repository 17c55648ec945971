"""Secret scan over an incremental ledger of blobs, with DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its content. The ledger holds the (blob, rule, rule version)
triples already scanned and what was found; a run scans the contents that are not in it, once per content, and joins the
findings back to all paths. Contents travel only to meet the choice of one row per blob; paths, spans and counts carry
the blob's address.

A span is [start, end) in code points. Rules are patterns whose matches are leftmost and do not overlap within the rule;
a match that fails its length condition is dropped. Positions come from the lengths of what lies between the matches.
Null contents count as empty; repeated rows keep a result row each; equal contents share their findings; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """`least`: characters that the group must have for the match to count."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run that is long enough is the same match as the whole run with the short ones dropped
RULES = (
    Rule("assign", 1, ASSIGN, 2, 8),
    Rule("access", 1, r"(AKIA[A-Z0-9]{12,})", 1, 16),
    Rule("hex", 1, r"([0-9a-f]{32,})", 1, 32),
    Rule("provider", 1, r"(gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 12),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind: string, start: int, end: int>>"


def _spans(text: str, rule: Rule) -> Column:
    """Spans of one rule: matches and the pieces between them, their lengths summed up."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), part.alias("p")), lambda b, m: F.struct(
        F.length(b).alias("gap"), F.length(m["w"]).alias("n"), F.length(m["p"]).alias("own")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    walked = F.aggregate(steps, zero, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["n"]).alias("at"),
        F.when(s["own"] >= rule.least, F.concat(acc["out"], F.array(F.struct(
            F.lit(rule.kind).alias("kind"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["n"]).alias("end")))))
        .otherwise(acc["out"]).alias("out")))["out"]
    return F.when(F.col(text).rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`versions` (path, text) against `rules`: (path, blob) of all rows, and the ledger (blob, kind, version, spans) brought up to date.

    `ledger` is what an earlier run returned. Its pairs of blob and rule version are not scanned again.
    """
    rows = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = written(rows.select("path", "blob"), "paths")
    one = paths.groupBy("blob").agg(F.min("path").alias("path"))
    todo = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        one = one.withColumn("todo", todo)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
        one = one.join(known, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("known", F.array().cast("array<struct<kind:string,version:int>>"))))
        one = one.filter(F.size("todo") > 0)
    one = one.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "todo")
    unseen = rows.join(one.hint("shuffle_hash"), rows.path.eqNullSafe(F.col("_path")) & (rows.blob == F.col("_blob")))
    own = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(
        F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), _spans("text", r)).alias("spans")) for r in rules]
    found = unseen.select("blob", F.inline(F.array(*own))).filter("spans is not null")
    # a path may repeat with the same content
    found = found.dropDuplicates(["blob", "kind", "version"])
    if ledger is not None:
        found = found.unionByName(ledger.select(*found.columns))
    return paths, found


def findings(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): counts by base kind, a digest of the base spans, and all spans."""
    paths, ledger = scan(docs.select(F.col("doc_id").alias("path"), "text"))
    order = F.create_map(*[x for n, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(n))])
    hit = ledger.filter(F.size("spans") > 0).select("blob", F.inline("spans")).groupBy("blob").agg(F.sort_array(F.collect_list(
        F.struct("start", order[F.col("kind")].alias("order"), "kind", "end"))).alias("spans"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("bigint")
    hit = hit.select("blob", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
    # as a table, so that the join reads both sides from plain shuffles and a very common blob can be split
    out = paths.join(written(hit, "findings"), "blob", "left")
    return out.select(F.col("path").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in BASE],
                      F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _oracle() -> str:
    """The same spans in SQL: pieces between the matches, and running sums over both."""
    quoted = lambda p: p.replace("'", "''")
    parts = [f"""SELECT text, '{r.kind}' AS kind, {n} AS o, unnest(range(1, len(w) + 1)) AS i, w, g,
      string_split_regex(text, '{quoted(r.pattern)}') AS p, {r.least} AS least
      FROM (SELECT text, regexp_extract_all(text, '{quoted(r.pattern)}', 0) AS w, regexp_extract_all(text, '{quoted(r.pattern)}', {r.group}) AS g FROM t) x"""
             for n, r in enumerate(RULES)]
    lengths = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)"
    return f"""
WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT text, kind, o, CAST({lengths} AS BIGINT) AS a, CAST({lengths} + length(w[i]) AS BIGINT) AS b FROM m WHERE length(g[i]) >= least),
h AS (SELECT text, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (WHERE kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans FROM s GROUP BY text)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN h ON coalesce(d.text, '') = h.text
"""


ORACLE = _oracle()
