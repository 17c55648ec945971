"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask names six of eight neighbouring token positions; the other two are ignored. The seeds of the benchmark items are
joined with those of the documents, and each hit is verified along its diagonal: a document overlaps an item when at
least 11 tokens are equal within 13 neighbouring item positions (for items of fewer than 11 tokens: all of them). The two
masks together hit every such overlap, whichever two tokens were substituted (a test tries all cases). An item of fewer
than eight tokens holds no mask; its seed is the hash of the whole item, and it overlaps where all its tokens stand in a row.

A document's token hashes stay in its row; a seed is computed from them, looked up, and only hits leave the row. The
seeds of the benchmark are counted first and broadcast within `max_broadcast` rows; for a larger
benchmark the seeds of both sides meet by shuffle, without texts. No document is sampled or cut.

Tokens are maximal runs of letters and digits in lower case. Items without a token match nothing. Null texts count as empty; repeated rows and equal ids add to one result row per (doc_id, item_id); ties between
diagonals go to the smaller start; further columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SPAN = 8
WITHIN = 13
NEEDED = 11
TOKEN = r"[\p{L}\p{N}]+"
MAX_BROADCAST = 1_000_000


def _hashed(text: str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per position `i` and mask with its seed `h`; `tokens` holds the token hashes of the row."""
    at = rows.filter(F.size("tokens") >= SPAN).select(*keep, F.explode(F.sequence(F.lit(0), F.size("tokens") - SPAN)).alias("i"))
    seeds = [F.xxhash64(F.lit(n), *[F.get("tokens", F.col("i") + p) for p in mask]) for n, mask in enumerate(MASKS)]
    return at.select(*keep, "i", F.explode(F.array(*seeds)).alias("h"))


def _runs(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """One row per position and each size of `sizes` that fits behind it, with the hash of these tokens."""
    at = rows.filter(F.size("tokens") >= min(sizes)).select(*keep, F.explode(F.sequence(F.lit(0), F.size("tokens") - min(sizes))).alias("i"))
    run = lambda n: F.when(F.col("i") + n <= F.size("tokens"), F.xxhash64(F.lit(len(MASKS) + n), *[F.get("tokens", F.col("i") + p) for p in range(n)]))
    return at.select(*keep, "i", F.explode(F.array_compact(F.array(*[run(n) for n in sizes]))).alias("h"))


def overlaps(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_equal, item_tokens, doc_start) of every overlap, on its diagonal with the most equal tokens."""
    bench = written(items.select("item_id", _hashed("text").alias("tokens")).distinct(), "benchmark")
    named = bench.withColumn("item", F.xxhash64("tokens"))
    # at most SPAN - 1 sizes
    short = sorted(r["n"] for r in bench.select(F.size("tokens").alias("n")).filter(F.col("n").between(1, SPAN - 1)).distinct().collect())
    own = _seeds(named, ["item", "tokens"])
    for n in short:
        own = own.unionByName(_runs(named.filter(F.size("tokens") == n), ["item", "tokens"], [n]))
    seeds = written(own.select("h", "item", F.col("i").alias("j"), F.size("tokens").alias("n")).distinct(), "seeds")
    looked = lambda d, keep: _seeds(d, keep).unionByName(_runs(d, keep, short)) if short else _seeds(d, keep)
    rows = docs.select("doc_id", _hashed("text").alias("tokens")).withColumn("row", F.xxhash64("tokens"))
    # the item's first position on a diagonal may lie before the document; absent tokens are null
    start = F.col("i") - F.col("j")
    on_diagonal = F.slice("tokens", F.greatest("doc_start", F.lit(0)) + 1, F.col("n") + F.least("doc_start", F.lit(0)))
    if seeds.count() <= max_broadcast:
        hits = looked(rows, ["doc_id", "row", "tokens"]).join(F.broadcast(seeds), "h")
        hits = hits.select("doc_id", "row", "item", "n", "tokens", start.alias("doc_start"))
    else:
        # seeds alone go through the shuffle; the documents that were hit come in afterwards
        narrow = looked(rows, ["doc_id", "row", "tokens"]).select("doc_id", "row", "i", "h").join(seeds, "h")
        narrow = narrow.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "item", "n", start.alias("doc_start")).distinct()
        hits = narrow.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).drop("d", "r")
    found = hits.select("doc_id", "row", "item", "doc_start", on_diagonal.alias("own")).groupBy(
        "doc_id", "row", "item", "doc_start").agg(F.first("own").alias("own"))
    wanted = bench.withColumn("item", F.xxhash64("tokens"))
    both = found.join(wanted, "item")
    equal = F.expr("""transform(sequence(0, size(tokens) - 1),
        j -> coalesce(cast(get(own, j + least(doc_start, 0)) = get(tokens, j) as int), 0))""")
    dense = F.expr(f"""exists(sequence(0, size(tokens) - 1), j -> get(equal, j) = 1
        and aggregate(slice(equal, j + 1, {WITHIN}), 0, (n, e) -> n + e) >= least({NEEDED}, size(tokens)))""")
    checked = both.withColumn("equal", equal).filter(dense)
    n_equal = F.aggregate("equal", F.lit(0), lambda n, e: n + e)
    best = F.max(F.struct(n_equal.alias("n"), (-F.col("doc_start")).alias("s")))
    out = checked.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max(F.size("tokens")).alias("item_tokens"))
    return out.select("doc_id", "item_id", F.col("b.n").alias("n_equal"), "item_tokens", (-F.col("b.s")).alias("doc_start"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that overlap no item. Rows without an id stay unless such a row overlaps."""
    bad = overlaps(docs, items).select(F.col("doc_id").alias("bad")).distinct()
    return docs.select(F.struct("*").alias("d")).join(bad, F.col("d.doc_id").eqNullSafe(F.col("bad")), "left_anti").select("d.*")


ORACLE = rf"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM benchmark),
dt AS (SELECT doc_id, md5(array_to_string(w, ' ')) AS r, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS j FROM b),
m AS (SELECT doc_id, r, item_id, n, i - j AS s, j FROM dt JOIN bt USING (t)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, r, item_id, s ORDER BY j RANGE BETWEEN CURRENT ROW AND {WITHIN - 1} FOLLOWING) AS near,
  count(*) OVER (PARTITION BY doc_id, r, item_id, s) AS n_equal FROM m),
g AS (SELECT DISTINCT doc_id, item_id, n, s, n_equal FROM c WHERE near >= least({NEEDED}, n))
SELECT doc_id, item_id, CAST(n_equal AS INT) AS n_equal, CAST(n AS INT) AS item_tokens, CAST(s AS INT) AS doc_start
FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, s) = 1
"""
