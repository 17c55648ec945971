"""Ranked lexical search: impact vectors in buckets of like length, pruned as in LEMP, survivors rescored in integers.

A document's vector holds the impact of every term that some item asks for; an item's vector holds the weights of its
terms; the score is their inner product. One pass over the documents counts the terms and writes them as numbers; length
statistics and document frequencies cover all documents. A task orders the vectors it reads by their Euclidean length and
cuts them into buckets; whatever reads them, a bucket is bounded in rows and entries. For an item and its threshold (the
score of its k-th best so far):

* Cauchy-Schwarz: where the item's length times the longest vector of a bucket is below the threshold, this bucket and all
  shorter ones are skipped.
* Coordinate bounds: the rarest coordinates come first, until the others, each at the largest impact that the bucket holds,
  stay below the threshold. Only documents that hold one of these are candidates. A candidate goes on if its sum so far plus
  the smaller of two bounds of the rest (largest impacts, or Cauchy-Schwarz of the lengths that remain) reaches the threshold.
* The scores of the survivors are summed in 64-bit integers from all their coordinates.

The thresholds come from a first round over the longest bucket of every task and rise as a task goes on; scores equal to a
threshold are kept, so ties are decided over all documents. Items are taken in blocks of `BLOCK` characters (a single item
is the smallest block); what is broadcast is one block's terms and weights.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased. Null and
empty texts have no term and don't count. Every row is a document of its own; equal scores go by doc_id, null ids last.
Rows of one item_id (null is an id too) are one item that asks for all their terms; items without a term that occurs get
no rows. Long texts are read in pieces; further columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, texts, written
from .words import counted, words

TOP = 50
BLOCK = 4_000_000
ENTRIES = 1 << 20
ROWS = 16_384
BUCKET = 1024
RATIO = 0.9
_SLACK = 1 + 1e-9


def _counter(known):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}
        for b in slices(batches):
            n, ends, terms, tfs = [], [0], [], []
            for text in texts(b.column("text")):
                total, found = counted(text, number)
                n.append(total)
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], schema=schema).filter(pa.array(np.array(n) > 0))

    return count


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Impact of a term that occurs `tf` times in a document of `n` terms, among `docs` documents of `length` terms together."""
    m = 50 + (50 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Vectors:
    """Impact vectors, the longest first. Entry k of a row: term and impact; `ends` are the rows' ends."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), impact.astype(float) ** 2, len(sizes))
        order = np.argsort(-squares, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        self.ids, self.missing, self.squares, self.sizes = ids[order], missing[order], squares[order], sizes[order]
        self.ends = np.cumsum(self.sizes)
        take = np.repeat(starts - (self.ends - self.sizes), self.sizes) + np.arange(len(terms))
        self.terms, self.impact = terms[take], impact[take]

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], docs: int, length: int) -> "Vectors":
        t = pa.Table.from_batches(batches).combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in batches]).astype(np.int64)
        n, tf = t.column("n").to_numpy(), flat("tfs").astype(np.int64)
        ids = t.column("doc_id").combine_chunks()
        return cls(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, flat("terms"), impacts(tf, np.repeat(n, sizes), docs, length))

    def first(self, rows: int) -> "Vectors":
        """The longest `rows` vectors."""
        end = int(self.sizes[:rows].sum())
        return Vectors(self.ids[:rows], self.missing[:rows], self.sizes[:rows], self.terms[:end], self.impact[:end])

    def joined(self, other: "Vectors") -> "Vectors":
        return Vectors(*[np.concatenate([getattr(v, c) for v in (self, other)]) for c in ("ids", "missing", "sizes", "terms", "impact")])


class Buckets:
    """Buckets of `vectors`, each with its entries by coordinate and every coordinate's largest impact."""

    def __init__(self, vectors: Vectors, coordinates: int):
        self.v = vectors
        norms = np.sqrt(vectors.squares)
        self.bounds, at = [], 0
        while at < len(norms):
            end = min(at + BUCKET, max(at + 1, int(np.searchsorted(-norms, -RATIO * norms[at], side="right"))))
            if end - at < BUCKET // 8:
                end = min(at + BUCKET // 8, len(norms))
            self.bounds.append((at, end))
            at = end
        self.longest = norms[[a for a, _ in self.bounds]] if self.bounds else norms
        row = np.repeat(np.arange(len(norms)), vectors.sizes)
        bucket = np.repeat(np.arange(len(self.bounds)), [b - a for a, b in self.bounds])
        key = vectors.terms.astype(np.int64) * max(len(self.bounds), 1) + bucket[row]
        order = np.argsort(key, kind="stable")
        self.row, self.impact = row[order], vectors.impact[order]
        count = np.bincount(key, minlength=coordinates * len(self.bounds))
        self.stop = np.cumsum(count).reshape(coordinates, -1)
        self.start = self.stop - count.reshape(coordinates, -1)
        top = np.zeros(count.size, np.int64)
        full = np.flatnonzero(count)
        if len(full):
            top[full] = np.maximum.reduceat(self.impact, self.start.ravel()[full])
        self.top = top.reshape(coordinates, -1)

    def reaching(self, b: int, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of bucket `b` with a score above 0 and of at least `threshold`. `terms` go from rare to frequent
        with their `weights`; `dense` holds the weights of all coordinates."""
        at, end = self.bounds[b]
        largest = self.top[terms, b] * weights
        rest = np.cumsum(largest[::-1])[::-1]
        lengths = np.sqrt(np.cumsum((weights.astype(float) ** 2)[::-1])[::-1])
        focus = int(np.count_nonzero(np.minimum(rest, lengths * self.longest[b]) * _SLACK >= max(threshold, 1)))
        spans = [(self.start[t, b], self.stop[t, b], w) for t, w in zip(terms[:focus], weights[:focus])]
        spans = [s for s in spans if s[1] > s[0]]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.concatenate([self.row[s:e] for s, e, _ in spans]) - at
        part = np.concatenate([self.impact[s:e] for s, e, _ in spans])
        w = np.repeat([w for *_, w in spans], [e - s for s, e, _ in spans])
        so_far = np.bincount(row, part * w, end - at)
        used = np.bincount(row, part.astype(float) ** 2, end - at)
        found = np.flatnonzero(so_far)
        left = np.zeros(len(found))
        if focus < len(terms):
            left = np.minimum(float(rest[focus]), lengths[focus] * np.sqrt(np.maximum(self.v.squares[at + found] * _SLACK - used[found], 0)))
        found = at + found[(so_far[found] + left) * _SLACK >= threshold]
        sizes = self.v.sizes[found]
        ends = np.cumsum(sizes)
        take = np.repeat(self.v.ends[found] - ends, sizes) + np.arange(sizes.sum())
        scores = np.add.reduceat(dense[self.v.terms[take]] * self.v.impact[take], ends - sizes) if len(found) else np.zeros(0, np.int64)
        good = (scores >= threshold) & (scores > 0)
        return found[good], scores[good]


class Best:
    """The best `top` of one item so far."""

    def __init__(self, threshold: int, top: int):
        self.threshold, self.top = threshold, top
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if len(scores):
            s, i, m = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.missing, missing)))
            order = np.lexsort((i, m, -s))[:self.top]
            self.scores, self.ids, self.missing = s[order], i[order], m[order]
            if len(order) == self.top:
                self.threshold = max(self.threshold, int(self.scores[-1]))


def _searched(vectors: Vectors, asked: list[tuple[np.ndarray, np.ndarray]], coordinates: int, best: list[Best]) -> None:
    buckets = Buckets(vectors, coordinates)
    dense = np.zeros(coordinates, np.int64)
    for (terms, weights), own in zip(asked, best):
        length = math.sqrt(float((weights.astype(float) ** 2).sum()))
        dense[terms] = weights
        for b in range(len(buckets.bounds)):
            if length * buckets.longest[b] * _SLACK < max(own.threshold, 1):
                break
            rows, scores = buckets.reaching(b, terms, weights, dense, own.threshold)
            own.add(scores, vectors.ids[rows], vectors.missing[rows])
        dense[terms] = 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, of at most `ROWS` rows and about `ENTRIES` entries."""
    held, rows, entries = [], 0, 0
    for b in slices(batches):
        held.append(b)
        rows, entries = rows + b.num_rows, entries + len(b.column("terms").flatten())
        if rows >= ROWS or entries >= ENTRIES:
            yield held
            held, rows, entries = [], 0, 0
    if rows:
        yield held


def _searcher(plan, first_only: bool, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked, coordinates, docs, length, thresholds = plan.value
        best = [Best(t, top) for t in thresholds]
        longest = None
        for block in _blocks(batches):
            vectors = Vectors.of(block, docs, length)
            if first_only:
                longest = vectors.first(BUCKET) if longest is None else longest.joined(vectors.first(BUCKET)).first(BUCKET)
            else:
                _searched(vectors, asked, coordinates, best)
        if longest is not None:
            _searched(longest, asked, coordinates, best)
        number = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        if len(number):
            whole = lambda c: np.concatenate([getattr(b, c) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), items.take(pa.array(number)), pa.array(whole("ids"), mask=whole("missing")), pa.array(whole("scores"))],
                                             names=["item", "item_id", "doc_id", "score"])

    return search


def _ranked(docs: DataFrame, wanted: dict, item_kind: str, top: int) -> DataFrame:
    """The ranking of one block of items: {item_id: terms}."""
    spark = docs.sparkSession
    known = sorted(set().union(*wanted.values()))
    number = {t: i for i, t in enumerate(known)}
    counts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _counter(spark.sparkContext.broadcast(known)), "doc_id bigint, n bigint, terms array<int>, tfs array<int>")
    counts = written(counts, "terms")
    total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(known), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    asked, items = [], []
    for item, terms in wanted.items():
        own = np.array([number[t] for t in terms if df[number[t]]], np.int64)
        w = np.array([weight(int(df[t]), total["docs"]) for t in own], np.int64)
        order = np.lexsort((own, -w))
        asked.append((own[order], w[order]))
        items.append(item)
    plan = [pa.array(items), asked, len(known), total["docs"], max(total["length"], 1)]
    schema = f"item int, item_id {item_kind}, doc_id bigint, score bigint"
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def round_of(thresholds: list[int], first_only: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((*plan, thresholds))
        found = counts.mapInArrow(_searcher(shared, first_only, top), schema)
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)

    thresholds = [0] * len(items)
    for r in round_of(thresholds, True).filter(F.col("rank") == top).select("item", "score").toLocalIterator():
        thresholds[r["item"]] = r["score"]
    return round_of(thresholds, False).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents (doc_id, text) of every row of `items` (item_id, text)."""
    kind = dict(items.dtypes)["item_id"]
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block))
    rows = items.select("item_id", F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))
    out = None
    for n in range(blocks):
        wanted: dict = {}
        for r in rows.filter(F.col("block") == n).filter("text is not null").toLocalIterator():
            for part in words(r["text"]):
                wanted.setdefault(r["item_id"], set()).update(part)
        if wanted:
            found = _ranked(docs, wanted, kind, top)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint") if out is None else out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
o AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM o, c GROUP BY t),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN o USING (t) JOIN f USING (t), c GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= {TOP}
"""
