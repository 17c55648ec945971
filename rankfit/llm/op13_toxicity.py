"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, and calibrated votes.

* Examples. At most `PER_CLASS` labelled texts of each label, one per distinct text (of several labels for an id or a text
  the largest counts), those with the smallest hash.
* Vectors. The coordinates are the words whose presence goes with the label: significant in a chi-squared test over the
  examples at `LEVEL` for all tested words together, those of at least `TESTED` examples (at most the `MAX_TERMS` strongest). A word's value is (1 + ln tf) ln((N + 1) / (df + 1/2)), N and df counted
  over all documents. Vectors have length 1.
* Index. Examples lie in blocks of `BLOCK`, like ones together. A word has its postings and its largest value by block. A
  document's products with those largest values bound its cosines in a block; blocks are opened in falling order of their
  bound, until the next bound is below the k-th best cosine found. So the `NEIGHBOURS` nearest are exact (ties: the
  example with the smaller number).
* Score. Neighbours vote with 1 / (distance + `NEAR`), distance being 1 - cosine, times how many labelled texts an example
  of its label stands for. A logistic curve fitted to the votes of the examples among each other (each without itself)
  makes the vote's share a probability. A document without any of the words, or without a neighbour that shares one, gets
  the share of label 1 among such examples. `evidence` lists the nearest as (doc_id, label, cosine).

The driver holds the chosen words and the examples' vectors, bounded by `PER_CLASS` and `MAX_TERMS`, not by the length of
texts; every task holds the index made of them.

Null and empty texts count as a document without words. Repeated rows and equal ids keep a row each; rows without an id are
scored, never learned from. Long texts are read whole, in pieces. Further columns are ignored. Where nothing is labelled
every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import sample_per_class, slices, texts, written
from .words import counted, words

PER_CLASS = 1000
LEVEL = 0.05
TESTED = 5
MAX_TERMS = 20_000
NEIGHBOURS = 21
BLOCK = 64
NEAR = 0.1
PRIOR = 0.5
SHOWN = 5
TOGETHER = 8192
CUT = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: the checksum of the id's text divides by 5. A null id counts as its empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        for row, label, text in zip(b.column("row"), b.column("label"), texts(b.column("text"))):
            own = sorted(set().union(*words(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(own), t) for x, t in ((row, pa.int64()), (label, pa.int32()))] + [pa.array(own, pa.binary())],
                                             names=["row", "label", "term"])


def _counter(known):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}
        for b in slices(batches):
            found = [counted(t, number)[1] for t in texts(b.column("text"))]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array([x for f in found for x in sorted(f.items())] and [x[k] for f in found for x in sorted(f.items())], pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *lists], names=["doc_id", "row", "terms", "tfs"])

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each word, so that only sums are shuffled."""
    total = np.zeros(0, np.int64)
    for b in batches:
        own = np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        own[:len(total)] += total
        total = own
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["t", "n"])


class Index:
    """Unit vectors of the examples by word, in blocks."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.idf, self.size = idf, len(vectors)
        # like ones together: by the heaviest word
        heaviest = [int(t[np.argmax(v)]) if len(t) else -1 for t, v in vectors]
        self.order = np.lexsort((np.arange(len(vectors)), heaviest))
        place = np.empty(len(vectors), np.int64)
        place[self.order] = np.arange(len(vectors))
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        value = np.concatenate([v for _, v in vectors] or [np.zeros(0)])
        at = np.repeat(place, [len(t) for t, _ in vectors])
        key = term * self.blocks + at // BLOCK
        sort = np.lexsort((at, key))
        self.at, self.value = at[sort], value[sort]
        count = np.bincount(key, minlength=len(idf) * self.blocks)
        self.stop = np.cumsum(count).reshape(len(idf), self.blocks)
        self.count = count.reshape(len(idf), self.blocks)
        top = np.zeros(count.size)
        full = np.flatnonzero(count)
        if len(full):
            top[full] = np.maximum.reduceat(self.value, (self.stop - self.count).ravel()[full])
        self.top = top.reshape(len(idf), self.blocks)

    def unit(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = (1 + np.log(tf)) * self.idf[terms]
        return v / max(np.sqrt((v * v).sum()), 1e-300)

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the `k` nearest with a cosine above 0, nearest first; `without` is left out."""
        bound = values @ self.top[terms]
        opened = np.argsort(-bound, kind="stable")
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in opened:
            if bound[b] <= 0 or len(found) >= k and bound[b] * (1 + 1e-9) < cosines[k - 1]:
                break
            n = self.count[terms, b]
            ends = np.cumsum(n)
            take = np.repeat(self.stop[terms, b] - ends, n) + np.arange(ends[-1])
            low = b * BLOCK
            dots = np.bincount(self.at[take] - low, self.value[take] * np.repeat(values, n), BLOCK)
            hit = np.flatnonzero(dots)
            example = self.order[low + hit]
            found, cosines = np.concatenate((found, example)), np.concatenate((cosines, dots[hit]))
            best = np.lexsort((found, -cosines))
            found, cosines = found[best], cosines[best]
            own = found != without
            found, cosines = found[own][:k], cosines[own][:k]
        return found, cosines


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with a small ridge that pulls to slope 1 and offset 0."""
    at, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        slope = design.T @ (w * (p - y)) + 0.01 * (at - [1.0, 0.0])
        step = np.linalg.solve((design * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 0.01 * np.eye(2), slope)
        at = at - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    return float(at[0]), float(at[1])


class Model:
    def __init__(self, known: list[bytes], index: Index, ids: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, k: int):
        self.known, self.index, self.ids, self.labels, self.stands_for, self.k = known, index, ids, labels, stands_for, k
        self.curve, self.alone = (1.0, 0.0), 0.0

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the weighted votes, with `PRIOR` votes of an example of each label beside them."""
        w = self.stands_for[self.labels[found]] / (1 - np.minimum(cosines, 1) + NEAR)
        ones = (w * self.labels[found]).sum()
        own = np.maximum(self.stands_for, 1) * PRIOR
        return float(np.log(ones + own[1]) - np.log(w.sum() - ones + own[0]))

    def calibrated(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> "Model":
        """With the curve fitted to the examples' votes, each without itself."""
        votes, truth, alone = [], [], [1.0, 1.0]
        for i, (t, v) in enumerate(vectors):
            found, cosines = self.index.nearest(t, v, self.k, i) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
            if len(found):
                votes.append(self.vote(found, cosines))
                truth.append(self.labels[i])
            else:
                alone[self.labels[i]] += self.stands_for[self.labels[i]]
        self.alone = alone[1] / sum(alone)
        if votes:
            y = np.array(truth)
            self.curve = _logistic(np.array(votes), y, self.stands_for[y] / max(self.stands_for.max(), 1))
        return self

    def score(self, terms: np.ndarray, tf: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability of label 1, and the nearest examples with their cosines."""
        found, cosines = self.index.nearest(terms, self.index.unit(terms, tf), self.k) if len(terms) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(found):
            return self.alone, found, cosines
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.vote(found, cosines) + self.curve[1], -40, 40)))), found, cosines


def examples(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, row, label) of the examples, `row` being the hash of the text, and how many texts an example of label 0 and
    of label 1 stands for."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    have = docs.join(known, "doc_id").groupBy("row").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
    have = written(have, "labelled")
    chosen = written(sample_per_class(have, "label", "row", per_class).select("doc_id", "row", "label"), "examples")
    sizes = {r["label"]: r["n"] for r in have.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return chosen, np.array([sizes.get(y, 0) / max(min(sizes.get(y, 0), per_class), 1) for y in (0, 1)])


def telling_words(docs: DataFrame, chosen: DataFrame, level: float = LEVEL, least: int = TESTED, most: int = MAX_TERMS) -> list[bytes]:
    """The words whose presence in an example goes with its label, in their order."""
    of = F.broadcast(chosen.withColumnsRenamed({"doc_id": "of_doc", "row": "of_row"}))
    rows = docs.join(of, (F.col("row") == F.col("of_row")) & (F.col("doc_id") == F.col("of_doc"))).select("row", "label", "text")
    # rows that repeat give the same words
    terms = rows.mapInArrow(_distinct_words, "row bigint, label int, term binary").distinct()
    seen = terms.groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("a"))
    total = chosen.agg(F.count("*").cast("double").alias("all"), F.sum("label").cast("double").alias("ones")).first()
    if not total["all"] or not 0 < total["ones"] < total["all"]:
        return []
    all_, ones = F.lit(total["all"]), F.lit(total["ones"])
    seen = written(seen.filter(F.col("n") >= least), "tested")
    limit = NormalDist().inv_cdf(1 - level / 2 / max(seen.count(), 1)) ** 2
    cross = F.greatest(F.abs(F.col("a") * all_ - F.col("n") * ones) - all_ / 2, F.lit(0.0))
    other = F.col("n") * (all_ - F.col("n")) * ones * (all_ - ones)
    strong = seen.withColumn("x", F.when(other > 0, all_ * cross * cross / other).otherwise(0.0)).filter(F.col("x") >= limit)
    return sorted(bytes(r["term"]) for r in strong.orderBy(F.desc("x"), "term").limit(most).collect())


def fit(docs: DataFrame, counts_of, labels: DataFrame, per_class: int, k: int) -> tuple[Model, DataFrame]:
    """The model, and the word counts of all documents, dealt out anew: their table is small, but scoring takes its time."""
    chosen, stands_for = examples(docs, labels, per_class)
    known = telling_words(docs, chosen)
    counts = counts_of(known)
    n = counts.count()
    df = np.zeros(len(known))
    for r in counts.select("terms").mapInArrow(_frequencies, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r["t"]] = r["n"]
    # one row of each example, whatever repeats
    own = counts.join(F.broadcast(chosen.withColumnsRenamed({"doc_id": "of_doc", "row": "of_row"})), (F.col("row") == F.col("of_row")) & (F.col("doc_id") == F.col("of_doc")))
    got = own.select("doc_id", "row", "label", "terms", "tfs").distinct().orderBy("row", "doc_id").collect()
    ids, truth = np.array([r["doc_id"] for r in got], np.int64), np.array([r["label"] for r in got], np.int64)
    index = Index(np.log((n + 1) / (df + 0.5)), [])
    vectors = [(t := np.array(r["terms"], np.int64), index.unit(t, np.array(r["tfs"], float))) for r in got]
    return Model(known, Index(index.idf, vectors), ids, truth, stands_for, k).calibrated(vectors), counts.repartition(max(1, -(-n // TOGETHER)))


def _scorer(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.struct(
        [("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())])))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches):
            terms, tfs = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            ends = np.cumsum(b.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            got = [m.score(terms[s:e], tfs[s:e]) for s, e in zip([0, *ends[:-1]], ends)]
            shown = [[{"doc_id": int(m.ids[i]), "label": int(m.labels[i]), "cosine": float(c)} for i, c in zip(found[:SHOWN], cosines)] for _, found, cosines in got]
            scores = np.array([g[0] for g in got])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32)), pa.array(shown, schema.field("evidence").type)], schema=schema)

    return score


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of `docs` (doc_id, text), learned from `labels` (doc_id, toxic)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))

    def counts_of(known: list[bytes]) -> DataFrame:
        return written(rows.mapInArrow(_counter(spark.sparkContext.broadcast(known)), "doc_id bigint, row bigint, terms array<int>, tfs array<int>"), "counts")

    model, counts = fit(rows, counts_of, labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic"), per_class, neighbours)
    out = counts.select("doc_id", "terms", "tfs").mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id bigint, score double, predicted int, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
