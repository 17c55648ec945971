"""Quality score: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates and scored as
sparse dot products.

Words are runs of letters and digits, and runs of other signs are words of their own. A word also has a form: lower case,
capitalised, upper case, with a digit, signs, or the same as the word before. Features are words, pairs of words, and runs
of one to three forms, hashed to `BUCKETS` numbers; the value of a feature is its share of the text.
The model is fitted on at most `PER_CLASS` labelled rows of each label, the ones with the smallest hash of their id.

Empty and null texts have no feature and get the score of the bias alone; so does every text where nothing is labelled
(score 0.5). Repeated rows and equal ids keep a row each; of several labels for an id the largest counts; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, held_out, sample_per_class, segment_sums, slices, texts
from .ftrl import Penalties, sigmoid, train
from .op3_language import _parts

BUCKETS = 1 << 18
BIAS = BUCKETS
PER_CLASS = 1000
PENALTIES = Penalties(alpha=0.3, l1=0.02, l2=0.01, epochs=4)
CUT = 0.7
SCALE = 10.0
LOWER, TITLE, UPPER, DIGIT, SIGNS, AGAIN = range(6)
_R = 0x100000001B3


@cache
def _byte_kinds() -> np.ndarray:
    """0 white space, 1 lower letter or part of a longer character, 2 upper letter, 3 digit, 4 other."""
    kinds = np.full(256, 4, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[ord("a"):ord("z") + 1] = 1
    kinds[128:] = 1
    kinds[ord("A"):ord("Z") + 1] = 2
    kinds[ord("0"):ord("9") + 1] = 3
    return kinds


@cache
def _powers() -> np.ndarray:
    out = [1]
    for _ in range(255):
        out.append((out[-1] * _R + 0x9E37) & (1 << 64) - 1)
    return np.array(out, np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int64)


def _features(docs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (buckets of all texts in order, number per text), one for each kind of feature."""
    raw = [d.encode() for d in docs]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kinds = _byte_kinds()[data]
    group = np.where(kinds == 0, np.uint8(0), np.where(kinds == 4, np.uint8(2), np.uint8(1)))
    start = np.flatnonzero((group != 0) & (group != np.concatenate(([np.uint8(0)], group[:-1]))))
    if not len(start):
        return []
    bounds = np.concatenate((start, [len(data)]))
    lengths = np.diff(bounds)
    at = np.arange(start[0], len(data)) - np.repeat(start, lengths)
    own = data[start[0]:]
    lower = own + np.where(kinds[start[0]:] == 2, np.uint8(32), np.uint8(0))
    value = np.where(kinds[start[0]:] == 0, np.uint64(0), (lower.astype(np.uint64) + np.uint64(7)) * _powers()[at & 255])
    h = np.add.reduceat(value, start - start[0])
    upper = np.add.reduceat((kinds[start[0]:] == 2).astype(np.int32), start - start[0])
    digit = np.add.reduceat((kinds[start[0]:] == 3).astype(np.int32), start - start[0])
    ink = np.add.reduceat((kinds[start[0]:] != 0).astype(np.int32), start - start[0])
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    form = np.where(upper == 0, LOWER, np.where((upper == 1) & (ink > 1), TITLE, UPPER))
    form = np.where(digit > 0, DIGIT, form)
    form = np.where(group[start] == 2, SIGNS, form)
    together = owner[1:] == owner[:-1]
    form[1:][together & (h[1:] == h[:-1])] = AGAIN
    n = len(docs)
    count = lambda who: np.bincount(who, minlength=n)
    salt = lambda x: np.uint64(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    pair = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
    f = form.astype(np.uint64)
    three = together[1:] & together[:-1]
    return [
        (_bucket(h ^ salt(1)), count(owner)),
        (_bucket(pair[together] ^ salt(2)), count(owner[1:][together])),
        (_bucket(f + salt(3)), count(owner)),
        (_bucket((f[:-1] * np.uint64(8) + f[1:])[together] + salt(4)), count(owner[1:][together])),
        (_bucket((f[:-2] * np.uint64(64) + f[1:-1] * np.uint64(8) + f[2:])[three] + salt(5)), count(owner[2:][three])),
    ]


def _sparse(doc: str) -> tuple[np.ndarray, np.ndarray]:
    got = _features([doc])
    if not got:
        return np.zeros(0, np.int64), np.zeros(0)
    idx, n = np.unique(np.concatenate([g for g, _ in got]), return_counts=True)
    return idx, n / sum(len(g) for g, _ in got)


class Model:
    def __init__(self, weights: np.ndarray):
        self.bias, self.table = float(weights[BIAS]), weights[:BUCKETS].astype(np.float32)

    def scores(self, docs: list[str]) -> np.ndarray:
        out = []
        for part in _parts(docs):
            s, total = np.zeros(len(part)), np.zeros(len(part))
            for g, n in _features(part):
                s += segment_sums(self.table[g], n)
                total += n
            out.append(sigmoid(self.bias + SCALE * s / np.maximum(total, 1)))
        return np.concatenate(out) if out else np.zeros(0)



def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])
    for b in slices(batches):
        got = [_sparse(t) for t in texts(b.column("text"))]
        yield from arrow_batches({"key": b.column("key"), "label": b.column("label"), "buckets": [g[0] for g in got],
                                  "shares": [g[1] for g in got]}, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, penalties: Penalties = PENALTIES) -> Model:
    """Model from `labels` (doc_id, quality) of documents that no test holds out."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    have = docs.select(F.col("doc_id")).distinct().join(known, "doc_id").withColumn("key", F.col("doc_id").cast("string"))
    chosen = sample_per_class(have, "label", "key", per_class)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("key", "label", "text")
    got = rows.mapInArrow(_sample_features, "key string, label int, buckets array<int>, shares array<float>").toPandas()
    got = got.sort_values(["key", "label"], ignore_index=True)
    if got["label"].nunique() == 0:
        return Model(np.zeros(BUCKETS + 1))
    made = [(np.append(np.asarray(b, np.int32), np.int32(BIAS)), np.append(np.asarray(x, np.float32) * SCALE, np.float32(1)), int(y))
            for b, x, y in zip(got.pop("buckets"), got.pop("shares"), got["label"])]
    w = train(made, BUCKETS + 1, 2, penalties)
    return Model(w[:, 1] - w[:, 0])


def _scorer(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.value.scores(texts(b.column("text")))
            yield from arrow_batches({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s,
                                      "predicted": (s >= CUT).astype(np.int32)}, schema)

    return score


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        _scorer(shared), "doc_id bigint, held_out boolean, score double, predicted int")
