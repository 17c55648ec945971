"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader under elastic-net penalties, then temperature-calibrated.

Features are character 1- to 3-grams of the lower-case text, every run of non-letters one space, hashed to `BUCKETS`
numbers. Term frequency is the share of the text's n-grams; document frequencies are counted over all training rows and
whole texts. The model is fitted on at most `PER_CLASS` rows of each label, the ones with the smallest hash of their id;
one in five of those sets the temperature only. Prediction is one pass over whole texts: the weights times the inverse
document frequencies are one table of bounded size, and a text's scores are means over its n-grams.

Null texts, texts without a letter, and all texts where nothing is labelled are `und` with score 0. A tie goes to the
label that sorts first. Repeated rows and equal ids keep a row each; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, held_out, sample_per_class, segment_sums, slices, texts
from .ftrl import Penalties, softmax, temperature, train

BUCKETS = 1 << 16
PER_CLASS = 400
PENALTIES = Penalties(alpha=1.0, l1=0.01, l2=0.01, epochs=3)
SCALE = 20.0


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _ngrams(docs: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By length of n-gram: the bucket of every n-gram of all texts in order, and the number per text; and which texts have a letter."""
    lowered = [d.lower() for d in docs]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    chars = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    owner = np.repeat(np.arange(len(docs)), sizes)
    # the blank that closes a text stays; of other runs of non-letters the first one
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.where(letter, chars, np.uint32(32))[keep]
    owner = owner[keep]
    has = segment_sums(letter.astype(np.int64), sizes) > 0
    mix = np.uint32(2654435761)
    grams, owners = [], []
    h = np.zeros(len(chars), np.uint32)
    for k in range(3):
        if len(chars) <= k:
            break
        h = (h[: len(chars) - k] ^ chars[k:]) * mix + np.uint32(k + 1)
        whole = owner[k:] == owner[: len(owner) - k]
        grams.append(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16))[whole])
        owners.append(owner[: len(owner) - k][whole])
    counts = [np.bincount(o, minlength=len(docs)) for o in owners]
    return grams, counts, has


def _counts_of(docs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, counts, total) of each text."""
    for d in docs:
        grams, _, has = _ngrams([d])
        if len(grams) and has[0]:
            all_ = np.concatenate(grams)
            idx, n = np.unique(all_, return_counts=True)
            yield idx.astype(np.int64), n, len(all_)
        else:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), 0


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in slices(batches):
        for part in _parts(texts(b.column("text"))):
            grams, counts, has = _ngrams(part)
            bounds = [np.concatenate(([0], np.cumsum(c))) for c in counts]
            for i in np.flatnonzero(has):
                seen = np.zeros(BUCKETS, bool)
                for g, at in zip(grams, bounds):
                    seen[g[at[i]:at[i + 1]]] = True
                df += seen
                n += 1
    full = np.flatnonzero(df)
    schema = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])
    yield from arrow_batches({"bucket": np.concatenate((full, [-1])), "df": np.concatenate((df[full], [n]))}, schema)


def _parts(docs: list[str], chars: int = 1 << 18) -> Iterator[list[str]]:
    """Runs of texts of about a quarter of a million characters together: numpy works on them at once, in bounded memory."""
    part, size = [], 0
    for d in docs:
        part.append(d)
        size += len(d)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("lang", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("total", pa.int64())])
    for b in slices(batches):
        got = list(_counts_of(texts(b.column("text"))))
        yield from arrow_batches({
            "key": b.column("key"), "lang": b.column("lang"), "buckets": [g[0] for g in got], "counts": [g[1] for g in got],
            "total": [g[2] for g in got]}, schema)


class Model:
    """Labels, the table of weights times inverse document frequencies, and the temperature."""

    def __init__(self, labels: list[str], table: np.ndarray, heat: float):
        self.labels, self.table, self.heat = labels, table.astype(np.float32), heat

    def scores(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Linear scores (texts, labels), and which texts have a letter."""
        grams, counts, has = _ngrams(docs)
        total = np.zeros(len(docs))
        s = np.zeros((len(docs), len(self.labels)))
        for g, n in zip(grams, counts):
            s += segment_sums(self.table[g], n)
            total += n
        return SCALE * s / np.maximum(total, 1)[:, None], has

    def predict(self, docs: list[str]) -> list[tuple[str, float]]:
        if not self.labels:
            return [("und", 0.0)] * len(docs)
        out = []
        for part in _parts(docs):
            s, has = self.scores(part)
            p = softmax(s / self.heat)
            best = p.argmax(axis=1)
            out += [(self.labels[k], float(p[i, k])) if has[i] else ("und", 0.0) for i, k in enumerate(best)]
        return out


def fit(docs: DataFrame, per_class: int = PER_CLASS, penalties: Penalties = PENALTIES) -> Model:
    """Model from the labelled rows (text, lang) of `docs` that no test holds out."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    df = rows.select("text").mapInArrow(_document_frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    known = df[df["bucket"] >= 0]
    n_docs = int(df.loc[df["bucket"] < 0, "df"].sum())
    idf = np.zeros(BUCKETS)
    idf[known["bucket"].to_numpy()] = np.log((1 + n_docs) / (1 + known["df"].to_numpy())) + 1
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    chosen = sample_per_class(rows.select("doc_id", key.alias("key"), "lang"), "lang", "key", per_class)
    sampled = rows.join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))),
                        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    got = sampled.select(key.alias("key"), "lang", "text").mapInArrow(
        _sample_features, "key string, lang string, buckets array<int>, counts array<int>, total bigint").toPandas()
    got = got[got["total"] > 0].sort_values(["key", "lang", "total"], ignore_index=True)
    labels = sorted(set(got["lang"]))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), 1.0)
    number = {x: i for i, x in enumerate(labels)}
    made = [(np.asarray(b, np.int64), SCALE * np.asarray(c) / t * idf[np.asarray(b, np.int64)], number[x])
            for b, c, t, x in zip(got["buckets"], got["counts"], got["total"], got["lang"])]
    learn = [r for i, r in enumerate(made) if i % 5] or made
    weights = train(learn, BUCKETS, len(labels), penalties)
    rest = made[::5]
    heat = temperature(np.array([v @ weights[i] for i, v, _ in rest]), np.array([y for _, _, y in rest]))
    return Model(labels, weights * idf[:, None], heat)


def _predictor(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = model.value.predict(texts(b.column("text")))
            yield from arrow_batches({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": [g[0] for g in got],
                                      "score": [g[1] for g in got]}, schema)

    return predict


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs`."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        _predictor(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _sieve(model, text: int, least: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = model.value.predict(texts(b.column(text).cast(pa.string())))
            yield b.filter(pa.array([p != "und" and s >= least for p, s in got], pa.bool_()))

    return keep


def with_language(docs: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """The documents whose language is told with a score of `least` or more; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(_sieve(shared, docs.columns.index("text"), least), plain.schema).toDF(*docs.columns)
