"""Shared helpers: tables, reliable scratch tables, the labelled split, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, scratch_path, short_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: read many times, computed once, and safe when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows kept from every training: the checksum of the id's text leaves remainder 2. A null id counts as its empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_per_class(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """At most `per_class` rows of each label, those with the smallest hash of their key: a bounded training sample.

    The labels (a dimension of at most 10,000 values) are counted first, so that of any label only about twice the sample is
    ever ordered in one place.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    sizes = short_values(rows.groupBy(label).agg(F.count("*").alias("n")), [label, "n"])
    if not sizes:
        return rows.limit(0)
    kind = dict(rows.dtypes)[label]
    most = F.create_map(*[F.lit(x) for name, n in sizes if name is not None for x in (name, min(1 << 30, (2 * per_class + 100) * (1 << 30) // n))])
    few = rows.filter(place < most.cast(f"map<{kind}, bigint>")[F.col(label)]).distinct()
    w = Window.partitionBy(label).orderBy(place, key)
    return few.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_class).drop("rn")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of `rows` rows, so that few texts at a time are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def arrow_batches(columns: dict[str, object], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, zero for empty ones."""
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in `edges` (u, v); the root is the smallest node of its component.

    Large-star and small-star rounds until the edges no longer change: every round is two aggregations and joins over all
    edges, so a component of any size is never gathered in one task. Each round is checkpointed.
    """
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
