"""Staged partitions, table sinks and keyed upserts on parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.keyed import first_per_key
from ..operators.sets import additive_schema

# fixed values: document keys a user may store
ALLOWED_KEYS = ["swimmer", "my_list", "crm_data", "vibe_state", "other_prefs", "preferences"]


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def staged_ids(spark: SparkSession, root: str, key: str = "bundle_id") -> DataFrame:
    """Every id with the status of its last attempt and, where that failed, why. Reads the stage markers only."""
    marks = f"{root}/_marks"
    if not path_exists(spark, marks):
        return spark.createDataFrame([], f"{key} string, status string, error string")
    d = spark.read.parquet(marks)
    return first_per_key(d, [key], [F.desc("attempt")]).select(key, "status", "error")


def attempted(rows: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`work` over the rows, a part of one id's rows at a time; what it raises becomes a row (key, _error) instead of the end
    of the job. The other columns follow `schema`, which has the key too."""
    kind = T._parse_datatype_string(schema)

    def run(batches):
        for d in batches:
            for name, part in d.groupby(key, sort=False, dropna=False):
                try:
                    out = work(part).assign(_error=None)[[*kind.names, "_error"]]
                except Exception as e:  # noqa: BLE001 - recorded with its id
                    out = pd.DataFrame({c: [name if c == key else None] for c in kind.names} | {"_error": [f"{type(e).__name__}: {e}"]}, dtype=object)
                yield out

    return rows.mapInPandas(run, T.StructType([*kind.fields, T.StructField("_error", T.StringType())]))


def stage_partitions(rows: DataFrame, ids: DataFrame, root: str, key: str = "bundle_id", work: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                     schema: str | None = None) -> DataFrame:
    """Write one partition per id that is not staged yet; an id without rows gets an empty-stage marker. Returns the
    markers. Running it again adds what is missing and tries again what failed.

    `work` makes an id's rows (of `schema`) from parts of them. An id for which it raises is marked failed, with the error, and
    none of its rows is staged; the others go on.
    """
    spark = rows.sparkSession
    before = staged_ids(spark, root, key)
    todo = ids.select(key).distinct().join(before.filter("status <> 'failed'").select(key), key, "left_anti")
    fresh = rows.join(todo, key, "left_semi")
    attempt = spark.read.parquet(f"{root}/_marks").agg(F.max("attempt")).first()[0] + 1 if path_exists(spark, f"{root}/_marks") else 0
    failed = spark.createDataFrame([], f"{key} string, error string")
    if work is not None:
        # the work is done once, whatever reads its rows
        done = f"{root}/_work/{attempt}"
        attempted(fresh, key, work, schema).write.mode("overwrite").parquet(done)
        tried = spark.read.parquet(done)
        failed = tried.filter("_error is not null").groupBy(key).agg(F.min("_error").alias("error"))
        fresh = tried.filter("_error is null").drop("_error").join(failed, key, "left_anti")
    # many tasks may write one partition, so a hot id is not pulled into a single file
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{root}/data")
    have = fresh.select(key).distinct().withColumn("_have", F.lit(True))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_have"), "staged").otherwise("empty")
    marks = todo.join(have, key, "left").join(failed, key, "left").select(key, status.alias("status"), "error", F.lit(attempt).alias("attempt"))
    marks.write.mode("append").parquet(f"{root}/_marks")
    return staged_ids(spark, root, key).select(key, "status")


def read_stages(spark: SparkSession, root: str) -> DataFrame:
    """Union of all stages. Ids keep the type they were staged with, however their folders are named."""
    marks, found = staged_ids(spark, root), spark.read.parquet(f"{root}/data").schema
    key = marks.columns[0]
    kinds = [T.StructField(f.name, marks.schema[key].dataType if f.name == key else f.dataType) for f in found]
    return spark.read.schema(T.StructType(kinds)).parquet(f"{root}/data")


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv") -> None:
    """Fixed columns in fixed order; extra ones are ignored, missing ones written empty."""
    have = set(df.columns)
    out = df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


# ---- upserts ---------------------------------------------------------------------------------------------


def latest_per_key(rows: DataFrame, keys: Sequence[str], updated: str, tie: str) -> DataFrame:
    return first_per_key(rows, list(keys), [F.desc(updated), F.desc(tie)])


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], updated: str, tie: str) -> DataFrame:
    """Last write per key over base and changes; columns new in the changes are added."""
    return latest_per_key(additive_schema(base, changes), keys, updated, tie)


def kv_upsert(base: DataFrame, changes: DataFrame, allowed: Sequence[str] = tuple(ALLOWED_KEYS), user: str = "user_id",
              key: str = "data_key", updated: str = "updated_at", tie: str = "seq") -> DataFrame:
    """Last document per (user, key); keys outside the allowed list are ignored."""
    return upsert(base, changes.filter(F.col(key).isin(list(allowed))), [user, key], updated, tie)


def kv_load(table: DataFrame, schema: str, user: str = "user_id", key: str = "data_key", value: str = "data_value") -> DataFrame:
    """Documents with their JSON parsed; text that does not parse stays available as text."""
    return table.select(user, key, value, F.from_json(value, schema).alias("doc"))


def cache_upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], updated: str, tie: str) -> DataFrame:
    return upsert(base, changes, keys, updated, tie)


def cache_hit(first: str = "known_for", second: str = "campus_life_main"):
    """A row that carries cost data only is a miss."""
    return (F.length(F.coalesce(F.col(first), F.lit(""))) > 0) | (F.length(F.coalesce(F.col(second), F.lit(""))) > 0)
