"""Unions, deduplication, patches and upserts between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .keyed import first_per_key, top_k_per_key


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def additive_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union that adds columns missing on either side as nulls."""
    return old.unionByName(new, allowMissingColumns=True)


def union_dedupe(parts: Sequence[DataFrame], keys: Sequence[str], group: str, order: Sequence, cap: int | None = None) -> DataFrame:
    """Union in source order; the first source of a key wins; optionally only the best `cap` per group."""
    tagged = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)]
    d = first_per_key(union_all(tagged), keys, ["_src", *order]).drop("_src")
    return top_k_per_key(d, [group], order, cap, "_rn").drop("_rn") if cap else d


def anti_new(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows plus the fresh ones whose keys are not there yet."""
    return existing.unionByName(fresh.join(existing.select(*keys), list(keys), "left_anti"))


def blocklist_filter(rows: DataFrame, blocked: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(blocked.select(key).distinct(), key, "left_anti")


def replace_slice(rows: DataFrame, fresh: DataFrame, entity: str, category: str, url: str = "url", score: str = "score",
                  blocked: DataFrame | None = None, limit: int = 32) -> DataFrame:
    """Replace the (entity, category) slices that occur in `fresh`, minus blocked urls, and trim again."""
    from .assets import trim_per_category

    kept = rows.join(fresh.select(entity, category).distinct(), [entity, category], "left_anti")
    new = blocklist_filter(fresh, blocked, url) if blocked is not None else fresh
    both = kept.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return trim_per_category(both, entity, category, url, score, limit, order="_src").drop("_src")


def patch_columns(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], defaults: dict[str, str]) -> DataFrame:
    """Upsert that touches only some columns; an inserted row gets the defaults elsewhere."""
    p = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    d = base.join(p, base[key] == F.col("_k"), "full_outer")
    inserted, touched = F.col(key).isNull(), F.col("_k").isNotNull()
    out = []
    for c in base.columns:
        if c == key:
            out.append(F.coalesce(key, "_k").alias(key))
        elif c in columns:
            out.append(F.when(touched, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(inserted, F.lit(defaults.get(c))).otherwise(F.col(c)).alias(c))
    return d.select(*out)


def merge_curated(base: DataFrame, curated: DataFrame, key: str, slots: Sequence[str]) -> DataFrame:
    """Curated picks over the base entry: an empty pick keeps the old one; picked slots lose their fallback mark and
    get provenance 'curated'. base: key, slots, is_fallback map, source_pages map."""
    c = curated.select(F.col(key).alias("_k"), *[F.col(s).alias(f"_c_{s}") for s in slots])
    any_pick = F.lit(False)
    for s in slots:
        any_pick = any_pick | F.col(f"_c_{s}").isNotNull()
    d = base.join(c.filter(any_pick), base[key] == F.col("_k"), "full_outer")
    flags = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(f"_c_{s}").isNotNull(), F.struct(F.lit(s), F.lit(False))) for s in slots])))
    pages = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(f"_c_{s}").isNotNull(), F.struct(F.lit(s), F.lit("curated"))) for s in slots])))

    def overlay(old: str, new):
        kept = F.map_filter(F.coalesce(F.col(old), F.map_from_arrays(F.array(), F.array()).cast(dict(base.dtypes)[old])),
                            lambda k, v: ~F.map_contains_key(new, k))
        return F.map_concat(kept, new)

    return d.select(
        F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_c_{s}", s).alias(s) for s in slots],
        overlay("is_fallback", flags).alias("is_fallback"), overlay("source_pages", pages).alias("source_pages"))
