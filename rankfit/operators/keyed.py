"""Per-key building blocks that stay safe when one key holds a large share of all rows.

* `first_per_key` / `top_k_per_key`: `row_number() <= k`, which Spark turns into a group limit before the
  shuffle, so a hot key moves at most k rows per input partition.
* `with_group_stats`: partial aggregation plus a join back, instead of an unbounded window per key.
* `carry_forward` / `running_total`: two-level windows over fixed-length chunks of the order column.
* `exact_quantiles`: ranges of distinct values, so no task sorts a whole group.
* `global_rank`: places in a whole order, or within long keys, from ranges and their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

CHUNK = 65536


def near(df: DataFrame, most: int) -> DataFrame:
    """The table, materialised, and broadcast up to so many rows; beyond them Spark decides."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= most else df


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return top_k_per_key(df, keys, order, 1, "_first").drop("_first")


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Attach group aggregates to every row. Keys compare null-safe, as in a grouping."""
    renamed = {k: f"_k_{k}" for k in keys}
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    agg = agg.withColumnsRenamed(renamed)
    cond = None
    for k, r in renamed.items():
        eq = df[k].eqNullSafe(agg[r])
        cond = eq if cond is None else cond & eq
    return df.join(agg, cond).drop(*renamed.values())


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "position", keys: Sequence[str] = ()) -> DataFrame:
    """The place of every row, from 1, in the order of `order`; with `keys`, its place among the rows of its keys.

    Rows are dealt out in ranges of (keys, order) and numbered inside them; the ranges' sizes, one number for each partition,
    give the offsets. So neither the whole order nor a hot key is ever in one task. Ties are spread as they come: end the
    order with a column that tells rows apart. Nulls come first in ascending columns, as everywhere.
    """
    columns = [*[F.asc(k) for k in keys], *order]
    # the rank of a row is fixed from here on, whatever is computed again
    d = cut_lineage(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in d.groupBy(part.alias("p")).agg(F.max(inside) + 1).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_p bigint, _before bigint")
    out = d.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + inside + 1)
    out = out.select(*df.columns, name)
    if not keys:
        return out
    out = with_group_stats(out, keys, _least=F.min(name))
    return out.withColumn(name, F.col(name) - F.col("_least") + 1).drop("_least")


def needs_chunks(df: DataFrame, order: str, chunk: int = CHUNK) -> bool:
    """Whether some key runs past one chunk. Reads the order column only."""
    longest = df.agg(F.max(order)).first()[0]
    return longest is not None and longest >= chunk


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    # both branches below read this table, so it is materialised once instead of being computed twice
    return cut_lineage(df.withColumn("_chunk", F.floor(F.col(order) / chunk)))


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], chunked: bool | None = None,
                  chunk: int = CHUNK) -> DataFrame:
    """Fill nulls of `values` with the last non-null value before them, per key in `order` (an integer).

    Where every key fits in one chunk this is a plain window, and a chain of carries shares one shuffle and sort. Longer
    keys are cut in chunks: a window per chunk, a short table of chunk ends, and a join back. `chunked` says which;
    when it is not given the longest key is looked up.
    """
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not (needs_chunks(df, order, chunk) if chunked is None else chunked):
        return df.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in values})
    d = _chunked(df, order, chunk)
    parts = [*keys, "_chunk"]
    inside = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(*parts).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_end_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *parts, *[F.last(f"_end_{v}", ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])
    filled = d.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in values}).join(carried, parts)
    filled = filled.withColumns({v: F.coalesce(F.col(v), F.col(f"_in_{v}")) for v in values})
    return filled.select(*df.columns)


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, chunked: bool | None = None,
                  chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sum per key in `order` (an integer), cut in chunks for long keys."""
    if not (needs_chunks(df, order, chunk) if chunked is None else chunked):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    d = _chunked(df.withColumn("_v", value), order, chunk)
    parts = [*keys, "_chunk"]
    inside = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*parts).agg(F.sum("_v").alias("_sum")).select(
        *parts, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    out = d.withColumn("_run", F.sum("_v").over(inside)).join(starts, parts)
    return out.withColumn(name, F.col("_run") + F.col("_start")).select(*df.columns, name)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per key with their counts in `_n`, materialised: later passes read this short table only."""
    w = F.col(weight) if weight else F.lit(1)
    return cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(w).cast("bigint").alias("_n")))


def order_statistics(
    counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Per key of a `value_counts` table: total `n` and, for each named probability, the two neighbouring order
    statistics and the fraction between them as `<name>_lo`, `<name>_hi`, `<name>_f`.

    Values are dealt out in ranges of (key, value) of like size, drawn from a sample, so a long key lies in many ranges and an
    outlier in one of them like any other value. The ranges' counts give where each begins, and only ranges that hold a
    wanted rank are counted through. Exact, and the same whatever the size.
    """
    keys = list(keys)
    ranked = _ranked_ranges(counts, keys, value, probs)
    picks = []
    for c, r in _wanted_ranks(probs).items():
        here = (F.col("_hi_rank") - F.col("_n") <= r) & (r < F.col("_hi_rank"))
        picks.append(F.max(F.when(here, F.col(value))).alias(c))
    out = ranked.groupBy(*keys, "n").agg(*picks)
    pos = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    return out.withColumns({f"{name}_f": x - F.floor(x) for name, x in pos.items()})


def _wanted_ranks(probs: dict[str, float]) -> dict[str, Column]:
    out = {}
    for name, p in probs.items():
        low = F.floor(F.lit(float(p)) * (F.col("n") - 1))
        out[f"{name}_lo"], out[f"{name}_hi"] = low, F.least(low + 1, F.col("n") - 1)
    return out


def _ranked_ranges(counts: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    # which range a value is in is fixed from here on
    d = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    sizes = d.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    # a key has at most as many rows here as there are ranges
    w = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_end": F.sum("_size").over(w.orderBy("_range")), "n": F.sum("_size").over(w)}).withColumn("_start", F.col("_end") - F.col("_size"))
    holds = F.lit(False)
    for r in _wanted_ranks(probs).values():
        holds = holds | ((F.col("_start") <= r) & (r < F.col("_end")))
    wanted = sizes.filter(holds).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), "_start", "n")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(wanted, same).withColumn("_hi_rank", F.col("_start") + F.sum("_n").over(inside)).drop(*[f"_k_{k}" for k in keys], "_r")


def interpolated(name: str, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Linear interpolation between the two order statistics, each optionally clipped to [lo, hi]."""

    def clip(c: Column) -> Column:
        return c if lo is None else F.greatest(lo, F.least(hi, c))

    a, b = clip(F.col(f"{name}_lo")), clip(F.col(f"{name}_hi"))
    return a + F.col(f"{name}_f") * (b - a)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    stats = order_statistics(value_counts(df, keys, value, weight), keys, value, probs)
    return stats.select(*keys, "n", *[interpolated(name).alias(name) for name in probs])
