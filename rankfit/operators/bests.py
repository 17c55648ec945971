"""Best values per participant, seed candidates, new bests and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.admission import lookup
from ..functions.numeric import col, round_to, to_double
from ..functions.times import is_placeholder_time

MIN_IMPROVEMENT = 0.15
# fixed values: (distance, stroke code) -> event
EVENT_CODES = {
    (50, "1"): "50 Free", (100, "1"): "100 Free", (200, "1"): "200 Free", (500, "1"): "500 Free",
    (1000, "1"): "1000 Free", (1650, "1"): "1650 Free",
    (100, "2"): "100 Back", (200, "2"): "200 Back",
    (100, "3"): "100 Breast", (200, "3"): "200 Breast",
    (100, "4"): "100 Fly", (200, "4"): "200 Fly",
    (200, "5"): "200 IM", (400, "5"): "400 IM",
}
# fixed values: largest believable improvement in seconds
MAX_DROP = {
    "50 Free": 0.7, "50 Back": 0.7, "50 Breast": 0.7, "50 Fly": 0.7, "100 Free": 1.2, "100 Back": 1.2,
    "100 Breast": 1.2, "100 Fly": 1.2, "200 Free": 2.0, "200 Back": 2.0, "200 Breast": 2.0, "200 Fly": 2.0,
    "200 IM": 2.0, "400 IM": 4.0, "500 Free": 4.0, "1000 Free": 8.0, "1650 Free": 12.0,
}


def event_of(distance, stroke) -> Column:
    """Event label of a distance and stroke code; null when not supported."""
    table = {f"{d}|{code}": event for (d, code), event in EVENT_CODES.items()}
    return lookup(F.concat_ws("|", col(distance).cast("string"), col(stroke)), table)


def legal_yards(raw: DataFrame) -> DataFrame:
    """Short-course rows that are not marked illegal, with their event."""
    d = raw.filter((F.col("eventcourse") == "Y") & F.coalesce("legal", F.lit(True)))
    return d.withColumn("event", event_of("eventdistance", "eventstroke")).filter(F.col("event").isNotNull())


def min_per_key(raw: DataFrame, key: str = "swimmer_id") -> DataFrame:
    """Fastest legal value per event; a verified value always goes before a declared one."""
    text = F.coalesce(F.nullif("eventtime", F.lit("")), F.nullif("seedtime", F.lit("")))
    d = legal_yards(raw).withColumn("time_sec", to_double(text)).filter(F.col("time_sec") > 0)
    return d.groupBy(key, "event").agg(F.min("time_sec").alias("time_sec"))


def first_nonnull(raw: DataFrame, key: str = "swimmer_id", flag: str = "eventgender", order: str = "pos") -> DataFrame:
    """First M or F flag per participant in input order."""
    code = F.upper(F.trim(F.col(flag)))
    d = raw.filter(code.isin("M", "F"))
    first = F.min_by(code, F.struct(F.col(order), code))
    return d.groupBy(key).agg(F.when(first == "M", "men").otherwise("women").alias("gender"))


def max_drop(event) -> Column:
    return lookup(col(event), MAX_DROP)


def seed_pr_filter(raw: DataFrame) -> DataFrame:
    """Declared values that may be real unseen bests: not a placeholder, faster by at least 0.15 s and by no
    more than the event's cap."""
    d = legal_yards(raw).filter(~is_placeholder_time("seedtime"))
    d = d.withColumns({"verified_sec": to_double("eventtime"), "seed_sec": to_double("seedtime")})
    d = d.filter((F.col("verified_sec") > 0) & (F.col("seed_sec") > 0) & (F.col("seed_sec") < F.col("verified_sec")))
    gain = F.col("verified_sec") - F.col("seed_sec")
    d = d.filter((gain >= MIN_IMPROVEMENT) & (gain <= max_drop("event")))
    return d.withColumn("improvement", round_to(gain, 2))


def new_pr_join(proposed: DataFrame, accepted: DataFrame, keys=("swimmer_id", "event"), sec: str = "time_sec") -> DataFrame:
    """Proposed bests that are new or strictly faster than the accepted ones."""
    old = accepted.select(*keys, F.col(sec).alias("old_sec"))
    d = proposed.join(old, list(keys), "left")
    return d.filter(F.col("old_sec").isNull() | (F.col(sec) < F.col("old_sec")))


def freshness_gate(last_sync, now: Column, hours: int = 48) -> Column:
    """True when the last sync is at least `hours` old; missing or malformed passes."""
    ts = F.try_to_timestamp(F.regexp_replace(col(last_sync).cast("string"), "Z$", "+00:00"))
    age = F.unix_micros(now) - F.unix_micros(ts)
    return F.coalesce(age >= hours * 3600 * 1_000_000, F.lit(True))


def running_bests(events: DataFrame, keys, order, sec: str) -> DataFrame:
    """Batch form of new-best detection: rows that beat everything before them for the same keys.

    The earlier minimum is taken over fixed-length time slices first, so a hot key is split.
    """
    from pyspark.sql import Window

    keys = list(keys)
    slices = events.withColumn("_day", F.to_date(order[0]))
    inside = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    daily = slices.groupBy(*keys, "_day").agg(F.min(sec).alias("_m")).select(
        *keys, "_day", F.min("_m").over(before).alias("_prev"))
    d = slices.withColumn("_in", F.min(sec).over(inside)).join(daily, [*keys, "_day"])
    d = d.withColumn("old_best", F.least("_in", "_prev"))
    return d.filter(F.col("old_best").isNull() | (F.col(sec) < F.col("old_best"))).drop("_day", "_in", "_prev")
