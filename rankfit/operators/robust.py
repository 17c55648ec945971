"""Robust profiles per group and the validation of anchor rows against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import round_to
from ..session import cut_lineage
from .keyed import interpolated, order_statistics, value_counts

METRICS = ("sw", "deep", "spread", "shape")
STATS = ("n", "median", "mad", "p05", "p25", "p75", "p95")
PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
MIN_SAMPLES = 8
# fixed values: weights of the profile distance
DISTANCE_WEIGHTS = {"sw": 0.5, "deep": 1.0, "spread": 1.5, "shape": 1.5}
# fixed values: event -> (fastest winner, slowest winner, slowest 16th); tested in this order by substring
EVENT_BOUNDS = [
    ("1650 free", 700.0, 1920.0, 2400.0),
    ("1000 free", 400.0, 1200.0, 1500.0),
    ("500 free", 200.0, 560.0, 720.0),
    ("200 free", 80.0, 220.0, 420.0),
    ("100 free", 35.0, 100.0, 210.0),
    ("50 free", 15.0, 52.0, 130.0),
    ("200 back", 85.0, 230.0, 420.0),
    ("100 back", 40.0, 110.0, 210.0),
    ("200 breast", 100.0, 255.0, 460.0),
    ("100 breast", 45.0, 120.0, 220.0),
    ("200 fly", 85.0, 235.0, 420.0),
    ("100 fly", 38.0, 108.0, 210.0),
    ("400 im", 200.0, 490.0, 720.0),
    ("200 im", 85.0, 230.0, 420.0),
]
HARD_REASONS = ["anchor_order_broken", "sw_absurdly_fast", "sw_absurdly_slow", "deep_absurdly_slow",
                "deep_extreme_outlier"]
CROSS_RATIO = 4.0
MOST_PROFILES = 10_000
# profiles up to which they are broadcast to the rows, whose few genders and events would otherwise be few tasks
NEAR_PROFILES = 100_000


def robust_profile(rows: DataFrame, sw: str = "sw", deep: str = "deep", min_n: int = MIN_SAMPLES) -> DataFrame:
    """Per (gender, event): winsorized median, MAD and percentiles of four metrics, one wide row.

    Clipping is monotone, so the order statistics of the winsorized sample are the clipped order statistics of
    the raw sample: one pass gives all percentiles, a second one the MAD.
    """
    keys = ["gender", "event"]
    base = rows.select(
        F.lower(F.trim("gender")).alias("gender"), F.lower(F.trim("event")).alias("event"),
        F.col(sw).alias("sw"), F.col(deep).alias("deep"),
    ).filter((F.col("sw") > 0) & (F.col("deep") > 0) & (F.col("deep") >= F.col("sw")))
    long = base.withColumns({"spread": F.col("deep") - F.col("sw"), "shape": F.col("deep") / F.col("sw")}).unpivot(
        keys, list(METRICS), "metric", "v")
    # NaN and infinity compare as largest, so one bound removes both
    long = long.filter((F.col("v") > 0) & (F.col("v") < F.lit(float("inf"))))
    mkeys = [*keys, "metric"]
    counts = value_counts(long, mkeys, "v")
    raw = order_statistics(counts, mkeys, "v", PROBS).filter(F.col("n") >= min_n)
    bounds = raw.withColumns({"_lo": interpolated("p05"), "_hi": interpolated("p95")})
    stats = cut_lineage(bounds.select(
        *mkeys, "n", "_lo", "_hi", *[interpolated(p, F.col("_lo"), F.col("_hi")).alias(p) for p in PROBS]))
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("v")))
    dev = counts.join(stats.select(*mkeys, "_lo", "_hi", "median"), mkeys).withColumn(
        "_dev", F.abs(clipped - F.col("median")))
    mad = order_statistics(value_counts(dev, mkeys, "_dev", "_n"), mkeys, "_dev", {"mad": 0.5}).select(
        *mkeys, interpolated("mad").alias("mad"))
    full = stats.join(mad, mkeys)
    wide = full.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in METRICS for s in STATS])
    known = base.select(*keys).distinct()
    return known.join(wide, keys, "left")


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return F.abs(value - median) / (F.lit(1.4826) * mad + F.lit(1e-6))


def _severity(z: Column, soft, hard) -> Column:
    return F.when(z <= soft, "").when(z <= hard, "soft").when(z <= 5.0, "hard").when(z.isNotNull(), "extreme")


def _penalty(sev: Column, soft: float, hard: float, extreme: float) -> Column:
    return F.when(sev == "soft", soft).when(sev == "hard", hard).when(sev == "extreme", extreme).otherwise(0.0)


def profile_distance(values: dict[str, Column], stat) -> Column:
    """Weighted robust-z distance; metrics without statistics do not count. `stat(name)` gives a column."""
    return weighted_distance({m: robust_z(values[m], stat(f"{m}_median"), stat(f"{m}_mad")) for m in DISTANCE_WEIGHTS})


def weighted_distance(zs: dict[str, Column]) -> Column:
    total, weight = F.lit(0.0), F.lit(0.0)
    for m, w in DISTANCE_WEIGHTS.items():
        z = zs[m]
        total = total + F.coalesce(w * z * z, F.lit(0.0))
        weight = weight + F.when(z.isNotNull(), w).otherwise(0.0)
    return F.sqrt(F.try_divide(total, F.nullif(weight, F.lit(0.0))))


def family_bounds(event: Column) -> Column:
    """Struct(floor, winner_ceiling, deep_ceiling) of the first event name contained in the text."""
    e, out = F.lower(F.trim(event)), None
    for name, lo, win, deep in EVENT_BOUNDS:
        s = F.struct(F.lit(lo).alias("floor"), F.lit(win).alias("sw_ceiling"), F.lit(deep).alias("deep_ceiling"))
        cond = F.contains(e, F.lit(name))
        out = F.when(cond, s) if out is None else out.when(cond, s)
    return out


def nearest_other(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add `best_event` and `best_dist`: the closest profile of the same gender and another event (ties by name).

    Profiles are one short array per gender, so rows are neither exploded nor shuffled; a gender with more than
    `MOST_PROFILES` of them is an error.
    """
    return _nearest(rows, *_in_reach(profiles))


def _in_reach(profiles: DataFrame):
    """The profiles, worked out once, and how a table made of them is brought to the rows."""
    profiles = cut_lineage(profiles)
    return profiles, F.broadcast if profiles.count() <= NEAR_PROFILES else lambda d: d


def _nearest(rows: DataFrame, profiles: DataFrame, near) -> DataFrame:
    fields = ["event", *[f"{m}_{s}" for m in METRICS for s in ("median", "mad")]]
    lists = profiles.groupBy(F.col("gender").alias("_g")).agg(
        F.collect_list(F.struct(*fields)).alias("_profiles"))
    lists = lists.withColumn("_profiles", F.when(F.size("_profiles") > MOST_PROFILES, F.raise_error(F.lit("too many profiles of a gender"))).otherwise(F.col("_profiles")))
    joined = rows.drop("best_dist", "best_event").join(near(lists), rows["gender_norm"] == F.col("_g"), "left").drop("_g")
    others = F.filter("_profiles", lambda p: p["event"] != F.col("event_norm"))
    zs = F.transform(others, lambda p: F.struct(p["event"].alias("e"), *[
        robust_z(F.col(m), p[f"{m}_median"], p[f"{m}_mad"]).alias(m) for m in METRICS]))
    scored = F.transform(zs, lambda z: F.struct(weighted_distance({m: z[m] for m in METRICS}).alias("d"), z["e"].alias("e")))
    best = F.array_min(F.filter(scored, lambda s: s["d"].isNotNull()))
    # an array of one: the search runs once a row, however often its result is read from here on
    return joined.select("*", F.inline(F.array(best)).alias("best_dist", "best_event")).drop("_profiles")


def validate_rows(rows: DataFrame, profiles: DataFrame, sw: str = "sw", deep: str = "deep") -> DataFrame:
    """Confidence, label, reasons and the nearest other event for every anchor row.

    A row is only flagged when a structural signal fired; soft signals alone leave it valid.
    """
    d = rows.withColumns({
        "gender_norm": F.lower(F.trim("gender")), "event_norm": F.lower(F.trim("event")),
        "sw": F.col(sw).cast("double"), "deep": F.col(deep).cast("double"),
    })
    d = d.withColumns({"spread": F.col("deep") - F.col("sw"),
                       "shape": F.when(F.col("sw") > 0, F.col("deep") / F.col("sw"))})
    stat_cols = [f"{m}_{s}" for m in METRICS for s in ("median", "mad")] + ["sw_p95"]
    profiles, near = _in_reach(profiles)
    own = profiles.select(F.col("gender").alias("_pg"), F.col("event").alias("_pe"), F.lit(True).alias("_has"), *stat_cols)
    d = d.join(near(own), (d["gender_norm"] == F.col("_pg")) & (d["event_norm"] == F.col("_pe")), "left")
    d = _nearest(d, profiles, near)
    has = F.coalesce(F.col("_has"), F.lit(False))
    values = {m: F.col(m) for m in METRICS}
    z = {m: F.when(has, robust_z(values[m], F.col(f"{m}_median"), F.col(f"{m}_mad"))) for m in METRICS}
    sprint = F.contains("event_norm", F.lit("50 free")) | F.contains("event_norm", F.lit("100 free"))
    soft, hard = F.when(sprint, 2.5).otherwise(2.0), F.when(sprint, 4.5).otherwise(3.0)
    sev = {
        "sw": _severity(z["sw"], 2.0, 3.0), "deep": _severity(z["deep"], 2.0, 3.0),
        "spread": _severity(z["spread"], soft, hard), "shape": _severity(z["shape"], soft, hard),
    }
    d = d.withColumns({f"_sev_{m}": s for m, s in sev.items()}).withColumn("_b", family_bounds(F.col("event_norm")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    claimed = F.when(has, profile_distance(values, F.col))
    d = d.withColumns({
        "claimed_dist": claimed,
        "best_dist": F.when(has, F.col("best_dist")),
        "best_event": F.when(has, F.col("best_event")),
        "_order": yes(F.col("sw") > F.col("deep")),
        "_fast": yes(F.col("sw") < F.col("_b.floor") / 2.5),
        "_slow": yes(F.col("sw") > F.col("_b.sw_ceiling")),
        "_deep_slow": yes(F.col("deep") > F.col("_b.deep_ceiling") * 2.5),
    })
    d = d.withColumn("_slow_p", has & ~F.col("_slow") & yes(F.col("sw") > F.col("sw_p95") * 2.0))
    d = d.withColumn("_cross", yes((F.col("best_dist") > 0) & (F.col("claimed_dist") / F.nullif("best_dist", F.lit(0.0)) > CROSS_RATIO)))
    s = {m: F.coalesce(F.col(f"_sev_{m}"), F.lit("")) for m in METRICS}
    penalty = (
        F.when(F.col("_order"), 55.0).otherwise(0.0) + F.when(F.col("_fast"), 55.0).otherwise(0.0)
        + F.when(F.col("_slow"), 55.0).otherwise(0.0) + F.when(F.col("_deep_slow"), 55.0).otherwise(0.0)
        + _penalty(s["sw"], 3.0, 8.0, 15.0) + _penalty(s["deep"], 8.0, 18.0, 30.0)
        + _penalty(s["spread"], 10.0, 22.0, 38.0) + _penalty(s["shape"], 10.0, 22.0, 38.0)
        + F.when(F.col("_slow_p"), 45.0).otherwise(0.0) + F.when(F.col("_cross"), 15.0).otherwise(0.0)
    )
    outlier = lambda m: F.when(s[m] != "", F.concat(F.lit(f"{m}_"), s[m], F.lit("_outlier")))
    implausible = lambda m: F.when(s[m].isin("hard", "extreme"), f"{m}_implausible").when(
        s[m] == "soft", f"{m}_soft_outlier")
    reasons = F.array_compact(F.array(
        F.when(F.col("_order"), "anchor_order_broken"), F.when(F.col("_fast"), "sw_absurdly_fast"),
        F.when(F.col("_slow"), "sw_absurdly_slow"), F.when(F.col("_deep_slow"), "deep_absurdly_slow"),
        outlier("sw"), outlier("deep"), implausible("spread"), implausible("shape"),
        F.when(F.col("_slow_p"), "sw_absurdly_slow"), F.when(F.col("_cross"), "closer_to_other_event"),
    ))
    d = d.withColumns({"_reasons": reasons, "_conf": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty))})
    is_hard = F.arrays_overlap("_reasons", F.array(*[F.lit(h) for h in HARD_REASONS])) | F.col("_cross")
    missing = F.col("sw").isNull() | F.col("deep").isNull()
    label = (
        F.when(missing, "review").when(~is_hard, "valid").when(F.col("_conf") >= 80, "valid")
        .when(F.col("_conf") >= 50, "review").otherwise("likely_wrong_event")
    )
    known = lambda c: F.when(~missing, c)
    verdict = {
        "spread_seconds": round_to("spread", 3),
        "shape_ratio": round_to("shape", 4),
        "validation_label": label,
        "confidence_score": F.when(missing, 50.0).otherwise(round_to("_conf", 1)),
        "reasons": known(F.array_join("_reasons", "; ")),
        "closest_other_event": known(F.coalesce("best_event", F.lit(""))),
        "claimed_event_distance": known(round_to("claimed_dist", 3)),
        "closest_other_event_distance": known(round_to("best_dist", 3)),
    }
    # an array of one again: a filter on the label reads it instead of working out every signal a second time
    return d.select(*rows.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in verdict.items()]))))


def validation_report(validated: DataFrame) -> DataFrame:
    """Only the rows that need attention and carry both values."""
    return validated.filter((F.col("validation_label") != "valid") & F.col("reasons").isNotNull())
