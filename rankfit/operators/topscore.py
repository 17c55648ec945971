"""Scoring many participants against group anchors: event scores, top-k sums, top-n rankings, comparisons."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import round_to, tenths
from ..functions.scoring import confidence_weight, estimate_place, exp_points, place_label, tier_label
from ..session import cut_lineage
from .keyed import top_k_per_key

TOP_K = 4
# anchor rows up to which they are broadcast, and how many tasks share the work of one shuffle partition of times
MOST_ANCHORS, TASKS = 100_000, 4


def dealt(times: DataFrame, key: str = "swimmer") -> DataFrame:
    """Times dealt out by participant before they are multiplied by the groups, so that what follows per (participant, group)
    needs no shuffle of its own. A participant has one row per event. The number of tasks is given, as small partitions are
    not to be joined again: the rows grow in them."""
    return times.repartition(TASKS * int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _with_anchors(times: DataFrame, anchors: DataFrame) -> DataFrame:
    """Times meet the anchors of their event where they lie, up to `MOST_ANCHORS` of them; beyond that Spark decides."""
    anchors = cut_lineage(anchors)
    return times.join(F.broadcast(anchors) if anchors.count() <= MOST_ANCHORS else anchors, "event")


def score_events(times: DataFrame, anchors: DataFrame, place: Column | None = None, confidence=confidence_weight) -> DataFrame:
    """Participant times joined to the anchors of their event in every group, with place and points.

    times: swimmer, event, sec. anchors: conference, event, first, eighth, sixteenth, sec_per_place.
    The join multiplies times by the number of groups, not by the number of teams. Anchors are one row per group and
    event; their number decides whether they are broadcast or the hot events are split.
    """
    at = place if place is not None else estimate_place("sec", "first", "eighth", "sixteenth", "sec_per_place")
    d = _with_anchors(times, anchors).withColumn("_place", at).filter(F.col("_place").isNotNull())
    d = d.withColumns({"_exp": exp_points("_place"), "confidence": confidence("_place")})
    return d.select(
        "swimmer", "conference", "event",
        round_to("sec", 3).alias("sec"),
        round_to("_place", 2).alias("place"),
        round_to(F.col("_exp") * F.col("confidence"), 2).alias("pts"),
        round_to("_exp", 2).alias("exp_pts"),
        "confidence",
        place_label("_place").alias("place_label"),
    )


def points_cents(c) -> Column:
    """Points rounded to hundredths as whole numbers, so sums do not depend on row order."""
    return F.floor(c * 100 + 0.5).cast("bigint")


def top_k_sum(scored: DataFrame, keys: Sequence[str] = ("swimmer", "conference"), k: int = TOP_K) -> DataFrame:
    """Sum of the k best event points per key, with the depth flag. Zero sums are dropped.

    One pass: the group limit keeps at most k rows per key and input partition before the shuffle. Points are never
    negative, so k events score exactly when all of the k best do.
    """
    best = top_k_per_key(scored, list(keys), [F.desc("pts"), F.asc("event")], k)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "event")))
    sums = best.groupBy(*keys).agg(
        (F.sum(points_cents(F.col("pts"))) / F.lit(100.0)).alias("raw_pts"),
        F.array_join(F.transform(ordered, lambda s: s["event"]), ", ").alias("top_events"),
        (F.count_if(F.col("pts") > 0) >= k).alias("has_depth"),
    )
    return sums.filter(F.col("raw_pts") != 0)


def weighted_top_k_sum(scored: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("swimmer", "conference")) -> DataFrame:
    """Sum of the best points, each weighted by its rank position."""
    best = top_k_per_key(scored, list(keys), [F.desc("pts"), F.asc("event")], len(weights))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("rn") - 1)
    # weights carry two decimals, so ten-thousandths are whole numbers
    part = F.floor(F.col("pts") * w * 10000 + 0.5).cast("bigint")
    return best.groupBy(*keys).agg(round_to(F.sum(part) / F.lit(10000.0), 2).alias("raw_pts"))


def spread_to_teams(sums: DataFrame, teams: DataFrame) -> DataFrame:
    """Fan group sums out to the teams of the group: adjusted points and tier per (swimmer, school)."""
    d = sums.join(teams, "conference").withColumn("adj_pts", round_to(F.col("raw_pts") * F.col("psf"), 2))
    return d.withColumn("adj_tier", tier_label("adj_pts"))


def top_n_per_key(scores: DataFrame, n: int, keys: Sequence[str] = ("swimmer",), score: str = "a_score", mark: int = 5) -> DataFrame:
    """Best n scored events per key with the leading ones marked."""
    d = top_k_per_key(scores, list(keys), [F.desc(score), F.asc("event")], n)
    return d.withColumn("top5", F.col("rn") <= mark)


def unranked(times: DataFrame, standards: DataFrame, keys: Sequence[str] = ("gender", "event")) -> DataFrame:
    """Events that cannot be scored: no usable time or no standard."""
    usable = F.col("sec").isNotNull() & (F.col("sec") > 0)
    bad = times.filter(~usable)
    return bad.unionByName(times.filter(usable).join(standards.select(*keys).distinct(), list(keys), "left_anti"))


def bracket_lookup(times: DataFrame, standards_long: DataFrame) -> DataFrame:
    """Score by the bracket that holds the time: standards as (gender, event, level 0..4, sec).

    Brackets are ranges between neighbouring levels; the join is an equality on (gender, event) with the range
    as residual, so it runs as a hash join.
    """
    lv = standards_long.select("gender", "event", F.col("level").alias("_lo"), F.col("sec").alias("_lo_sec"))
    up = standards_long.select("gender", "event", (F.col("level") - 1).alias("_lo"), F.col("sec").alias("_hi_sec"))
    b = lv.join(up, ["gender", "event", "_lo"])
    inside = (F.col("_hi_sec") <= F.col("sec")) & (F.col("sec") <= F.col("_lo_sec"))
    below = (F.col("_lo") == 0) & (F.col("sec") > F.col("_lo_sec"))
    above = (F.col("_lo") == 3) & (F.col("sec") < F.col("_hi_sec"))
    d = times.join(b, ["gender", "event"]).filter(inside | below | above)
    frac = F.coalesce(F.try_divide(F.col("_lo_sec") - F.col("sec"), F.col("_lo_sec") - F.col("_hi_sec")), F.lit(0.0))
    d = d.withColumn("a_score", F.col("_lo") + frac)
    # a time exactly on a level satisfies two brackets with the same score
    return d.groupBy(*times.columns).agg(F.max("a_score").alias("a_score"))


def score_variants(times: DataFrame, anchors: DataFrame, variants: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """As `score_events`, for several variants (place, confidence) over one join: `place_<variant>` and `pts_<variant>`, null
    where a variant has no place."""
    d = _with_anchors(times, anchors).select("swimmer", "conference", "event", *[place.alias(f"_at_{v}") for v, (place, _) in variants.items()])
    cols = []
    for v, (_, confidence) in variants.items():
        at = F.col(f"_at_{v}")
        cols += [round_to(at, 2).alias(f"place_{v}"), round_to(exp_points(at) * confidence(at), 2).alias(f"pts_{v}")]
    return d.filter(F.coalesce(*[F.col(f"_at_{v}") for v in variants]).isNotNull()).select("swimmer", "conference", "event", *cols)


def variant_scores(scored: DataFrame, variant: str) -> DataFrame:
    """The events of one variant, as `top_k_sum` takes them."""
    return scored.filter(F.col(f"place_{variant}").isNotNull()).select("swimmer", "conference", "event", F.col(f"pts_{variant}").alias("pts"))


def variant_compare(prod: DataFrame, exp: DataFrame, shifts: DataFrame, keys: Sequence[str] = ("swimmer", "school"),
                    event_keys: Sequence[str] = ("swimmer", "conference")) -> DataFrame:
    """Deltas between two scoring variants per key, tier change, and the notable event shifts as text."""
    keys, ek = list(keys), list(event_keys)
    p = prod.select(*keys, "conference", F.col("raw_pts").alias("prod_raw"), F.col("adj_pts").alias("prod_adj"),
                    F.col("adj_tier").alias("prod_tier"))
    e = exp.select(*keys, F.col("raw_pts").alias("exp_raw"), F.col("adj_pts").alias("exp_adj"),
                   F.col("adj_tier").alias("exp_tier"))
    return _deltas(p.join(e, keys).join(shift_texts(shifts, ek), ek, "left"))


def compare_sums(prod: DataFrame, exp: DataFrame, shifts: DataFrame, teams: DataFrame, keys: Sequence[str] = ("swimmer", "conference")) -> DataFrame:
    """`variant_compare` from the sums of two variants (see `top_k_sum`): they meet per group, and only then fan out to teams."""
    ek = list(keys)
    d = prod.select(*ek, F.col("raw_pts").alias("prod_raw")).join(exp.select(*ek, F.col("raw_pts").alias("exp_raw")), ek)
    d = d.join(shift_texts(shifts, ek), ek, "left").join(teams, "conference")
    d = d.withColumns({f"{v}_adj": round_to(F.col(f"{v}_raw") * F.col("psf"), 2) for v in ("prod", "exp")})
    return _deltas(d.withColumns({f"{v}_tier": tier_label(f"{v}_adj") for v in ("prod", "exp")}))


def shift_texts(shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The shifts of a key as one text, the most points of the first variant first, and their number."""
    d = shifts.groupBy(*keys).agg(F.sort_array(F.collect_list("shift")).alias("_list"))
    return d.select(*keys, F.array_join(F.transform("_list", shift_text), "; ").alias("place_shifts"), F.size("_list").cast("bigint").alias("n_shifts"))


def shift_text(s: Column) -> Column:
    at = lambda i: [F.lit(" pl="), tenths(s[f"p{i}"]), F.lit("/pts="), tenths(s[f"s{i}"])]
    return F.concat(s["event"], F.lit(": "), s["v1"], *at(1), F.lit(" → "), s["v2"], *at(2), F.lit(" (Δplace="), tenths(s["p2"] - s["p1"], True),
                    F.lit(", Δpts="), tenths(s["s2"] - s["s1"], True), F.lit(")"))


def _deltas(d: DataFrame) -> DataFrame:
    change = F.when(F.col("prod_tier") == F.col("exp_tier"), "same").otherwise(
        F.concat_ws(" → ", "prod_tier", "exp_tier"))
    return d.withColumns({
        "delta_raw": round_to(F.col("exp_raw") - F.col("prod_raw"), 2),
        "delta_adj": round_to(F.col("exp_adj") - F.col("prod_adj"), 2),
        "tier_change": change, "place_shifts": F.coalesce("place_shifts", F.lit("")), "n_shifts": F.coalesce("n_shifts", F.lit(0)),
    })


def event_shifts(scored: DataFrame, first: str, second: str) -> DataFrame:
    """Events with `moved`, whether place or points differ by at least half a unit between two variants of `score_variants`, and the
    numbers of those that did as `shift`. No event is dropped: a filter would be moved into the scoring and compute every place
    many times."""
    cols = {"p1": f"place_{first}", "s1": f"pts_{first}", "p2": f"place_{second}", "s2": f"pts_{second}"}
    far = lambda a, b: F.coalesce(F.abs(F.col(cols[b]) - F.col(cols[a])) >= 0.5, F.lit(False))
    shift = F.struct((-F.col(cols["s1"])).alias("first"), "event", *[F.col(c).alias(n) for n, c in cols.items()], F.lit(first).alias("v1"), F.lit(second).alias("v2"))
    return scored.withColumn("moved", far("p1", "p2") | far("s1", "s2")).withColumn("shift", F.when(F.col("moved"), shift))
