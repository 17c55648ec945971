"""Place estimation, points, labels and standard scores as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clamp, col, nonzero


def _width(hi: Column, lo: Column) -> Column:
    """Interval width; a zero width divides by one."""
    return nonzero(hi - lo, 1.0)


def estimate_place(sec, first, eighth, sixteenth, sec_per_place) -> Column:
    """Continuous place from three anchors. Any missing anchor gives null, never an error."""
    t, a, b, c = (col(x).cast("double") for x in (sec, first, eighth, sixteenth))
    step = nonzero(col(sec_per_place).cast("double"), 1.0)
    return (
        F.when(t.isNull() | a.isNull() | b.isNull() | c.isNull(), F.lit(None).cast("double"))
        .when(t <= a, F.lit(1.0))
        .when(t <= b, 1.0 + (t - a) / _width(b, a) * 7)
        .when(t <= c, 8.0 + (t - b) / _width(c, b) * 8)
        .otherwise(16.0 + (t - c) / step)
    )


def exp_points(place) -> Column:
    return clamp(21.0 - col(place), 0.0, 20.0)


def confidence_weight(place) -> Column:
    p = col(place)
    return F.when(p <= 12, 1.0).when(p <= 14, 0.85).when(p <= 16, 0.65).when(p.isNotNull(), 0.0)


def _ladder(c, steps, last: str, strict: bool) -> Column:
    """Label by the first upper limit that holds."""
    x = col(c)
    out = None
    for limit, label in steps:
        cond = (x < limit) if strict else (x <= limit)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(x.isNotNull(), out.otherwise(last))


# fixed values: label limits
ZONE_STEPS = [
    (1.5, "Contender"),
    (3.5, "Podium"),
    (5.5, "Premium (1–5)"),
    (14.5, "Main Scoring (6–14)"),
    (16.5, "Extension (15–16)"),
]
PLACE_STEPS = [(1.5, "Contender"), (3.5, "🏅 Podium"), (8.5, "A Final"), (16.5, "B Final"), (20, "Bubble")]
TIER_STEPS = [
    (1, "Not Competitive"),
    (4, "Below Roster Level"),
    (10, "Recruitable"),
    (18, "Priority Recruit"),
    (35, "Top Recruit"),
    (50, "Conference Star"),
]
STANDARD_STEPS = [(0, "Sub-B"), (1, "B/BB"), (2, "A"), (3, "AA"), (4, "AAA")]
STRENGTH_LABELS = {"1A": "Super Powerhouse", "1B": "Powerhouse", "2": "Strong", "3": "Mid-pack", "4": "Developing"}


def place_label(place) -> Column:
    return _ladder(place, PLACE_STEPS, "Out of range", strict=False)


def zone_label(place) -> Column:
    return _ladder(place, ZONE_STEPS, "Out of range", strict=False)


def tier_label(points) -> Column:
    return _ladder(points, TIER_STEPS, "High-Point Contender", strict=True)


def a_tier_label(score) -> Column:
    return _ladder(score, STANDARD_STEPS, "AAAA+", strict=True)


def strength_label(tier_short, adj_tier) -> Column:
    """Program strength in words; without a tier the swim tier stands in."""
    out = None
    for code, label in STRENGTH_LABELS.items():
        cond = col(tier_short) == code
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(col(adj_tier))


def derived_fifth(first, eighth) -> Column:
    a, e = col(first), col(eighth)
    return a + F.lit(4.0) / F.lit(7.0) * (e - a)


def derived_fourteenth(eighth, sixteenth) -> Column:
    e, s = col(eighth), col(sixteenth)
    return e + F.lit(6.0) / F.lit(8.0) * (s - e)


def estimate_place_5_14(sec, first, fifth, fourteenth) -> Column:
    """Three-zone variant on 1st / 5th / 14th anchors, extended beyond 14 with the 5-to-14 slope."""
    t, a, f, n = (col(x).cast("double") for x in (sec, first, fifth, fourteenth))
    at_least = lambda w: F.greatest(w, F.lit(0.001))
    place = (
        F.when(t <= a, F.lit(1.0))
        .when(t <= f, 1.0 + (t - a) / at_least(f - a) * 4.0)
        .when(t <= n, 5.0 + (t - f) / at_least(n - f) * 9.0)
        .otherwise(14.0 + (t - n) / at_least((n - f) / 9.0))
    )
    return F.when(t.isNotNull() & a.isNotNull() & f.isNotNull() & n.isNotNull(), place)


def confidence_5_14(place) -> Column:
    p = col(place)
    return F.when(p <= 14, 1.0).when(p <= 16, 0.35).when(p.isNotNull(), 0.0)


def a_score(sec, b, a, aa, aaa, aaaa) -> Column:
    """Fractional standard score: 0 at B, 4 at AAAA, extrapolated on both sides."""
    return _standard_score(sec, b, a, aa, aaa, aaaa, clamped=False)


def a_score_clamped(sec, b, a, aa, aaa, aaaa) -> Column:
    """Same scale with a floor of -1 and the other zero-width rules."""
    return _standard_score(sec, b, a, aa, aaa, aaaa, clamped=True)


def _standard_score(sec, b, a, aa, aaa, aaaa, clamped: bool) -> Column:
    t = col(sec).cast("double")
    rungs = [col(x).cast("double") for x in (b, a, aa, aaa, aaaa)]
    slow_width, fast_width = rungs[0] - rungs[1], rungs[3] - rungs[4]
    if clamped:
        below = F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(rungs[0] - t, slow_width), F.lit(-1.0)))
        above = 4.0 + F.coalesce(F.try_divide(rungs[4] - t, fast_width), F.lit(0.0))
    else:
        below = F.when(slow_width <= 0, 0.0).otherwise(F.try_divide(rungs[0] - t, slow_width))
        above = F.when(fast_width <= 0, 4.0).otherwise(4.0 + F.try_divide(rungs[4] - t, fast_width))
    inner = F.lit(0.0)
    for i in range(3, -1, -1):
        width = rungs[i] - rungs[i + 1]
        at_zero = F.lit(0.5) if clamped else F.lit(0.0)
        frac = F.when(width == 0, at_zero).otherwise(F.try_divide(rungs[i] - t, width))
        inner = F.when((rungs[i + 1] <= t) & (t <= rungs[i]), float(i) + frac).otherwise(inner)
    known = t.isNotNull()
    for r in rungs:
        known = known & r.isNotNull()
    slow, fast = (t >= rungs[0], below), (t <= rungs[4], above)
    (c1, v1), (c2, v2) = (slow, fast) if clamped else (fast, slow)
    return F.when(known, F.when(c1, v1).when(c2, v2).otherwise(inner))
