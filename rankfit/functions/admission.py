"""Selectivity, the admission decision matrix with its ordered guardrails, and merit estimates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import col

# fixed values: labels from worst to best
LABELS = ["Moonshot", "Major Reach", "Possible", "Realistic Shot", "Strong Chance", "Very Strong Chance"]
MOONSHOT_FUN = "Moonshot — Apply for Fun"
# fixed values: academic band -> swim band -> label
MATRIX = {
    4: {4: "Very Strong Chance", 3: "Strong Chance", 2: "Strong Chance", 1: "Realistic Shot", 0: "Possible"},
    3: {4: "Strong Chance", 3: "Strong Chance", 2: "Realistic Shot", 1: "Possible", 0: "Possible"},
    2: {4: "Strong Chance", 3: "Realistic Shot", 2: "Possible", 1: "Possible", 0: "Major Reach"},
    1: {4: "Realistic Shot", 3: "Possible", 2: "Possible", 1: "Major Reach", 0: "Moonshot"},
    0: {4: "Major Reach", 3: "Major Reach", 2: "Moonshot", 1: "Moonshot", 0: "Moonshot"},
}
# fixed values: swim tier to support band
SWIM_BANDS = {
    "High-Point Contender": 4,
    "Conference Star": 4,
    "Priority Recruit": 3,
    "Top Recruit": 3,
    "Recruitable": 2,
    "Below Roster Level": 1,
    "Not Competitive": 0,
}
# fixed values: selectivity limits (accept fraction at most, median SAT at least) and floor offset
SELECTIVITY = [
    ("ultra_selective", 0.15, 1500),
    ("highly_selective", 0.30, 1400),
    ("selective", 0.50, 1300),
]
SAT_OFFSETS = {"ultra_selective": 60, "highly_selective": 80, "selective": 100, "broader_admit": 120}
# fixed values: label colours
LABEL_COLORS = {
    "Very Strong Chance": "#059669",
    "Strong Chance": "#10B981",
    "Realistic Shot": "#2563EB",
    "Possible": "#3B82F6",
    "Major Reach": "#F59E0B",
    "Moonshot": "#6B7280",
    MOONSHOT_FUN: "#6B7280",
}
# fixed values: working columns of `school_terms`
SCHOOL_TERMS = ["_lo", "_hi", "_elite", "_floor", "_ultra", "_high", "_shift"]


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Map a column through a fixed table. The key is evaluated once, whatever the table's size."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def selectivity_tier(accept_pct, sat_median) -> Column:
    acc, sat = col(accept_pct) / F.lit(100.0), col(sat_median)
    out = None
    for name, max_acc, min_sat in SELECTIVITY:
        hit = _no(acc <= max_acc) | _no(sat >= min_sat)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("broader_admit")


def usable_sat(sat) -> Column:
    return F.when(col(sat) >= 400, col(sat))


def usable_gpa(gpa) -> Column:
    return F.when(col(gpa) > 0, col(gpa))


def cap_rank(rank: Column, best_allowed: str) -> Column:
    """Labels are handled as ranks 0..5; a cap can only lower."""
    return F.least(rank, F.lit(LABELS.index(best_allowed)))


def school_terms(df, accept="accept", sat_median="sat_median", sat25="sat25", sat75="sat75", hidden_ivy="hidden_ivy", psf="psf"):
    """Add the columns of the decision that hang on the school alone: selectivity, the SAT range with its floor, flags and shift.
    Where schools are joined to many participants they are worked out before the join, once a school."""
    med = col(sat_median)
    lo = F.coalesce(F.nullif(col(sat25), F.lit(0)), F.when(med != 0, med - 60))
    hi = F.coalesce(F.nullif(col(sat75), F.lit(0)), F.when(med != 0, med + 60))
    d = df.withColumns({"_lo": lo, "_hi": hi, "sel_tier": selectivity_tier(accept, sat_median), "_elite": _no(col(hidden_ivy))})
    floor = F.greatest(F.lit(800), F.col("_lo") - lookup(F.col("sel_tier"), SAT_OFFSETS).cast("int"))
    return d.withColumns({
        "_floor": F.when(F.col("_lo").isNotNull(), floor),
        "_ultra": F.col("sel_tier") == "ultra_selective",
        "_high": F.col("sel_tier") == "highly_selective",
        "_shift": F.when(col(psf) > 1.0, 1).when(col(psf) <= 0.78, -1).otherwise(0),
    })


def admission_bands(df, sat="sat", gpa="gpa", sat_median="sat_median", gpa_mean="gpa_mean", adj_tier="adj_tier"):
    """Add the working columns of the decision to rows with `school_terms`: bands and how they compare with the floors."""
    base = df.withColumns({"_s": usable_sat(sat), "_g": usable_gpa(gpa)})
    s, g = F.col("_s"), F.col("_g")
    base = base.withColumns({"_gpa_low": _no(g < 2.0), "_below": _no(s < F.col("_floor"))})
    # outside the low-GPA stop the floor only counts when the whole range is known
    base = base.withColumn("_sat_low", F.col("_below") & (F.col("_gpa_low") | F.col("_hi").isNotNull()))
    sat_sub = (
        F.when(s.isNull() | F.col("_lo").isNull() | F.col("_hi").isNull(), 0)
        .when(s > F.col("_hi"), 2)
        .when(s >= F.col("_lo"), 1)
        .when(~F.col("_sat_low"), 0)
        .otherwise(-2)
    )
    mean = col(gpa_mean)
    gpa_sub = F.when(_no(g > mean + 0.10), 1).when(_no(g < mean - 0.15), -1).otherwise(0)
    swim = F.greatest(F.lit(0), F.least(F.lit(4), lookup(col(adj_tier), SWIM_BANDS, 0) + F.col("_shift")))
    # each of these is read several times and written once
    base = base.withColumns({"_raw": sat_sub + gpa_sub, "_swim": swim, "_weak": _no(s - col(sat_median) <= -120) | _no(g < 3.4)})
    raw = F.col("_raw")
    band = F.when(raw == 4, 4).when(raw >= 2, 3).when(raw >= 0, 2).when(raw >= -2, 1).otherwise(0)
    return base.withColumns({
        "acad_band": F.when(F.col("_gpa_low"), 0).otherwise(band),
        "swim_band": F.when(F.col("_weak"), 0).when(F.col("_elite"), F.least(F.col("_swim"), F.lit(2))).otherwise(F.col("_swim")),
    })


def admission_label(df, has_meta="has_meta", moonshot="moonshot", sat="sat", gpa="gpa", sat_median="sat_median",
                    gpa_mean="gpa_mean", adj_tier="adj_tier", prepared: bool = False, **school):
    """Add `label`, `color`, `acad_band`, `swim_band`. Guardrails run in their fixed order. `prepared` rows carry their
    `school_terms` already; all working columns are dropped."""
    d = df if prepared else school_terms(df, sat_median=sat_median, **school)
    given = [c for c in df.columns if c not in SCHOOL_TERMS] if prepared else df.columns
    d = admission_bands(d, sat, gpa, sat_median, gpa_mean, adj_tier)
    acad, swim = F.col("acad_band"), F.col("swim_band")
    cells = [LABELS.index(MATRIX[a][s]) for a in range(5) for s in range(5)]
    d = d.withColumn("_rank", F.get(F.array(*[F.lit(x) for x in cells]), acad * 5 + swim))

    def step(expr: Column) -> None:
        nonlocal d
        d = d.withColumn("_rank", expr)

    r = F.col("_rank")
    step(
        F.when(F.col("_sat_low") & F.col("_gpa_low"), 0)
        .when(F.col("_gpa_low"), F.when(swim == 4, 1).otherwise(0))
        .when(F.col("_sat_low") & (acad == 0), cap_rank(r, "Major Reach"))
        .otherwise(r)
    )
    ultra, high = F.col("_ultra"), F.col("_high")
    step(F.when((ultra | high) & _no(F.col("_g") < 3.5), 0).otherwise(r))
    strong_alone = (acad >= 3) & ~F.col("_elite") & ~F.col("_weak")
    step(F.when((swim == 0) & strong_alone, 4).when(swim == 0, cap_rank(r, "Possible")).otherwise(r))
    step(
        F.when(ultra & (acad == 0), 0)
        .when(ultra & (swim == 0), 0)
        .when(ultra & (acad == 1) & (swim == 4), cap_rank(r, "Possible"))
        .when(high & (acad == 0), F.when(swim >= 3, cap_rank(r, "Major Reach")).otherwise(0))
        .otherwise(r)
    )
    step(F.when(F.col("_weak"), cap_rank(r, "Major Reach")).otherwise(r))
    decided = col(has_meta) & ~_no(col(moonshot))
    label = F.when(~col(has_meta), "Unknown").when(_no(col(moonshot)), MOONSHOT_FUN).otherwise(
        F.get(F.array(*[F.lit(x) for x in LABELS]), r)
    )
    d = d.withColumns({
        "label": label,
        "acad_band": F.when(decided, acad),
        "swim_band": F.when(decided, swim),
    }).withColumn("color", lookup(F.col("label"), LABEL_COLORS, "#94A3B8"))
    return d.drop(*[c for c in d.columns if c.startswith("_") and c not in given])


def admission_label_simple(accept, sat_median, sat) -> Column:
    """Rule for entities outside the scored set: accept band and SAT gap only."""
    acc = F.coalesce(col(accept), F.lit(50))
    gap = usable_sat(sat) - F.coalesce(col(sat_median), F.lit(1200))
    at = lambda d: _no(gap >= d)
    return (
        F.when(acc <= 7, "Moonshot")
        .when(acc <= 15, F.when(at(-30), "Major Reach").otherwise("Moonshot"))
        .when(acc <= 25, F.when(at(0), "Realistic Shot").when(at(-60), "Major Reach").otherwise("Moonshot"))
        .otherwise(F.when(at(0), "Strong Chance").when(at(-80), "Realistic Shot").otherwise("Major Reach"))
    )


# fixed values: ACT composite -> SAT composite
ACT_SAT = {
    36: 1590, 35: 1540, 34: 1500, 33: 1460, 32: 1430, 31: 1400, 30: 1370, 29: 1340, 28: 1310, 27: 1280, 26: 1240,
    25: 1210, 24: 1180, 23: 1140, 22: 1110, 21: 1080, 20: 1040, 19: 1010, 18: 970, 17: 930, 16: 890, 15: 850,
}


def act_to_sat(act) -> Column:
    a = col(act).cast("int")
    formula = F.bround(a / F.lit(36.0) * 1200 + 400, 0).cast("int")
    return F.coalesce(lookup(a, ACT_SAT), formula)


# fixed values: cost of attendance by accept percent, two published tables
COST_SIX = [(10, 90000), (20, 87000), (35, 82000), (55, 75000), (70, 65000), (None, 58000)]
COST_FIVE = [(20, 72000), (35, 67000), (55, 61000), (70, 56000), (None, 51000)]


def cost_of_attendance(accept, bands=None) -> Column:
    out = None
    for limit, cost in bands or COST_SIX:
        if limit is None:
            return out.otherwise(F.lit(cost))
        cond = col(accept) <= limit
        out = F.when(cond, F.lit(cost)) if out is None else out.when(cond, F.lit(cost))
    return out


def _money(c: Column) -> Column:
    return F.format_number(c, 0)


def merit_estimate(merit_level, sat, gpa, sat_median, accept, bands=None) -> Column:
    """Struct of cost, merit range, net range and the display strings."""
    coa = cost_of_attendance(accept, bands)
    level = col(merit_level)
    gap = F.coalesce(F.nullif(col(sat), F.lit(0)), F.lit(1000)) - F.coalesce(
        F.nullif(col(sat_median), F.lit(0)), F.lit(1200)
    )
    elite = _no(col(gpa) >= 3.9)
    most = F.when(level == "high", 25).otherwise(15)  # thousands
    # percent of the maximum, low and high end
    lo_pct = F.when(gap < -50, 0).when((gap <= 50) & ~elite, 25).when((gap <= 120) & ~elite, 50).otherwise(65)
    hi_pct = F.when(gap < -50, 0).when((gap <= 50) & ~elite, 40).when((gap <= 120) & ~elite, 65).otherwise(75)
    thousands = lambda pct: F.bround(most * pct / F.lit(100.0), 0).cast("int") * 1000
    lo, hi = thousands(lo_pct), thousands(hi_pct)
    none, low = level == "none", lo_pct == 0
    offers = ~none & ~low
    coa_text = F.concat(F.lit("~$"), _money(coa))
    span = lambda x, y: F.concat(F.lit("~$"), _money(x), F.lit("–$"), _money(y))
    floor0 = lambda x: F.greatest(F.lit(0), x)
    return F.struct(
        coa.alias("coa"),
        F.when(offers, lo).alias("merit_low"),
        F.when(offers, hi).alias("merit_high"),
        F.when(none, "None").when(low, "$0").otherwise(span(lo, hi)).alias("merit"),
        F.when(none, F.concat(coa_text, F.lit(" before need-based aid")))
        .when(low, coa_text)
        .otherwise(span(floor0(coa - hi), floor0(coa - lo)))
        .alias("net"),
        F.when(none, "This school does not offer merit scholarships—aid here is need-based.")
        .when(low, "Your current academic numbers are below this school's typical merit threshold.")
        .otherwise("Strong students like you are often considered for merit here.")
        .alias("note"),
        offers.alias("has_merit"),
    )


def merit_signal(sat, sat25, sat75, gpa, gpa_mean) -> Column:
    given = lambda c: F.nullif(col(c).cast("double"), F.lit(0.0))
    s, lo, hi, g, m = (given(c) for c in (sat, sat25, sat75, gpa, gpa_mean))
    return (
        F.when(_no(s > hi), "above_75th")
        .when(_no(s > lo), "above_median")
        .when(s.isNotNull() & lo.isNotNull(), "at_or_below_median")
        .when(_no(g > m), "above_median")
        .when(g.isNotNull() & m.isNotNull(), "at_or_below_median")
        .otherwise("unknown")
    )


def merit_projection(signal, low, high) -> Column:
    """Projected part of a published merit range; null where no number may be given."""
    lo, hi, sig = col(low), col(high), col(signal)
    part = lambda f: lo + F.floor((hi - lo) * F.lit(f)).cast("int")
    return F.struct(
        F.when(sig == "above_75th", part(0.55)).when(sig == "above_median", part(0.25)).alias("proj_low"),
        F.when(sig == "above_75th", hi).when(sig == "above_median", part(0.60)).alias("proj_high"),
    )


