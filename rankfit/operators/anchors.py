"""From ranked results to three anchors per group: depth, versions, merging, coverage status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import round_to
from .keyed import first_per_key

ANCHOR_PLACES = (1, 8, 16)
MIN_SHORT_FIELD = 8
OVERLAP_LIMIT = 3


def fastest_per_place(df: DataFrame, keys: Sequence[str], place: str = "place", sec: str = "sec") -> DataFrame:
    """One value per (group, place): the fastest."""
    return df.groupBy(*keys, place).agg(F.min(sec).alias(sec))


def nth_anchors(df: DataFrame, keys: Sequence[str], place: str = "place", sec: str = "sec") -> DataFrame:
    """Anchors at places 1, 8 and 16 with the two tolerances: a single gap between present neighbours, and a
    complete short field of at least eight. Groups without all three anchors are dropped.

    Input holds one row per (group, place). One partial aggregation, no window.
    """
    grouped = _place_values(df, keys, place, sec)
    t = {p: _anchor_at(p) for p in ANCHOR_PLACES}
    out = grouped.select(*keys, *[t[p].alias(f"t{p}") for p in ANCHOR_PLACES]).dropna(subset=["t1", "t8", "t16"])
    step = F.when(F.col("t16") != F.col("t1"), round_to((F.col("t16") - F.col("t1")) / 15, 4)).otherwise(0.0)
    return out.select(
        *keys,
        round_to("t1", 3).alias("first"),
        round_to("t8", 3).alias("eighth"),
        round_to("t16", 3).alias("sixteenth"),
        step.alias("sec_per_place"),
    )


def _place_values(df: DataFrame, keys, place: str, sec: str) -> DataFrame:
    p = F.col(place)
    needed = sorted({q for a in ANCHOR_PLACES for q in (a - 1, a, a + 1)})
    return df.groupBy(*keys).agg(
        *[F.max(F.when(p == q, F.col(sec))).alias(f"_p{q}") for q in needed],
        F.count(place).alias("_n"),
        F.min(place).alias("_min"),
        F.max(place).alias("_max"),
        F.max_by(sec, place).alias("_last"),
    )


def _anchor_at(p: int) -> Column:
    gap = (F.col(f"_p{p - 1}") + F.col(f"_p{p + 1}")) / 2.0
    complete = (F.col("_min") == 1) & (F.col("_n") == F.col("_max"))
    short = complete & (F.col("_max") >= MIN_SHORT_FIELD) & (F.col("_max") < p)
    return F.coalesce(F.col(f"_p{p}"), gap, F.when(short, F.col("_last")))


def consecutive_depth(df: DataFrame, keys: Sequence[str], place: str = "place") -> DataFrame:
    """Distinct places, deepest place and the unbroken run from place 1.

    The run ends at the smallest place without a successor, found by an anti join on (group, place), so a
    hot group is spread over tasks.
    """
    places = df.select(*keys, place).distinct()
    previous = places.withColumn(place, F.col(place) - 1)
    ends = places.join(previous, [*keys, place], "left_anti").groupBy(*keys).agg(F.min(place).alias("_run_end"))
    sizes = places.groupBy(*keys).agg(
        F.count("*").alias("swimmer_count"), F.max(place).alias("deepest_place"), F.min(place).alias("_min")
    )
    depth = F.when(F.col("_min") == 1, F.col("_run_end")).otherwise(F.lit(0))
    return sizes.join(ends, list(keys)).select(
        *keys, "swimmer_count", "deepest_place", depth.alias("consecutive_depth")
    )


def version_summary(df: DataFrame, keys: Sequence[str], version: str, place: str = "place", sec: str = "sec",
                    session: str = "session_score") -> DataFrame:
    """One row per (group, source version): session score, completeness, size, rank-1 value, has_anchor."""
    by = [*keys, version]
    vals = _place_values(df, [*by, session], place, sec)
    complete = sum((F.col(f"_p{p}").isNotNull().cast("int") for p in ANCHOR_PLACES), F.lit(0))
    has = F.lit(True)
    for p in ANCHOR_PLACES:
        has = has & _anchor_at(p).isNotNull()
    return vals.select(
        *by, session, complete.alias("completeness"), F.col("_n").alias("size"), F.col("_p1").alias("first_sec"),
        has.alias("has_anchor"),
    )


def pick_best_version(summary: DataFrame, keys: Sequence[str], version: str, plausible: Column,
                      session: str = "session_score") -> DataFrame:
    """Best version per group by session score, completeness, size, then version order. An implausible winner
    yields to the next plausible version with complete anchors. Flags say what happened."""
    rank = [F.desc(session), F.desc("completeness"), F.desc("size"), F.asc(version)]
    d = summary.withColumn("_ok", F.coalesce(plausible, F.lit(False)) & F.col("first_sec").isNotNull() & F.col("has_anchor"))
    best = first_per_key(d, keys, rank)
    alt = first_per_key(d.filter("_ok"), keys, rank).select(*keys, F.col(version).alias("_alt"))
    facts = d.groupBy(*keys).agg(
        F.max(session).alias("_top"),
        F.count_if((F.col(session) >= 2) & F.col("first_sec").isNotNull()).alias("_finals"),
        F.min(F.when(F.col(session) >= 2, round_to("first_sec", 2))).alias("_f_lo"),
        F.max(F.when(F.col(session) >= 2, round_to("first_sec", 2))).alias("_f_hi"),
    )
    out = best.join(alt, list(keys), "left").join(facts, list(keys))
    checked = F.col("has_anchor") & F.col("first_sec").isNotNull() & ~F.col("_ok")
    chosen = F.when(checked, F.coalesce(F.col("_alt"), F.col(version))).otherwise(F.col(version))
    flags = F.array_compact(F.array(
        F.when(F.col("_top") == 0, F.lit("only_prelims")),
        F.when((F.col("_finals") > 1) & (F.col("_f_lo") != F.col("_f_hi")), F.lit("conflicting_finals")),
        F.when(checked & F.col("_alt").isNotNull(), F.lit("implausible_replaced")),
        F.when(checked & F.col("_alt").isNull(), F.lit("implausible_kept")),
    ))
    return out.select(*keys, chosen.alias(version), F.array_join(flags, "; ").alias("flags"))


def smart_merge(df: DataFrame, keys: Sequence[str], version: str, place: str = "place", sec: str = "sec",
                session: str = "session_score") -> DataFrame:
    """Fold versions in order: little overlap (at most three places) unions the places, first kept; otherwise
    the better version (session score, then completeness) replaces the state.

    A version is one row with a bitmap of its places (64 to a word). The fold runs over the versions of a group in order and
    tells from which version on places count and which of the later ones were united; overlap is a count of common bits. The
    places themselves stay where they are and are picked by that answer. A group's versions, not its rows, are one array.
    """
    keys = list(keys)
    rows = df.groupBy(*keys, version, place).agg(F.min(F.struct(sec, session)).alias("_s"))
    rows = rows.select(*keys, F.col(version).alias("_v"), F.col(place).alias("_p"), F.col(f"_s.{sec}").alias("_sec"), F.col(f"_s.{session}").alias("_score"))
    # no place is a place too: a word of its own
    word = F.coalesce(F.floor(F.col("_p") / 64), F.lit(-(1 << 62)))
    bit = F.expr("shiftleft(1L, cast(coalesce(pmod(_p, 64), 0) AS int))")
    words = rows.groupBy(*keys, "_v", word.alias("_w")).agg(F.bit_or(bit).alias("_b"), F.max("_score").alias("_score"))
    versions = words.groupBy(*keys, "_v").agg(F.collect_list(F.struct("_w", "_b")).alias("bits"), F.max("_score").alias("score"))
    anchors = sum(1 << p for p in ANCHOR_PLACES)
    full = lambda bits: f"bit_count(coalesce({bits}[0L], 0L) & {anchors}L)"
    # maps have no order, their entries have
    ordered = versions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), "bits", "score"))).alias("_all"))
    fold = ordered.withColumn("_state", F.expr(f"""aggregate(
        transform(slice(_all, 2, size(_all)), (x, i) -> named_struct('i', i + 1, 'bits', map_from_entries(x.bits), 'score', x.score)),
        named_struct('bits', map_from_entries(_all[0].bits), 'score', _all[0].score, 'since', 0, 'united', cast(array() AS array<int>)),
        (s, x) -> CASE
            WHEN aggregate(map_values(map_zip_with(s.bits, x.bits, (k, a, b) -> bit_count(coalesce(a, 0L) & coalesce(b, 0L)))), 0, (n, c) -> n + c) <= {OVERLAP_LIMIT}
            THEN named_struct('bits', map_zip_with(s.bits, x.bits, (k, a, b) -> coalesce(a, 0L) | coalesce(b, 0L)), 'score', greatest(s.score, x.score), 'since', s.since, 'united', array_append(s.united, x.i))
            WHEN x.score > s.score OR (x.score = s.score AND {full('x.bits')} > {full('s.bits')})
            THEN named_struct('bits', x.bits, 'score', x.score, 'since', x.i, 'united', cast(array() AS array<int>))
            ELSE s END)"""))
    # the versions that count, in order, with the score of the merged state
    counting = fold.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.size("_all") > 1).alias("_merged"), F.col("_state.score").alias("_best"), F.inline(F.expr(
        "transform(array_prepend(_state.united, _state.since), i -> named_struct('_i', i, '_of', _all[i].v))")))
    same = F.col("_v").eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"_k_{k}"))
    held = rows.join(counting, same)
    score = F.when(F.col("_merged"), F.coalesce("_best", "_score")).otherwise(F.col("_score"))
    first = first_per_key(held.select(*keys, "_p", "_i", "_sec", score.alias("_score")), [*keys, "_p"], ["_i"])
    kinds = {f.name: f.dataType for f in df.schema}
    return first.select(*keys, F.col("_p").cast(kinds[place]).alias(place), F.col("_sec").cast(kinds[sec]).alias(sec), F.col("_score").cast(kinds[session]).alias(session))


def quality_label(session_score: Column) -> Column:
    return F.when(session_score >= 2, "finals").when(session_score == 1, "best_available").otherwise("prelim_fallback")


def fallback_type(quality: Column) -> Column:
    return F.when(quality == "prelim_fallback", "prelims_used_last_resort").when(
        quality == "best_available", "best_available_nonfinal_used")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence) -> tuple[DataFrame, DataFrame]:
    """The row that holds its key first (ties: the smallest of the other columns), and the suppressed duplicates with a flag.

    The first row of a key is a minimum, reduced before the shuffle. Rows meet it once, by key; a row that is not it is a
    duplicate as it stands, and of rows that equal it all but one are.
    """
    ranked = [*order, *[c for c in df.columns if c not in order]]
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_head"))
    kept = firsts.select("_head.*").select(*df.columns)
    marked = df.join(firsts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_head"), _null_safe(df, keys))
    marked = marked.withColumn("_is_first", F.struct(*ranked).eqNullSafe(F.col("_head")))
    copies = marked.filter("_is_first").groupBy(*df.columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    copies = copies.select(*df.columns, F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n"))).alias("_i")).drop("_i")
    dropped = marked.filter("NOT _is_first").select(*df.columns).unionByName(copies)
    return kept, dropped.withColumn("issue", F.lit("duplicate_suppressed"))


def _null_safe(df: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"_key_{k}"))
    return cond


def anchor_sanity(df: DataFrame, true5="true5", true14="true14", first="first", eighth="eighth", sixteenth="sixteenth"):
    """5th and 14th anchors: true places when both exist and are in order, derived ones otherwise, with a tag."""
    from ..functions.scoring import derived_fifth, derived_fourteenth

    d5, d14 = derived_fifth(first, eighth), derived_fourteenth(eighth, sixteenth)
    both = F.col(true5).isNotNull() & F.col(true14).isNotNull()
    p5, p14 = F.when(both, F.col(true5)).otherwise(d5), F.when(both, F.col(true14)).otherwise(d14)
    broken = p5 >= p14
    return df.withColumns({
        "fifth": F.when(broken, d5).otherwise(p5),
        "fourteenth": F.when(broken, d14).otherwise(p14),
        "source": F.when(broken, "derived_fallback").when(both, "true").otherwise("derived"),
    })


def monotonic_check(first, eighth, sixteenth) -> Column:
    """True when all three anchors exist and are out of order."""
    return F.coalesce(~((F.col(first) <= F.col(eighth)) & (F.col(eighth) <= F.col(sixteenth))), F.lit(False))
