"""Team tables: data-quality rules, duplicate resolution, share tiers and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import norm_ws
from ..functions.numeric import exact_sum, round_to, to_double, to_long
from .keyed import first_per_key, with_group_stats

TABLE = ["bundle_id", "conference", "gender"]
TIER_MIN_RATIO = [("Tier 1", 0.85), ("Tier 2", 0.60), ("Tier 3", 0.35)]
TIER1A_MIN_SHARE = 0.24
QA_COLUMNS = [*TABLE, "issue_type", "team", "detail"]


def _issue(df: DataFrame, kind: str, team, detail: Column) -> DataFrame:
    return df.select(*TABLE, F.lit(kind).alias("issue_type"), team.alias("team"), detail.alias("detail"))


def _quoted(c: str) -> Column:
    return F.concat(F.lit("raw='"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))


def parse_scores(raw: DataFrame) -> DataFrame:
    """Typed score and rank beside the text ones. Expects bundle_id, conference, gender, rank, team, score, pos."""
    return raw.withColumns({
        "score_f": to_double(F.regexp_replace(F.trim("score"), ",", "")),
        "rank_i": to_long("rank").cast("int"),
        "team_key": norm_ws("team"),
    })


def dedupe_resolve(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per normalized team: the highest score, first seen on ties. Returns rows and QA issues."""
    keys = [*TABLE, "team_key"]
    groups = valid.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("pos").alias("first_pos"),
        F.min_by("team", "pos").alias("_first_team"),
        (F.min("score_f") != F.max("score_f")).alias("_scores_differ"),
        (F.min(F.coalesce("rank", F.lit(""))) != F.max(F.coalesce("rank", F.lit("")))).alias("_ranks_differ"),
        F.max("score_f").alias("_best"),
        F.min("score_f").alias("_worst"),
    )
    best = first_per_key(valid, keys, [F.desc("score_f"), F.asc("pos")])
    rows = best.join(groups.select(*keys, "first_pos"), keys)
    same = ~F.col("_scores_differ") & ~F.col("_ranks_differ")
    n = F.col("_n").cast("string")
    detail = F.when(same, F.concat(F.lit("n="), n, F.lit(" identical rows — kept one"))).otherwise(F.concat(
        F.lit("n="), n, F.lit(" rows with differing scores ["), F.col("_worst").cast("string"), F.lit(" .. "),
        F.col("_best").cast("string"), F.lit("] — kept highest ("), F.col("_best").cast("string"), F.lit(")")))
    qa = _issue(groups.filter("_n > 1"), "duplicate_team_row", F.col("_first_team"), detail)
    return rows, qa


def duplicate_rank(rows: DataFrame) -> DataFrame:
    """Every holder of a rank after the first one, with the first holder named."""
    held = rows.filter(F.col("rank_i").isNotNull())
    firsts = held.groupBy(*TABLE, "rank_i").agg(
        F.min("first_pos").alias("_head"), F.min_by("team", "first_pos").alias("_holder"))
    later = held.join(firsts, [*TABLE, "rank_i"]).filter(F.col("first_pos") > F.col("_head"))
    detail = F.concat(F.lit("rank="), F.col("rank_i").cast("string"), F.lit(" also assigned to "), F.col("_holder"))
    return _issue(later, "duplicate_rank", F.col("team"), detail)


def validate_table(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows of usable tables, and one QA row per problem."""
    d = parse_scores(raw)
    none = F.lit("")
    qa = [
        _issue(d.filter(F.col("score_f").isNull()), "malformed_score", F.col("team"), _quoted("score")),
        _issue(d.filter("score_f < 0"), "negative_score", F.col("team"),
               F.concat(F.lit("score="), F.col("score_f").cast("string"))),
    ]
    valid = d.filter("score_f >= 0")
    qa.append(_issue(valid.filter(F.col("rank_i").isNull()), "missing_rank", F.col("team"), _quoted("rank")))
    rows, dup = dedupe_resolve(valid)
    qa += [dup, duplicate_rank(rows)]
    tables = d.groupBy(*TABLE).agg(F.max(F.when(F.col("score_f") >= 0, F.col("score_f"))).alias("_top"))
    bad = tables.filter(F.coalesce(F.col("_top"), F.lit(0.0)) <= 0)
    why = F.when(F.col("_top").isNull(), "no_parseable_rows").otherwise("all_scores_zero_or_negative")
    qa.append(_issue(bad, "invalid_table", none, why))
    qa.append(_issue(bad, "skipped_table", none, F.lit("table_failed_validation")))
    clean = rows.join(bad.select(*TABLE), TABLE, "left_anti")
    issues = qa[0]
    for q in qa[1:]:
        issues = issues.unionByName(q)
    return clean, issues


def share_tiers(rows: DataFrame, keys=TABLE, score: str = "score_f") -> DataFrame:
    """Ratio to the group's best, share of its total, and the tier they imply."""
    d = with_group_stats(rows, keys, champion_score=F.max(score), total_meet_points=exact_sum(score, 4))
    frac = lambda den: F.coalesce(round_to(F.try_divide(F.col(score), F.col(den)), 6), F.lit(0.0))
    d = d.withColumns({"champion_ratio": frac("champion_score"), "meet_share": frac("total_meet_points")})
    base = None
    for name, limit in TIER_MIN_RATIO:
        cond = F.col("champion_ratio") >= limit
        base = F.when(cond, name) if base is None else base.when(cond, name)
    d = d.withColumn("base_tier", base.otherwise("Tier 4"))
    top, big = F.col("base_tier") == "Tier 1", F.col("meet_share") >= TIER1A_MIN_SHARE
    return d.withColumns({
        "power_class": F.when(top & big, "Super Powerhouse").when(top, "Powerhouse").otherwise(""),
        "final_tier": F.when(top & big, "Tier 1A").when(top, "Tier 1B").otherwise(F.col("base_tier")),
    })


def tier_order(df: DataFrame) -> list[Column]:
    return [F.asc("conference"), F.asc("gender"), F.coalesce("rank_i", F.lit(9999)).asc(), F.desc("score_f"), F.asc("team")]


def tier_rows_sort(df: DataFrame) -> DataFrame:
    """Conference, gender, rank (missing last), score descending, team."""
    return df.orderBy(*tier_order(df))


def tier_summary(rows: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(F.col("final_tier") == t)
    first = F.when(F.col("rank_i") == 1, F.struct(-F.col("score_f"), F.col("team")))
    best = F.struct(-F.col("score_f"), F.coalesce("rank_i", F.lit(9999)), F.col("team"))
    return rows.groupBy(*TABLE).agg(
        F.count("*").alias("number_of_teams"),
        F.trim(F.coalesce(F.min_by("team", first), F.min_by("team", best))).alias("winner"),
        F.max("champion_score").alias("champion_score"),
        F.max("total_meet_points").alias("total_meet_points"),
        count("Tier 1A").alias("tier_1a_count"), count("Tier 1B").alias("tier_1b_count"),
        count("Tier 2").alias("tier_2_count"), count("Tier 3").alias("tier_3_count"),
        count("Tier 4").alias("tier_4_count"),
    )


def best_source_per_group(rows: DataFrame, keys, source="source", rank="rank", team="team", score="score") -> DataFrame:
    """The source with the highest rank-1 score wins its group (first name on ties); groups without a rank 1 keep
    all sources. Then the best row per (rank, team)."""
    keys = list(keys)
    best = rows.filter(F.col(rank) == 1).groupBy(*keys).agg(
        F.min_by(source, F.struct(-F.col(score), F.col(source))).alias("_source"))
    kept = rows.join(best, keys, "left").filter(F.col("_source").isNull() | (F.col(source) == F.col("_source")))
    return first_per_key(kept.drop("_source"), [*keys, rank, team], [F.desc(score), F.asc(source)])


