"""Expected grids, missing-row classification, roll-ups and population counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.events import OPTIONAL_EVENTS
from .keyed import first_per_key

TARGET_PLACE = 16
LISTED = 500
EXCUSED = ["missing_optional_1000", "missing_data_ceiling", "missing_likely_not_contested"]


def expected_grid(groups: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """Every group combined with every expected value of the given columns.

    The value lists are fixed, so each group row is expanded in place; nothing is joined.
    """
    d = groups
    for name, items in values.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return d


def expected_grid_of(groups: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Same with dimension columns that come from data. The values lie in lists of about `LISTED`; every group meets every list
    by its number, so a dimension may have any number of values."""
    d = groups
    for name, dim in dims.items():
        values = dim.select(name).filter(F.col(name).isNotNull()).distinct()
        lists = max(1, -(-values.count() // LISTED))
        listed = values.groupBy(F.pmod(F.xxhash64(name), F.lit(lists)).alias("_list")).agg(F.collect_list(name).alias("_values"))
        d = d.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lists - 1).cast("bigint"))))
        d = d.join(listed, "_list").withColumn(name, F.explode("_values")).drop("_list", "_values")
    return d


def depth_achievable(depth: Column, deepest: Column, count: Column) -> Column:
    enough = (depth >= TARGET_PLACE) | (deepest >= TARGET_PLACE) | (count >= TARGET_PLACE)
    return F.when(enough, "yes").when((depth > 0) | (count > 0), "no").otherwise("na")


def coverage_status(grid: DataFrame, captured: DataFrame, depth: DataFrame, keys: Sequence[str], event: str = "event",
                    not_contested: Column | None = None) -> DataFrame:
    """Status per expected row. `captured` carries the keys and data_quality; `depth` the keys with
    swimmer_count, deepest_place and consecutive_depth."""
    keys = list(keys)
    d = grid.join(captured.select(*keys, "data_quality"), keys, "left").join(depth, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("swimmer_count", "deepest_place", "consecutive_depth")}
    d = d.withColumn("_seen", F.col("swimmer_count").isNotNull()).withColumns(zero)
    run, deep, n = F.col("consecutive_depth"), F.col("deepest_place"), F.col("swimmer_count")
    ceiling = F.col("_seen") & (run < TARGET_PLACE) & (deep < TARGET_PLACE) & (n < TARGET_PLACE)
    got = F.col("data_quality").isNotNull()
    optional = F.col(event).isin(OPTIONAL_EVENTS)
    uncontested = F.coalesce(not_contested, F.lit(False)) if not_contested is not None else F.lit(False)
    status = (
        F.when(got, "captured").when(optional, "missing_optional_1000")
        .when(uncontested, "missing_likely_not_contested").when(ceiling, "missing_data_ceiling")
        .otherwise("missing_true_parser_miss")
    )
    notes = (
        F.when(got, "").when(optional, "optional_not_required").when(uncontested, "likely_not_contested")
        .when(ceiling, F.format_string(
            "data_ceiling — consecutive_depth: %d, swimmers: %d, target: %d", run, n, F.lit(TARGET_PLACE)))
        .when(F.col("_seen"), "event_detected_but_incomplete").otherwise("not_detected")
    )
    source = F.when(got, F.col("data_quality")).when(optional, "not_required").when(uncontested, "not_contested").otherwise("missing")
    reach = (F.when(got, "yes").when(optional | uncontested, "na").when(ceiling, "no")
             .otherwise(depth_achievable(run, deep, n)))
    return d.withColumns({
        "coverage_status": status, "detected": F.when(got, "yes").otherwise("no"), "source_type": source,
        "notes": notes, "target_anchor_place": F.lit(TARGET_PLACE), "anchor_depth_achievable_yn": reach,
    }).drop("_seen", "data_quality")


def coverage_rollup(coverage: DataFrame, by: str = "conference", event: str = "event", enough: int = 18) -> DataFrame:
    """Per group: captured of possible, per gender, the missing list and a status.

    The missing list is bounded by the event grid of the group, so it is collected after the filter.
    """
    rows = coverage.filter(F.col(by) != "Unknown")
    yes, required = F.col("detected") == "yes", ~F.col(event).isin(OPTIONAL_EVENTS)
    miss = required & ~yes
    label = F.concat(F.col("gender"), F.lit(" "), F.col(event), F.lit(" ("), F.col("coverage_status"), F.lit(")"))
    d = rows.groupBy(by).agg(
        F.count_if(required & yes).alias("anchors_captured"),
        F.count_if(required).alias("total_possible"),
        F.count_if(yes & (F.col("gender") == "men")).alias("men_anchors"),
        F.count_if(yes & (F.col("gender") == "women")).alias("women_anchors"),
        F.count_if(miss).alias("missing_events_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(miss, label))), "; ").alias("missing_events_list"),
        F.count_if(miss & ~F.col("coverage_status").isin(EXCUSED)).alias("_unexcused"),
    )
    status = (F.when((F.col("anchors_captured") == F.col("total_possible")) | (F.col("_unexcused") == 0), "Perfect")
              .when(F.col("anchors_captured") >= enough, "Strong").otherwise("Gaps"))
    return d.withColumn("conference_status", status).drop("_unexcused")


def overall_coverage(rollup: DataFrame) -> DataFrame:
    """Number and whole percentage of groups per status."""
    total = F.count("*")
    cols = []
    for s in ("Perfect", "Strong", "Gaps"):
        n = F.count_if(F.col("conference_status") == s)
        cols += [n.alias(s.lower()), F.floor(100 * n / total).alias(f"{s.lower()}_pct")]
    return rollup.agg(total.alias("conferences"), *cols)


def missing_classification_counts(coverage: DataFrame, by: str = "conference", event: str = "event") -> DataFrame:
    rows = coverage.filter((F.col(by) != "Unknown") & (F.col("detected") != "yes") & ~F.col(event).isin(OPTIONAL_EVENTS))
    return rows.groupBy("coverage_status").agg(F.count("*").alias("n"))


def category_counts(rows: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """One column per known category."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(category) == v).alias(f"n_{v}") for v in values])


def under_quota(entities: DataFrame, rows: DataFrame, key: str, category: str, values: Sequence[str], quota: int = 16) -> DataFrame:
    """(entity, category) pairs that hold fewer rows than the quota, absent ones included."""
    counts = rows.groupBy(key, category).agg(F.count("*").alias("n"))
    grid = expected_grid(entities.select(key).distinct(), {category: values})
    d = grid.join(counts, [key, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.filter(F.col("n") < quota)


def curation_progress(schools: DataFrame, candidates: DataFrame, curated: DataFrame, key: str = "school",
                      group: str = "conference") -> DataFrame:
    """Per group: members, curated members, members with candidates."""
    cand = candidates.select(key).distinct().withColumn("_cand", F.lit(True))
    cur = curated.select(key).distinct().withColumn("_cur", F.lit(True))
    d = schools.join(cand, key, "left").join(cur, key, "left")
    return d.groupBy(group).agg(
        F.count("*").alias("school_count"), F.count("_cur").alias("curated_count"),
        F.count("_cand").alias("has_candidates_count"))


def tier_histogram(rows: DataFrame, tier: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts in a fixed tier order plus a text of the non-empty ones."""
    counts = [F.count_if(F.col(tier) == t).alias(f"n{i}") for i, t in enumerate(order)]
    d = rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)
    parts = [F.when(F.col(f"n{i}") > 0, F.concat(F.col(f"n{i}").cast("string"), F.lit(f" {t}"))) for i, t in enumerate(order)]
    return d.withColumn("summary", F.concat_ws(", ", *parts))


def population_counts(rows: DataFrame, has_data: Column, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count("*").alias("total"), F.count_if(has_data).alias("with_data"),
            F.count_if(~F.coalesce(has_data, F.lit(False))).alias("without_data")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def conference_members(teams: DataFrame, group: str = "conference", member: str = "school", finish: str = "finish") -> DataFrame:
    """Distinct members of each group in finish order (missing last), numbered by a rank within the group.

    Kept as rows, so a group of any size stays distributed; members share no list.
    """
    best = teams.groupBy(group, member).agg(F.min(F.coalesce(F.nullif(finish, F.lit(0)), F.lit(99))).alias("finish_order"))
    return best.orderBy(group, "finish_order", member)


def source_coverage(rows: DataFrame, pages: DataFrame, keys: Sequence[str] = ("bundle_id",)) -> DataFrame:
    """Per bundle: pages scanned, rows captured, genders, selected source and parse status."""
    keys = list(keys)
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("rows_captured"),
        F.array_join(F.array_sort(F.collect_set("gender")), "|").alias("genders_found"),
        F.min_by("source", F.struct("gender", "rank", "source")).alias("selected_source"),
    )
    d = pages.groupBy(*keys).agg(F.sum("pages_scanned").alias("candidate_pages_scanned"),
                                 F.max("section_found").alias("_heading")).join(got, keys, "left")
    both = F.col("genders_found").isin("men|women") | F.contains(F.coalesce("genders_found", F.lit("")), F.lit("combined")) | (
        F.col("genders_found").rlike(r"\bmen\b") & F.col("genders_found").rlike(r"\bwomen\b"))
    status = (F.when(F.col("rows_captured").isNotNull(), F.when(both, "captured_complete").otherwise("captured_partial"))
              .when(F.col("_heading"), "section_found_no_rows").otherwise("section_not_found"))
    return d.select(
        *keys, F.coalesce("selected_source", F.lit("")).alias("selected_source"), "candidate_pages_scanned",
        F.col("rows_captured").isNotNull().alias("section_found"),
        F.coalesce("rows_captured", F.lit(0)).alias("rows_captured"),
        F.coalesce("genders_found", F.lit("")).alias("genders_found"), status.alias("parse_status"))


def needs_refresh(entities: DataFrame, entries: DataFrame, key: str, slots: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """Entities without an entry, with an empty slot, or with a slot marked as fallback."""
    d = entities.select(key).distinct().join(entries, key, "left")
    bad = F.lit(False)
    for s in slots:
        bad = bad | (F.coalesce(F.col(s), F.lit("")) == "")
    for f in fallback:
        bad = bad | F.coalesce(F.col(f), F.lit(False))
    return d.filter(bad).select(key)


def dominant_domain(links: DataFrame, key: str, url: str = "url", suffix: str | None = None) -> DataFrame:
    """Most frequent registrable domain (last two host parts) per entity; ties by name."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    d = links.withColumn("_host", host).filter(F.contains("_host", F.lit(".")))
    if suffix:
        d = d.filter(F.endswith("_host", F.lit(suffix)))
    counts = d.groupBy(key, F.substring_index("_host", ".", -2).alias("domain")).agg(F.count("*").alias("n"))
    return first_per_key(counts, [key], [F.desc("n"), F.asc("domain")])
