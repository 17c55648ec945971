"""Anchors, coverage and team tables from result text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import events as E
from ..functions.admission import lookup
from ..functions.text import source_priority
from ..operators import anchors as A, coverage as C, extraction as X, tiers as T
from ..session import cut_lineage
from ..sources.tables import file_metadata

GROUP = ["bundle_id", "gender", "event"]


VOTE_PAGES = 8


def classify_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """files with name_gender, file_gender and session_score: by the file's name where it says so, else by its text.

    The text votes for the gender with its first and last eight pages (so a file with all women's events first is seen to hold
    both), and for the session with its first eight. A phrase counts within a line. A file without any sign of a gender holds both.
    """
    pages = lines.groupBy("source_file").agg(F.max("page_no").alias("_n"))
    d = lines.join(pages, "source_file").filter((F.col("page_no") <= VOTE_PAGES) | (F.col("page_no") > F.col("_n") - VOTE_PAGES))
    session = F.when(F.col("page_no") <= VOTE_PAGES, E.session_score("text")).otherwise(0)
    votes = d.groupBy("source_file").agg(F.sum(E.gender_signals("text", "men")).alias("_men"), F.sum(E.gender_signals("text", "women")).alias("_women"), F.sum(session).alias("_session"))
    d = files.withColumn("_m", file_metadata("source_file")).join(votes, "source_file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    said = E.gender_vote(zero("_men"), zero("_women"))
    kind = F.when(F.col("_m.is_prelim"), "prelims").when(F.col("_m.is_final"), "finals").otherwise(E.session_vote(zero("_session")))
    return d.select(*files.columns, F.col("_m.gender").alias("name_gender"), F.when(F.col("_m.gender").isin("men", "women"), F.col("_m.gender"))
                    .when(said != "unknown", said).otherwise("combined").alias("file_gender"), lookup(kind, E.SESSION_SCORES, 1).cast("int").alias("session_score"))


def fold_sections(results: DataFrame, files: DataFrame) -> DataFrame:
    """Sections of the same event within a file folded in text order."""
    d = results.join(files.select("source_file", "bundle_id", "session_score"), "source_file")
    keys = ["bundle_id", "gender", "event", "source_file"]
    return A.smart_merge(d.select(*keys, "header_line", "place", "sec", "session_score"), keys, "header_line")


def incomplete_groups(versions: DataFrame, groups: DataFrame) -> DataFrame:
    """Expected (bundle, gender, event) without any version that has complete anchors."""
    done = A.version_summary(versions, GROUP, "source_file").filter("has_anchor").select(*GROUP).distinct()
    grid = C.expected_grid(groups.select("bundle_id", "gender").distinct(), {"event": E.TARGET_EVENTS})
    return grid.join(done, GROUP, "left_anti")


def event_versions(lines: DataFrame, files: DataFrame, recover: bool = True) -> DataFrame:
    """All versions (one per source file and pass) of every event, with the second pass for incomplete groups.

    files: source_file, bundle_id, file_gender, name_gender, session_score, file_order. Lines that hold several entries are
    split first. A bundle whose first pass finds nothing is taken for men's.
    """
    lines = X.split_merged(lines)
    first = fold_sections(X.extract_results(lines, files.select("source_file", "file_gender", "name_gender")), files)
    first = cut_lineage(first.withColumn("pass", F.lit(1)))
    if not recover:
        return first
    genders = files.select("bundle_id").distinct().join(first.select("bundle_id", "gender").distinct(), "bundle_id", "left")
    missing = incomplete_groups(first, genders.select("bundle_id", F.coalesce("gender", F.lit("men")).alias("gender")))
    found = X.second_pass(lines, files.select("source_file", "bundle_id", "file_gender"), missing)
    second = cut_lineage(fold_sections(found, files))
    # files are read in order and reading stops for an event once one of them completed it
    full = A.version_summary(second, GROUP, "source_file").filter("has_anchor")
    order = files.select("source_file", "file_order")
    stop = full.join(order, "source_file").groupBy(*GROUP).agg(F.min("file_order").alias("_stop"))
    second = second.join(order, "source_file").join(stop, GROUP, "left")
    second = second.filter(F.col("_stop").isNull() | (F.col("file_order") <= F.col("_stop"))).drop("file_order", "_stop")
    return first.unionByName(second.withColumn("pass", F.lit(2)))


def build_anchors(lines: DataFrame, files: DataFrame, recover: bool = True) -> dict[str, DataFrame]:
    """anchors, places, flags and fallbacks of all bundles. files also carries conference and year; it is a short table that
    many steps read, so it, and the votes it may come from, are worked out once."""
    files = cut_lineage(files)
    v = event_versions(lines, files, recover)
    v = cut_lineage(v.withColumn("version", F.concat_ws("#", "source_file", F.col("pass").cast("string"))))
    summary = A.version_summary(v, GROUP, "version")
    plausible = E.plausible_range("event", "first_sec", "gender")
    best = A.pick_best_version(summary, GROUP, "version", plausible)
    chosen = v.join(best.select(*GROUP, "version"), [*GROUP, "version"], "left_semi")
    info = files.select("bundle_id", "conference", "year").dropDuplicates(["bundle_id"])
    meta = chosen.groupBy(*GROUP).agg(F.max("session_score").alias("session_score"), F.min("source_file").alias("source_file"))
    rows = A.nth_anchors(chosen, GROUP).join(meta, GROUP).join(info, "bundle_id")
    rows = rows.withColumn("data_quality", A.quality_label(F.col("session_score")))
    kept, dropped = A.first_wins(rows, ["conference", "year", "gender", "event"], ["bundle_id"])
    fallback = kept.filter("data_quality <> 'finals'").withColumn("fallback_type", A.fallback_type(F.col("data_quality")))
    places = chosen.join(kept.select(*GROUP, "data_quality"), GROUP)
    return {"anchors": kept, "duplicates": dropped, "flags": best.filter("flags <> ''"), "fallbacks": fallback,
            "places": places.select(*GROUP, "place", "sec", "data_quality"), "chosen": chosen}


def coverage_report(anchors: DataFrame, chosen: DataFrame, bundles: DataFrame) -> dict[str, DataFrame]:
    """Coverage per bundle, gender and event, and the roll-up per conference."""
    grid = C.expected_grid(bundles.select("bundle_id", "conference"), {"gender": ["men", "women"], "event": E.TARGET_EVENTS})
    depth = A.consecutive_depth(chosen, GROUP)
    cov = C.coverage_status(grid, anchors, depth, GROUP)
    roll = C.coverage_rollup(cov)
    return {"coverage": cov, "rollup": roll, "overall": C.overall_coverage(roll),
            "missing": C.missing_classification_counts(cov)}


def build_team_tiers(raw: DataFrame) -> dict[str, DataFrame]:
    """Tiers, summary and QA of text score tables."""
    clean, qa = T.validate_table(raw)
    tiers = T.share_tiers(clean)
    return {"tiers": tiers, "summary": T.tier_summary(tiers), "qa": qa}


def build_team_scores(lines: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Final standings per bundle and gender, and the source coverage.

    files: source_file, bundle_id, conference, file_name.
    """
    pages = lines.groupBy("source_file").agg(F.max("page_no").alias("pages")).join(
        files.select("source_file", (source_priority("file_name") >= 200).alias("is_auxiliary")), "source_file")
    rows = X.tail_then_full(lines, pages)
    rows = rows.join(files.select("source_file", "bundle_id", "conference"), "source_file").withColumn("source", F.col("source_file"))
    final = T.best_source_per_group(rows, ["bundle_id", "gender"])
    seen = rows.groupBy("source_file").agg(F.lit(True).alias("section_found"))
    scanned = pages.join(seen, "source_file", "left").join(files.select("source_file", "bundle_id"), "source_file")
    scanned = scanned.select("bundle_id", F.col("pages").alias("pages_scanned"), F.coalesce("section_found", F.lit(False)).alias("section_found"))
    return {"scores": final, "coverage": C.source_coverage(final, scanned)}
