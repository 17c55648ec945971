"""Score every participant at every school, or one school in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.admission import admission_label, school_terms
from ..functions.numeric import round_to
from ..functions.scoring import tier_label
from ..functions.text import division_of
from ..operators.coverage import expected_grid_of
from ..operators.topscore import dealt, score_events, top_k_sum
from ..session import short_values


def score_all(swimmers: DataFrame, times: DataFrame, anchors: DataFrame, schools: DataFrame) -> DataFrame:
    """One row per (swimmer, school).

    swimmers: swimmer, sat, gpa. times: swimmer, event, sec. anchors: conference, event and the anchor values.
    schools: conference, school, psf, has_swim, and the metadata columns of the admission decision with has_meta.

    Event points depend on the conference only, so the top-four sum is taken per (swimmer, conference) before schools
    come in. The grid is built by expanding each swimmer over the short list of conferences and joining schools on
    the conference; no table is crossed with another.
    """
    sums = top_k_sum(score_events(dealt(times), anchors)).select("swimmer", "conference", "raw_pts", "top_events", "has_depth")
    confs = [c for c, in short_values(schools, ["conference"]) if c is not None]
    # what hangs on the school alone is worked out once a school, not once a row of the result
    schools = school_terms(schools.withColumns({"psf": F.when(F.col("has_swim"), F.col("psf")).otherwise(1.0), "division": division_of("conference")}))
    grid = swimmers.withColumn("conference", F.explode(F.array(*[F.lit(c) for c in confs]).cast("array<string>")))
    d = grid.join(sums, ["swimmer", "conference"], "left").join(schools, "conference")
    scored = F.col("has_swim") & F.col("raw_pts").isNotNull()
    d = d.withColumns({
        "raw_pts": F.when(scored, F.col("raw_pts")).otherwise(0.0),
        "top_events": F.when(scored, F.col("top_events")).otherwise(""),
        "has_depth": F.when(scored, F.col("has_depth")).otherwise(False),
        "_scored": scored,
    })
    d = d.withColumn("adj_pts", round_to(F.col("raw_pts") * F.col("psf"), 2))
    d = d.withColumn("adj_tier", F.when(F.col("_scored"), tier_label("adj_pts")).otherwise("")).drop("_scored")
    d = admission_label(d, prepared=True)
    return d.withColumn("label", F.when(F.col("label") == "Unknown", "").otherwise(F.col("label")))


def score_one(times: DataFrame, anchors: DataFrame, school: DataFrame) -> DataFrame:
    """All events of every swimmer at the given school rows (conference, school, psf): scored ones with points, the
    others marked as not benchmarked."""
    rows = school.select(F.struct("conference", "school", "psf").alias("_s"))
    at = expected_grid_of(times.filter(F.col("sec").isNotNull()), {"_s": rows}).select(*times.columns, "_s.*")
    marks = score_events(times, anchors.join(school.select("conference").distinct(), "conference", "left_semi"))
    d = at.join(marks.select("swimmer", "conference", "event", "place", "pts", "place_label"),
                ["swimmer", "conference", "event"], "left")
    return d.select("swimmer", "school", "event", "sec", "place", "pts", "place_label",
                    F.col("pts").isNotNull().alias("benchmarked"))
