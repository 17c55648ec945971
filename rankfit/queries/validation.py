"""Validation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import anchors as A, robust as RB, tiers as T
from .aggregates import COVER_COLS, COVER_CTE, coverage, profile_ctes, summary_sql, tiers_sql, wide_profile_sql
from .base import query, rnd
from .joins import _V, distance_sql
from .sources import TB


@query("monotonic_check", "SELECT conference, count(*) AS rows_checked, count(*) FILTER (coalesce(NOT (v1 <= v8 AND v8 <= v16), false)) AS violations FROM (SELECT Conference AS conference, CAST(v1 AS DOUBLE) AS v1, CASE WHEN n % 5 <> 0 THEN CAST(v8 AS DOUBLE) END AS v8, CAST(v16 AS DOUBLE) AS v16 FROM {anchor_text} WHERE Gender = 'men') x GROUP BY 1")
def _(t):
    d = TB.scan_anchors(t.anchor_csv)
    return d.groupBy("conference").agg(F.count("*").alias("rows_checked"), F.count_if("out_of_order").alias("violations"))


_PARSED = """d AS (SELECT *, TRY_CAST(replace(trim(score), ',', '') AS DOUBLE) AS score_f, TRY_CAST(trim(rank) AS INTEGER) AS rank_i, lower(regexp_replace(trim(team), '\\s+', ' ', 'g')) AS team_key FROM {score_text}), v AS (SELECT * FROM d WHERE score_f >= 0),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, conference, gender, team_key ORDER BY score_f DESC, pos) AS rn, min(pos) OVER (PARTITION BY bundle_id, conference, gender, team_key) AS first_pos FROM v) x WHERE rn = 1),
tb AS (SELECT bundle_id, conference, gender, max(score_f) FILTER (score_f >= 0) AS top FROM d GROUP BY 1, 2, 3), bad AS (SELECT * FROM tb WHERE coalesce(top, 0) <= 0),
h AS (SELECT *, min(first_pos) OVER (PARTITION BY bundle_id, conference, gender, rank_i) AS head, arg_min(team, first_pos) OVER (PARTITION BY bundle_id, conference, gender, rank_i) AS holder FROM u WHERE rank_i IS NOT NULL)"""
_QA = """SELECT bundle_id, conference, gender, 'malformed_score' AS issue_type, team, 'raw=''' || score || '''' AS detail FROM d WHERE score_f IS NULL UNION ALL SELECT bundle_id, conference, gender, 'negative_score', team, 'score=' || CAST(score_f AS VARCHAR) FROM d WHERE score_f < 0
 UNION ALL SELECT bundle_id, conference, gender, 'missing_rank', team, 'raw=''' || rank || '''' FROM v WHERE rank_i IS NULL UNION ALL SELECT bundle_id, conference, gender, 'duplicate_rank', team, 'rank=' || rank_i || ' also assigned to ' || holder FROM h WHERE first_pos > head
 UNION ALL SELECT bundle_id, conference, gender, 'invalid_table', '', CASE WHEN top IS NULL THEN 'no_parseable_rows' ELSE 'all_scores_zero_or_negative' END FROM bad UNION ALL SELECT bundle_id, conference, gender, 'skipped_table', '', 'table_failed_validation' FROM bad"""


@query("validate_table", f"WITH {_PARSED} {_QA}")
def _(t):
    _, qa = T.validate_table(t.score_text)
    return qa


CLEAN_CTE = f"{_PARSED}, clean AS (SELECT u.* FROM u LEFT JOIN bad USING (bundle_id, conference, gender) WHERE bad.top IS NULL AND NOT EXISTS (SELECT 1 FROM bad b2 WHERE b2.bundle_id = u.bundle_id AND b2.conference = u.conference AND b2.gender = u.gender))"


@query("build_team_tiers", f"WITH {CLEAN_CTE} SELECT bundle_id, conference, gender, rank_i, trim(team) AS team, score_f, champion_score, total_meet_points, champion_ratio, meet_share, base_tier, power_class, final_tier FROM ({tiers_sql('clean')}) z")
def _(t):
    from ..plans.results import build_team_tiers

    d = build_team_tiers(t.score_text)["tiers"].withColumn("team", F.trim("team"))
    return d.select("bundle_id", "conference", "gender", "rank_i", "team", "score_f", "champion_score", "total_meet_points", "champion_ratio", "meet_share", "base_tier", "power_class", "final_tier")


@query("build_team_tiers_summary", f"WITH {CLEAN_CTE} {summary_sql('clean')}")
def _(t):
    from ..plans.results import build_team_tiers

    return build_team_tiers(t.score_text)["summary"]


# ---- robust validation -----------------------------------------------------------------------------------

_WIDE = f"{profile_ctes()}, {wide_profile_sql()}"
_Z = lambda m, v: f"(abs({v} - w.{m}_median) / (1.4826::DOUBLE * w.{m}_mad + 1e-6))"
_SEV = lambda z, s, h: f"CASE WHEN {z} <= {s} THEN '' WHEN {z} <= {h} THEN 'soft' WHEN {z} <= 5 THEN 'hard' WHEN {z} IS NOT NULL THEN 'extreme' END"
_JOIN = "FROM {pairs} r LEFT JOIN wide w ON w.gender = lower(r.gender) AND w.event = lower(r.event)"


@query("robust_outlier", f"WITH {_WIDE} SELECT r.bundle, r.gender, r.event, {rnd(_Z('sw', 'r.sw'), 4)} AS z, {_SEV(_Z('sw', 'r.sw'), 2.0, 3.0)} AS severity {_JOIN}")
def _(t):
    prof = RB.robust_profile(t.pairs).select("gender", "event", "sw_median", "sw_mad")
    d = t.pairs.withColumns({"g": F.lower("gender"), "e": F.lower("event")})
    d = d.join(prof.withColumnsRenamed({"gender": "g", "event": "e"}), ["g", "e"], "left")
    z = RB.robust_z(F.col("sw"), F.col("sw_median"), F.col("sw_mad"))
    return d.select("bundle", "gender", "event", round_to(z, 4).alias("z"), RB._severity(z, 2.0, 3.0).alias("severity"))


@query("profile_distance", f"WITH {_WIDE} SELECT r.bundle, r.gender, r.event, {rnd(distance_sql(_V, 'w'), 4)} AS distance {_JOIN}")
def _(t):
    prof = RB.robust_profile(t.pairs)
    d = t.pairs.withColumns({"g": F.lower("gender"), "e": F.lower("event"), "spread": F.col("deep") - F.col("sw"), "shape": F.col("deep") / F.col("sw")})
    d = d.join(prof.withColumnsRenamed({"gender": "g", "event": "e"}), ["g", "e"], "left")
    dist = RB.profile_distance({m: F.col(m) for m in RB.METRICS}, F.col)
    return d.select("bundle", "gender", "event", round_to(dist, 4).alias("distance"))


def _bound(i: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(r.event), '{b[0]}') THEN {b[i]}::DOUBLE" for b in RB.EVENT_BOUNDS) + " END"


def validate_sql() -> str:
    sprint = "(contains(lower(r.event), '50 free') OR contains(lower(r.event), '100 free'))"
    soft, hard = f"CASE WHEN {sprint} THEN 2.5 ELSE 2.0 END", f"CASE WHEN {sprint} THEN 4.5 ELSE 3.0 END"
    pen = lambda s, a, b, c: f"CASE {s} WHEN 'soft' THEN {a} WHEN 'hard' THEN {b} WHEN 'extreme' THEN {c} ELSE 0 END"
    return f"""WITH {_WIDE}, near AS (SELECT r.bundle, r.gender, r.event, arg_min(o.event, (d, o.event)) AS best_event, min(d) AS best_dist FROM {{pairs}} r JOIN (SELECT * FROM wide) o ON o.gender = lower(r.gender) AND o.event <> lower(r.event), LATERAL (SELECT {distance_sql(_V, 'o')} AS d) dd WHERE d IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT r.*, w.gender IS NOT NULL AS has, {_SEV(_Z('sw', 'r.sw'), 2.0, 3.0)} AS s1, {_SEV(_Z('deep', 'r.deep'), 2.0, 3.0)} AS s2, {_SEV(_Z('spread', '(r.deep - r.sw)'), soft, hard)} AS s3, {_SEV(_Z('shape', '(r.deep / r.sw)'), soft, hard)} AS s4,
 coalesce(r.sw > r.deep, false) AS ord, coalesce(r.sw < {_bound(1)} / 2.5, false) AS fast, coalesce(r.sw > {_bound(2)}, false) AS slow, coalesce(r.deep > {_bound(3)} * 2.5, false) AS dslow, coalesce(r.sw > w.sw_p95 * 2.0, false) AS slowp0, {distance_sql(_V, 'w')} AS claimed {_JOIN}),
b AS (SELECT a.*, n.best_event, n.best_dist, slowp0 AND NOT slow AS slowp, coalesce(n.best_dist > 0 AND claimed / nullif(n.best_dist, 0) > 4.0, false) AS crossed FROM a LEFT JOIN near n ON n.bundle = a.bundle AND n.gender = a.gender AND n.event = a.event),
c AS (SELECT *, greatest(0, least(100, 100.0 - (ord::INT * 55 + fast::INT * 55 + slow::INT * 55 + dslow::INT * 55 + {pen('s1', 3, 8, 15)} + {pen('s2', 8, 18, 30)} + {pen('s3', 10, 22, 38)} + {pen('s4', 10, 22, 38)} + slowp::INT * 45 + crossed::INT * 15)))::DOUBLE AS conf,
 [x for x in [CASE WHEN ord THEN 'anchor_order_broken' END, CASE WHEN fast THEN 'sw_absurdly_fast' END, CASE WHEN slow THEN 'sw_absurdly_slow' END, CASE WHEN dslow THEN 'deep_absurdly_slow' END, CASE WHEN s1 <> '' THEN 'sw_' || s1 || '_outlier' END, CASE WHEN s2 <> '' THEN 'deep_' || s2 || '_outlier' END,
  CASE WHEN s3 IN ('hard', 'extreme') THEN 'spread_implausible' WHEN s3 = 'soft' THEN 'spread_soft_outlier' END, CASE WHEN s4 IN ('hard', 'extreme') THEN 'shape_implausible' WHEN s4 = 'soft' THEN 'shape_soft_outlier' END, CASE WHEN slowp THEN 'sw_absurdly_slow' END, CASE WHEN crossed THEN 'closer_to_other_event' END] if x IS NOT NULL] AS rs FROM b),
e AS (SELECT *, list_has_any(rs, ['anchor_order_broken', 'sw_absurdly_fast', 'sw_absurdly_slow', 'deep_absurdly_slow', 'deep_extreme_outlier']) OR crossed AS hard_hit FROM c)
SELECT bundle, gender, event, CASE WHEN NOT hard_hit THEN 'valid' WHEN conf >= 80 THEN 'valid' WHEN conf >= 50 THEN 'review' ELSE 'likely_wrong_event' END AS validation_label, {rnd('conf', 1)} AS confidence_score, array_to_string(rs, '; ') AS reasons, coalesce(best_event, '') AS closest_other_event,
 {rnd('claimed', 3)} AS claimed_event_distance, {rnd('best_dist', 3)} AS closest_other_event_distance FROM e"""


_VCOLS = ["bundle", "gender", "event", "validation_label", "confidence_score", "reasons", "closest_other_event", "claimed_event_distance", "closest_other_event_distance"]


def validated(t):
    return RB.validate_rows(t.pairs, RB.robust_profile(t.pairs)).select(*_VCOLS)


@query("validate_row", validate_sql())
def _(t):
    return validated(t)


@query("validate", f"SELECT * FROM ({validate_sql()}) x WHERE validation_label <> 'valid'")
def _(t):
    return RB.validation_report(validated(t))


@query("coverage_status", f"WITH {COVER_CTE} SELECT {COVER_COLS} FROM cov")
def _(t):
    return coverage(t)


@query("quality_label", """SELECT version, quality, CASE quality WHEN 'prelim_fallback' THEN 'prelims_used_last_resort' WHEN 'best_available' THEN 'best_available_nonfinal_used' END AS fallback, count(*) AS n FROM (SELECT version, CASE WHEN session_score >= 2 THEN 'finals' WHEN session_score = 1 THEN 'best_available' ELSE 'prelim_fallback' END AS quality FROM {versions}) x GROUP BY 1, 2, 3""")
def _(t):
    d = t.versions.withColumn("quality", A.quality_label(F.col("session_score")))
    return d.groupBy("version", "quality", A.fallback_type(F.col("quality")).alias("fallback")).agg(F.count("*").alias("n"))


_D5 = "(first + 4.0::DOUBLE / 7.0 * (eighth - first))"
_D14 = "(eighth + 6.0::DOUBLE / 8.0 * (sixteenth - eighth))"


@query("anchor_sanity", f"""SELECT k, ln, {rnd('CASE WHEN p5 >= p14 THEN d5 ELSE p5 END', 6)} AS fifth, {rnd('CASE WHEN p5 >= p14 THEN d14 ELSE p14 END', 6)} AS fourteenth, CASE WHEN p5 >= p14 THEN 'derived_fallback' WHEN both_true THEN 'true' ELSE 'derived' END AS source
FROM (SELECT *, CASE WHEN both_true THEN t5 ELSE d5 END AS p5, CASE WHEN both_true THEN t14 ELSE d14 END AS p14 FROM (SELECT *, {_D5} AS d5, {_D14} AS d14, sec AS t5, CASE WHEN ln % 2 = 0 THEN first + 15000 END AS t14, ln % 2 = 0 AS both_true FROM {{bands}}) x) y""")
def _(t):
    d = t.bands.withColumns({"true5": F.col("sec"), "true14": F.when(F.col("ln") % 2 == 0, F.col("first") + 15000)})
    d = A.anchor_sanity(d)
    return d.select("k", "ln", round_to("fifth", 6).alias("fifth"), round_to("fourteenth", 6).alias("fourteenth"), "source")
