"""Published rows of a real season, typed in: a profile from its 33 anchor pairs, and two rows of the validation report."""

import pytest

from rankfit.operators import robust as R

# first and sixteenth place of the men's 50 yards freestyle, one pair per championship; one of them was misread
MEN_50_FREE = [
    (18.63, 19.43), (19.94, 21.31), (19.43, 20.48), (19.18, 20.6), (18.46, 21.01), (19.21, 21.23), (398.5, 297.05), (19.13, 20.22), (19.6, 20.61),
    (20.84, 23.08), (20.03, 21.39), (19.6, 20.53), (18.91, 20.64), (18.82, 19.97), (20.72, 22.04), (20.02, 20.87), (20.49, 22.65), (19.97, 21.3),
    (20.7, 21.8), (19.2, 20.73), (19.61, 21.01), (19.97, 21.3), (20.29, 21.92), (19.28, 20.48), (20.14, 21.17), (20.23, 21.47), (20.23, 21.47),
    (19.73, 21.11), (20.36, 21.57), (18.42, 19.51), (19.15, 20.95), (19.72, 20.99), (20.17, 21.58)]
EXPECTED = {
    "sw_n": 32, "sw_median": 19.725, "sw_mad": 0.51, "sw_p05": 18.595575, "sw_p25": 19.195, "sw_p75": 20.185, "sw_p95": 20.70405,
    "deep_median": 21.06, "deep_mad": 0.435, "deep_p05": 19.87685, "deep_p25": 20.6075, "deep_p75": 21.47, "deep_p95": 22.163525,
    "spread_median": 1.325, "spread_mad": 0.215, "spread_p05": 0.9138, "spread_p25": 1.0975, "spread_p75": 1.4475, "spread_p95": 2.1762,
    "shape_median": 1.0655007612839138, "shape_mad": 0.008528442951388548, "shape_p05": 1.0465362134033989, "shape_p25": 1.0586257494155369,
    "shape_p75": 1.075448465198123, "shape_p95": 1.1058361131173018}
# medians and absolute deviations of three profiles: event -> sw, deep, spread, shape, and the 95th percentile of sw
PROFILES = {
    "100 free": ((50.0, 0.585), (53.265, 1.525), (3.27, 0.84), (1.0655273688356366, 0.0158581605758783), 52.4515),
    "200 free": ((108.59, 2.17), (116.56, 3.24), (7.68, 1.7), (1.0697498104624716, 0.012699629199353968), 115.2103),
    "200 im": ((121.68, 2.14), (130.26, 3.21), (8.18, 1.11), (1.0670107383667695, 0.008139245845418586), 127.1425)}


@pytest.fixture(scope="module")
def men(spark):
    rows = spark.createDataFrame([("men", "50 Free", a, b) for a, b in MEN_50_FREE], "gender string, event string, sw double, deep double")
    return rows, R.robust_profile(rows).cache()


def test_profile(men):
    row = men[1].first().asDict()
    # the spread of a pair is a difference of two printed times, so the report's last digits are its rounding
    assert {k: pytest.approx(v, rel=1e-6) for k, v in EXPECTED.items()} == {k: row[k] for k in EXPECTED}


def test_misread_row(men):
    rows, profile = men
    bad = [r for r in R.validate_rows(rows, profile).collect() if r["validation_label"] != "valid"]
    assert [(r["sw"], r["validation_label"], r["confidence_score"], r["spread_seconds"], r["shape_ratio"], r["claimed_event_distance"]) for r in bad] == [
        (398.5, "likely_wrong_event", 0.0, -101.45, 0.7454, 321.626)]
    assert bad[0]["reasons"] == "anchor_order_broken; sw_absurdly_slow; sw_extreme_outlier; deep_extreme_outlier; spread_implausible; shape_implausible"


def test_row_of_another_event(spark):
    names = [f"{m}_{s}" for m in R.METRICS for s in ("median", "mad")]
    rows = [("women", e, *[x for pair in p[:4] for x in pair], p[4]) for e, p in PROFILES.items()]
    profiles = spark.createDataFrame(rows, "gender string, event string, " + ", ".join(f"{n} double" for n in [*names, "sw_p95"]))
    one = spark.createDataFrame([("women", "200 IM", 111.27, 118.59)], "gender string, event string, sw double, deep double")
    r = R.validate_rows(one, profiles).first()
    assert (r["spread_seconds"], r["shape_ratio"], r["validation_label"], r["confidence_score"]) == (7.32, 1.0658, "review", 69.0)
    assert r["reasons"] == "sw_hard_outlier; deep_soft_outlier; closer_to_other_event"
    assert (r["closest_other_event"], r["claimed_event_distance"], r["closest_other_event_distance"]) == ("200 free", 1.621, 0.372)
