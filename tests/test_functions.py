import pytest
from pyspark.sql import functions as F

from rankfit.functions import admission as AD, assets as AS, events as EV, names as N, numeric as NU, scoring as SC, text as TX, times as TI


@pytest.mark.parametrize("text,sec", [("4:37", 277.0), ("59.5", 59.5), ("", None), ("x", None), ("1:2:3", None), ("DQ", None), (" 1:02.5 ", 62.5), ("12d", None), ("1,474", None), ("1_0", 10.0)])
def test_parse_time(one, text, sec):
    assert one(TI.parse_time("x"), text) == sec


def test_parse_time_variants(one):
    assert one(TI.parse_time("x", extra_parts="ignore"), "1:2:3") == 62.0
    assert one(TI.parse_time("x", minutes="int"), "1.5:10") is None
    assert one(TI.parse_time_hms("x"), "1:02:03.5") == 3723.5
    assert one(TI.parse_time_hms("x"), "scr") is None
    assert one(TI.parse_time_hms("x"), "58.10q") == 58.1


def test_format_time(one):
    assert one(TI.format_time("x"), 59.5, "double") == "59.50"
    assert one(TI.format_time("x"), 277.0, "double") == "4:37.00"
    assert one(TI.format_time("x"), 3723.5, "double") == "1:02:03.50"
    assert one(TI.format_time_rounded("x"), 59.999, "double") == "1:00.00"


@pytest.mark.parametrize("args,place", [
    ((20.0, 20.0, 21.0, 22.0, 0.1), 1.0), ((20.5, 20.0, 21.0, 22.0, 0.1), 4.5), ((21.5, 20.0, 21.0, 22.0, 0.1), 12.0), ((22.3, 20.0, 21.0, 22.0, 0.1), 19.0),
    ((20.5, 20.0, 20.0, 21.0, 0.1), 12.0), ((23.0, 20.0, 21.0, 22.0, 0.0), 17.0), ((23.0, 20.0, 21.0, 22.0, None), 17.0), ((23.0, None, 21.0, 22.0, 0.1), None)])
def test_estimate_place(spark, args, place):
    d = spark.createDataFrame([args], "t double, a double, b double, c double, s double")
    got = d.select(SC.estimate_place("t", "a", "b", "c", "s")).first()[0]
    assert got == (None if place is None else pytest.approx(place))


def test_points_and_labels(one):
    assert one(SC.exp_points("x"), 4.5, "double") == 16.5
    assert one(SC.exp_points("x"), 30.0, "double") == 0.0
    assert [one(SC.confidence_weight("x"), p, "double") for p in (12.0, 14.0, 16.0, 16.1)] == [1.0, 0.85, 0.65, 0.0]
    assert one(SC.tier_label("x"), 0.99, "double") == "Not Competitive"
    assert one(SC.tier_label("x"), 50.0, "double") == "High-Point Contender"


@pytest.mark.parametrize("sec,plain,clamped", [(60.0, 0.0, 0.0), (30.0, 4.0, 4.0), (25.0, 5.0, 5.0), (90.0, -3.0, -1.0), (45.0, 2.0, 2.0)])
def test_standard_score(spark, sec, plain, clamped):
    d = spark.createDataFrame([(sec, 60.0, 50.0, 45.0, 35.0, 30.0)], "t double, b double, a double, aa double, aaa double, aaaa double")
    cols = ("t", "b", "a", "aa", "aaa", "aaaa")
    assert tuple(d.select(SC.a_score(*cols), SC.a_score_clamped(*cols)).first()) == (plain, clamped)


def _applicant(spark, **kw):
    base = dict(sat=1400, gpa=3.9, accept=40, sat_median=1350, sat25=None, sat75=None, gpa_mean=3.7, hidden_ivy=False, adj_tier="Recruitable", psf=1.0, moonshot=False, has_meta=True)
    base |= kw
    schema = "sat int, gpa double, accept int, sat_median int, sat25 int, sat75 int, gpa_mean double, hidden_ivy boolean, adj_tier string, psf double, moonshot boolean, has_meta boolean"
    return AD.admission_label(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_admission_cases(spark):
    assert _applicant(spark)["label"] == "Realistic Shot" or _applicant(spark)["acad_band"] == 3
    assert _applicant(spark, gpa=1.9)["label"] == "Moonshot"
    assert _applicant(spark, moonshot=True)["label"] == AD.MOONSHOT_FUN
    assert _applicant(spark, has_meta=False)["label"] == "Unknown"
    low = _applicant(spark, sat=1230)
    assert low["swim_band"] == 0 and AD.LABELS.index(low["label"]) <= 1
    assert _applicant(spark, adj_tier="Not Competitive", sat=1500, gpa=4.0)["label"] == "Strong Chance"
    assert _applicant(spark, accept=10, adj_tier="Not Competitive")["label"] == "Moonshot"


@pytest.mark.parametrize("text,out", [("A B A B", "A B"), ("A A", "A"), ("A B C", "A B C"), ("one", "one"), ("A A B", "A")])
def test_undouble(one, text, out):
    assert one(N.undouble_name("x"), text) == out


def test_names(one):
    assert one(N.uninvert_name("x"), "North Carolina, University of") == "University of North Carolina"
    assert one(N.norm_query("x"), "St. John's Coll & Univ") == "saint johns college and university"
    assert one(N.key_words("x"), "The College of New Jersey") == ["new", "jersey"]


def test_event_text(one):
    ev = one(EV.norm_event("x"), "Event 26 Men 200 Yard Butterfly - B Final")
    assert (ev["event"], ev["gender"]) == ("200 Fly", "men")
    assert one(EV.norm_event("x"), "Men 400 Medley Relay")["event"] is None
    assert one(EV.final_type("x"), "Friday Final Results") is None
    r = one(EV.parse_result_line("x"), "4 Smith, Ann SO School 1:02.34 1:01.89 A")
    assert (r["place"], r["time"], r["suffix"]) == (4, "1:01.89", "A")
    assert one(EV.parse_result_line("x"), "24.36 27.51 28.02")["place"] is None
    assert one(EV.split_merged_line("x"), "4 Pere, Al 4:19.73 17 Magner, Ed 4:27.36") == ["4 Pere, Al 4:19.73", "17 Magner, Ed 4:27.36"]


def test_score_text(one):
    got = one(TX.score_entries("x"), "1. Yale 200 2. Brown Univ. 1,100.50")
    assert [(r["rank"], r["team"], r["score"]) for r in got] == [(1, "Yale", 200.0), (2, "Brown Univ", 1100.5)]
    got = one(TX.score_entries("x", table=True), "3 Princeton University Princeton University 631. 50")
    assert [(r["rank"], r["team"], r["score"]) for r in got] == [(3, "Princeton University", 631.5)]
    assert one(TX.score_line("x"), "Team Score   55") is None


def test_rounding_and_urls(one):
    assert one(NU.round_to("x", 2), 1.005, "double") == 1.0
    base = F.lit("https://a.org/d/p.html?q=1")
    assert one(AS.resolve_url("x", base), "../i/z.png") == "https://a.org/i/z.png"
    assert one(AS.resolve_url("x", base), "//c.org/z.png") == "https://c.org/z.png"
    assert one(AS.best_srcset("x"), "a.jpg 300w, b.jpg 1200w")["url"] == "b.jpg"
