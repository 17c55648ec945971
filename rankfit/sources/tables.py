"""Scans: anchors, team snapshots, scores, places, standards, file metadata and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import col, to_double, to_long
from ..functions.text import detect_conference
from ..operators.anchors import monotonic_check
from ..operators.keyed import first_per_key

# fixed values: columns an anchor file must have
ANCHOR_COLUMNS = ["Conference", "Gender", "Event", "1st", "8th", "16th"]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; types are decided by the scan functions."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}; found: {sorted(df.columns)}")
    return df


def _given(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(f"`{name}`"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def scan_anchors(raw: DataFrame, gender: str = "men") -> DataFrame:
    """Typed anchors of one gender. The seconds column goes before the text one; rows with neither 1st nor 8th drop
    out; of several rows per (conference, event) the last one stays, in `pos` order or else in the order they are read."""
    raw = raw if "pos" in raw.columns else raw.withColumn("pos", F.monotonically_increasing_id())
    d = require_columns(raw, ANCHOR_COLUMNS).filter(F.lower(F.trim("Gender")) == gender)
    anchor = lambda n: to_double(F.coalesce(_given(d, f"{n}_seconds"), _given(d, n)))
    d = d.select(
        F.trim("Conference").alias("conference"), F.trim("Event").alias("event"), anchor("1st").alias("first"),
        anchor("8th").alias("eighth"), anchor("16th").alias("sixteenth"),
        to_double(_given(d, "Sec_per_place")).alias("sec_per_place"), "pos")
    d = d.filter((F.col("conference") != "") & (F.col("event") != "") & (F.col("first").isNotNull() | F.col("eighth").isNotNull()))
    d = d.withColumn("out_of_order", monotonic_check("first", "eighth", "sixteenth"))
    return first_per_key(d, ["conference", "event"], [F.desc("pos")]).drop("pos")


def scan_teams(raw: DataFrame, aliases: DataFrame, gender: str = "men", order: str = "pos") -> DataFrame:
    """Typed team records of one gender; the first row per (conference, canonical name) wins."""
    from ..operators.matching import canonicalize

    d = raw.filter(F.lower("gender") == gender).withColumns({"conference": F.trim("Conference"), "school": F.trim("Team")})
    d = d.filter((F.col("conference") != "") & (F.col("school") != "") & (F.col("conference") != "Unknown"))
    d = canonicalize(d, aliases)
    d = first_per_key(d, ["conference", "school"], [F.asc(order)])
    text = lambda c: F.coalesce(c, F.lit(""))
    return d.select(
        "conference", "school", "raw_name", "normalized",
        F.coalesce(F.nullif(to_double("PSF"), F.lit(0.0)), F.lit(1.0)).alias("psf"),
        text("Tier").alias("tier"), F.nullif(to_long("Finish"), F.lit(0)).cast("int").alias("finish"),
        to_double("MenPoints").alias("points"), text("tier_short").alias("tier_short"),
        text("final_tier").alias("final_tier"), text("PowerClass").alias("power_class"), order)


def scan_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path)


def scan_long_places(raw: DataFrame) -> DataFrame:
    """Long place table: unparsable rows drop out, the fastest time per place stays."""
    d = raw.select(
        F.trim("Conference").alias("conference"), F.trim("Event").alias("event"), F.lower(F.trim("Gender")).alias("gender"),
        to_long("Place").cast("int").alias("place"), to_double("Time_Sec").alias("sec"))
    d = d.dropna(subset=["place", "sec"])
    return d.groupBy("conference", "event", "gender", "place").agg(F.min("sec").alias("sec"))


STANDARDS_TYPE = "map<string,map<string,map<string,double>>>"


def scan_standards(documents: DataFrame, text: str = "value") -> DataFrame:
    """Nested standards JSON (gender -> event -> level -> seconds) as rows; boys and girls become men and women."""
    d = documents.select(F.from_json(text, STANDARDS_TYPE).alias("_g"))
    d = d.select(F.explode("_g").alias("gender", "_e")).select("gender", F.explode("_e").alias("event", "_l"))
    d = d.select("gender", "event", F.explode("_l").alias("level", "sec"))
    alias = F.when(F.col("gender") == "boys", "men").when(F.col("gender") == "girls", "women").otherwise(F.col("gender"))
    return d.withColumn("gender", alias).dropDuplicates(["gender", "event", "level"])


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    return scan_standards(spark.read.text(path, wholetext=True))


def standards_wide(long: DataFrame) -> DataFrame:
    """One row per (gender, event) with the five scored levels."""
    at = lambda lv: F.max(F.when(F.col("level") == lv, F.col("sec")))
    return long.groupBy("gender", "event").agg(*[at(lv).alias(f"std_{lv.lower()}") for lv in ("B", "A", "AA", "AAA", "AAAA")])


# fixed values: token sets of file names
WOMEN_TOKENS = ["women", "womens", "woman"]
MEN_TOKENS = ["men", "mens", "man"]
COMBINED_TOKENS = ["combined", "full", "complete", "both", "coed"]
PRELIM_TOKENS = ["prelim", "prelims", "preliminary", "preliminaries", "heats", "heat"]
FINAL_TOKENS = ["final", "finals"]
DAY_TOKENS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "tues", "wed",
              "thu", "thur", "thurs", "fri", "sat", "sun"]
OTHER_TOKENS = ["swimming", "swim", "diving", "s", "d", "sd", "championship", "championships", "champ", "champs",
                "results", "result", "conference", "ncaa", "session", "event", "events", "day", "daily", "meet",
                "invite", "invitational", "pdf", "w", "all"]


def file_metadata(name) -> Column:
    """Struct(year, gender, is_prelim, is_final, day, conference_hint) from a file name."""
    base = F.regexp_replace(F.substring_index(col(name), "/", -1), r"(?i)(\.pdf)+$", ".pdf")
    stem = F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    toks = F.split(stem, r"[_\s\-]+")
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    has = lambda values: F.arrays_overlap(toks, listed(values))
    year = F.filter(F.transform(toks, lambda t: F.regexp_extract(t, r"(?<!\d)(20\d\d)(?!\d)", 1)), lambda y: y != "")
    sexes = F.filter(F.transform(toks, lambda t: (
        F.when(t.isin([*WOMEN_TOKENS, "w"]), "women").when(t.isin(MEN_TOKENS), "men").when(t.isin(COMBINED_TOKENS), "combined"))),
        lambda g: g.isNotNull())
    nxt = lambda i: F.get(toks, i + 1)
    days = F.filter(F.transform(toks, lambda t, i: (
        F.when(t.rlike(r"^(day|d)[1-9]$"), t)
        .when((t == "day") & nxt(i).rlike("^[1-9]$"), F.concat(F.lit("day"), nxt(i)))
        .when(t.isin(DAY_TOKENS), t))), lambda d: d.isNotNull())
    strip = [*WOMEN_TOKENS, *MEN_TOKENS, *COMBINED_TOKENS, *PRELIM_TOKENS, *FINAL_TOKENS, *DAY_TOKENS, *OTHER_TOKENS]
    hint = F.filter(toks, lambda t: ~t.isin(strip) & ~t.rlike(r"^(20\d\d|day[1-9]|d[1-9]|\d)$"))
    return F.struct(
        F.get(year, F.lit(0)).alias("year"), F.coalesce(F.get(sexes, F.lit(0)), F.lit("combined")).alias("gender"),
        has(PRELIM_TOKENS).alias("is_prelim"), (has(FINAL_TOKENS) & ~has(PRELIM_TOKENS)).alias("is_final"),
        F.get(days, F.lit(0)).alias("day"), F.array_join(hint, "_").alias("conference_hint"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per document under a folder, at any depth: (file_name, n_bytes, modified) from the metadata of the files
    themselves, and what the name tells. Contents are not read. A document that was written as a folder of part files goes by
    the folder's name."""
    m = F.col("_metadata")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        m["file_path"].alias("path"), m["file_name"].alias("name"), m["file_size"].alias("size"), m["file_modification_time"].alias("at"))
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(F.substring_index(F.substring_index("path", "/", -2), "/", 1), "^[A-Za-z_]+=", "")
    d = files.select(F.when(F.startswith("name", F.lit("part-")), plain(folder)).otherwise(plain(F.col("name"))).alias("file_name"), "size", "at")
    d = d.groupBy("file_name").agg(F.sum("size").alias("n_bytes"), F.max("at").alias("modified"))
    return d.withColumn("_m", file_metadata("file_name")).select("file_name", "n_bytes", "modified", "_m.*")


def bundle_key(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Files with their metadata, conference and bundle id (conference slug and year)."""
    d = files.withColumn("_m", file_metadata(name))
    d = d.withColumn("conference", detect_conference(name, "_m.conference_hint")).select(*files.columns, "_m.*", "conference")
    slug = F.regexp_replace(F.lower("conference"), "[^a-z0-9]", "")
    return d.withColumn("bundle_id", F.concat_ws("_", slug, F.coalesce("year", F.lit("unknown"))))


def group_filter(rows: DataFrame, wanted: list[str], key: str = "bundle_id") -> DataFrame:
    """Groups whose id contains any of the texts. (An id that starts with a text also contains it, so the prefix rung
    can never add a group.)"""
    low, hit = F.lower(key), F.lit(False)
    for w in wanted:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return rows.filter(hit)


def last_day_first(files: DataFrame, day: str = "day", name: str = "file_name") -> list[Column]:
    """Sort columns: day number descending (missing last), then file name."""
    n = F.nullif(F.regexp_extract(F.coalesce(F.col(day), F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("int")
    return [n.desc_nulls_last(), F.asc(name)]
