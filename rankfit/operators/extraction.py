"""Result and score tables from lines of text.

Input is a lines table (source_file, page_no, line_no, text) where line_no counts through the file. State such as
the current section, event and final runs forward with two-level windows, so a very long file is split in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import events as E, text as X
from ..functions.times import parse_time_hms, time_suffix
from ..session import cut_lineage
from .keyed import carry_forward, first_per_key, needs_chunks, running_total

FILE = ["source_file"]
MISS_LIMIT, MISS_LIMIT_WIDE = 5, 12
TAIL_PAGES = 10


def lines_of(df: DataFrame, key: str, text: str, page: str | None = None) -> DataFrame:
    """Lines table of a text column."""
    cols = [F.col(key).cast("string").alias("source_file"), (F.col(page) if page else F.lit(1)).alias("page_no")]
    return df.select(*cols, F.posexplode(X.lines(text)).alias("line_no", "text"))


def split_merged(lines: DataFrame) -> DataFrame:
    """One row per entry of a merged line. Lines are numbered anew in each file, as every line may become several."""
    d = lines.select("source_file", "page_no", "line_no", E.split_merged_line("text").alias("_pieces"))
    d = running_total(d, ["source_file"], "line_no", F.size("_pieces").cast("bigint"), "_till", chunked=True)
    d = d.select("source_file", "page_no", (F.col("_till") - F.size("_pieces")).alias("_since"), F.posexplode("_pieces").alias("_i", "text"))
    return d.select("source_file", "page_no", (F.col("_since") + F.col("_i")).cast("int").alias("line_no"), "text")


def carry_state(lines: DataFrame, values: list[str], keys: list[str] = FILE, chunked: bool | None = None) -> DataFrame:
    return carry_forward(lines, keys, "line_no", values, chunked)


def mark_lines(lines: DataFrame) -> DataFrame:
    """Per line: kind, event, event gender, final label, and the parsed result."""
    d = lines.withColumns({"kind": E.classify_line("text"), "_ev": E.norm_event("text"), "final": E.final_type("text")})
    result = E.parse_result_line("text")
    return d.withColumns({
        "event": F.when(F.col("kind") == "event", F.col("_ev.event")),
        "event_gender": F.when(F.col("kind") == "event", F.col("_ev.gender")),
        "_r": F.when(F.col("kind") == "result", result),
    }).drop("_ev")


def extract_results(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (source_file, gender, event, header_line, place, sec, suffix, final) of all results.

    files: source_file, file_gender (men / women / combined / unknown) and name_gender (from the file name). The
    first value of a place wins within an event section.
    """
    long = needs_chunks(lines, "line_no")
    d = mark_lines(lines).join(files, "source_file")
    kind, fg = F.col("kind"), F.col("file_gender")
    men_header = (kind == "event") & F.col("event").isNotNull() & (F.col("event_gender") == "men")
    upgrade = men_header & (fg == "women") & (F.col("name_gender") != "women")
    d = carry_state(d.withColumn("_up", F.when(upgrade, True)), ["_up"], chunked=long)
    fg = F.when(F.coalesce("_up", F.lit(False)), "combined").otherwise(F.col("file_gender"))
    d = d.withColumn("_fg", fg)
    said = (F.when(kind == "section_men", "men").when(kind == "section_women", "women")
            .when((kind == "event") & F.col("event").isNotNull() & F.col("event_gender").isin("men", "women"), F.col("event_gender")))
    allowed = F.when(said == "men", F.col("_fg") != "women").when(said == "women", F.col("_fg") != "men")
    d = carry_state(d.withColumn("_section", F.when(allowed, said)), ["_section"], chunked=long)
    start = F.when(F.col("file_gender").isin("men", "women"), F.col("file_gender"))
    section = F.coalesce("_section", start)
    resolved = F.when(F.col("event_gender").isin("men", "women"), F.col("event_gender")).otherwise(section)
    fits = F.col("_fg").isin("combined", "unknown") | (F.col("_fg") == resolved)
    opens = (kind == "event") & F.col("event").isNotNull() & resolved.isNotNull() & fits
    boundary = kind.isin("event", "section_men", "section_women")
    d = d.withColumn("_head", F.when(boundary, F.struct(
        F.col("line_no").alias("header_line"),
        F.when(opens, F.col("event")).alias("event"), F.when(opens, resolved).alias("gender"))))
    return _results_in_sections(d, boundary, FILE, long)


def _results_in_sections(d: DataFrame, boundary: Column, keys: list[str], long: bool) -> DataFrame:
    """Pair results with the carried header and final label, then resolve times found on a later line."""
    final = F.when(boundary, F.coalesce("final", F.lit("unknown"))).when(F.col("kind") == "final", F.col("final"))
    d = carry_state(d.withColumn("_final", final), ["_head", "_final"], keys, long)
    place, time = F.col("_r.place"), F.col("_r.time")
    full = E.final_offset(place, F.col("_final"))
    in_event = F.col("_head.event").isNotNull()
    ranked = in_event & place.isNotNull() & ~boundary & (F.col("kind") != "final")
    # a ranked line opens an island that stays open only while its time is missing; a boundary closes it
    island = F.when(boundary, F.struct(F.col("line_no").alias("at"), F.lit(None).cast("int").alias("waiting"))).when(
        ranked, F.struct(F.col("line_no").alias("at"), F.when(time.isNull(), full).alias("waiting")))
    d = carry_state(d.withColumns({"_island": island, "_full": F.when(ranked, full)}), ["_island"], keys, long)
    waits = in_event & ~ranked & ~boundary & (F.col("kind") != "final") & F.col("_island.waiting").isNotNull()
    d = d.withColumns({"_direct": ranked & time.isNotNull(), "_late": F.when(waits, E.first_long_time("text"))})
    # two readers below: the lines that give a time are materialised once, without their texts
    d = cut_lineage(d.filter(F.col("_direct") | F.col("_late").isNotNull()).select(
        *keys, "page_no", "line_no", "_head", "_direct", F.when(F.col("_direct"), F.col("_full")).otherwise(F.col("_island.waiting")).alias("place"),
        F.when(F.col("_direct"), time).otherwise(F.col("_late")).alias("time"), F.when(F.col("_direct"), F.col("_r.suffix")).otherwise(time_suffix("text")).alias("suffix"),
        F.col("_final").alias("final"), F.col("_island.at").alias("_at")))
    direct = d.filter("_direct").drop("_direct", "_at")
    late = first_per_key(d.filter("NOT _direct"), [*keys, "_at"], ["line_no"]).drop("_direct", "_at")
    rows = direct.unionByName(late).withColumn("sec", parse_time_hms("time")).filter(F.col("sec").isNotNull())
    rows = rows.select(*keys, "page_no", "line_no", "_head.*", "place", "sec", "suffix", "final")
    return first_per_key(rows, [*keys, "header_line", "place"], ["line_no"])


def second_pass(lines: DataFrame, files: DataFrame, missing: DataFrame) -> DataFrame:
    """Looser extraction for groups still incomplete.

    files: source_file, bundle_id, file_gender. missing: bundle_id, gender, event. A section that has found nothing by
    the end of its page is abandoned. Wanted events travel as one short list per (bundle, gender).
    """
    wanted = missing.groupBy("bundle_id", "gender").agg(F.array_sort(F.collect_set("event")).alias("_wanted"))
    d = lines.join(files, "source_file").join(wanted, "bundle_id")
    d = d.filter(~((F.col("file_gender") == "men") & (F.col("gender") == "women"))
                 & ~((F.col("file_gender") == "women") & (F.col("gender") == "men")))
    d = d.withColumns({
        "final": E.final_type("text"), "_is_header": E.is_event_header("text"),
        "_loose": E.loose_events("text", F.col("gender"), F.col("_wanted")), "_r": E.parse_result_line("text")})
    label = ~F.col("_is_header") & F.col("final").isNotNull()
    opens = ~label & F.col("_loose").isNotNull()
    closes = ~label & F.col("_loose").isNull() & F.col("_is_header")
    boundary = opens | closes
    d = d.withColumns({
        "kind": F.when(label, "final").when(boundary, "event").otherwise("other"),
        "_head": F.when(boundary, F.struct(
            F.col("line_no").alias("header_line"), F.col("_loose").alias("event"), F.col("page_no").alias("header_page")))})
    rows = _results_in_sections(d, F.col("kind") == "event", ["source_file", "gender"], needs_chunks(lines, "line_no"))
    keys = ["source_file", "gender", "header_line"]
    alive = rows.groupBy(*keys).agg(F.min("page_no").alias("_p"), F.first("header_page").alias("_h")).filter("_p = _h")
    return rows.join(alive.select(*keys), keys, "left_semi").drop("header_page")


# ---- score tables ----------------------------------------------------------------------------------------


def score_sections(lines: DataFrame) -> DataFrame:
    """Lines inside score blocks with their gender, heading and layout.

    A heading opens a block on its page; an event header closes it; non-entry lines stay in while fewer than five
    of them follow each other. Each line is tested once per layout and the layout in force is carried forward.
    """
    keys, long = ["source_file", "page_no"], needs_chunks(lines, "line_no")
    s = F.trim("text")
    heading, table = s.rlike(X.HEADING), s.rlike(X.TABLE_HEADER)
    d = lines.withColumns({"_heading": heading, "_table": table & ~heading})
    mark = F.when(F.col("_heading"), F.struct(
        X.heading_gender(s).alias("gender"), s.alias("section_heading"), F.col("line_no").alias("block")))
    d = carry_forward(d.withColumns({
        "_block": mark, "_layout": F.when(F.col("_heading"), False).when(F.col("_table"), True)}), keys, "line_no", ["_block", "_layout"], long)
    d = d.filter(F.col("_block").isNotNull() & ~F.col("_heading") & ~F.col("_table") & ~s.rlike(X.TOTAL_LINE))
    listed, tabled = X.score_entries("text"), X.score_entries("text", table=True)
    has_entry = F.when(F.col("_layout"), s.rlike(X.TABLE_ENTRY)).otherwise(F.col("text").rlike(X.LIST_ENTRY))
    d = d.withColumns({"gender": F.col("_block.gender"), "section_heading": F.col("_block.section_heading"),
                       "block": F.col("_block.block"), "has_entry": has_entry})
    closing = ~F.col("has_entry") & s.rlike(X.EVENT_LINE)
    ends = d.filter(closing).groupBy(*keys, "block").agg(F.min("line_no").alias("_end"))
    d = d.join(ends, [*keys, "block"], "left").filter(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    entries = F.when(F.col("_layout"), tabled).otherwise(listed)
    return d.select(*keys, "line_no", "gender", "section_heading", "block", "has_entry", F.col("_layout").alias("is_table"),
                    entries.alias("entries"))


def running_miss_cutoff(lines: DataFrame, keys: list[str], hit: str, limit: int = MISS_LIMIT) -> DataFrame:
    """Lines kept while fewer than `limit` misses follow the last hit; also the miss count of every line."""
    long = needs_chunks(lines, "line_no")
    d = running_total(lines, keys, "line_no", F.when(F.col(hit), 0).otherwise(1), "_misses", long)
    d = carry_forward(d.withColumn("_at_hit", F.when(F.col(hit), F.col("_misses"))), keys, "line_no", ["_at_hit"], long)
    d = d.withColumn("misses", F.col("_misses") - F.coalesce("_at_hit", F.lit(0)))
    return d.filter(F.col("misses") < limit).drop("_misses", "_at_hit")


def extract_score_rows(lines: DataFrame) -> DataFrame:
    """All (rank, team, score) rows of the score blocks."""
    d = score_sections(lines).filter(F.size("entries") > 0)
    return d.select("source_file", "page_no", "line_no", "gender", "section_heading", F.inline("entries"))


def tail_then_full(lines: DataFrame, pages: DataFrame, tail: int = TAIL_PAGES) -> DataFrame:
    """Score rows of the last pages of each file; of the whole file where the tail holds none or one gender only.

    pages: source_file, pages, is_auxiliary. Auxiliary files always count in full. Only the tails are read first. The other
    pages are read for the files that need them, by a join that prunes the scan where lines are stored by file.
    """
    at = pages.select("source_file", "pages", "is_auxiliary")
    in_tail = F.col("is_auxiliary") | (F.col("page_no") > F.col("pages") - tail)
    first = cut_lineage(extract_score_rows(lines.join(at, "source_file").filter(in_tail).select(*lines.columns)))
    found = first.groupBy("source_file").agg(F.min("gender").alias("_lo"), F.max("gender").alias("_hi"))
    # a test that looks selective makes the join prune the scan
    tested = cut_lineage(at.join(found, "source_file", "left").withColumn("_genders", F.when(F.col("_lo") != F.col("_hi"), 2).otherwise(1)))
    rest = lines.join(tested.filter(F.col("_genders") < 2).drop("_lo", "_hi", "_genders"), "source_file").filter(~in_tail).select(*lines.columns)
    return first.unionByName(extract_score_rows(rest))


# fixed values: what opens a standings block, what switches the flag inside one, and the column heads in it
WIDE_HEAD = r"(?i)\bteam\s+(?:final\s+)?(?:scores?|standings?|rankings?|results?|points?)\b|\bfinal\s+(?:team\s+)?(?:scores?|standings?|rankings?|results?|points?)\b|\b(?:men'?s?|women'?s?)\s*[-–]?\s*(?:team\s+)?(?:final\s+)?(?:scores?|standings?|rankings?|results?|points?)\b|\boverall\s+(?:team\s+)?(?:scores?|standings?|rankings?)\b"
WIDE_WOMEN = r"(?i)\bwomen'?s?\s*(team|final|standing|score|rank)"
WIDE_MEN = r"(?i)\bmen'?s?\s*(team|final|standing|score|rank)"
WIDE_SKIP = r"(?i)^\s*(?:rank|place|pos|#|team|school|points?|score|pts)\s*$"


def wide_score_rows(lines: DataFrame, gender: str = "men") -> DataFrame:
    """Rows (team, score) of one gender from standings blocks in any of the three line layouts.

    A heading opens a block and names its gender (the wanted one where it names none); lines inside may switch it. Lines of
    the other gender, lines that are no entry and empty lines are misses; entries and switches end a run of misses. The first
    line that comes after twelve misses ends the block; column heads count as nothing.
    """
    s = X.strip(F.col("text"))
    is_head = s.rlike(WIDE_HEAD)
    switch = F.when(~is_head & s.rlike(WIDE_WOMEN), "women").when(~is_head & s.rlike(WIDE_MEN), "men")
    named = X.heading_gender(s)
    d = lines.select("source_file", "line_no", "text", F.when(is_head, F.col("line_no")).alias("block"), (s == "").alias("_blank"), switch.isNotNull().alias("_switch"),
                     F.when(is_head, F.when(named.isin("men", "women"), named).otherwise(gender)).otherwise(switch).alias("gender"), (~is_head & switch.isNull() & s.rlike(WIDE_SKIP)).alias("_skip"))
    d = d.withColumn("_head", F.col("block").isNotNull())
    d = carry_state(d, ["block"]).filter(F.col("block").isNotNull() & ~F.col("_skip"))
    keys = ["source_file", "block"]
    d = carry_state(d, ["gender"], keys)
    d = d.withColumn("_row", F.when(~F.col("_head") & ~F.col("_switch") & (F.col("gender") == gender), X.score_line("text")))
    d = d.withColumn("_reset", F.col("_head") | F.col("_switch") | F.col("_row").isNotNull())
    # misses up to each line, and of those the ones before it
    d = running_miss_cutoff(d, keys, "_reset", 1 << 30)
    before = F.coalesce(F.lag("misses").over(Window.partitionBy(*keys).orderBy("line_no")), F.lit(0))
    d = d.withColumn("_over", ~F.col("_head") & ~F.col("_switch") & ~F.col("_blank") & (before >= MISS_LIMIT_WIDE))
    stops = d.filter("_over").groupBy(*keys).agg(F.min("line_no").alias("_stop"))
    d = d.join(stops, keys, "left").filter(F.col("_row").isNotNull() & (F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))))
    return d.select("source_file", "line_no", "gender", "_row.team", F.col("_row.score_text").try_cast("double").alias("score"))
