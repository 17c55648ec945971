"""School universe, swimmer bests and batch search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import intent as I
from ..functions.admission import admission_label_simple, lookup, selectivity_tier
from ..functions.names import looks_like_name, norm_key, search_surface
from ..functions.numeric import round_to, to_double, to_long
from ..functions.scoring import a_score, a_tier_label
from ..operators import bests as B, matching as M, ranking as R, topscore as S
from ..operators.keyed import first_per_key, global_rank, top_k_per_key
from ..session import cut_lineage

META = ["accept", "sat_median", "sat25", "sat75", "gpa_mean", "hidden_ivy", "ivy_league", "stem", "moonshot", "merit",
        "location"]


def explore_universe(snapshot: DataFrame, teams: DataFrame, aliases: DataFrame, short_names: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per school of the snapshot: men's and women's values, the matched team, metadata and row type.

    snapshot: Conference, Team, gender, Finish, MenPoints, tier_short, final_tier, PowerClass, pos (text).
    teams: typed team records. short_names: short (normalized), full.
    """
    d = M.canonicalize(snapshot.withColumn("school", F.trim("Team")), aliases).filter((F.col("school") != "") & (F.col("gender") != ""))
    d = d.select("school", F.lower("gender").alias("gender"), F.col("Conference").alias("conference"), "tier_short", "final_tier",
                 F.col("PowerClass").alias("power_class"), to_long("Finish").cast("int").alias("finish"),
                 to_double("MenPoints").alias("score"), "pos")
    both = M.gender_pivot_join(d, "school", ["conference", "tier_short", "final_tier", "power_class", "finish", "score"])
    keyed = teams.select(F.struct("conference", "school", "psf", "tier").alias("_t"), norm_key("school").alias("_a"),
                         norm_key("raw_name").alias("_b"), F.col("pos"))
    index = keyed.select("_t", F.explode(F.array("_a", "_b")).alias("_k"), "pos")
    full = short_names.join(index, short_names["short"] == F.col("_k")).select("_t", norm_key("full").alias("_k"), "pos")
    # the reverse short-name entries come last and replace earlier ones
    index = index.withColumn("_late", F.lit(0)).unionByName(full.withColumn("_late", F.lit(1)))
    index = first_per_key(index, ["_k"], [F.desc("_late"), F.desc("pos")]).select("_k", "_t")
    u = both.withColumn("_k", norm_key("school")).join(index, "_k", "left").drop("_k")
    u = u.withColumns({
        "team_school": F.col("_t.school"),
        "conference": F.when(F.col("_t").isNotNull() & F.coalesce("conference", F.lit("")).isin("Unknown", ""), F.col("_t.conference"))
        .otherwise(F.col("conference")),
        "psf": F.coalesce(F.col("_t.psf"), F.lit(1.0)), "tier": F.coalesce(F.col("_t.tier"), F.lit("")),
        "has_swim": F.col("_t").isNotNull(),
        "row_type": F.when(F.col("_t").isNotNull(), "modeled_school").otherwise("snapshot_only"),
        "tier_short": F.coalesce(F.nullif("men_tier_short", F.lit("")), F.nullif("women_tier_short", F.lit("")), F.lit("")),
        "finish": F.coalesce(F.nullif("men_finish", F.lit(0)), "women_finish"),
    }).drop("_t")
    u = M.two_key_fallback(u, meta, "school", "team_school", "name")
    return u.withColumn("has_meta", F.col("meta_source") != "none")


def swimmer_bests(raw: DataFrame, standards: DataFrame, n: int = 10) -> DataFrame:
    """Best legal times with gender, the standard score, and the top n per swimmer.

    standards: gender, event, std_b .. std_aaaa.
    """
    bests = B.min_per_key(raw).join(B.first_nonnull(raw), "swimmer_id", "left")
    d = bests.withColumn("gender", F.coalesce("gender", F.lit("men"))).join(standards, ["gender", "event"])
    score = a_score("time_sec", "std_b", "std_a", "std_aa", "std_aaa", "std_aaaa")
    d = d.withColumn("a_score", round_to(score, 3)).withColumn("a_tier", a_tier_label("a_score"))
    return S.top_n_per_key(d, n, ["swimmer_id"]).select("swimmer_id", "gender", "event", "time_sec", "a_score", "a_tier", "rn")


def search(queries: DataFrame, universe: DataFrame, acronyms: DataFrame, candidates: DataFrame, cand_aliases: DataFrame,
           excluded: DataFrame, outside: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Deterministic search over a batch of queries: (query_id, school, path, position, label).

    queries: query_id, query, swimmer, has_times, and sat where `outside` is given. universe: one row per (swimmer, school) with score and metadata
    columns. candidates: query_id, candidate, pos (names proposed for broad queries). excluded: query_id, school.
    outside: name, accept, sat_median of schools outside the universe. `fuzzy` off leaves out the ratio rung of the names.

    Path per query: names resolved (all of them, or the one plus the most similar schools), a name that is not known (a
    stub row with the simple admission label, plus the schools most like it), broad pool, or proposed candidates with
    intent filters; the pre-sorted pool stands in where too few candidates map or none survives. Candidates map to the
    first school in result order: points over all swimmers of the batch, then name.
    """
    # only the swimmers who search; four branches read the result, so it is materialised once
    universe = cut_lineage(universe.join(queries.select("swimmer").distinct(), "swimmer", "left_semi"))
    q = queries.withColumns({"_i": I.query_intent("query")})
    q = q.withColumns({"_broad": I.is_broad_pool(F.col("_i"), "query"), "limit": F.when(I.wants_more("query"), 12).otherwise(6)})
    names = universe.select("school", "location").dropDuplicates(["school"])
    names = names.withColumn("surface", search_surface("school", "location"))
    hits = M.resolve_entities(q, names, acronyms, fuzzy=fuzzy).join(q.select("query_id", "query"), "query").drop("query")
    hits = cut_lineage(R.exclude_list(hits, excluded, keys=["query_id", "school"]))
    n_hits = hits.groupBy("query_id").agg(F.count("*").alias("_hits"))
    q = q.join(n_hits, "query_id", "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    q = q.withColumn("path", F.when(F.col("_hits") >= 2, "multi_match").when(F.col("_hits") == 1, "direct_match")
                     .when(looks_like_name("query"), "unknown_name").when(F.col("_broad"), "broad_pool").otherwise("candidates"))
    sat = F.col("sat") if "sat" in q.columns else F.lit(None).cast("int")
    q = q.withColumns(R.asked_order("query"))
    info = cut_lineage(q.select("query_id", "query", "swimmer", "path", "limit", "has_times", "_i", "_kind", "_states", sat.alias("_sat")))

    multi = hits.join(info.filter("path = 'multi_match'").select("query_id", "path"), "query_id")
    multi = global_rank(multi, [F.desc("score"), F.asc("school")], "position", ["query_id"]).select("query_id", "school", "path", F.col("position").cast("int").alias("position"))
    direct = hits.join(info.filter("path = 'direct_match'").select("query_id", "path"), "query_id")
    like = R.similar_entities(universe.dropDuplicates(["school"]))
    near = direct.join(like, direct["school"] == like["target"]).select("query_id", F.col("candidate").alias("school"), "path", F.col("rank"))
    near = R.exclude_list(near, excluded, keys=["query_id", "school"])
    near = near.select("query_id", "school", "path", (F.col("rank") + 1).alias("position"))
    direct = direct.select("query_id", "school", "path", F.lit(1).alias("position")).unionByName(near)

    stub, like_stub = _unknown_names(info.filter("path = 'unknown_name'"), universe, excluded, outside)
    # a query has a row for every school from here on, so its text stays behind
    pool = universe.join(info.filter("path IN ('broad_pool', 'candidates')").drop("_sat", "query"), "swimmer")
    pool = R.exclude_list(pool, excluded, keys=["query_id", "school"])
    broad = R.viable_pool(pool.filter("path = 'broad_pool'"))
    broad = broad.select("query_id", "school", "path", F.coalesce(F.nullif("accept", F.lit(0)), F.lit(999)).alias("_first"), "adj_pts")
    broad = global_rank(broad, [F.asc("_first"), F.desc("adj_pts"), F.asc("school")], "position", ["query_id"])
    broad = broad.select("query_id", "school", "path", F.col("position").cast("int").alias("position"))

    order = global_rank(universe.groupBy("school").agg(F.max("adj_pts").alias("most")), [F.desc("most"), F.asc("school")], "pos")
    mapped = M.token_jaccard_match(candidates, order.drop("most"), cand_aliases).join(candidates, "candidate")
    # the plan of the match is long and would stand in the result four times
    mapped = cut_lineage(first_per_key(mapped, ["query_id", "school"], [F.asc("pos")]).select("query_id", "school", F.col("pos").alias("_order")))
    cand = pool.filter("path = 'candidates'").join(mapped, ["query_id", "school"])
    enough = cand.groupBy("query_id").agg(F.count("*").alias("_n")).filter("_n >= 3").select("query_id")
    cand = cand.join(enough, "query_id", "left_semi").withColumns({
        "is_swim": F.col("_i.is_swim"), "is_explicit_reach": F.col("_i.is_explicit_reach"),
        "adm_threshold": F.col("_i.adm_threshold"), "has_any_times": F.col("has_times")})
    kept, _ = R.hard_filter(cand.filter("_i.is_personal"))
    keep = kept.unionByName(cand.filter("NOT _i.is_personal"))
    hard = F.col("_hard")
    keep = cut_lineage(keep.select("query_id", "school", "path", "limit", "label", "adj_pts", "_order", F.col("_i.is_prestige_sort").alias("_hard")))
    keep = top_k_per_key(keep, ["query_id"], [
        F.when(hard, I.label_score("label")).otherwise(0).asc(), F.when(hard, -F.col("adj_pts")).otherwise(0.0).asc(), "_order"],
        12, "position").filter(F.col("position") <= F.col("limit")).select("query_id", "school", "path", "position")
    bare = pool.filter("path = 'candidates'").join(keep.select("query_id").distinct(), "query_id", "left_anti")
    fallback = R.intent_sort(bare, text=None, limit=6).select("query_id", "school", F.lit("fallback").alias("path"), "position")
    known = multi.unionByName(direct).unionByName(like_stub).unionByName(broad).unionByName(keep).unionByName(fallback)
    return known.withColumn("label", F.lit(None).cast("string")).unionByName(stub)


def _unknown_names(info: DataFrame, universe: DataFrame, excluded: DataFrame, outside: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The stub of a name that is not in the universe, and the schools most like it: its division and tier are not known, so
    the gap in selectivity decides, then the result order."""
    words = F.transform(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != ""), lambda w: F.when(
        (w == F.upper(w)) & (F.length(w) > 1), F.upper(w)).otherwise(F.initcap(F.lower(w))))
    d = info.select("query_id", "swimmer", "path", "_sat", F.array_join(words, " ").alias("school"))
    if outside is None:
        d = d.withColumns({"accept": F.lit(None).cast("int"), "sat_median": F.lit(None).cast("int"), "name": F.lit(None).cast("string")})
    else:
        d = d.join(outside.select("name", "accept", "sat_median"), F.lower("school") == F.lower("name"), "left")
    label = F.when(F.col("name").isNotNull(), admission_label_simple("accept", "sat_median", "_sat")).otherwise("")
    stub = d.select("query_id", "school", "path", F.lit(1).alias("position"), label.alias("label"))
    rank = lambda a, s: lookup(selectivity_tier(a, s), I.SELECTIVITY_ORDER, 3)
    mine = d.select("query_id", "swimmer", "path", rank("accept", "sat_median").alias("_own"))
    rows = universe.select("swimmer", "school", "adj_pts", rank("accept", "sat_median").alias("_sel")).join(mine, "swimmer")
    rows = R.exclude_list(rows, excluded, keys=["query_id", "school"])
    like = top_k_per_key(rows, ["query_id"], [F.abs(F.col("_sel") - F.col("_own")), F.desc("adj_pts"), "school"], R.SIMILAR_LIMIT, "_rn")
    return stub, like.select("query_id", "school", "path", (F.col("_rn") + 1).alias("position"))
