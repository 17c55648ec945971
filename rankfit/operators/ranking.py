"""Filters with reasons, sort orders chosen per query, similarity and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import intent as I
from ..functions.admission import lookup, selectivity_tier
from ..session import cut_lineage
from .keyed import global_rank, top_k_per_key

PRE_SORT_LIMIT = 150
SIMILAR_LIMIT = 35


def hard_filter(rows: DataFrame, **cols) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and removed rows with the joined reasons."""
    names = dict(is_swim="is_swim", is_reach="is_explicit_reach", threshold="adm_threshold", has_times="has_any_times",
                 adj_tier="adj_tier", has_swim="has_swim", label="label") | cols
    d = rows.withColumn("_reasons", I.filter_reasons(**names))
    kept = d.filter(F.size("_reasons") == 0).drop("_reasons")
    removed = d.filter(F.size("_reasons") > 0).withColumn("reason", F.array_join("_reasons", "; ")).drop("_reasons")
    return kept, removed


def exclude_list(rows: DataFrame, *lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in none of the lists."""
    for excluded in lists:
        rows = rows.join(excluded.select(*keys), list(keys), "left_anti")
    return rows


def viable_pool(rows: DataFrame, has_swim: str = "has_swim", tier: str = "adj_tier") -> DataFrame:
    return rows.filter(F.col(has_swim) & ~F.coalesce(F.col(tier), F.lit("")).isin("", "Not Competitive"))


def rank_results(rows: DataFrame, points: str = "adj_pts", name: str = "school") -> DataFrame:
    return rows.orderBy(F.desc(points), F.asc(name))


def tier_order_sort(rows: DataFrame, tier: str = "tier_short", finish: str = "finish", name: str = "school") -> list[Column]:
    """Sort columns: tier in its own order, finish (missing as 99), name."""
    return [lookup(F.col(tier), I.TIER_ORDER, 5).asc(),
            F.coalesce(F.nullif(finish, F.lit(0)), F.lit(99)).asc(), F.asc(name)]


def asked_order(text: str = "query") -> dict[str, Column]:
    """What `intent_sort` takes from the text of a query, to be worked out before queries meet their rows."""
    return {"_kind": I.sort_kind(text), "_states": I.region_of_query(text)}


def intent_sort(rows: DataFrame, query_key: str = "query_id", text: str | None = "query", name: str = "school",
                limit: int = PRE_SORT_LIMIT, **cols) -> DataFrame:
    """Best rows per query in the order its text asks for, numbered; ties keep points then name order. Without `text` the rows
    carry `asked_order`."""
    d = rows if text is None else rows.withColumns(asked_order(text))
    first, second = I.sort_keys(F.col("_kind"), F.col("_states"), **cols)
    d = d.withColumns({"_k1": first, "_k2": second})
    pts = F.col(cols.get("adj_pts", "adj_pts"))
    out = top_k_per_key(d, [query_key], ["_k1", "_k2", F.desc(pts), F.asc(name)], limit, "position")
    return out.drop("_kind", "_states", "_k1", "_k2")


def intent_rank(queries: DataFrame, pool: DataFrame, query_key: str = "query_id", text: str = "query", name: str = "school",
                limit: int = PRE_SORT_LIMIT, **cols) -> DataFrame:
    """(query, school, position): the best rows of one pool for every query, in the order its text asks for.

    There are no more orders than sort kinds and named regions, whatever the number of queries. The pool is ranked once for
    each, and a query takes the head of its own.
    """
    key = lambda kind, states: F.concat_ws("|", kind, F.array_join(states, ","))
    kinds = [k for k, _ in I.SORTS if k != "strength"] + ["strength"]
    orders = [F.struct(F.lit("region").alias("k"), F.array(*[F.lit(x) for x in s]).alias("s")) for s in sorted({tuple(s) for _, s in I.REGIONS})]
    orders += [F.struct(F.lit(k).alias("k"), F.lit(None).cast("array<string>").alias("s")) for k in kinds]
    d = pool.withColumn("_o", F.explode(F.array(*orders)))
    first, second = I.sort_keys(F.col("_o.k"), F.col("_o.s"), **cols)
    d = d.select(key(F.col("_o.k"), F.col("_o.s")).alias("_order"), first.alias("_k1"), second.alias("_k2"), F.col(cols.get("adj_pts", "adj_pts")).alias("_pts"), name)
    heads = top_k_per_key(d, ["_order"], ["_k1", "_k2", F.desc("_pts"), F.asc(name)], limit, "position").select("_order", name, "position")
    kind = I.sort_kind(text)
    asked = queries.select(query_key, key(kind, F.when(kind == "region", I.region_of_query(text))).alias("_order"))
    return asked.join(heads, "_order").select(query_key, name, "position")


def prestige_sort(rows: DataFrame, query_key: str, limit: Column | int, by_label: bool = True, label: str = "label",
                  accept: str = "accept", points: str = "adj_pts", name: str = "school") -> DataFrame:
    """Hardest first: by label score or by accept rate (missing last), then points; limit per query, a number or a column."""
    first = I.label_score(label) if by_label else F.coalesce(F.nullif(accept, F.lit(0)), F.lit(999))
    order = [first.asc(), F.desc(points), F.asc(name)]
    if isinstance(limit, int):
        return top_k_per_key(rows, [query_key], order, limit, "position")
    ranked = global_rank(rows.withColumn("_first", first), [F.asc("_first"), *order[1:]], "position", [query_key])
    return ranked.drop("_first").filter(F.col("position") <= limit).withColumn("position", F.col("position").cast("int"))


def pick_by_position(pool: DataFrame, picks: DataFrame, key: str, order: Sequence, limit: int = SIMILAR_LIMIT) -> DataFrame:
    """Picks (key, number, why) applied to the ordered pool; numbers outside it drop out."""
    numbered = top_k_per_key(pool, [key], order, limit, "number")
    return numbered.join(picks, [key, "number"])


def similar_entities(rows: DataFrame, name: str = "school", division: str = "division", accept: str = "accept",
                     sat: str = "sat_median", tier: str = "tier_short", order: Sequence[str] | None = None,
                     limit: int = SIMILAR_LIMIT) -> DataFrame:
    """For every entity the `limit` closest others: division penalty 4 + 3 x selectivity gap + tier gap.

    The distance depends on three short-valued columns, and of the division it asks only whether it is the same. So a list
    of the closest is merged from two: the closest of the own division, and the closest of all divisions with the penalty
    (an entity of the own division stands in both; the nearer one counts). Both come from the first limit + 1 entities of
    every pair of selectivity and tier, by division and overall. The overall lists don't depend on the division, so the work
    is linear in the divisions, and the result is exact.
    """
    ordering = list(order or [name])
    d = rows.withColumns({
        "_sel": lookup(selectivity_tier(accept, sat), I.SELECTIVITY_ORDER, 3),
        "_tier": lookup(F.col(tier), I.TIER_ORDER, 99),
        "_div": F.coalesce(F.col(division), F.lit("")),
    })
    pair, cell = ["_sel", "_tier"], ["_div", "_sel", "_tier"]
    tail = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(ordering)], F.col(name).alias("candidate"))
    heads = top_k_per_key(d, cell, ordering, limit + 1, "_rn").select(*cell, tail.alias("_c"))
    overall = top_k_per_key(heads, pair, ["_c"], limit + 1, "_rn").select(*pair, "_c")
    cells = cut_lineage(d.select(*cell).distinct())
    gap = F.abs(F.col("_sel") - F.col("c_sel")) * 3 + F.when((F.col("_tier") != 99) & (F.col("c_tier") != 99), F.abs(F.col("_tier") - F.col("c_tier"))).otherwise(0)
    best = lambda near, keys: top_k_per_key(near, keys, ["distance", "_c"], limit + 1, "_rn").select(*keys, "distance", "_c")
    inside = cells.join(heads.withColumnsRenamed({c: f"c{c}" for c in pair}), "_div").withColumn("distance", gap)
    # pairs of pairs meet on their keys: every pair looks up all values of the other's attributes
    values = lambda table, missing: F.explode(F.array(*[F.lit(v) for v in sorted({*table.values(), missing})]))
    sought = cells.select(*pair).distinct().withColumn("c_sel", values(I.SELECTIVITY_ORDER, 3)).withColumn("c_tier", values(I.TIER_ORDER, 99))
    across = best(sought.join(overall.withColumnsRenamed({c: f"c{c}" for c in pair}), ["c_sel", "c_tier"]).withColumn("distance", gap + 4), pair)
    both = best(inside, cell).unionByName(cells.join(across, pair).select(*cell, "distance", "_c"))
    merged = both.groupBy(*cell, "_c").agg(F.min("distance").alias("distance"))
    lists = merged.groupBy(*cell).agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "_c"))), 1, limit + 1).alias("_list"))
    others = F.slice(F.filter("_list", lambda x: x["_c"]["candidate"] != F.col("target")), 1, limit)
    out = d.select(F.col(name).alias("target"), *cell).join(lists, cell).select("target", F.posexplode(others).alias("_at", "_x"))
    return out.select("target", F.col("_x._c.candidate").alias("candidate"), F.col("_x.distance").alias("distance"), (F.col("_at") + 1).alias("rank"))


def program_line(rows: DataFrame) -> Column:
    """One descriptive text line of an entity."""
    flag = lambda c: F.lower(F.coalesce(F.col(c), F.lit(False)).cast("string"))
    return F.concat(
        F.col("school"), F.lit(" ("), F.col("conference"), F.lit("): admission="), F.coalesce("label", F.lit("")),
        F.lit(", hiddenIvy="), flag("hidden_ivy"), F.lit(", stem="), flag("stem"), F.lit(", merit="),
        F.coalesce("merit", F.lit("")), F.lit(", accept="), F.coalesce(F.col("accept").cast("string"), F.lit("?")), F.lit("%"))


def student_context(name, gpa, sat, act, events: Column, vibe: Column, notes) -> Column:
    """Compact profile text: only the parts that are given."""
    skip = ["Not sure yet", "Genuinely want to be well-rounded", ""]
    prefs = F.filter(F.map_values(vibe), lambda v: v.isNotNull() & ~v.isin(skip))
    text = F.trim(F.coalesce(F.col(notes), F.lit("")))
    return F.concat_ws(
        ", ",
        F.concat(F.lit("Student: "), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("the swimmer"))),
        F.when(F.col(gpa) > 0, F.format_string("GPA %.1f", F.col(gpa))),
        F.when(F.col(sat) > 0, F.concat(F.lit("SAT "), F.col(sat).cast("string")))
        .when(F.col(act) > 0, F.concat(F.lit("ACT "), F.col(act).cast("string"))),
        F.when(F.size(events) > 0, F.concat(F.lit("events: "), F.array_join(F.slice(events, 1, 3), ", "))),
        F.when(F.size(prefs) > 0, F.concat(F.lit("preferences: "), F.array_join(F.slice(prefs, 1, 4), "; "))),
        F.when(text != "", F.concat(F.lit("notes: "), F.substring(text, 1, 200))),
    )
