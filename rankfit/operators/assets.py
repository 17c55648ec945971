"""Candidate pools: trimming, slot picks, cross-entity reuse and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, scratch_path
from .keyed import first_per_key, global_rank, top_k_per_key, with_group_stats

CATEGORIES = ["campus", "pool", "student_life"]
STAND_INS = 4096


def trim_per_category(rows: DataFrame, entity: str = "school", category: str = "category", url: str = "url",
                      score: str = "score", limit: int = 24, order: str | None = None) -> DataFrame:
    """First row per url (input order, else best score), then the best `limit` per known category; a row without
    one belongs to the campus. Rows of unknown categories stay."""
    first = [F.asc(order), F.desc(score)] if order else [F.desc(score)]
    d = first_per_key(rows.filter(F.coalesce(F.col(url), F.lit("")) != ""), [entity, url], [*first, F.asc(category)])
    d = d.withColumn("_category", F.coalesce(F.col(category), F.lit("campus")))
    known = F.col("_category").isin(CATEGORIES)
    best = top_k_per_key(d.filter(known), [entity, "_category"], [F.desc(score), F.asc(url)], limit, "_rn").drop("_rn")
    return best.unionByName(d.filter(~known)).drop("_category")


def best_per_slot(rows: DataFrame, entity: str, slot: str, url: str = "url", score: str = "score") -> DataFrame:
    """Highest score above zero per (entity, slot). The best row decides, so the test comes after the aggregation and a
    costly score expression is evaluated once."""
    key = F.struct(-F.col(score), F.col(url))
    best = rows.groupBy(entity, slot).agg(F.min_by(url, key).alias(url), F.max(score).alias(score))
    return best.filter(F.col(score) > 0)


def exclusive_slot_pick(rows: DataFrame, entity: str, slots: Sequence[tuple[str, str, int]], url: str = "url",
                        floor: int = -20) -> DataFrame:
    """One url per slot in slot order; a url serves one slot of an entity only. A slot takes the best url that
    reaches its minimum, else the best one above the floor (marked as fallback), else nothing.

    slots: (name, score column, minimum).
    """
    out = rows.select(entity).distinct()
    free = rows
    for i, (name, score, minimum) in enumerate(slots):
        best = first_per_key(free.filter(F.col(score) >= floor), [entity], [F.desc(score), F.asc(url)])
        pick = best.select(entity, F.col(url).alias(name), (F.col(score) < minimum).alias(f"{name}_fallback"))
        out = out.join(pick, entity, "left").withColumn(f"{name}_fallback", F.coalesce(f"{name}_fallback", F.lit(True)))
        if i < len(slots) - 1:
            free = free.join(pick.select(entity, F.col(name).alias(url)), [entity, url], "left_anti")
    return out


def cross_group_frequency(rows: DataFrame, value: str, group: str, most: int = 4) -> DataFrame:
    """Rows with the number of distinct groups that use their value, and whether that makes it generic."""
    uses = rows.select(value, group).distinct().groupBy(value).agg(F.count("*").alias("group_count"))
    return rows.join(uses, value).withColumn("is_generic", F.col("group_count") > most)


def null_shared(rows: DataFrame, values: Sequence[str], group: str, others: int = 2) -> DataFrame:
    """All rows; a value that `others` or more other groups use in any of the columns becomes null, and `<column>_fallback`
    says where one is missing. Rows without a value have nothing to look up; they are dealt out by a stand-in key, not to one task."""
    used = rows.select(F.col(group).alias("_g"), F.explode(F.array(*values)).alias("_v")).filter("_v is not null").distinct()
    shared = used.groupBy("_v").agg(F.count("*").alias("_n")).filter(F.col("_n") - 1 >= others).select("_v")
    for v in values:
        # a stand-in that is a shared value by chance changes nothing: null stays null
        stand_in = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*rows.columns), F.lit(STAND_INS)).cast("string"))
        found = shared.select(F.col("_v").cast("string").alias("_key"), F.lit(True).alias("_shared"))
        rows = rows.withColumn("_key", F.coalesce(F.col(v).cast("string"), stand_in)).join(found, "_key", "left")
        rows = rows.withColumn(v, F.when(F.col("_shared").isNull(), F.col(v))).drop("_key", "_shared").withColumn(f"{v}_fallback", F.col(v).isNull())
    return rows


def global_exclusive_pick(rows: DataFrame, entity: str, entity_order: str, url: str = "url", score: str = "score",
                          minimum: int = -5, block: int = 1024, head: int = 32) -> DataFrame:
    """Best url per entity where earlier entities choose first and a url is used once. A null order comes before all
    others; entities of equal order choose by entity; of several orders of an entity the first counts. A null url is none.

    Entities are numbered and cut in blocks. Prefixes of blocks double in length: one block, the next, the next two, four,
    and so on. A prefix is settled in rounds over all its blocks at once: a block chooses one by one among what neither
    earlier prefixes (a table that is only appended to) nor, as of the last round, earlier blocks have taken. The first block
    is right at once; a round that changes nothing has settled all. So the number of rounds follows how far a conflict
    reaches from block to block, not the number of entities.

    Rounds read the `head` best offers of an entity, closed by a mark where it has more. An entity that comes to its mark
    has run out and goes into the next round with all its offers; a prefix is settled when none ran out anew. All offers are
    written once, and again in one folder per prefix when the first entity runs out. In its turn the n-th of a block needs
    its n best offers only: a task holds at most block x block / 2 rows and block x (head + 1).
    """
    spark = rows.sparkSession
    given, heads, whole, taken = (scratch_path(spark, n) for n in ("offers", "heads", "whole", "taken"))
    first = F.struct(F.col(entity_order).isNotNull().alias("known"), F.col(entity_order).alias("at"))
    usable = rows.filter((F.col(score) >= minimum) & F.col(url).isNotNull())
    usable.select(F.col(entity).alias("_entity"), F.col(url).alias("_url"), F.col(score).alias("_score"), first.alias("_first")).write.parquet(given)
    offers = spark.read.parquet(given)
    turns = offers.groupBy("_entity").agg(F.min("_first").alias("_first"))
    turns = global_rank(turns, [F.asc("_first"), F.asc("_entity")], "_turn").select(F.col("_entity").alias("_e"), (F.col("_turn") - 1).alias("_turn"))
    number = F.floor(F.col("_turn") / block)
    prefix = F.when(number == 0, 0).otherwise(F.floor(F.log2(F.greatest(number, F.lit(1)).cast("double")) + 1e-12) + 1).cast("int")
    turns = turns.withColumns({"_block": number, "_prefix": prefix})

    def in_turn(d: DataFrame, path: str) -> DataFrame:
        d = d.join(turns, F.col("_entity").eqNullSafe(F.col("_e"))).drop("_e")
        d.write.partitionBy("_prefix").parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    best = top_k_per_key(offers.drop("_first"), ["_entity"], [F.desc("_score"), F.asc("_url")], head + 1, "_rank")
    best = in_turn(best.withColumn("_end", F.col("_rank") > head), heads)
    prefixes = [r["_prefix"] for r in best.select("_prefix").distinct().orderBy("_prefix").collect()]
    schema = best.withColumn("_all", F.lit(False)).select("_entity", "_url", "_score", "_turn", "_block", "_end", "_all").schema
    spark.createDataFrame([], schema).write.parquet(taken)
    everything = None
    for k in prefixes:
        used = spark.read.schema(schema).parquet(taken).select(F.col("_url").alias("_used"))
        unused = lambda d, c: d.filter(F.col("_prefix") == k).join(used, c, "left_anti").drop("_prefix")
        own = unused(best, (F.col("_url") == F.col("_used")) & ~F.col("_end"))
        picked, asked = None, False
        while True:
            if asked and everything is None:
                everything = in_turn(offers.drop("_first"), whole)
            again = _block_round(own, unused(everything, F.col("_url") == F.col("_used")) if asked else None, picked, schema, block)
            ran_out = not again.filter(F.col("_end") & ~F.col("_all")).isEmpty()
            settled = not ran_out and (k <= 1 or (picked is not None and _same(again, picked)))
            picked, asked = again, asked or ran_out
            if settled:
                break
        picked.filter(~F.col("_end")).write.mode("append").parquet(taken)
    return spark.read.schema(schema).parquet(taken).select(F.col("_entity").alias(entity), F.col("_url").alias(url), F.col("_score").alias(score))


def _block_round(heads: DataFrame, offers: DataFrame | None, picked: DataFrame | None, schema, block: int) -> DataFrame:
    """What every block chooses when the blocks before it hold what they picked in the round before, from the heads and, for
    entities that have run out, from all offers. An entity that comes to its mark gets a row with `_end`."""
    d = heads.withColumn("_all", F.lit(False))
    if picked is not None:
        held = picked.filter(~F.col("_end")).groupBy(F.col("_url").alias("_held")).agg(F.min("_block").alias("_holder"))
        d = d.join(held, (F.col("_url") == F.col("_held")) & (F.col("_holder") < F.col("_block")) & ~F.col("_end"), "left_anti")
    if offers is not None:
        out = picked.filter(F.col("_end") | F.col("_all")).select(F.col("_turn").alias("_t"))
        marks = d.filter("_end").join(out, F.col("_turn") == F.col("_t"), "left_semi").withColumns({"_all": F.lit(True), "_rank": F.lit(block + 1)})
        more = offers.join(out, F.col("_turn") == F.col("_t"), "left_semi").groupBy("_entity", "_url", "_turn", "_block").agg(F.max("_score").alias("_score"))
        more = more.join(held, (F.col("_url") == F.col("_held")) & (F.col("_holder") < F.col("_block")), "left_anti")
        more = top_k_per_key(more, ["_turn"], [F.desc("_score"), F.asc("_url")], block, "_rank").filter(F.col("_rank") <= F.col("_turn") % block + 1)
        d = d.join(out, F.col("_turn") == F.col("_t"), "left_anti").unionByName(marks).unionByName(more.withColumns({"_end": F.lit(False), "_all": F.lit(True)}))
    return cut_lineage(d.groupBy("_block").applyInPandas(_choose, schema))


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two rounds picked the same; a turn has one row in each."""
    sides = [d.select("_turn", "_url", "_end", F.lit(n).alias("_side")) for d, n in ((a, 1), (b, -1))]
    return sides[0].unionByName(sides[1]).groupBy("_turn", "_url", "_end").agg(F.sum("_side").alias("_n")).filter("_n <> 0").isEmpty()


def _choose(offers: pd.DataFrame) -> pd.DataFrame:
    """One by one the best offer whose url is free; the mark of an entity that finds none before it."""
    offers = offers.sort_values(["_turn", "_rank"], ignore_index=True)
    taken, served, rows = set(), None, []
    for i, (turn, url, end) in enumerate(zip(offers["_turn"], offers["_url"], offers["_end"])):
        if turn != served and (end or url not in taken):
            if not end:
                taken.add(url)
            served = turn
            rows.append(i)
    return offers.loc[rows, ["_entity", "_url", "_score", "_turn", "_block", "_end", "_all"]]


def crowded(rows: DataFrame, entity: str, limit: int, count: Column | None = None) -> DataFrame:
    """Entities that hold more rows than the limit."""
    return with_group_stats(rows, [entity], n=count if count is not None else F.count("*")).filter(F.col("n") > limit)
