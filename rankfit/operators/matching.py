"""Name reconciliation: alias tables, lookup cascades, containment, token overlap and fuzzy matching.

Text comparisons never pair every query with every name. Each rung first joins on a selective key (an exact
form, a rarest gram, a rarest token or a token-prefix) that every true match must share, then verifies the pair.
All rungs work on distinct texts, so copies of a text cost nothing extra.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import NAME_STOP, PREFIX_STOP, norm_key, norm_name, norm_query, tokens
from ..session import cut_lineage
from .keyed import first_per_key, top_k_per_key, with_group_stats

GRAM = 4
FUZZY_CUTOFF, FUZZY_HITS = 0.80, 6
MIN_CONFIDENCE = 0.55
HEAVY_ROWS, HEAVY_PARTS = 4096, 4096
SMALL_POSTINGS = 1 << 21


def canonicalize(rows: DataFrame, aliases: DataFrame, name: str = "school") -> DataFrame:
    """Canonical name, reason and a normalized flag per row. aliases: raw, canonical, reason."""
    a = aliases.select(F.col("raw").alias(name), F.col("canonical").alias("_c"), "reason")
    d = rows.join(a, name, "left").withColumn("raw_name", F.col(name))
    return d.withColumns({"normalized": F.col("_c").isNotNull(), name: F.coalesce("_c", name)}).drop("_c")


def normalization_log(canonical: DataFrame, group: str = "conference", name: str = "school") -> DataFrame:
    return canonical.filter("normalized").select(
        F.col("raw_name").alias("raw"), F.col(name).alias("canonical"), "reason", group)


def cascade_lookup(left: DataFrame, right: DataFrame, short_names: DataFrame, key: str, group: str = "conference",
                   name: str = "school", raw: str = "raw_name", order: str = "pos") -> DataFrame:
    """First hit of: exact (group, name), short-name alias, same group, any group when unique; then the same with
    the raw name. Returns the left key with the matched right `order` value and the rung (1-4, 5-8 for raw names).

    right: group, name, and a unique `order` column that says which row comes first.
    """
    r = right.select(norm_key(group).alias("_g"), norm_key(name).alias("_n"), F.col(order).alias("hit"))
    exact = r.groupBy("_g", "_n").agg(F.max("hit").alias("hit_exact"), F.min("hit").alias("hit_same"))
    by_name = r.groupBy("_n").agg(F.min("hit").alias("hit_any"), F.count("*").alias("_copies"))
    shorts = short_names.select(F.col("short").alias("_n"), norm_key("full").alias("_full"))
    via = shorts.join(by_name.select(F.col("_n").alias("_full"), F.col("hit_any").alias("hit_alias")), "_full").select("_n", "hit_alias")

    def rungs(nm: str, base: int) -> DataFrame:
        d = left.select(key, norm_key(group).alias("_g"), norm_key(nm).alias("_n"))
        d = d.join(exact, ["_g", "_n"], "left").join(via, "_n", "left").join(by_name, "_n", "left")
        unique = F.when(F.col("_copies") == 1, F.col("hit_any"))
        hits = [F.col("hit_exact"), F.col("hit_alias"), F.col("hit_same"), unique]
        rung = F.lit(None).cast("int")
        for i in range(3, -1, -1):
            rung = F.when(hits[i].isNotNull(), base + i).otherwise(rung)
        return d.select(key, F.coalesce(*hits).alias("hit"), rung.alias("rung"))

    first = rungs(name, 1)
    second = rungs(raw, 5).withColumnsRenamed({"hit": "hit2", "rung": "rung2"})
    d = first.join(second, key)
    return d.select(key, F.coalesce("hit", "hit2").alias("hit"), F.coalesce("rung", "rung2").alias("rung"))


def two_key_fallback(rows: DataFrame, meta: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Metadata by the first name, else by the second; `meta_source` says which."""
    cols = [c for c in meta.columns if c != key]
    a = meta.select(F.col(key).alias("_k1"), F.struct(*cols).alias("_m1"))
    b = meta.select(F.col(key).alias("_k2"), F.struct(*cols).alias("_m2"))
    d = rows.join(a, rows[first] == F.col("_k1"), "left").join(b, rows[second] == F.col("_k2"), "left")
    m = F.coalesce("_m1", "_m2")
    source = F.when(F.col("_m1").isNotNull(), "first").when(F.col("_m2").isNotNull(), "second").otherwise("none")
    return d.select(*rows.columns, *[m[c].alias(c) for c in cols], source.alias("meta_source"))


def gender_pivot_join(rows: DataFrame, key: str, values: Sequence[str], order: str = "pos") -> DataFrame:
    """One row per key with the last men's and women's values side by side and the primary of the two."""
    last = lambda v, g: F.max_by(v, F.when(F.col("gender") == g, F.col(order)))
    d = rows.groupBy(key).agg(
        *[last(v, g).alias(f"{g}_{v}") for g in ("men", "women") for v in values],
        (F.count_if(F.col("gender") == "men") > 0).alias("_men"),
        F.array_join(F.array_sort(F.collect_set("gender")), ",").alias("gender_coverage"))
    return d.withColumns({
        v: F.when(F.col("_men"), F.col(f"men_{v}")).otherwise(F.col(f"women_{v}")) for v in values}).drop("_men")


def geo_lookup(rows: DataFrame, overrides: DataFrame, locations: DataFrame, aliases: DataFrame, coords: DataFrame,
               key: str = "school") -> DataFrame:
    """Coordinates by manual override, else by own location, else by the alias's location; nulls are the missing."""
    o = overrides.select(F.col(key), F.struct("lat", "lng").alias("_o"))
    own = locations.select(F.col(key), F.col("location").alias("_l1"))
    al = aliases.select(F.col("raw").alias(key), "canonical").join(
        locations.select(F.col(key).alias("canonical"), F.col("location").alias("_l2")), "canonical").drop("canonical")
    d = rows.join(o, key, "left").join(own, key, "left").join(al, key, "left")
    d = d.withColumn("location", F.coalesce("_l1", "_l2"))
    c = coords.select("location", F.struct("lat", "lng").alias("_c"))
    d = d.join(c, "location", "left")
    at = F.coalesce("_o", "_c")
    return d.select(*rows.columns, "location", F.round(at["lat"], 5).alias("lat"), F.round(at["lng"], 5).alias("lng"))


# ---- candidate generation --------------------------------------------------------------------------------


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams of a text of at least n characters."""
    starts = F.sequence(F.lit(1), F.length(c) - (n - 1))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))))


def longest(df: DataFrame, text: str) -> Column:
    """Length of the longest text, as a scalar subquery; null where there is none."""
    return df.agg(F.max(F.length(text))).scalar()


def heavy_split(posting: DataFrame, probe: DataFrame, key: str, row: str, df: DataFrame, least: int = HEAVY_ROWS) -> DataFrame:
    """The join of `probe` with `posting` on `key`, where the postings of heavy keys are dealt out by a second key.

    A key with more than `least` rows (`_df` in `df`) lies in parts of about that many, by the hash of the row, and what looks
    it up is copied to each of them; from `HEAVY_PARTS` parts on the parts grow instead.
    """
    parts = F.least(F.lit(HEAVY_PARTS), F.ceil(F.col("_df") / least)).cast("int")
    heavy = df.filter(F.col("_df") > least).select(key, parts.alias("_parts"))
    of = F.coalesce("_parts", F.lit(1))
    left = probe.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1))).drop("_parts")
    right = posting.join(heavy, key, "left").withColumn("_part", F.pmod(F.hash(row), of)).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def contained_pairs(needles: DataFrame, needle: str, haystack: DataFrame, hay: str, min_length: int = GRAM) -> DataFrame:
    """Pairs where the needle, of at least `min_length` characters, occurs inside the hay text.

    A needle of four or more characters is looked up by its rarest four-gram only, and dropped at once when one of its
    grams is in no hay text. A shorter needle is itself a gram of its length. A hay text has about as many grams as letters, so
    it goes by a number until its candidates are known; where the needles have up to `SMALL_POSTINGS` letters in all, their grams
    are broadcast, and no other gram leaves the place of its text.
    """
    hays = cut_lineage(haystack.select(F.col(hay)).distinct().withColumn("_hay", F.monotonically_increasing_id()))
    need = needles.select(F.col(needle)).distinct().filter(F.length(needle) >= min_length)
    need = cut_lineage(need.filter(F.length(needle) <= longest(hays, hay)))
    letters = lambda d, c: d.agg(F.sum(F.length(c).cast("bigint"))).first()[0] or 0
    few = letters(need, needle) <= SMALL_POSTINGS
    near = F.broadcast if few else lambda d: d

    posting = hays.filter(F.length(hay) >= GRAM).select("_hay", F.explode(grams(F.col(hay), GRAM)).alias("_gram"))
    only = lambda sought: posting.join(near(sought.select("_gram").distinct()), "_gram", "left_semi") if few else posting
    long = need.filter(F.length(needle) >= GRAM).withColumn("_grams", grams(F.col(needle), GRAM))
    parts = long.select(needle, F.size("_grams").alias("_all"), F.explode("_grams").alias("_gram"))
    df = only(parts).groupBy("_gram").agg(F.count("*").alias("_df"))
    known = parts.join(F.broadcast(df) if letters(hays, hay) <= SMALL_POSTINGS else df, "_gram")
    rare = known.groupBy(needle, "_all").agg(F.min(F.struct("_df", "_gram")).alias("_r"), F.count("*").alias("_known"))
    rare = cut_lineage(rare.filter(F.col("_known") == F.col("_all")).select(needle, "_r.*"))
    out = heavy_split(only(rare), rare.drop("_df"), "_gram", "_hay", rare.select("_gram", "_df").distinct())
    out = out.select(needle, "_hay").join(hays, "_hay").filter(F.contains(F.col(hay), F.col(needle))).select(needle, hay)
    if min_length < GRAM:
        heads = F.flatten(F.array_compact(F.array(*[grams(F.col(hay), n) for n in range(min_length, GRAM)])))
        inside = hays.select("_hay", F.explode(heads).alias(needle)).join(near(need.filter(F.length(needle) < GRAM)), needle)
        out = out.unionByName(inside.join(hays, "_hay").select(needle, hay))
    return out


def first_containing(needles: DataFrame, needle: str, records: DataFrame, name: str, order: str) -> DataFrame:
    """(needle, name): for every needle the first record, by `order`, whose name contains it.

    A needle of up to three characters is a gram itself, and of every gram only the head of its posting, its first record,
    is kept; longer ones are looked up by their rarest gram.
    """
    r = records.groupBy(name).agg(F.min(order).alias(order))
    need = needles.select(needle).distinct()
    first = F.min(F.struct(order, name)).alias("_f")
    out = contained_pairs(need, needle, r, name).join(r, name).groupBy(needle).agg(first)
    for n in range(1, GRAM):
        heads = r.filter(F.length(name) >= n).select(name, order, F.explode(grams(F.col(name), n)).alias(needle)).groupBy(needle).agg(first)
        out = out.unionByName(need.filter(F.length(needle) == n).join(heads, needle))
    return out.select(needle, F.col(f"_f.{name}").alias(name))


def prefix_token_pairs(queries: DataFrame, query: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs where every token of a query of two or more tokens starts some token of the name."""
    toks = lambda c: tokens(F.col(c), PREFIX_STOP)
    q = queries.select(query).distinct().withColumn("_qt", toks(query)).filter(F.size("_qt") >= 2)
    s = names.select(name).distinct().withColumn("_st", toks(name)).filter(F.size("_st") > 0)
    heads = F.array_distinct(F.flatten(F.transform("_st", lambda t: F.transform(
        F.sequence(F.lit(2), F.length(t)), lambda i: F.substr(t, F.lit(1), i)))))
    posting = s.select(name, "_st", F.explode(heads).alias("_key"))
    df = posting.groupBy("_key").agg(F.count("*").alias("_df"))
    rare = q.select(query, "_qt", F.explode("_qt").alias("_key")).join(df, "_key").groupBy(query, "_qt").agg(
        F.min_by("_key", F.struct("_df", "_key")).alias("_key"), F.count("*").alias("_known"))
    rare = rare.filter(F.col("_known") == F.size("_qt"))
    ok = F.forall("_qt", lambda t: F.exists("_st", lambda u: F.startswith(u, t)))
    return heavy_split(posting, rare.drop("_known"), "_key", name, df).filter(ok).select(query, name)


def jaccard_pairs(left: DataFrame, left_key: str, right: DataFrame, right_key: str, token_col: str = "toks",
                  threshold: float = 0.5) -> DataFrame:
    """Pairs of token sets with Jaccard similarity of at least the threshold.

    Prefix filter: the tokens of a left set are ordered from rare to frequent (in the right sets). Where a pair's first common
    token lies too late for the sets' sizes, the pair can't reach the threshold; the others are verified at that token, once,
    where the right row lies. So neither candidates nor token lists are shuffled while the left sets' postings are small
    enough to be broadcast (`SMALL_POSTINGS` tokens in all); larger ones are joined by token.
    """
    filled = F.size(token_col) > 0
    lmap = left.filter(filled).select(left_key, F.array_sort(token_col).alias("_setl"))
    ls = lmap.select("_setl").distinct()
    rs = right.filter(filled).select(right_key, F.col(token_col).alias("_setr"))
    tokens_of = rs.select(right_key, "_setr", F.explode("_setr").alias("_t"))

    size = F.size("_setl")
    volume = ls.agg(F.sum(size.cast("bigint") * size)).first()[0] or 0
    near = F.broadcast if volume <= SMALL_POSTINGS else lambda d: d
    single = ls.select("_setl", F.explode("_setl").alias("_t"))
    df = tokens_of.select("_t").join(near(single.select("_t").distinct()), "_t", "left_semi").groupBy("_t").agg(F.count("*").alias("_df"))
    ranked = single.join(df, "_t", "left").groupBy("_setl").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), F.col("_t").alias("t")))).alias("_o"))
    ranked = ranked.select("_setl", F.transform("_o", lambda s: s["t"]).alias("_l"))
    # from the first common token on, so many tokens of the left set can be shared
    posting = ranked.select("_setl", "_l", F.posexplode("_l").alias("_at", "_t")).withColumn("_left", size - F.col("_at")).drop("_at")
    posting = posting.filter(F.col("_left") >= size * threshold - 1e-9)

    # inter / (a + b - inter) >= t where inter (1 + t) >= t (a + b)
    both = size + F.size("_setr")
    cand = tokens_of.join(near(posting), "_t").filter(F.least("_left", F.size("_setr")) * (1 + threshold) >= both * threshold - 1e-9)
    inter = F.size(F.array_intersect("_l", "_setr"))
    good = cand.withColumn("jaccard", inter / (both - inter)).filter(F.col("jaccard") >= threshold)
    good = good.filter(F.get(F.array_intersect("_l", "_setr"), F.lit(0)) == F.col("_t")).select("_setl", right_key, "jaccard")
    return good.join(near(lmap), "_setl").select(left_key, right_key, "jaccard")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(name: pd.Series, query: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two short texts. The query is the second sequence of the matcher."""
    out = []
    for a, b in zip(name, query):
        out.append(difflib.SequenceMatcher(None, a, b).ratio())
    return pd.Series(out, dtype="float64")


def fuzzy_pairs(queries: DataFrame, query: str, names: DataFrame, name: str, cutoff: float = FUZZY_CUTOFF,
                hits: int = FUZZY_HITS) -> DataFrame:
    """The best `hits` names per query with a ratio of at least the cutoff.

    Keys are bigrams (single characters for texts under four characters). With ratio r, a query of length a and a
    name of length b have M >= r(a + b)/2 matched characters, so at most 2(a - M) + (b - M) bigrams of the query can
    be missing from the name; one more of its rarest bigrams than that must be shared. For texts of joint length
    above five some matched run has two characters, so looking up all bigrams is always enough. An edit-distance
    bound then prunes pairs before the ratio itself decides.
    """
    q = queries.select(query).distinct().filter(F.length(query) > 0)
    s = names.select(name).distinct().filter(F.length(name) > 0)
    # a text so much longer than every name can't reach the ratio
    q = q.filter(F.length(query) * cutoff <= longest(s, name) * (2 - cutoff))

    def keyed(d: DataFrame, c: str) -> DataFrame:
        both = F.concat(F.coalesce(grams(F.col(c), 2), F.array().cast("array<string>")), grams(F.col(c), 1))
        return d.select(c, F.explode(F.array_distinct(both)).alias("_key"))

    # the length of a name is a second key: a query of length a reaches the ratio with lengths from a c / (2 - c) to a (2 - c) / c
    posting = keyed(s, name).withColumn("_size", F.length(name))
    df = posting.groupBy("_key").agg(F.count("*").alias("_df"))
    ql = F.length(query)
    use_bigrams = ql >= 4
    mine = keyed(q, query).filter(F.when(use_bigrams, F.length("_key") == 2).otherwise(F.length("_key") == 1))
    ranked = mine.join(df, "_key", "left").groupBy(query).agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("_df", F.lit(0)).alias("d"), F.col("_key").alias("k")))).alias("_o"))
    r = cutoff
    per_name = 1.5 * r - 1
    partner = r / (2 - r) if per_name >= 0 else (2 - r) / r
    lost = F.when(use_bigrams, F.floor(ql * ((2 - 1.5 * r) - per_name * partner) + 1e-9)).otherwise(
        F.floor(ql * (2 - 2 * r) / (2 - r) + 1e-9))
    keep = F.least(F.size("_o"), lost + 1).cast("int")
    heads = ranked.select(query, F.explode(F.transform(F.slice("_o", F.lit(1), keep), lambda x: x["k"])).alias("_key"))
    sizes = F.sequence(F.ceil(ql * cutoff / (2 - cutoff) - 1e-9).cast("int"), F.floor(ql * (2 - cutoff) / cutoff + 1e-9).cast("int"))
    by_size = lambda d: d.withColumn("_key", F.concat_ws("\n", "_key", F.col("_size").cast("string"))).drop("_size")
    posting, probe = by_size(posting), by_size(heads.withColumn("_size", F.explode(sizes)))
    counts = posting.groupBy("_key").agg(F.count("*").alias("_df"))
    cand = heavy_split(posting, probe, "_key", name, counts).select(query, name).distinct()
    short, long = F.least(F.length(query), F.length(name)), F.greatest(F.length(query), F.length(name))
    edits = F.floor((short + long) * (1 - cutoff) + 1e-9).cast("int")
    cand = cand.filter((2 * short >= (short + long) * cutoff) & (F.levenshtein(query, name) <= edits))
    scored = cand.withColumn("ratio", sequence_ratio(F.col(name), F.col(query))).filter(F.col("ratio") >= cutoff)
    return top_k_per_key(scored, [query], [F.desc("ratio"), F.desc(name)], hits, "_rn").drop("_rn")


# ---- resolvers -------------------------------------------------------------------------------------------


def resolve_entities(queries: DataFrame, names: DataFrame, acronyms: DataFrame, query: str = "query", name: str = "school",
                     surface: str = "surface", fuzzy: bool = True) -> DataFrame:
    """Scored matches per query: alias or exact 1.0, query in name .85, name in query .80, token prefixes .78,
    fuzzy ratio x .8, and location text .65 only for queries nothing else matched. Best score per name, at least
    .55. acronyms: short (normalized), canonical.
    """
    # the distinct texts are normalized once; every rung reads these short tables
    q = cut_lineage(queries.select(F.col(query).alias("_raw")).distinct().withColumn("_q", norm_query("_raw")))
    s = names.select(F.col(name).alias("_name"), F.col(surface).alias("_surface")).dropDuplicates(["_name"])
    s = cut_lineage(s.withColumn("_n", norm_query("_name")))
    qn, nn = q.select("_q").distinct(), s.select("_n").distinct()
    hit = lambda d, score: d.select("_q", "_name", F.lit(score).cast("double").alias("score"))
    to_names = lambda d: d.join(s.select("_n", "_name"), "_n")
    alias = qn.join(acronyms.select(F.col("short").alias("_q"), F.col("canonical").alias("_name")), "_q").join(
        s.select("_name"), "_name", "left_semi")
    long_q = qn.filter(F.length("_q") >= 4)
    # names that share a normalized form: the last in name order stands for it in the exact and fuzzy rungs
    forms = s.groupBy("_n").agg(F.max("_name").alias("_name"))
    exact = qn.join(forms.withColumnRenamed("_n", "_q"), "_q")
    inside = to_names(contained_pairs(long_q, "_q", nn, "_n"))
    around = to_names(contained_pairs(nn, "_n", long_q, "_q").filter(~F.contains("_n", F.col("_q"))))
    prefix = to_names(prefix_token_pairs(qn, "_q", nn, "_n"))
    found = hit(alias, 1.0).unionByName(hit(exact, 1.0)).unionByName(hit(inside, 0.85)).unionByName(
        hit(around, 0.80)).unionByName(hit(prefix, 0.78))
    if fuzzy:
        by_norm = fuzzy_pairs(qn, "_q", nn, "_n").join(forms, "_n")
        typed = fuzzy_pairs(q, "_raw", s, "_name").join(q, "_raw").join(s.select("_name", "_n"), "_name")
        near = by_norm.select("_q", "_name", "_n").unionByName(typed.select("_q", "_name", "_n")).distinct()
        found = found.unionByName(near.select(
            "_q", "_name", (sequence_ratio(F.col("_q"), F.col("_n")) * 0.80).alias("score")))
    best = cut_lineage(found.groupBy("_q", "_name").agg(F.max("score").alias("score")))
    rest = long_q.join(best.select("_q").distinct(), "_q", "left_anti")
    places = contained_pairs(rest, "_q", s, "_surface").join(s.select("_surface", "_name"), "_surface")
    full = best.unionByName(hit(places, 0.65)).filter(F.col("score") >= MIN_CONFIDENCE)
    full = full.groupBy("_q", "_name").agg(F.max("score").alias("score"))
    return q.join(full, "_q").select(F.col("_raw").alias(query), F.col("_name").alias(name), "score")


def token_jaccard_match(candidates: DataFrame, records: DataFrame, aliases: DataFrame, cand: str = "candidate",
                        name: str = "school", order: str = "pos", threshold: float = 0.5) -> DataFrame:
    """One record per candidate text by the first rung that hits: alias, exact, containment either way (first
    record in order), token Jaccard (best, then first). aliases: raw (normalized), canonical."""
    c = cut_lineage(candidates.select(F.col(cand)).distinct().withColumn("_c", norm_name(cand)).filter(F.trim(cand) != ""))
    # records that share a normalized form: the last one stands for it
    r = cut_lineage(records.select(F.col(name).alias("_name"), F.col(order).alias("_pos"), norm_name(name).alias("_n")))
    forms = r.groupBy("_n").agg(F.max_by("_name", "_pos").alias("_name"), F.min("_pos").alias("_pos"))
    cn, rn = c.select("_c").distinct(), forms.select("_n")
    pick = lambda d, rung: d.select("_c", "_name", F.lit(rung).alias("rung"), F.col("_pos").cast("double").alias("_key"))
    al = aliases.select(F.col("raw").alias("_c"), norm_name("canonical").alias("_n"))
    r0 = pick(cn.join(al, "_c").join(forms, "_n"), 0)
    r1 = pick(cn.join(forms.withColumnRenamed("_n", "_c"), "_c"), 1)
    left = first_containing(cn, "_c", forms, "_n", "_pos").unionByName(contained_pairs(rn, "_n", cn, "_c", 1).select("_c", "_n"))
    r2 = pick(left.join(forms, "_n"), 2)
    ct = cn.withColumn("toks", tokens(F.col("_c"), NAME_STOP))
    rt = r.withColumn("toks", tokens(F.col("_n"), NAME_STOP))
    sim = jaccard_pairs(ct, "_c", rt.withColumn("_rid", F.struct("_pos", "_name")), "_rid", threshold=threshold)
    r3 = sim.select("_c", F.col("_rid._name").alias("_name"), F.lit(3).alias("rung"), F.col("_rid._pos").alias("_p"), "jaccard")
    r3 = first_per_key(r3, ["_c"], [F.desc("jaccard"), "_p"]).select("_c", "_name", "rung", F.lit(0.0).alias("_key"))
    hits = r0.unionByName(r1).unionByName(r2).unionByName(r3)
    best = first_per_key(hits, ["_c"], ["rung", "_key", "_name"]).select("_c", "_name", "rung")
    return c.join(best, "_c").select(cand, F.col("_name").alias(name), "rung")


def dedupe_mapped(mapped: DataFrame, name: str = "school", order: str = "pos") -> DataFrame:
    """Each record once, at its first candidate."""
    return first_per_key(mapped, [name], [F.asc(order)])


def partial_name_lookup(queries: DataFrame, records: DataFrame, query: str = "query", name: str = "school", order: str = "pos") -> DataFrame:
    """Case-insensitive exact match, else containment either way; the first record wins."""
    q = queries.select(F.col(query)).distinct().withColumn("_q", F.lower(F.trim(query)))
    r = records.select(F.col(name).alias("_name"), F.lower(name).alias("_n"), F.col(order).alias("_pos"))
    qn, rn = q.select("_q").distinct(), r.select("_n").distinct()
    exact = qn.join(r.withColumnRenamed("_n", "_q"), "_q").select("_q", "_name", "_pos", F.lit(0).alias("rung"))
    pairs = contained_pairs(rn, "_n", qn, "_q", 1).select("_q", "_n").unionByName(first_containing(qn, "_q", r, "_n", "_pos")).distinct()
    part = pairs.join(r, "_n").select("_q", "_name", "_pos", F.lit(1).alias("rung"))
    best = first_per_key(exact.unionByName(part), ["_q"], ["rung", "_pos"])
    return q.join(best, "_q").select(query, F.col("_name").alias(name), "rung")


def duplicated_names(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs more than once, with the number of copies."""
    return with_group_stats(rows, [name], copies=F.count("*")).filter(F.col("copies") > 1)
