"""Name keys, tokens and repairs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import col

# fixed values: words that carry no identity in a name
NAME_STOP = ["university", "college", "institute", "school", "of", "the", "at", "and", "in", "a", "tech", "for"]
KEY_STOP = ["university", "college", "of", "the", "at", "and", "a", "an", "state", "institute", "technology", "school"]
PREFIX_STOP = ["of", "the", "and", "at", "for", "in", "a"]
NOT_A_NAME = [
    "find", "show", "good", "best", "near", "with", "help", "looking", "want", "suggest", "recommend", "schools",
    "colleges", "programs", "like", "similar", "strong", "competitive", "academic", "research", "liberal",
    "division", "d3", "private", "public", "small", "large", "northeast", "south", "west", "midwest", "where",
    "should", "would", "could", "can", "what", "which", "how", "why", "when", "swim", "swimming", "get", "into",
    "for", "me", "my", "i",
]
INVERTED = r"(?i)^(.+?),\s*University\s+of(?:,\s*(.+))?$"


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def norm_key(c) -> Column:
    """Lower case letters and digits only."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]", ""), F.lit(""))


def norm_ws(c) -> Column:
    return F.lower(F.regexp_replace(_strip(col(c)), r"\s+", " "))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_query(c) -> Column:
    """Liberal form of a typed name: & and common short forms spelled out, punctuation gone."""
    s = F.replace(F.lower(_strip(col(c))), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, r"['’`\-\.]", "")
    s = F.regexp_replace(s, r"[^a-z0-9 ]", " ")
    for short, full in (("st", "saint"), ("univ", "university"), ("coll", "college")):
        s = F.regexp_replace(s, rf"\b{short}\b", full)
    return _strip(F.regexp_replace(s, r"\s+", " "))


def norm_name(c) -> Column:
    return _strip(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", ""), r"\s+", " "))


def tokens(normalized: Column, stop: list[str], min_len: int = 2) -> Column:
    parts = F.filter(F.split(normalized, " "), lambda t: (F.length(t) >= min_len))
    return F.array_except(F.array_distinct(parts), words(stop))


def name_tokens(c) -> Column:
    return tokens(norm_name(c), NAME_STOP)


def uninvert_name(c) -> Column:
    """`X, University of[, Y]` to `University of X [Y]`; other names unchanged."""
    s = col(c)
    base, rest = _strip(F.regexp_extract(s, INVERTED, 1)), _strip(F.regexp_extract(s, INVERTED, 2))
    natural = F.concat(F.lit("University of "), base, F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))
    return F.when(s.rlike(INVERTED), natural).otherwise(s)


def key_words(c) -> Column:
    """Punctuation-stripped lower-case tokens that identify the name."""
    bare = F.transform(F.split(_strip(col(c)), r"\s+"), lambda t: F.regexp_replace(t, r"^[.,;:'\"()\[\]]+|[.,;:'\"()\[\]]+$", ""))
    long = F.filter(bare, lambda t: F.length(t) > 1)
    return F.filter(F.transform(long, lambda t: F.lower(t)), lambda t: ~F.array_contains(words(KEY_STOP), t))


def undouble_name(c) -> Column:
    """A word list that repeats itself becomes one copy; else a repeated leading run does."""
    s = col(c)
    p = F.split(_strip(s), r"\s+")
    n = F.size(p)
    halves = F.filter(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), lambda h: (
        (n % h == 0) & (F.slice(p, F.lit(1), h) == F.slice(p, n - h + 1, h))))
    lead = F.filter(F.sequence(F.floor(n / 2).cast("int"), F.lit(1)), lambda h: (
        F.slice(p, F.lit(1), h) == F.slice(p, h + 1, h)))
    h1, h2 = F.get(halves, F.lit(0)), F.get(lead, F.lit(0))
    return (
        F.when(n < 2, s)
        .when(h1.isNotNull(), F.array_join(F.slice(p, F.lit(1), n - h1), " "))
        .when(h2.isNotNull(), F.array_join(F.slice(p, F.lit(1), h2), " "))
        .otherwise(s)
    )


# fixed values: state codes and names
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan",
    "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas",
    "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming",
}


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def state_code(location) -> Column:
    """Text after the last ', ', empty when there is none."""
    loc = F.coalesce(col(location), F.lit(""))
    return F.when(F.contains(loc, F.lit(", ")), F.trim(F.substring_index(loc, ", ", -1))).otherwise("")


def city(location) -> Column:
    return F.trim(F.substring_index(F.coalesce(col(location), F.lit("")), ",", 1))


def state_name(location) -> Column:
    loc = F.coalesce(col(location), F.lit(""))
    code = F.when(F.contains(loc, F.lit(",")), F.upper(F.trim(F.substring_index(loc, ",", -1))))
    return F.coalesce(F.try_element_at(literal_map(STATES), code), F.lit(""))


def search_surface(name, location) -> Column:
    """Normalized name, location and full state name in one searchable text."""
    loc = F.coalesce(col(location), F.lit(""))
    place = F.when(loc != "", norm_query(F.regexp_replace(loc, "[,.]", " ")))
    full = state_name(loc)
    return F.concat_ws(" ", norm_query(name), place, F.when(full != "", norm_query(full)))


def looks_like_name(c) -> Column:
    low = F.lower(col(c))
    parts = F.filter(F.split(_strip(low), r"\s+"), lambda t: t != "")
    return F.size(parts).between(1, 5) & ~F.arrays_overlap(parts, words(NOT_A_NAME)) & ~F.endswith(low, F.lit("?"))
