"""Query intent, regions and sort keys for columns of query texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .admission import lookup
from .names import state_code
from .numeric import col

# fixed values: phrases of each intent
SWIM = ["swim", "pool", "stroke", "relay", "contribute", "compete", "make the team", "recruit", "roster",
        "athletic fit", "lineup", "cuts", "finals", "time trial", "team", "score", "in range", "fast enough",
        "fastest", "50 free", "100 free", "200 free", "500 free", "1000 free", "1650", "100 back", "200 back",
        "100 breast", "200 breast", "100 fly", "200 fly", "200 im", "400 im", "backstroke", "breaststroke",
        "butterfly", "individual medley", "distance swimmer", "sprinter", "swim fit", "event profile",
        "distance free"]
PERSONAL = ["for me", "for my", "help me", "find me", "my list", "my fit", "my shot", "my chance", "my best",
            "my options", "my realistic", "i should", "i can", "i could", "i want", "i need", "i have", "i would",
            "i'm", "i am", "am i", "can i", "could i", "would i", "should i", "i'd", "where should i", "where i",
            "recommend", "shot at", "have a shot", "have a chance", "a chance at", "chance of being",
            "realistically", "realistic", "able to", "good fit", "best fit", "right fit", "fit best", "in range",
            "my ", "like me", "recruitable", "pipe dream", "swim fit", "recruit me", "want me", "take me"]
REACH = ["dream school", "reach school", "long shot", "longshot", "unrealistic", "probably can't", "can't swim",
         "stretch school", "aspiration", "long-shot", "not fast enough", "too fast for", "too slow", "can't make",
         "wouldn't be competitive", "out of my league", "below roster level", "stop considering", "no shot",
         "have no shot", "wasting my time", "not competitive", "not in range", "too far out"]
HIGH_BAR = ["definitely get", "certain to get", "guaranteed", "can definitely", "easy to get", "safety",
            "sure thing", "will get in"]
STANDARD_BAR = ["get in", "get into", "admissible", "realistic", "where i can get", "i could get into",
                "can get into", "i can get in"]
PRESTIGE = ["hardest", "toughest", "most selective", "most prestigious", "most impressive", "highest ranked",
            "highest-ranked", "best ranked", "top ranked", "strongest academic", "strongest academics",
            "most academically", "smartest school", "smartest schools", "smartest college", "elite school",
            "elite schools", "elite college", "elite program", "most elite", "most academic", "academic school",
            "academic college", "best academic", "top academic", "highly selective", "high academic",
            "most well-known", "most well known", "best known", "ranked school", "ranked college",
            "ranked university"]
BROAD = ["all schools", "every school", "full list", "complete list", "all the schools", "every college",
         "all colleges"]
MORE = ["more schools", "more options", "show me more", "give me more"]
# fixed values: region keyword -> states, first hit wins
REGIONS = [
    ("west coast", ["CA", "OR", "WA"]),
    ("california", ["CA"]),
    ("pacific northwest", ["OR", "WA"]),
    ("southwest", ["CA", "AZ", "NM", "NV", "UT", "CO"]),
    ("mountain", ["CO", "UT", "WY", "ID", "MT", "NV", "AZ", "NM"]),
    ("new england", ["MA", "ME", "NH", "VT", "RI", "CT"]),
    ("northeast", ["NY", "NJ", "CT", "MA", "ME", "NH", "VT", "RI", "PA", "MD", "DE"]),
    ("east coast", ["NY", "NJ", "CT", "MA", "ME", "NH", "VT", "RI", "MD", "DE", "VA", "NC", "SC", "GA", "FL", "DC"]),
    ("southeast", ["VA", "NC", "SC", "GA", "FL", "TN", "AL", "MS", "LA", "AR", "KY", "WV"]),
    ("south", ["TX", "LA", "MS", "AL", "GA", "FL", "SC", "NC", "TN", "KY", "AR", "OK", "VA"]),
    ("texas", ["TX"]),
    ("midwest", ["OH", "IN", "IL", "MI", "WI", "MN", "IA", "MO", "ND", "SD", "NE", "KS"]),
    ("florida", ["FL"]),
    ("new york", ["NY"]),
]
# fixed values: phrase groups that choose a sort order, first hit wins
SORTS = [
    ("selective", ["prestig", "best school", "academic", "selective", "hardest", "toughest", "elite", "smartest",
                   "most impressive", "highest ranked", "highest-ranked", "strongest academic"]),
    ("stem", ["stem", "engineer", "tech", "med", "science"]),
    ("money", ["money", "cost", "afford", "save", "merit", "scholarship"]),
    ("strength", ["star", "podium", "win", "lead", "competi"]),
    ("social", ["fun", "social", "happy", "vibe", "culture"]),
    ("ivy", ["hidden ivy", "ivy"]),
    ("d1", ["d1", "division 1", "division one", "big school", "large"]),
    ("d3", ["d3", "division 3", "division iii", "small school", "small college"]),
]
# fixed values: label scores, strength of a conference tier without points, merit order
LABEL_SCORES = {
    "Very Strong Chance": 100,
    "Strong Chance": 80,
    "Realistic Shot": 60,
    "Possible": 40,
    "Major Reach": 15,
    "Moonshot": 5,
    "Moonshot — Apply for Fun": 2,
    "Unknown": 25,
}
TIER_PROXY = {"1A": 120, "1B": 95, "2": 70, "3": 45, "4": 20}
COMPOSITE_PROXY = {"1A": 130, "1B": 100, "2": 72, "3": 46, "4": 22}
MERIT_ORDER = {"high": 0, "moderate": 1, "none": 2}
SELECTIVITY_ORDER = {"ultra_selective": 0, "highly_selective": 1, "selective": 2, "broader_admit": 3}
TIER_ORDER = {"1A": 0, "1B": 1, "2": 2, "3": 3, "4": 4}
NOT_COMPETITIVE = ["Below Roster Level", "Not Competitive"]


def has_any(low: Column, phrases: list[str]) -> Column:
    """One alternation over all phrases, so a text is read once per intent."""
    escaped = [p.replace("(", r"\(").replace(")", r"\)").replace("?", r"\?") for p in dict.fromkeys(phrases)]
    return low.rlike("|".join(escaped))


def query_intent(c) -> Column:
    low = F.lower(col(c))
    personal = has_any(low, PERSONAL)
    return F.struct(
        personal.alias("is_personal"),
        has_any(low, SWIM).alias("is_swim"),
        has_any(low, REACH).alias("is_explicit_reach"),
        F.when(has_any(low, HIGH_BAR), 80).when(has_any(low, STANDARD_BAR), 60).alias("adm_threshold"),
        (personal & has_any(low, PRESTIGE)).alias("is_prestige_sort"),
    )


def is_broad_pool(intent: Column, c) -> Column:
    low = F.lower(col(c))
    return ((intent["is_prestige_sort"] | has_any(low, BROAD)) & intent["is_personal"] & intent["is_swim"]
            & ~intent["is_explicit_reach"])


def wants_more(c) -> Column:
    return has_any(F.lower(col(c)), MORE)


def region_of_query(c) -> Column:
    """States of the first region named; null when none is."""
    low, out = F.lower(col(c)), None
    for key, states in REGIONS:
        arr = F.array(*[F.lit(s) for s in states])
        cond = F.contains(low, F.lit(key))
        out = F.when(cond, arr) if out is None else out.when(cond, arr)
    return out


def sort_kind(c) -> Column:
    """Sort order a query asks for: region first, then the phrase groups, then plain strength."""
    low = F.lower(col(c))
    out = F.when(has_any(low, [k for k, _ in REGIONS]), "region")
    for kind, phrases in SORTS:
        out = out.when(has_any(low, phrases), kind)
    return out.otherwise("strength")


def label_score(label) -> Column:
    return lookup(col(label), LABEL_SCORES, 25)


def strength(adj_pts, tier_short) -> Column:
    pts = F.coalesce(col(adj_pts), F.lit(0.0))
    return F.when(pts > 0, pts).otherwise(lookup(col(tier_short), TIER_PROXY, 0).cast("double"))


def sort_keys(kind: Column, states: Column, location="location", accept="accept", stem="stem", merit="merit",
              hidden_ivy="hidden_ivy", ivy="ivy_league", division="division", adj_pts="adj_pts",
              tier_short="tier_short") -> tuple[Column, Column]:
    """Primary and secondary ascending keys of the order chosen per query."""
    s = strength(adj_pts, tier_short)
    flag = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 0.0).otherwise(1.0)
    acc = F.nullif(col(accept).cast("double"), F.lit(0.0))
    first = (
        F.when(kind == "region", flag(F.array_contains(states, state_code(location))))
        .when(kind == "selective", F.coalesce(acc, F.lit(999.0)))
        .when(kind == "stem", flag(col(stem)))
        .when(kind == "money", lookup(col(merit), MERIT_ORDER, 3).cast("double"))
        .when(kind == "social", -F.coalesce(acc, F.lit(0.0)))
        .when(kind == "ivy", flag(F.coalesce(col(hidden_ivy), F.lit(False)) | F.coalesce(col(ivy), F.lit(False))))
        .when(kind == "d1", flag(col(division) == "D1"))
        .when(kind == "d3", flag(col(division) == "D3"))
        .otherwise(-s)
    )
    second = F.when(kind.isin("region", "stem", "d1", "d3"), -s).otherwise(0.0)
    return first, second


def composite_rank(mode, label, adj_pts, has_swim, tier_short, accept) -> Column:
    """Weighted score: admission first for guided modes, program strength first otherwise."""
    pts = F.coalesce(col(adj_pts), F.lit(0.0))
    adm = label_score(label).cast("double")
    norm = lambda x: F.least(x / 130.0, F.lit(1.0)) * 100
    acc = F.coalesce(F.nullif(col(accept).cast("double"), F.lit(0.0)), F.lit(50.0))
    guided = adm * 0.60 + norm(F.greatest(pts, F.lit(0.0))) * 0.40 + F.least(acc / 100.0, F.lit(1.0)) * 3
    proxy = F.when(pts > 0, pts).otherwise(lookup(col(tier_short), COMPOSITE_PROXY, 0).cast("double"))
    return F.when(col(mode).isin("GUIDED", "CONSTRAINED"), guided).otherwise(norm(proxy) * 0.65 + adm * 0.35)


def filter_reasons(is_swim, is_reach, threshold, has_times, adj_tier, has_swim, label) -> Column:
    """Why a row contradicts a personal query; an empty array keeps it."""
    tier, has, need, lab = col(adj_tier), col(has_swim), col(threshold), col(label)
    swim = col(is_swim) & ~col(is_reach)
    reason = (
        F.when(~has, "no swim data")
        .when((F.coalesce(tier, F.lit("")) == "") & col(has_times), "no scorable events at this school")
        .when(tier.isin(NOT_COMPETITIVE), F.concat(F.lit("not competitive — "), tier))
    )
    needed = F.when(need >= 80, "Strong Chance").otherwise("Realistic Shot")
    below = F.concat(F.lit("below threshold ("), lab, F.lit(", need "), needed, F.lit("+)"))
    return F.array_compact(F.array(F.when(swim, reason), F.when(label_score(lab) < need, below)))


def fit_label(first, second, excluded: list[str] = ["Unknown", ""]) -> Column:
    """Up to two labels that say something, joined."""
    keep = F.filter(F.array(col(first), col(second)), lambda x: x.isNotNull() & ~x.isin(excluded))
    return F.array_join(F.slice(keep, 1, 2), " · ")
