"""Image candidates: url tests, additive scores, categories, confidence, labels, html extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .admission import lookup
from .names import key_words, uninvert_name
from .numeric import col

# fixed values: rejected extensions and url tokens
BAD_EXTENSIONS = [".svg", ".gif", ".bmp", ".tiff", ".tif", ".pdf", ".ico", ".webp"]
BAD_TOKENS = [
    "seal", "logo", "crest", "flag_of", "wordmark", "insignia", "monogram", "mascot", "badge", "shield", "patch",
    "_mark", "icon_", "favicon", "thumbnail", "sticker", "emblem", "sprite", "/button", "signature", "map",
    "locator", "county_", "state_map", "seal.", "coa.", "arms.", "placeholder", "spacer", "pixel.", "1x1", "blank.",
    "transparent.", "avatar", "gravatar", "generic-", "default-user", "default-photo", "ranking", "best-college",
    "best_college", "ranked-", "_ranked", "award-badge", "award_badge", "us-news", "usnews", "niche-badge",
    "college-ranking", "top-college", "top_college", "#1-", "no1-", "best-value", "best_value", "school-badge",
    "college-badge", "screenshot", "collage", "composite", "illustration", "infographic", "graphic_", "_graphic",
    "promo-graphic", "rendering", "architectural_rendering", "architectural-rendering", "_rendering.",
    "-rendering.", "render_", "concept_render", "satellite_map", "satellite-map", "satellite_view",
    "satellite-view", "google_maps", "googlemaps", "streetview", "street-view", "document_scan", "document-scan",
    "docuscan", "scan_", "_scan.", "watermark_", "_watermark", "watermarked", "getty", "shutterstock", "alamy",
    "dreamstime", "istockphoto", "instagram-", "facebook-", "social-post", "twitter-", "ad-", "-ad.", "32x32",
    "64x64", "48x48", "16x16",
]
# fixed values: minimum size and the base score of each page type
MIN_WIDTH, MIN_HEIGHT = 800, 400
PAGE_SCORES = {"swim": 4.0, "visit": 3.0, "campus": 2.5, "athletics": 2.0, "home": 1.5, "general": 1.0}
# fixed values: token lists of the score
BOOST_IMAGE = ["campus", "facility", "pool", "aerial", "natatorium", "quad", "exterior", "architecture", "aquatic",
               "swim", "athletic", "field", "stadium", "arena", "building", "hall", "center", "view", "grounds",
               "courtyard", "clocktower", "chapel"]
PENALTY_IMAGE = ["headshot", "portrait", "staff_", "faculty_", "_profile", "graduation", "-grad-", "diploma",
                 "award", "handshake", "classroom", "lecture", "lab-student", "laptop", "smiling", "group-photo",
                 "team-photo", "promo_", "marketing_"]
BOOST_PAGE = ["visit", "campus", "about", "traditions", "landmarks", "student-life", "facilities", "aquatics",
              "natatorium", "swimming", "athletics", "swim", "aquatic"]
PENALTY_PAGE = ["support", "advising", "/diversity", "/profile", "/apply", "campaign", "/giving", "/news/",
                "/faculty", "/staff", "fundrais", "alumni/giving", "accessibility"]
HISTORICAL = ["_1800", "_1810", "_1820", "_1830", "_1840", "_1850", "_1860", "_1870", "_1880", "_1890", "_1900",
              "_1910", "_1920", "_1930", "_1940", "_1950", "1800s", "1900s", "1910s", "1920s", "1930s", "1940s",
              "1950s", "vintage", "historic_photo", "historical_photo", "archive_photo", "black_and_white",
              "_bw_photo", "sepia_"]
HISTORICAL_YEAR = r"(?<![0-9])(1[89]\d{2}|1[0-5]\d{2})(?![0-9])"
POOL_TOKENS = ["swim", "pool", "aquatic", "natator", "diving"]
STUDENT_URL_TOKENS = ["student-life", "student_life", "studentlife", "students_at", "campus-life", "campus_life",
                      "campuslife"]
STUDENT_CONTEXT = ["student", "campus life", "campus_life"]
STUDENT_BACKFILL = ["student", "campus-life", "campus_life", "campuslife", "student-life", "student_life",
                    "residence", "dorm", "union"]


def contains_any(text: Column, tokens: list[str]) -> Column:
    """One alternation over all tokens, so the text is evaluated once."""
    return text.rlike("|".join(re.escape(t) for t in dict.fromkeys(tokens)))


def count_tokens(text: Column, tokens: list[str]) -> Column:
    total = F.lit(0)
    for t in tokens:
        total = total + F.contains(text, F.lit(t)).cast("int")
    return total


def text_of(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def unquoted(c) -> Column:
    """Percent-decoded lower-case text; the raw text where decoding fails. A plus sign stays a plus sign."""
    raw = text_of(c)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))


def is_bad_url(url) -> Column:
    u = F.lower(text_of(url))
    ends = F.lit(False)
    for e in BAD_EXTENSIONS:
        ends = ends | F.endswith(u, F.lit(e))
    return ends | contains_any(u, BAD_TOKENS)


def image_score(url, alt, page_type, page_url, width, height, prominence) -> Column:
    """Additive score with hard rejects; never below zero."""
    w, h = F.coalesce(col(width), F.lit(0)), F.coalesce(col(height), F.lit(0))
    sized = (w > 0) & (h > 0)
    reject = is_bad_url(url) | (sized & ((w < MIN_WIDTH) | (h < MIN_HEIGHT) | (h > w * 1.15)))
    base = lookup(col(page_type), PAGE_SCORES, 1.0)
    shown = F.coalesce(col(prominence), F.lit(0))
    lead = F.when(shown > 0, F.least(shown * 0.5, F.lit(4.0))).otherwise(0.0)
    area = F.when(sized, F.least(w.cast("double") * h / 1500000.0, F.lit(2.5))).otherwise(0.0)
    ratio = F.try_divide(w.cast("double"), F.nullif(h, F.lit(0)).cast("double"))
    shape = F.when(sized & (ratio >= 1.7), 1.2).when(sized & (ratio >= 1.3), 0.6).otherwise(0.0)
    words = F.concat(F.translate(F.lower(text_of(url)), "/-_", "   "), F.lit(" "), F.lower(text_of(alt)))
    file, page = unquoted(url), F.lower(text_of(page_url))
    old = contains_any(file, HISTORICAL) | file.rlike(HISTORICAL_YEAR)
    score = (
        base + lead + area + shape + count_tokens(words, BOOST_IMAGE) * 0.4 - count_tokens(words, PENALTY_IMAGE) * 1.0
        - F.when(old, 4.0).otherwise(0.0) + count_tokens(page, BOOST_PAGE) * 0.3 - count_tokens(page, PENALTY_PAGE) * 0.6
    )
    return F.when(reject, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


# ---- weight-table variants -------------------------------------------------------------------------------

# fixed values: keyword lists of the slot scores
HERO_PLUS = ["campus", "aerial", "quad", "grounds", "courtyard", "panoram", "entrance", "lawn", "building", "hall",
             "chapel", "library", "tower", "center", "science", "view", "arch", "fountain", "gateway", "green",
             "exterior", "academic"]
HERO_MINUS = ["portrait", "headshot", "rally", "protest", "game", "stadium", "pool", "swim", "athlete", "jersey",
              "locker"]
STUDENT_PLUS = ["student", "students", "class", "lecture", "graduation", "commencement", "activity", "club",
                "dining", "reading", "study", "campus-life", "residential", "community", "people", "life", "engage",
                "experience", "collaborate"]
STUDENT_MINUS = ["aerial", "exterior", "tower", "pool", "swim", "locker", "stadium", "stadium", "athlete"]
SWIM_STRONG = ["swim", "swimming", "diving", "swim-dive", "natator", "aquat", "aquatic", "pool", "championship-pool"]
SWIM_OK = ["athletic", "sport", "recreation", "fitness"]
SWIM_REJECT = ["football", "basketball", "baseball", "softball", "soccer", "lacrosse", "tennis", "volleyball",
               "hockey", "golf", "mascot", "jersey", "locker"]
# fixed values: scenic and penalised words of the anchor-term score
SCENIC_PLUS = ["campus", "aerial", "quad", "hall", "chapel", "library", "tower", "grounds", "exterior", "building",
               "panoram", "view", "autumn", "fall", "spring", "winter", "mountain"]
SCENIC_MINUS = ["portrait", "headshot", "game", "student", "classroom", "graduation", "ceremony", "stadium",
                "athletic"]
# fixed values: words and source points of the source-priority score
REPAIR_PLUS = ["campus", "quad", "hall", "chapel", "library", "exterior", "building", "view", "arboretum", "aerial"]
REPAIR_MINUS = ["student", "graduation", "ceremony", "game", "event", "athlete", "pool", "team", "portrait",
                "indoor", "classroom"]
SOURCE_POINTS = {"official_og": 15, "official": 12, "wikimedia": 4, "wikipedia": 2}


def keyword_score(text: Column, plus: list[str], minus: list[str], gain: int = 6, loss: int = 5) -> Column:
    low = F.lower(text)
    return count_tokens(low, plus) * gain - count_tokens(low, minus) * loss


def _page_points(page_type, table: dict[str, int], default: int = 0) -> Column:
    return lookup(col(page_type), table, default)


def slot_score(slot: str, text: Column, page_type, from_og, page_url=None) -> Column:
    """Score of a candidate for one slot: hero, student_life or swim."""
    if slot == "swim":
        low = F.lower(F.concat_ws(" ", text, col(page_url)) if page_url is not None else text)
        s = (F.when(contains_any(low, SWIM_STRONG), 20).otherwise(0) + F.when(contains_any(low, SWIM_OK), 5).otherwise(0)
             + _page_points(page_type, {"swim": 15, "athletics": 3}, -15))
        return F.when(contains_any(low, SWIM_REJECT), -50).otherwise(s)
    if slot == "hero":
        pts = {"homepage": 8, "admissions": 8, "student_life": 4, "athletics": -10, "swim": -10}
        s = keyword_score(text, HERO_PLUS, HERO_MINUS) + _page_points(page_type, pts)
    else:
        pts = {"student_life": 10, "admissions": 5, "homepage": 2, "athletics": -10, "swim": -10}
        s = keyword_score(text, STUDENT_PLUS, STUDENT_MINUS) + _page_points(page_type, pts)
    return F.when(F.coalesce(col(from_og), F.lit(False)), -10).otherwise(s)


def megapixel_score(width, height, url, host, prefer_edu: bool = True) -> Column:
    """Megapixels plus a bonus for an .edu host; zero when rejected or too small."""
    w, h = col(width), col(height)
    bonus = F.when(F.contains(text_of(host), F.lit(".edu")), 2.0).otherwise(0.0) if prefer_edu else F.lit(0.0)
    ok = ~is_bad_url(url) & (w >= MIN_WIDTH) & (h >= MIN_HEIGHT)
    return F.when(ok, w.cast("double") * h / 1000000.0 + bonus).otherwise(0.0)


def _size_points(w: Column, h: Column, steps: list[tuple[int, int]]) -> Column:
    width = F.lit(0)
    for limit, pts in sorted(steps):
        width = F.when(w >= limit, pts).otherwise(width)
    return width + F.when((w > 0) & (h > 0) & (w > h), 5).otherwise(0)


def _per_term(text: Column, terms: Column, points: int) -> Column:
    hits = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (t != "") & F.contains(text, t))
    return F.size(hits) * points


def anchor_term_score(text: Column, anchor_terms: Column, name_tokens: Column, width, height) -> Column:
    low, w, h = F.lower(text), F.coalesce(col(width), F.lit(0)), F.coalesce(col(height), F.lit(0))
    return (_per_term(low, anchor_terms, 12) + _per_term(low, name_tokens, 6)
            + _size_points(w, h, [(1200, 8), (800, 4)]) + keyword_score(low, SCENIC_PLUS, SCENIC_MINUS, 4, 5))


def source_priority_score(text: Column, source, preferred: Column, width, height) -> Column:
    low, w, h = F.lower(text), F.coalesce(col(width), F.lit(0)), F.coalesce(col(height), F.lit(0))
    return (_page_points(source, SOURCE_POINTS) + _per_term(low, preferred, 10)
            + _size_points(w, h, [(1200, 8), (800, 5), (600, 2)]) + keyword_score(low, REPAIR_PLUS, REPAIR_MINUS, 3, 4))


# ---- categories and evidence -----------------------------------------------------------------------------


def assign_category(page_type, url, page_url, alt, context) -> Column:
    u, p = unquoted(url), unquoted(page_url)
    a, x = F.lower(text_of(alt)), F.lower(text_of(context))
    url_pool = [*POOL_TOKENS, "aquatics"]
    pool = ((col(page_type) == "swim") | contains_any(u, url_pool) | contains_any(p, url_pool)
            | contains_any(a, POOL_TOKENS) | contains_any(x, POOL_TOKENS))
    student = (col(page_type) == "student_life") | contains_any(x, STUDENT_CONTEXT)
    for t in (u, p, a):
        student = student | contains_any(t, STUDENT_URL_TOKENS)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(pool), "pool").when(yes(student), "student_life").otherwise("campus")


def backfill_category(category, page_type, url, context) -> Column:
    """Category only where it is missing, by the simpler rule."""
    u, x = F.lower(text_of(url)), F.lower(text_of(context))
    yes = lambda c: F.coalesce(c, F.lit(False))
    derived = (
        F.when(yes(col(page_type) == "swim") | contains_any(u, POOL_TOKENS), "pool")
        .when(yes(col(page_type) == "student_life") | contains_any(u, STUDENT_BACKFILL)
              | contains_any(x, STUDENT_CONTEXT), "student_life").otherwise("campus")
    )
    return F.coalesce(col(category), derived)


def name_words(name) -> Column:
    return key_words(uninvert_name(name))


def pool_confidence(page_type, url, page_url, alt, context, name) -> Column:
    """Weighted evidence, at most one, that an image shows the entity's own pool."""
    u, p = unquoted(url), unquoted(page_url)
    a, x = F.lower(text_of(alt)), F.lower(text_of(context))
    pts = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0.0)
    kw = name_words(name)
    all_text = F.concat_ws(" ", u, p, a, x)
    found = F.size(F.filter(kw, lambda k: F.contains(all_text, k)))
    share = F.when(F.size(kw) > 0, 0.4 * (found / F.size(kw))).otherwise(0.0)
    total = (pts(col(page_type) == "swim", 0.5) + pts(contains_any(u, POOL_TOKENS), 0.2)
             + pts(contains_any(a, POOL_TOKENS), 0.15) + pts(contains_any(p, POOL_TOKENS), 0.15) + share
             + pts(F.contains(x, F.lit("site:")), 0.25))
    return F.least(total, F.lit(1.0))


FACILITY = (r"(?i)([\w\s]+(natatorium|aquatic\s+center|aquatic\s+centre|swim\s+complex|pool\s+complex|"
            r"pool\s+facility)[\w\s]*)")


def attribution_label(page_url, alt, context, source) -> Column:
    """Host or source name, then the facility name or a short alt text."""
    page, a = text_of(page_url), F.trim(text_of(alt))
    host = F.replace(F.lower(F.coalesce(F.try_parse_url(page, F.lit("HOST")), F.lit(""))), F.lit("www."), F.lit(""))
    first = (F.when(page != "", host).when(F.contains(text_of(source), F.lit("wiki_commons")), "Wikimedia Commons")
             .when(F.contains(text_of(source), F.lit("google_cse")), "Google Images").otherwise(""))
    facility = F.substring(F.trim(F.regexp_extract(F.concat_ws(" ", a, text_of(context)), FACILITY, 1)), 1, 60)
    second = F.when(facility != "", facility).when((a != "") & (F.length(a) < 80), a).otherwise("")
    return F.array_join(F.filter(F.array(first, F.when(second != first, second)), lambda s: s.isNotNull() & (s != "")), " · ")


def mentions_name(name, *texts) -> Column:
    """Any key word of the name occurs; a name without key words always passes."""
    low = F.lower(F.concat_ws(" ", *[text_of(t) for t in texts]))
    kw = name_words(name)
    return (F.size(kw) == 0) | F.exists(kw, lambda k: F.contains(low, k))


def file_matches_name(name, url) -> Column:
    """All key words of the name occur in the decoded file name."""
    file = F.translate(unquoted(F.substring_index(text_of(url), "/", -1)), "_-", "  ")
    return F.forall(name_words(name), lambda k: F.contains(file, k))


def source_adjust(score, source_kind, mentioned: Column) -> Column:
    """+1.5 for the entity's own site; without the name -1.0 for web search and half for encyclopedias."""
    s = F.coalesce(col(score), F.lit(2.0))
    return (F.when(col(source_kind) == "site", s + 1.5)
            .when((col(source_kind) == "search") & ~mentioned, s - 1.0)
            .when((col(source_kind) == "wiki") & ~mentioned, s * 0.5).otherwise(s))


JUNK = (r"(?i)logo|seal|flag|map|icon|coat|shield|wordmark|crest|badge|insignia|monogram|mascot|patch|\.gif|svg|"
        r"avatar|thumb(?!nail)|placeholder|spinner|blank|social|twitter|facebook|instagram|linkedin|youtube|"
        r"portrait|headshot|locator|chart|graphic|lockup|tile[-_]|bullet|question|default|vector|signature|letterhead")
OLD_PHOTO = (r"(?i)\b(ca\.?\s*1[5-9]\d\d|1[5-9]\d\d|18\d\d|190\d|191\d|192\d|histor|archiv|vintage|antique|sepia|"
             r"black.?white|b&w|bw_)\b")


def reject_reason(url, alt, width, source, must_tokens: Column, used: Column) -> Column:
    """First reason a candidate is unusable; null keeps it."""
    u, a = F.lower(text_of(url)), F.lower(text_of(alt))
    file = F.substring_index(u, "/", -1)
    ext = F.when(F.contains(file, F.lit(".")), F.substring_index(file, ".", -1)).otherwise("")
    text = F.concat_ws(" ", file, a, u)
    w = F.coalesce(col(width), F.lit(0))
    named = (F.size(must_tokens) == 0) | F.exists(must_tokens, lambda t: F.contains(text, t))
    return (
        F.when(used, "already used by another school")
        .when(ext.isin("svg", "gif", "ico"), F.concat(F.lit("bad extension: "), ext))
        .when((ext != "") & ~ext.isin("jpg", "jpeg", "png", "webp"), F.concat(F.lit("unsupported extension: "), ext))
        .when(text.rlike(JUNK), "junk/logo pattern")
        .when(file.rlike(OLD_PHOTO) | a.rlike(OLD_PHOTO), "historical/B&W (year token in filename/alt)")
        .when((w > 0) & (w < 500), F.concat(F.lit("too small: "), w.cast("string"), F.lit("px wide")))
        .when(col(source).isin("wikimedia", "wikipedia") & ~named, "no school name match")
    )


# ---- html ------------------------------------------------------------------------------------------------


def best_srcset(srcset) -> Column:
    """Struct(url, w) of the widest `Nw` entry (first on ties); the first bare url when no width is given."""
    parts = F.transform(F.split(text_of(srcset), ","), lambda p: F.split(F.trim(p), r"\s+"))
    parts = F.filter(parts, lambda p: F.get(p, F.lit(0)) != "")
    sized = F.filter(parts, lambda p: F.get(p, F.lit(1)).rlike(r"^\d+w$"))
    widths = F.transform(sized, lambda p: F.struct(
        F.regexp_replace(F.get(p, F.lit(1)), "w$", "").try_cast("int").alias("w"), F.get(p, F.lit(0)).alias("url")))
    top = F.array_max(F.transform(widths, lambda s: s["w"]))
    widest = F.get(F.filter(widths, lambda s: (s["w"] == top) & (s["w"] > 0)), F.lit(0))
    bare = F.get(F.get(F.filter(parts, lambda p: F.size(p) == 1), F.lit(0)), F.lit(0))
    return F.struct(
        F.coalesce(widest["url"], bare).alias("url"),
        F.coalesce(widest["w"], F.when(bare.isNotNull(), 0)).alias("w"),
    )


def resolve_url(raw, base, drop_query: bool = False) -> Column:
    """Absolute form of a link found on page `base`."""
    r, b = F.trim(text_of(raw)), text_of(base)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.substr(b, F.length(origin) + 1), r"[?#].*$", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    own, rest = F.regexp_extract(r, r"^[^?#]*", 0), F.regexp_extract(r, r"[?#].*$", 0)
    steps = F.split(F.substr(F.concat(folder, own), F.lit(2)), "/")
    at_end = F.get(F.reverse(steps), F.lit(0)).isin(".", "..")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(at_end & (F.size(kept) > 0), "/").otherwise(""), rest)
    out = (
        F.when(r == "", b)
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
        .when(F.startswith(r, F.lit("//")), F.concat(scheme, F.lit(":"), r))
        .when(F.startswith(r, F.lit("/")), F.concat(origin, r))
        .when(F.startswith(r, F.lit("?")), F.concat(origin, path, r))
        .when(F.startswith(r, F.lit("#")), F.concat(F.regexp_replace(b, "#.*$", ""), r))
        .otherwise(F.concat(origin, joined))
    )
    return F.substring_index(out, "?", 1) if drop_query else out


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside a tag text, empty when absent."""
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s>\"']+)", 1)
    return F.when(quoted != "", quoted).when(single != "", single).otherwise(bare)


def unescape(c: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


SKIPPED_BLOCKS = r"(?is)<(script|style|noscript|nav|footer|header)\b[^>]*>.*?</\1\s*>"
LAZY_SOURCES = ["src", "data-src", "data-lazy-src", "data-original", "data-lazy"]


def first_given(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def extract_images(df, html: str = "html", page_url: str = "url"):
    """One row per image of every page: meta images first (prominence 10), then body images in page order with
    a prominence for the first four. Blocks of navigation and script are skipped; within a page a url counts once."""
    h, base = F.col(html), F.col(page_url)
    meta_tags = F.regexp_extract_all(h, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    is_image = lambda t: (
        F.lower(attribute(t, "property")).isin("og:image", "og:image:secure_url")
        | F.lower(attribute(t, "name")).isin("twitter:image", "twitter:image:src"))
    metas = F.transform(F.filter(meta_tags, is_image), lambda t: F.struct(
        F.lit(0).alias("position"), unescape(attribute(t, "content")).alias("raw"), F.lit("").alias("alt"),
        F.lit(1200).alias("width"), F.lit(630).alias("height"), F.lit(True).alias("from_meta")))
    body = F.regexp_replace(h, SKIPPED_BLOCKS, " ")
    tags = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:img|source)\b[^>]*>)"), F.lit(1))

    def image(t: Column, i: Column) -> Column:
        best = best_srcset(unescape(first_given([attribute(t, "srcset"), attribute(t, "data-srcset")])))
        raw = F.coalesce(best["url"], unescape(first_given([attribute(t, a) for a in LAZY_SOURCES])))
        size = lambda a: F.coalesce(attribute(t, a).try_cast("int"), F.lit(0))
        given = attribute(t, "width")
        valid = given.rlike(r"^(\d+)?$") & attribute(t, "height").rlike(r"^(\d+)?$")
        width = F.when((given == "") & (best["w"] > 0), best["w"]).otherwise(size("width"))
        return F.struct(
            (i + 1).alias("position"), raw.alias("raw"), unescape(attribute(t, "alt")).alias("alt"),
            F.when(valid, width).otherwise(0).alias("width"), F.when(valid, size("height")).otherwise(0).alias("height"),
            F.lit(False).alias("from_meta"))

    usable = lambda s: (s["raw"] != "") & ~F.startswith(s["raw"], F.lit("data:"))
    found = F.filter(F.transform(tags, image), usable)
    found = F.transform(found, lambda s, i: s.withField("position", i + 1))
    every = F.transform(F.concat(F.filter(metas, usable), found), lambda s: s.withField("url", resolve_url(s["raw"], base)))
    once = F.filter(every, lambda s, i: F.array_position(F.transform(every, lambda x: x["url"]), s["url"]) == i + 1)
    rows = df.select("*", F.posexplode(once).alias("_at", "_img"))
    pos, meta = F.col("_img.position"), F.col("_img.from_meta")
    rows = rows.select(
        *df.columns, "_at", F.col("_img.url").alias("image_url"), F.col("_img.alt").alias("alt"),
        F.col("_img.width").alias("width"), F.col("_img.height").alias("height"), meta.alias("from_meta"),
        F.when(meta, 10).when(pos <= 4, 5 - pos).otherwise(0).alias("prominence"),
    )
    return rows
