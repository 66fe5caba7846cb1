"""Text normalisation, hashes, URLs, publishers and coded text reasons, as column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Literals that mean a missing value.
MISSING = ("", "nan", "none", "null", "n/a", "na")

# Pages that are no article, in order of precedence.
PAGE_REASONS = (
    ("access_denied_page", r"\baccess denied\b|\bcloudflare\b.*\brestrict access\b"),
    ("forbidden_page", r"^\W*403 forbidden\b"),
    ("login_or_signup_page", r"\blog in or sign up to view\b|\byou must log in to continue\b"),
    ("javascript_disabled_page", r"\bjavascript is disabled in your browser\b|\bproceed to legacy twitter\b|\bmake sure your browser supports javascript and cookies\b"),
    ("bare_platform_page", r"^\W*(facebook|twitter|instagram|youtube)\W*$"),
)

# Terms that give an outcome away.
OUTCOME_TERMS = (
    r"\bfake\b",
    r"\breal\b",
    r"\bfalse\b",
    r"\btrue\b",
    r"\bmisleading\b",
    r"\brating\b",
    r"\bhealthnewsreview\b",
    r"\bnews source\b",
    r"\bpress release\b",
    r"\baccess denied\b",
    r"\b403 forbidden\b",
    r"\blog in or sign up\b",
)

# Further terms that mark a feature as an artefact.
ARTIFACT_TERMS = OUTCOME_TERMS + (
    r"\bfacebook\b",
    r"\btwitter\b",
    r"\binstagram\b",
    r"\byoutube\b",
    r"\bcloudflare\b",
    r"\bjavascript\b",
    r"\bsource\b",
    r"\bartifact\b",
    r"\burl\b",
)

# Terms that masking removes.
MASKED_TERMS = (
    r"\b(?:facebook|twitter|instagram|youtube|healthnewsreview)\b",
    r"\b(?:fake|real|false|true|misleading)\b",
    r"\b(?:news source|news release|press release)\b",
)
# Words of a source name that masking leaves.
MASK_KEEPS = ("news", "health", "medical")

# Public suffixes of two labels, and hosts of archives.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "com.au", "com.br", "com.cn", "com.sg", "co.nz", "co.za", "org.uk")
ARCHIVE_HOSTS = ("archive.org", "web.archive.org")

# Publisher names that mean one publisher, and names that mean none.
PUBLISHER_ALIASES = {
    "abc news": "abcnews",
    "abcnews go": "abcnews",
    "ap associated press": "ap",
    "health day": "healthday",
    "healthday news": "healthday",
    "healthdaynews": "healthday",
    "reuters health": "reuters",
    "reutershealth": "reuters",
    "associated press": "ap",
    "associated press ap": "ap",
    "the associated press": "ap",
    "cnn health": "cnn",
    "cbs news": "cbsnews",
    "cbsnews": "cbsnews",
    "centers for disease control and prevention": "cdc",
    "national institutes of health": "nih",
    "nih national institutes of health": "nih",
    "u s food and drug administration": "fda",
    "us food and drug administration": "fda",
}
GENERIC_PUBLISHERS = ("https web archive", "https web archive org", "web archive", "web archive org")

# Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source")

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_ARCHIVED = r"(?i)https?://web\.archive\.org/web/(?:\d+|[a-z_]+)/(https?://.+)"


@F.arrow_udf(T.StringType())
def _decoded(text: pa.Array) -> pa.Array:
    """HTML entities and compatibility forms, for the rows that need it (others are null)."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", html.unescape(t)) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _decoded_if_odd(text: pa.Array) -> pa.Array:
    """As ``_decoded``, for all rows: ASCII text without ``&`` comes back as it is."""
    odd = pc.or_(pc.invert(pc.string_is_ascii(text)), pc.match_substring(text, "&"))
    return pc.replace_with_mask(text, odd, pa.array([unicodedata.normalize("NFKC", html.unescape(t)) for t in text.filter(odd).to_pylist()], text.type))


@F.arrow_udf(T.StringType())
def _without_marks(text: pa.Array) -> pa.Array:
    """Decomposed by compatibility, less combining marks; ASCII text comes back as it is."""
    odd = pc.invert(pc.string_is_ascii(text))
    bare = ["".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in text.filter(pc.fill_null(odd, False)).to_pylist()]
    return pc.replace_with_mask(text, pc.fill_null(odd, False), pa.array(bare, text.type))


def strip_accents(c: Column) -> Column:
    return _without_marks(c)


def _tidy(c: Column) -> Column:
    c = F.translate(c, "​﻿", "")
    c = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit(" ")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(F.lower(c).isin(*MISSING), F.lit("")).otherwise(F.trim(F.regexp_replace(c, _SPACE, " ")))


def clean_text(c: Column | str) -> Column:
    """Decoded, normalised text with single spaces; null and literals for missing give ''.

    ASCII text without ``&`` never leaves the JVM.
    """
    raw = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    odd = raw.rlike(r"[^\x00-\x7F]|&")
    return _tidy(F.when(odd, _decoded(F.when(odd, raw))).otherwise(raw))


def clean_made(c: Column) -> Column:
    """``clean_text`` of a value that costs much to make.

    What goes into a Python function is made once for it, and again for all
    that stands beside it; here nothing does.
    """
    return _tidy(_decoded_if_odd(F.coalesce(c, F.lit(""))))


def join_text(*parts: Column | str) -> Column:
    """Cleaned parts that are not blank, joined by a space and cleaned once more."""
    cleaned = F.array(*[clean_text(p) for p in parts])
    return clean_text(F.array_join(F.filter(cleaned, lambda x: x != ""), " "))


def simple_normalized(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of text that is clean already."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalized_text(c: Column | str) -> Column:
    return simple_normalized(clean_text(c))


def short_sha1(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def normalized_text_hash(c: Column | str) -> Column:
    return short_sha1(normalized_text(c))


def stable_id(*parts: Column | str, prefix: str = "rec", clean: bool = True) -> Column:
    """prefix_ and 16 hex digits of the SHA-1 of the cleaned parts, blanks kept."""
    cols = [clean_text(p) if clean else p for p in parts]
    return F.concat(F.lit(prefix + "_"), short_sha1(F.concat_ws("||", *cols)))


def seeded_hash(seed: int, stratum: Column | str, value: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), stratum, value).cast("binary"), 256)


def with_scheme(url: Column) -> Column:
    return F.when(url == "", "").when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def netloc(url: Column) -> Column:
    """Lower-case host with port, of a cleaned URL, without a leading www."""
    host = F.lower(F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def domain_from_url(c: Column | str) -> Column:
    return netloc(clean_text(c))


def unarchived(url: Column) -> Column:
    """The page behind a web archive's address."""
    return F.when(url.rlike(_ARCHIVED), F.regexp_extract(url, _ARCHIVED, 1)).otherwise(url)


@F.arrow_udf(T.StringType())
def _recoded(query: pa.Array) -> pa.Array:
    """Sorted, re-encoded query without tracking parameters (for queries that hold escapes)."""
    out = []
    for q in query.to_pylist():
        pairs = None if q is None else sorted((k, v) for k, v in parse_qsl(q, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING)
        out.append(None if pairs is None else urlencode(pairs))
    return pa.array(out, pa.string())


def canonical_article_url(c: Column | str) -> Column:
    """One key for the addresses of one page; '' where host or path is missing."""
    url = with_scheme(unarchived(clean_text(c)))
    host = netloc(url)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(rest, "/+", "/"), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    plain = query.rlike(r"^[A-Za-z0-9_.\-=&]*$") & ~query.rlike(r"(^|&)[^=&]*(&|$)") & ~query.rlike(r"=[^&]*=")
    names = F.split(query, "&")
    kept = F.filter(names, lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.split(F.lower(p), "=")[0].isin(*TRACKING))
    kept = F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(F.split(p, "=")[0].alias("k"), F.split(p, "=")[1].alias("v")))), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    query = F.when(query == "", "").when(plain, F.array_join(kept, "&")).otherwise(_recoded(F.when(~plain, query)))
    whole = F.concat(F.lit("https://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((host == "") | (path == ""), "").otherwise(whole)


def registrable_domain(c: Column | str) -> Column:
    """Last two labels of the host, three under a two-label suffix; '' for archives."""
    host = F.regexp_replace(netloc(unarchived(clean_text(c))), ":.*$", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when((host == "") | host.isin(*ARCHIVE_HOSTS), "").when(n <= 2, host).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def normalize_publisher_name(c: Column | str) -> Column:
    """Publisher key: address boilerplate, leading article, endings and legal forms dropped, aliases applied."""
    raw = clean_text(c)
    name = simple_normalized(raw)
    address = F.regexp_replace(F.regexp_replace(name, r"^(?:https?|ftp)\s+(?:www\s+)?", ""), r"^www\s+", "")
    name = F.when(raw.rlike(r"(?i)^(?:(?:https?|ftp)://|www\.)"), address).otherwise(name)
    name = F.regexp_replace(F.regexp_replace(name, r"^the\s+", ""), r"\s+(?:com|org|net)$", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\b(?:incorporated|corporation|company|limited|llc|inc|corp|ltd)\b", " "), r"\s+", " "))
    alias = F.create_map(*[F.lit(x) for kv in PUBLISHER_ALIASES.items() for x in kv])
    name = F.coalesce(F.try_element_at(alias, name), name)
    return F.when(name.isin(*GENERIC_PUBLISHERS), "").otherwise(name)


def content_exclusion_reason(c: Column | str) -> Column:
    """Coded reason why a text is no article, or ''."""
    value = clean_text(c)
    return simple_exclusion_reason(value)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def simple_exclusion_reason(value: Column) -> Column:
    def seen(v: Column) -> Column:
        return bound(simple_normalized(v), lambda n: F.struct(F.substring(v, 1, 800).alias("head"), F.when(n == "", 0).otherwise(F.size(F.split(n, " "))).alias("words"), F.length(F.replace(n, F.lit(" "), F.lit(""))).alias("letters")))

    def reason(s: Column) -> Column:
        out = F.when(s["letters"] < 10, "near_empty_text")
        for name, pattern in PAGE_REASONS:
            out = out.when((s["words"] <= 250) & s["head"].rlike("(?iU)" + pattern), name)
        return out.otherwise("")

    return bound(bound(value, seen), reason)


def count_terms(c: Column, patterns: tuple[str, ...] = OUTCOME_TERMS) -> Column:
    """Matches of all patterns together, letter case ignored."""
    value = F.coalesce(c, F.lit(""))
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(value, F.lit("(?iU)" + p))
    return total


def is_artifact_feature(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?iU)" + "|".join(ARTIFACT_TERMS))


def mask_artifacts(text: Column | str, source: Column | str | None = None) -> Column:
    """Text without addresses, source names and give-away terms; the source's words form a pattern of the row."""
    masked = F.regexp_replace(clean_text(text), r"(?i)https?://\S+|www\.\S+", " ")
    if source is not None:
        name = clean_text(source)
        long_words = F.filter(F.split(name, "[^a-zA-Z0-9]+"), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*MASK_KEEPS))
        tokens = F.filter(F.array_distinct(F.concat(F.array(name, F.replace(name, F.lit("."), F.lit(" "))), long_words)), lambda w: w != "")
        tokens = F.reverse(F.array_sort(F.transform(tokens, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
        # one pass a token, the longest first; the name leads, as few places hold it, and what stands before it is looked at after
        masked = F.aggregate(tokens, masked, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\Q"), t["w"], F.lit(r"\E(?<![a-z0-9]\Q"), t["w"], F.lit(r"\E)(?![a-z0-9])")), F.lit(" ")))
    for p in MASKED_TERMS:
        masked = F.regexp_replace(masked, "(?iU)" + p, " ")
    return clean_made(masked)


def word_count_unicode(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\b[\w'-]+\b"))


def token_count(c: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_count(F.lower(c), F.lit(r"(?U)\b\w\w+\b"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def latin_fraction(c: Column) -> Column:
    """Share of a-z among letters (0 if there is none)."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when(letters == 0, 0.0).otherwise(latin / letters)


def unicode_replacement_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("�"))


def parse_alternate_urls(c: Column) -> Column:
    """A JSON list of addresses, else a list divided by bars."""
    text = F.coalesce(c, F.lit(""))
    listed = F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<string>")
    scalar = F.from_json(F.when(text.rlike(r'^\s*"'), F.concat(F.lit("["), text, F.lit("]"))), "array<string>")
    return F.filter(F.coalesce(listed, scalar, F.split(text, r"\|")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


# Zones as offsets.
ZONES = (("PDT", "-0700"), ("PST", "-0800"), ("EDT", "-0400"), ("EST", "-0500"), ("CDT", "-0500"), ("CST", "-0600"))
#: Formats that free text may have; anything else is no date.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssZ", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy, h:mm a Z", "MMMM d, yyyy h:mm a Z")


def publication_time(c: Column) -> Column:
    """Timestamp of epoch seconds, epoch milliseconds or a date in a declared format; null otherwise."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    free = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\bat\b", " "), r"\s+", " "))
    for zone, offset in ZONES:
        free = F.regexp_replace(free, rf"\b{zone}\b", offset)
    tries = [F.try_to_timestamp(F.when(number.isNull() & (free != ""), free), F.lit(f)) for f in DATE_FORMATS]
    seconds = F.when(number.between(1e8, 2e10), F.timestamp_seconds(number.cast("long")))
    millis = F.when(number.between(1e11, 2e13), F.timestamp_millis(number.cast("long")))
    t = F.coalesce(seconds, millis, *tries)
    return F.when(F.year(t).between(1678, 2261), t)


def normalize_date(c: Column) -> Column:
    return F.coalesce(F.date_format(publication_time(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def parse_study_date(publication: Column, collection: Column) -> Column:
    """The publication date, else the collection date (month-day-year)."""
    return F.coalesce(F.try_to_timestamp(F.nullif(publication, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(F.nullif(collection, F.lit("")), F.lit("MM-dd-yyyy")))


def descriptor_signature(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def normalized_enum(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def assign_publisher_ids(df):
    """``df`` with source_name_normalized, source_domain and publisher_id.

    Where the first source of a dataset (``url_named``) names its items after
    addresses, the registrable domain identifies the publisher, else the name,
    else the domain; blank if there is neither. Names are never merged through
    a shared host.
    """
    name, domain = normalize_publisher_name("source_name"), registrable_domain("url")
    df = df.withColumn("source_name_normalized", name).withColumn("source_domain", domain)
    by_domain = F.when(F.col("source_domain") != "", F.concat(F.lit("domain:"), "source_domain"))
    by_name = F.when(F.col("source_name_normalized") != "", F.concat(F.lit("name:"), "source_name_normalized"))
    identity = F.when(F.col("url_named"), by_domain).otherwise(F.coalesce(by_name, by_domain))
    return df.withColumn("publisher_id", F.when(identity.isNull(), "").otherwise(stable_id(F.col("dataset"), identity, prefix="publisher", clean=False)))

