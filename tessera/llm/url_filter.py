"""URL filtering by host rules and a weighted vocabulary.

An Aho-Corasick automaton finds strict and soft terms in the lower-cased URL
in one pass; a hit counts only between boundaries (no letter or digit beside
it). One strict term, or soft terms of total weight 1 by distinct term,
reject. The vocabulary is a parameter: terms with weights, 1 or more for a
strict term, less for a soft one. Explicit rules by host and path prefix come first, the longest
winning.

Definite results: a null URL, or one without ``://``, has empty host and path
and no rule; the vocabulary still reads what text there is; repeated rows are
judged alike; further columns are ignored; an empty vocabulary allows all that
no rule blocks; an empty term is an error.
"""

from __future__ import annotations

import math
import string
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str


#: The rules of the query contract.
RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)
#: One hit rejects.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "casino", "viagra", "cialis", "warez", "malware", "phishing", "spam", "sex", "adult", "adults", "nsfw", "milf", "onlyfans", "slots", "jackpot", "sportsbook")
#: Each distinct hit counts half: two reject.
SOFT = ("free", "bet", "bets", "betting", "cheap", "pill", "pills", "pharmacy", "bonus", "win", "winner", "ads", "track", "tracker", "farm", "dating", "hot", "girls", "poker", "loan", "loans", "crypto", "download", "torrent", "crack", "click", "offer", "deal", "deals", "replica", "escort", "gambling", "lottery", "prize", "meds", "rx", "nude", "live", "cam", "cams", "singles", "viral")
WEIGHT = {**{t: 1.0 for t in STRICT}, **{t: 0.5 for t in SOFT}}
WORD = frozenset(string.ascii_lowercase + string.digits)


@lru_cache(maxsize=2)
def _automaton(vocabulary: tuple[tuple[str, float], ...]):
    a = ahocorasick.Automaton()
    for term, w in vocabulary:
        a.add_word(term, (term, w))
    a.make_automaton()
    return a


def _entries(vocabulary: Mapping[str, float]) -> tuple[tuple[str, float], ...]:
    """Lower-cased terms with their weights, sorted; of terms that fall together the greater weight counts."""
    out: dict[str, float] = {}
    for term, w in vocabulary.items():
        if not term:
            raise ValueError("a term must not be empty")
        out[term.lower()] = max(w, out.get(term.lower(), w))
    return tuple(sorted(out.items()))


def weight(url: str | None, entries: tuple[tuple[str, float], ...] = _entries(WEIGHT)) -> float:
    """Total weight of the distinct terms that stand between boundaries."""
    if not url or not entries:
        return 0.0
    u = url.lower()
    hits = {}
    for end, (term, w) in _automaton(entries).iter(u):
        start = end - len(term) + 1
        if (start == 0 or u[start - 1] not in WORD) and (end + 1 == len(u) or u[end + 1] not in WORD):
            hits[term] = w
    return math.fsum(hits.values())


def url_weight(url: Column, vocabulary: Mapping[str, float] = WEIGHT) -> Column:
    entries = _entries(vocabulary)

    @F.arrow_udf(T.DoubleType())
    def run(urls: pa.Array) -> pa.Array:
        return pa.array([weight(u, entries) for u in urls.to_pylist()], pa.float64())

    return run(url)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, *, rules: tuple[UrlRule, ...] = RULES, vocabulary: Mapping[str, float] = WEIGHT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, weight."""
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_weight(F.col(url_col), vocabulary).alias("weight"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("weight") >= 1, F.lit("block")).otherwise(F.lit("allow"))
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is tested first: it is outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "weight")
