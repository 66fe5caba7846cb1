"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. Only
(blob, rule, rule version) triples that the ledger lacks are scanned, each
blob once however many paths and versions hold it; findings join back to all
paths. DataFrame functions only: the matches of a pattern come from
regexp_extract_all, their places from the lengths of what split leaves
between them.

Definite results: null text is empty and has no findings; rows with one path
are versions of it and get a row each; a null path is an ordinary path;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Workspace


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` characters of ``group`` make a match count; others are dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0


#: The three base kinds. A run of hex digits or an access id is greedy, so its minimum stands in the pattern.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: a lambda would compute what it captures for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(xs: Column) -> Column:
    """An array in runs of about the square root of its length: what is built by appending then grows within a run only."""
    most = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
    return _let(most, lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / n).cast("int")), lambda i: F.slice(xs, i * n + 1, n)))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of a rule's matches, leftmost first and not overlapping, in code points with an exclusive end."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    long_enough = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least) if rule.least else F.transform(whole, lambda g: F.lit(True))
    parts = F.arrays_zip(F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), long_enough.alias("ok"))
    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    def places(xs: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(xs, start, step, lambda a: a["found"])

    def joined(runs: Column) -> Column:
        sizes = F.transform(runs, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"]))
        return _let(sizes, lambda ns: F.flatten(F.transform(runs, lambda xs, i: places(xs, F.aggregate(F.slice(ns, 1, i), F.lit(0), lambda acc, n: acc + n)))))

    found = _let(parts, lambda xs: _let(_runs(xs), joined))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPAN))


def scan_versions(files: DataFrame, *, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): spans by version of every path, and the ledger to pass in next time.

    ``findings`` has path, blob and spans (ordered by start, then rule).
    ``ledger`` has blob, rule, rule_version and spans for every pair scanned
    so far, findings or none.
    """
    ws = Workspace(files.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = files.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", blob_id(F.col("text"))).withColumn("key", F.coalesce(F.col("path").cast("string"), F.lit("")))
    versions = own.select("path", "blob")
    # one row holds each blob's text: the least path key; texts then travel to that join and nowhere else
    holders = own.groupBy("blob").agg(F.min("key").alias("key"))
    names = {f"{r.kind}": (i, r) for i, r in enumerate(rules)}
    if ledger is not None:
        current = F.lit(False)
        for r in rules:
            current = current | ((F.col("rule") == r.kind) & (F.col("rule_version") == r.version))
        ledger = ledger.where(current)
        present = ledger.join(holders.select("blob"), "blob", "left_semi")  # a scan needs no more of it than its own blobs
        seen = present.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one name a rule
        holders = holders.join(seen, "blob", "left").where(f"seen IS NULL OR size(seen) < {len(rules)}")
        holders = holders.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    todo = own.select("key", "blob", "text").join(holders.hint("shuffle_hash"), ["key", "blob"])
    results = []
    for kind, (i, r) in names.items():
        found = spans(F.col("text"), r, i)
        if ledger is not None:
            found = F.when(~F.array_contains("seen", kind), found)
        results.append(found.alias(kind))
    scanned = ws.keep(todo.select("blob", *results).dropDuplicates(["blob"]), "scanned")
    rows = F.array(*[F.struct(F.lit(kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.col(kind).alias("spans")) for kind, (_, r) in names.items()])
    fresh = scanned.select("blob", F.inline(rows)).where("spans IS NOT NULL")
    full = fresh if ledger is None else ledger.select("blob", "rule", "rule_version", "spans").unionByName(fresh)
    if ledger is None:
        hits = scanned.select("blob", F.array_sort(F.concat(*names)).alias("spans"))
    else:
        hits = present.select("blob", "rule", "rule_version", "spans").unionByName(fresh).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # a list for each rule, no more
    hits = hits.where("size(spans) > 0")
    findings = versions.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return findings, full


def digest(spans_col: str) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_by_document(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for every row."""
    findings, _ = scan_versions(docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text")))
    base = findings.withColumn("base", F.filter("spans", lambda s: s["order"] < len(BASE)))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(r.kind) for r in BASE]
    return base.select(F.col("path").alias("doc_id"), *count, F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"))
