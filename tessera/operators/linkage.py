"""Record linkage: exact keys, near titles, families, duplicate rules and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import connected_components
from tessera.operators.relational import join_groups
from tessera.runtime import Workspace


def family_group_id(url: Column, title: Column, text: Column) -> Column:
    """One id of a page: by address, else by a title of 20 characters, else by text."""
    u, n = T.canonical_article_url(url), T.normalized_text(title)
    raw = F.when(u != "", F.concat(F.lit("url||"), u)).when(F.length(n) >= 20, F.concat(F.lit("title||"), n)).otherwise(F.concat(F.lit("text||"), T.normalized_text_hash(text)))
    return F.concat(F.lit("family_"), T.short_sha1(raw))


def exact_keys(df: DataFrame) -> DataFrame:
    """(dataset, record_id, key): addresses, a telling title, a long body, the whole text.

    ``df`` has dataset, record_id, url, alternate_urls, title, body_text,
    model_text. Keys are hashes, so a long body costs sixteen characters.
    """
    urls = F.concat(F.array(F.coalesce(F.col("url"), F.lit(""))), T.parse_alternate_urls(F.col("alternate_urls")))
    title, body, whole = T.normalized_text("title"), T.normalized_text("body_text"), T.normalized_text("model_text")
    words = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    base = df.select("dataset", "record_id", urls.alias("urls"), title.alias("t"), body.alias("b"), whole.alias("w"))
    base = Workspace(df.sparkSession).keep(base, "normalised")  # texts are cleaned once, whatever reads them
    u = base.select("dataset", "record_id", F.explode("urls").alias("u")).select("dataset", "record_id", T.canonical_article_url("u").alias("u")).where("u <> ''").select("dataset", "record_id", F.concat(F.lit("url:"), "u").alias("key"))
    rest = F.filter(
        F.array(
            F.when((F.length("t") >= 20) & (words(F.col("t")) >= 6), F.concat(F.lit("title:"), T.short_sha1(F.col("t")))),
            F.when(words(F.col("b")) >= 30, F.concat(F.lit("body:"), T.short_sha1(F.col("b")))),
            F.when(F.col("w") != "", F.concat(F.lit("text:"), T.short_sha1(F.col("w")))),
        ),
        lambda k: k.isNotNull(),
    )
    return u.unionByName(base.select("dataset", "record_id", F.explode(rest).alias("key"))).distinct()


def key_edges(keys: DataFrame) -> DataFrame:
    """Star edges: every record of a key to the smallest one, so a key of a million records makes a million edges."""
    low = keys.groupBy("dataset", "key").agg(F.min("record_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    return join_groups(keys, low, ["dataset", "key"], "n").where("record_id <> dst").select("dataset", F.col("record_id").alias("src"), "dst").distinct()


def char_grams(title: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, words padded by a space; a padded word shorter than n has none of length n."""
    padded = F.transform(F.split(title, " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[of(w, n) for n in range(low, high + 1)]))))


def title_vectors(titles: DataFrame) -> DataFrame:
    """(dataset, id, times, g, x, place, left): unit TF-IDF weights of each title's n-grams.

    n-grams of one record only are left out. ``place`` numbers a title's
    n-grams from the rarest on (ties: by n-gram), the same order for all
    titles; ``left`` is the squared weight from that place to the end.
    """
    grams = titles.select("dataset", "id", "times", F.explode(char_grams(F.col("title"))).alias("g")).groupBy("dataset", "id", "times", "g").agg(F.count("*").alias("tf"))
    known = grams.groupBy("dataset", "g").agg(F.sum("times").alias("df"), F.count("*").alias("m")).where("df >= 2")  # over all records, whose titles may repeat
    n = titles.groupBy("dataset").agg(F.sum("times").alias("n"))
    v = join_groups(grams, known, ["dataset", "g"], "m", how="merge").where("df is not null").join(n, "dataset").withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    order = Window.partitionBy("dataset", "id").orderBy("df", "g")
    whole = Window.partitionBy("dataset", "id")
    square = F.col("x") * F.col("x")
    v = v.withColumns({"all": F.sum(square).over(whole), "left": F.sum(square).over(order.rowsBetween(0, Window.unboundedFollowing)), "place": F.row_number().over(order)})
    return v.select("dataset", "id", "times", "g", (F.col("x") / F.sqrt("all")).alias("x"), (F.col("left") / F.col("all")).alias("left"), "place")


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 2000) -> DataFrame:
    """(dataset, a, b), a < b: every pair of unit vectors whose dot product may reach ``threshold``, and few others.

    Two vectors that reach it meet first on some n-gram; before it neither
    side has weight that counts, so their product is at most the two weights
    there and the product of what is left behind it. Hence the n-gram lies in
    the prefix of either side in which ``left`` is the threshold's square or
    more, and the bound holds there. Postings of an n-gram longer than
    ``block`` are cut by record into blocks and meet block by block, so no task
    holds more than two blocks of one n-gram.
    """
    least = threshold - 1e-9
    head = vectors.where(F.col("left") >= least * least).select("dataset", "g", "id", "x", "left")
    size = head.groupBy("dataset", "g").agg(F.count("*").alias("m")).where("m > 1")
    posted = join_groups(head, size, ["dataset", "g"], "m", how="merge").where("m is not null")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    posted = posted.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    posted = posted.select("dataset", "g", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "id", "x", (F.col("left") - F.col("x") * F.col("x")).alias("rest"))
    keys = ["dataset", "g", "lo", "hi"]
    a, b = (posted.withColumnsRenamed({"id": side, "blk": f"{side}_blk", "x": f"{side}_x", "rest": f"{side}_rest"}) for side in ("a", "b"))
    bound = F.col("a_x") * F.col("b_x") + F.sqrt(F.greatest(F.col("a_rest"), F.lit(0.0)) * F.greatest(F.col("b_rest"), F.lit(0.0))) >= least
    across = (F.col("lo") == F.col("hi")) | (F.col("a_blk") != F.col("b_blk"))
    return a.join(b.hint("merge"), keys).where(bound & across & (F.col("a") < F.col("b"))).select("dataset", "a", "b").distinct()


def nearest(scored: DataFrame, slots: int) -> DataFrame:
    """Of (dataset, src, dst, similarity, taken, times): the ``dst`` that begin within the ``slots`` nearest records of ``src``.

    ``taken`` records equal ``src`` and come first; a ``dst`` of ``times``
    equal records fills as many slots. At most ``slots`` rows of a ``src``
    leave a task before the exchange.
    """
    rank = Window.partitionBy("dataset", "src").orderBy(F.desc("similarity"), "dst")
    few = scored.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= slots)
    before = F.coalesce(F.sum("times").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("taken")
    return few.withColumn("before", before).where(F.col("before") < slots).drop("rn", "before")


def fuzzy_title_edges(df: DataFrame, *, threshold: float = 0.97, neighbours: int = 7, ratio: float = 0.85, block: int = 2000) -> DataFrame:
    """(dataset, src, dst, similarity), src < dst, of titles with a TF-IDF cosine of ``threshold`` over character n-grams.

    A link stands if either title is among the ``neighbours`` nearest records
    of the other (ties: smaller record first) and their lengths are in
    ``ratio``; too short or long neighbours fill slots all the same. Distinct
    titles, named by their least record, are compared once; records of one
    title hang on it.
    """
    ws = Workspace(df.sparkSession, rest=2.0)
    t = df.select("dataset", "record_id", T.normalized_text("title").alias("title"))
    t = ws.keep(t.where((F.length("title") >= 30) & (F.size(F.split("title", " ")) >= 6)), "titles")
    titles = ws.keep(t.groupBy("dataset", "title").agg(F.min("record_id").alias("id"), F.count("*").alias("times")), "distinct")
    v = ws.keep(title_vectors(titles), "vectors")
    pairs = similar_pairs(v, threshold, block)
    x = v.select("dataset", F.col("id").alias("a"), "g", F.col("x").alias("xa"))
    y = v.select("dataset", F.col("id").alias("b"), "g", F.col("x").alias("xb"))
    # by exchanges: a broadcast of a part of these tables would be built by the driver
    sim = pairs.join(x.hint("merge"), ["dataset", "a"]).join(y.hint("merge"), ["dataset", "b", "g"]).groupBy("dataset", "a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 12).alias("similarity")).where(F.col("similarity") >= threshold)
    sim = ws.keep(sim, "similar")
    both = sim.select("dataset", F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").union(sim.select("dataset", "b", "a", "similarity"))
    own = titles.select("dataset", F.col("id").alias("src"), (F.col("times") - 1).alias("taken"), F.length("title").alias("l1"))
    far = titles.select("dataset", F.col("id").alias("dst"), "times", F.length("title").alias("l2"))
    kept = nearest(both.join(own.hint("merge"), ["dataset", "src"]).join(far.hint("merge"), ["dataset", "dst"]), neighbours)
    kept = kept.where(F.least("l1", "l2") >= ratio * F.greatest("l1", "l2")).select("dataset", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "similarity").distinct()
    same = join_groups(t, titles, ["dataset", "title"], "times", how="merge").where("record_id <> id").select("dataset", F.col("id").alias("src"), F.col("record_id").alias("dst"), F.lit(1.0).alias("similarity"))
    return kept.unionByName(same)


def families(records: DataFrame, edges: DataFrame) -> DataFrame:
    """dataset, record_id, family_group, family_size; a record without edges is its own family."""
    sep = F.lit("\u0001")
    e = edges.select(F.concat("dataset", sep, "src").alias("src"), F.concat("dataset", sep, "dst").alias("dst"))
    part = connected_components(e)
    r = records.select("dataset", "record_id").distinct().withColumn("node", F.concat("dataset", sep, "record_id"))
    r = r.join(part, "node", "left").withColumn("root", F.element_at(F.split(F.coalesce("component", "node"), "\u0001"), -1))
    size = r.groupBy("dataset", "root").agg(F.count("*").alias("family_size"))
    fid = T.stable_id(F.col("dataset"), F.col("root"), prefix="family", clean=False)
    return r.join(size, ["dataset", "root"]).select("dataset", "record_id", fid.alias("family_group"), "family_size")


def family_audit(fam: DataFrame) -> DataFrame:
    g = fam.groupBy("dataset", "family_group").agg(F.count("*").alias("n"))
    return g.groupBy("dataset").agg(F.sum("n").alias("records"), F.count("*").alias("families"), F.count_if(F.col("n") > 1).alias("multi_record"), F.max("n").alias("largest"), (F.sum("n") - F.count("*")).alias("unions"))


def apply_quality_rules(df: DataFrame) -> DataFrame:
    """exclusion_reason filled for eligible rows: first whole groups of conflicting duplicates, then all but the first of a group.

    ``df`` has dataset, record_id, duplicate_group, harmonized_label, exclusion_reason.
    """
    keys = ["dataset", "duplicate_group"]
    reason = F.coalesce("exclusion_reason", F.lit(""))
    open_ = reason == ""
    # one row a group, combined on the map side; a group of one open row changes nothing, so only others are joined back
    label = F.when(open_, F.col("harmonized_label"))
    groups = df.groupBy(*keys).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.min(F.when(open_, F.col("record_id"))).alias("_first"), F.count_if(open_).alias("_n")).where("_n > 1")
    d = join_groups(df, groups, keys, "_n")
    new = F.when(~open_, reason).when(F.col("_low") != F.col("_high"), "conflicting_exact_duplicate").when(F.col("record_id") != F.col("_first"), "exact_duplicate").otherwise("")
    return d.withColumn("exclusion_reason", new).drop("_low", "_high", "_first", "_n")


def assign_primary_cohorts(df: DataFrame, allowed: dict[str, list[str]] | None = None, minimum_words: int = 30) -> DataFrame:
    """Audit columns and the first reason that keeps a row out of the primary cohort.

    ``allowed`` lists the text units of each dataset; None allows all.
    """
    ok = F.lit(True)
    if allowed is not None:
        ok = F.lit(False)
        for dataset, units in allowed.items():
            ok = ok | ((F.col("dataset") == dataset) & F.col("text_unit").isin(*units))
    words = T.word_count_unicode(F.coalesce("body_text", F.lit("")))
    model = F.coalesce("model_text", F.lit(""))
    letters = F.length(F.regexp_replace(model, r"[^\p{L}]", ""))
    latin = F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(model, "[^A-Za-z]", "")) / letters)
    d = df.withColumns({"body_word_count": words, "latin_letter_fraction": latin, "language_audit_flag": (letters >= 50) & (latin < 0.8), "unicode_replacement_count": T.unicode_replacement_count(model), "analysis_cohort": F.concat_ws("_", "dataset", "text_unit")})
    reason = F.when(F.coalesce("exclusion_reason", F.lit("")) != "", F.col("exclusion_reason")).when(~ok, "non_primary_text_unit").when(F.col("body_word_count") < minimum_words, "insufficient_body_text").otherwise("")
    return d.withColumn("primary_exclusion_reason", reason).withColumn("primary_eligible", F.col("primary_exclusion_reason") == "")
