"""The shift bundle: thirteen tables that describe how a target differs from a source, from one scan.

Records are read once into a long form (dimension, component, value) with
counts on three sides: source, target, and the target records whose domain
the source knows (left out of every comparison). The counts are summed before
their one exchange and written; the tables are filters and sums of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.prefix import running_sums
from tessera.operators.relational import ContractError, require_columns
from tessera.operators.shift import MISSING, coded, js_divergence, tv_distance
from tessera.runtime import Workspace

REQUIRED = ("record_id", "harmonized_label", "text_unit", "publisher_id", "source_domain", "model_text", "title")
FIELDS = ("harmonized_label", "text_unit", "publisher_id", "source_domain")
TEXTS = {"full_text": "model_text", "title_only": "title"}
COHORTS = ("source_train", "target_test_before_domain_exclusion", "target_test_after_domain_exclusion")
HEADLINES = {
    "vocabulary": ("active_type_jaccard", "target_active_type_coverage_by_source", "target_token_coverage_by_source_active_types", "jensen_shannon_divergence_bits_retained_vocabulary"),
    "document_length": ("target_to_source_mean_ratio", "target_to_source_median_ratio", "standardized_mean_difference_target_minus_source", "kolmogorov_smirnov_statistic"),
    "composition": ("category_jaccard", "target_record_share_in_source_categories", "total_variation_distance", "jensen_shannon_divergence_bits", "target_minus_source_unreliable_prevalence"),
    "topic_proxy": ("jensen_shannon_divergence_bits_mean_topic_weights", "total_variation_distance_mean_topic_weights", "most_target_enriched_topic_delta", "most_source_enriched_topic_delta"),
    "domain_exclusion": ("target_records_removed", "target_record_removal_share", "target_domains_removed"),
}


def _per(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(None)).otherwise(a.cast("double") / b)


class Bundle(Mapping):
    """The tables by name, each built when it is asked for."""

    def __init__(self, build: dict[str, Callable[[], DataFrame]], metadata: dict):
        self.build, self.made, self.metadata = build, {}, metadata

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.build[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.build)

    def __len__(self) -> int:
        return len(self.build)


def long_counts(rows: DataFrame) -> DataFrame:
    """(dimension, component, value, s, t, x): counts on the sides 0, 1 and 2 of ``rows`` (columns of ``REQUIRED`` and side)."""
    words = {k: tokens(F.coalesce(F.col(c), F.lit(""))) for k, c in TEXTS.items()}
    entry = lambda kind, part, value: F.struct(F.lit(kind).alias("dimension"), F.lit(part).alias("component"), value.alias("value"))

    def terms(k: str) -> Column:
        return F.transform(words[k], lambda t: entry("term", k, t))

    parts = [terms(k) for k in TEXTS]
    parts += [F.array(*[entry("length", k, F.size(w).cast("string")) for k, w in words.items()], *[entry("category", c, coded(F.col(c))) for c in FIELDS])]
    long = rows.select("side", F.explode(F.concat(*parts)).alias("e")).select("side", "e.*")
    return long.groupBy("dimension", "component", "value").agg(*[F.count_if(F.col("side") == k).alias(n) for k, n in enumerate("stx")])


def shift_bundle(source: DataFrame, target: DataFrame, known: DataFrame, *, source_name: str, target_name: str, seed: int = 613, vocabulary_max_features: int = 20_000, least: int = 2, enriched: int = 25, topics: int = 10, topic_max_features: int = 5000, topic_rounds: int = 12) -> Bundle:
    """All tables of one direction. ``known`` holds the records whose ``source_domain`` a target record must not have."""
    ws = Workspace(source.sparkSession, rest=2.0)
    for df, name in ((source, COHORTS[0]), (target, COHORTS[1])):
        require_columns(df, set(REQUIRED), name)
    direction = F.lit(f"{source_name}_to_{target_name}").alias("direction")
    domains = ws.keep(known.select(coded(F.col("source_domain")).alias("d")).where(F.col("d") != MISSING).distinct(), "domains")
    hit = target.join(domains, coded(F.col("source_domain")) == F.col("d"), "left").withColumn("side", F.when(F.col("d").isNull(), 1).otherwise(2))
    rows = ws.keep(source.select(*REQUIRED, F.lit(0).alias("side")).unionByName(hit.select(*REQUIRED, "side")), "records")
    long = ws.keep(long_counts(rows), "long")
    n = long.where("dimension = 'category' AND component = 'text_unit'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "stx"]).first()
    if not n["s"] or not n["t"]:
        raise ContractError("source and target must hold records after the domains that both know are left out")
    ns, nt, nx = (F.lit(n[c]) for c in "stx")
    category = long.where("dimension = 'category'").drop("dimension").withColumnRenamed("component", "field")

    def cohort_profiles() -> DataFrame:
        has = lambda c, side: F.count_if((F.col("field") == c) & (side > 0))
        label = lambda v, side: F.coalesce(F.sum(F.when((F.col("field") == "harmonized_label") & (F.col("value") == v), side)), F.lit(0))
        sides = (F.col("s"), F.col("t") + F.col("x"), F.col("t"))
        out = None
        for cohort, dataset, side, total in zip(COHORTS, (source_name, target_name, target_name), sides, (ns, nt + nx, nt), strict=True):
            one = category.agg(label("reliable", side).alias("reliable_records"), label("unreliable", side).alias("unreliable_records"), has("text_unit", side).alias("text_units"), has("publisher_id", side).alias("publishers"), has("source_domain", side).alias("source_domains"))
            row = one.select(direction, F.lit(cohort).alias("cohort"), F.lit(dataset).alias("dataset"), total.alias("records"), "reliable_records", "unreliable_records", F.round(_per(F.col("unreliable_records"), total), 6).alias("unreliable_prevalence"), "text_units", "publishers", "source_domains")
            out = row if out is None else out.unionByName(row)
        return out

    def exclusion() -> DataFrame:
        d = category.where("field = 'source_domain'").join(domains.withColumn("seen", F.lit(True)), F.col("value") == F.col("d"), "left")
        c = F.count_if
        got = d.agg(c((F.col("t") + F.col("x")) > 0).alias("target_domains_before_exclusion"), c(F.col("t") > 0).alias("target_domains_after_exclusion"), c((F.col("x") > 0) & (F.col("value") != MISSING)).alias("target_domains_removed"), F.coalesce(F.sum(F.when(F.col("seen"), F.col("t"))), F.lit(0)).alias("remaining_target_records_on_exclusion_domains"))
        m = F.lit(domains.count())
        return got.select(direction, m.alias("source_domain_reference_count"), (nt + nx).alias("target_records_before_exclusion"), nt.alias("target_records_after_exclusion"), nx.alias("target_records_removed"), F.round(_per(nx, nt + nx), 6).alias("target_record_removal_share"), *got.columns)

    def retained() -> DataFrame:
        """The most frequent terms of each representation (ties: term order), with their shares."""
        terms = long.where("dimension = 'term' AND s + t > 0").select(F.col("component").alias("text_representation"), F.col("value").alias("term"), "s", "t")
        rank = Window.partitionBy("text_representation").orderBy(F.desc(F.col("s") + F.col("t")), "term")
        top = terms.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= vocabulary_max_features).drop("rn")  # a bounded heap a task, then max_features rows
        sums = top.groupBy("text_representation").agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"), F.count("*").alias("v"))
        return top.join(F.broadcast(sums), "text_representation").withColumns({"ps": F.try_divide("s", "ss"), "pt": F.try_divide("t", "tt")})

    kept_terms: list[DataFrame] = []

    def vocabulary_terms() -> DataFrame:
        if not kept_terms:
            kept_terms.append(ws.keep(retained(), "vocabulary"))
        return kept_terms[0]

    def vocabulary_summary() -> DataFrame:
        a, b = F.col("s") >= least, F.col("t") >= least
        got = vocabulary_terms().groupBy("text_representation").agg(
            F.count("*").alias("retained_vocabulary_terms"), F.max("ss").alias("source_retained_tokens"), F.max("tt").alias("target_retained_tokens"),
            F.count_if(a).alias("source_active_types"), F.count_if(b).alias("target_active_types"), F.count_if(a & b).alias("shared_active_types"),
            F.round(_per(F.count_if(a & b), F.count_if(a | b)), 6).alias("active_type_jaccard"),
            F.round(_per(F.count_if(a & b), F.count_if(b)), 6).alias("target_active_type_coverage_by_source"),
            F.round(_per(F.sum(F.when(a, F.col("t")).otherwise(0)), F.max("tt")), 6).alias("target_token_coverage_by_source_active_types"),
            F.round(_per(F.sum(F.when(b, F.col("s")).otherwise(0)), F.max("ss")), 6).alias("source_token_coverage_by_target_active_types"),
            F.round(js_divergence(), 6).alias("jensen_shannon_divergence_bits_retained_vocabulary"),
        )
        return got.select(direction, *got.columns)

    def vocabulary_shift_terms() -> DataFrame:
        t = vocabulary_terms().where((F.col("s") + F.col("t") >= least) & (F.col("ss") > 0) & (F.col("tt") > 0)).withColumn("delta", F.round(F.col("pt") - F.col("ps"), 12))
        log = F.log2(((F.col("t") + 0.5) / (F.col("tt") + 0.5 * F.col("v"))) / ((F.col("s") + 0.5) / (F.col("ss") + 0.5 * F.col("v"))))
        out = None
        for name, order in (("source_enriched", F.asc("delta")), ("target_enriched", F.desc("delta"))):
            w = Window.partitionBy("text_representation").orderBy(order, "term")
            own = t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= enriched)
            own = own.select(direction, "text_representation", F.lit(name).alias("enrichment"), "rank", "term", F.col("s").alias("source_count"), F.round("ps", 9).alias("source_share"), F.col("t").alias("target_count"), F.round("pt", 9).alias("target_share"), F.round("delta", 9).alias("target_minus_source_share"), F.round(log, 6).alias("target_to_source_log2_ratio_smoothed"))
            out = own if out is None else out.unionByName(own)
        return out

    lengths = long.where("dimension = 'length'").select(F.col("component").alias("text_representation"), F.col("value").cast("long").alias("len"), "s", "t")

    def document_length_profiles() -> DataFrame:
        both = lengths.select("text_representation", "len", F.explode(F.array(F.struct(F.lit(COHORTS[0]).alias("cohort"), F.col("s").alias("m")), F.struct(F.lit(COHORTS[2]).alias("cohort"), F.col("t").alias("m")))).alias("c")).select("text_representation", "len", "c.*").where("m > 0")
        total, mean = F.sum("m"), F.sum(F.col("len") * F.col("m")) / F.sum("m")
        square = F.sum(F.col("len") * F.col("len") * F.col("m")) - F.sum("m") * mean * mean
        q = F.percentile("len", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))), F.col("m"))
        got = both.groupBy("text_representation", "cohort").agg(
            total.alias("records"), F.round(_per(F.coalesce(F.sum(F.when(F.col("len") == 0, F.col("m"))), F.lit(0)), total), 6).alias("empty_document_share"), F.round(mean, 6).alias("mean_tokens"),
            F.round(F.when(total > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (total - 1))).otherwise(0.0), 5).alias("standard_deviation_tokens"), F.min("len").alias("minimum_tokens"),
            *[F.round(q[i], 6).alias(f"{p}_tokens") for i, p in enumerate(("p10", "p25", "median", "p75", "p90"))], F.max("len").alias("maximum_tokens"),
        )
        return got.select(direction, *got.columns)

    def document_length_shift() -> DataFrame:
        mean = lambda m: F.sum(F.col("len") * F.col(m)) / F.sum(m)
        square = lambda m: F.sum(F.col("len") * F.col("len") * F.col(m)) - F.sum(m) * mean(m) * mean(m)
        pooled = F.greatest(square("s") + square("t"), F.lit(0.0)) / (F.sum("s") + F.sum("t") - 2)
        smd = F.when((F.sum("s") < 2) | (F.sum("t") < 2), None).when(pooled == 0, F.when(mean("s") == mean("t"), 0.0)).otherwise((mean("t") - mean("s")) / F.sqrt(pooled))
        ms, mt = (F.percentile("len", 0.5, F.col(c)) for c in "st")
        got = lengths.groupBy("text_representation").agg(
            F.round(mean("t") - mean("s"), 6).alias("target_minus_source_mean_tokens"), F.round(_per(mean("t"), mean("s")), 6).alias("target_to_source_mean_ratio"), F.round(mt - ms, 6).alias("target_minus_source_median_tokens"),
            F.round(_per(mt, ms), 6).alias("target_to_source_median_ratio"), F.round(smd, 6).alias("standardized_mean_difference_target_minus_source"),
        )
        up = running_sums(lengths, F.col("len").asc(), {"s": "us", "t": "ut"}, {"s": "ss", "t": "tt"}, ["text_representation"])
        ks = up.groupBy("text_representation").agg(F.round(F.max(F.abs(F.col("us") / F.col("ss") - F.col("ut") / F.col("tt"))), 6).alias("kolmogorov_smirnov_statistic"))
        return got.join(ks, "text_representation").select(direction, *got.columns, "kolmogorov_smirnov_statistic")

    shares = category.withColumns({"ps": F.col("s") / ns, "pt": F.col("t") / nt})

    def categorical_distributions() -> DataFrame:
        return shares.where("s + t > 0").select(direction, "field", F.col("value").alias("category"), F.col("s").alias("source_count"), F.round("ps", 6).alias("source_share"), F.col("t").alias("target_count"), F.round("pt", 6).alias("target_share"), F.round(F.col("pt") - F.col("ps"), 6).alias("target_minus_source_share"))

    def categorical_shift_summary() -> DataFrame:
        d = shares.where("s + t > 0")
        a, b = F.col("s") > 0, F.col("t") > 0
        at = lambda v, p: F.coalesce(F.sum(F.when(F.col("value") == v, F.col(p))), F.lit(0.0))
        label = lambda c: F.when(F.col("field") == "harmonized_label", c)
        got = d.groupBy("field").agg(
            F.count_if(a).alias("source_unique_categories"), F.count_if(b).alias("target_unique_categories"), F.count_if(a & b).alias("shared_categories"), F.round(_per(F.count_if(a & b), F.count("*")), 6).alias("category_jaccard"),
            F.round(F.sum(F.when(a, F.col("pt")).otherwise(0.0)), 6).alias("target_record_share_in_source_categories"), F.round(F.sum(F.when(b, F.col("ps")).otherwise(0.0)), 6).alias("source_record_share_in_target_categories"),
            F.round(tv_distance(), 6).alias("total_variation_distance"), F.round(js_divergence(), 6).alias("jensen_shannon_divergence_bits"), F.round(F.max("ps"), 6).alias("source_top1_share"), F.round(F.max("pt"), 6).alias("target_top1_share"),
            F.round(F.sum(F.col("ps") ** 2), 6).alias("source_hhi"), F.round(F.sum(F.col("pt") ** 2), 6).alias("target_hhi"), F.round(1 / F.sum(F.col("ps") ** 2), 6).alias("source_effective_category_count"), F.round(1 / F.sum(F.col("pt") ** 2), 6).alias("target_effective_category_count"),
            F.round(at(MISSING, "ps"), 6).alias("source_missing_share"), F.round(at(MISSING, "pt"), 6).alias("target_missing_share"), at("unreliable", "ps").alias("ls"), at("unreliable", "pt").alias("lt"),
        )
        top = None
        for side, name in (("ps", "source_top5_share"), ("pt", "target_top5_share")):
            w = Window.partitionBy("field").orderBy(F.desc(side))
            own = d.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("field").agg(F.round(F.sum(side), 6).alias(name))
            top = own if top is None else top.join(own, "field")
        got = got.join(top, "field")
        got = got.withColumns({"source_unreliable_prevalence": F.round(label(F.col("ls")), 6), "target_unreliable_prevalence": F.round(label(F.col("lt")), 6), "target_minus_source_unreliable_prevalence": F.round(label(F.col("lt") - F.col("ls")), 6)}).drop("ls", "lt")
        return got.select(direction, *got.columns)

    topic_parts: list[tuple[DataFrame, DataFrame]] = []

    def topic() -> tuple[DataFrame, DataFrame]:
        """Every compared document with its share of each topic (an array), and the terms of the topics."""
        if not topic_parts:
            from tessera.operators.topics import topic_proxy

            mixtures, terms = topic_proxy(rows.where("side < 2").select("record_id", "side", F.col("model_text").alias("text")), "side", topics=topics, max_features=topic_max_features, rounds=topic_rounds, seed=seed)
            total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
            topic_parts.append((ws.keep(mixtures.withColumn("share", F.when(total > 0, F.transform("weights", lambda x: x / total))).drop("weights"), "mixtures"), terms))
        return topic_parts[0]

    cohort = F.when(F.col("side") == 0, COHORTS[0]).otherwise(COHORTS[2]).alias("cohort")
    named = lambda c: F.concat(F.lit("topic_"), F.lpad(c.cast("string"), 2, "0"))

    def topic_top_terms() -> DataFrame:
        return topic()[1].select(direction, named(F.col("topic")).alias("topic_id"), "rank", "term")

    def topic_assignments() -> DataFrame:
        best = F.array_position("share", F.array_max("share")) - 1
        return topic()[0].select(direction, cohort, "record_id", F.when(F.col("share").isNull(), "unassigned").otherwise(named(best)).alias("dominant_topic"), F.round(F.coalesce(F.array_max("share"), F.lit(0.0)), 6).alias("dominant_topic_weight_share"))

    def topic_distributions() -> DataFrame:
        m, sizes = topic()[0], {0: n["s"], 1: n["t"]}
        size = F.when(F.col("side") == 0, sizes[0]).otherwise(sizes[1])
        soft = m.select("side", F.posexplode("share").alias("k", "v")).groupBy("side", named(F.col("k")).alias("topic_id")).agg(F.sum("v").alias("w"))
        none = m.groupBy("side").agg(F.count_if(F.col("share").isNull()).cast("double").alias("w")).select("side", F.lit("unassigned").alias("topic_id"), "w")
        hard = topic_assignments().groupBy(F.when(F.col("cohort") == COHORTS[0], 0).otherwise(1).alias("side"), F.col("dominant_topic").alias("topic_id")).agg(F.count("*").alias("dominant_document_count"))
        got = soft.unionByName(none).join(hard, ["side", "topic_id"], "left")
        got = got.select("side", "topic_id", (F.col("w") / size).alias("share"), F.coalesce("dominant_document_count", F.lit(0)).alias("dominant_document_count"), size.alias("size"))
        other = got.groupBy("topic_id").agg(F.sum(F.when(F.col("side") == 1, F.col("share")).otherwise(-F.col("share"))).alias("delta"))
        return got.join(other, "topic_id").select(direction, cohort, "topic_id", F.round("share", 6).alias("mean_weight_share"), "dominant_document_count", F.round(F.col("dominant_document_count") / F.col("size"), 6).alias("dominant_document_share"), F.round("delta", 6).alias("target_minus_source_mean_weight_share"))

    def topic_summary() -> DataFrame:
        d = bundle["topic_proxy_distributions"]
        side = lambda c: F.sum(F.when(F.col("cohort") == c, F.col("mean_weight_share")).otherwise(0.0))
        by = d.groupBy("topic_id").agg(side(COHORTS[0]).alias("ps"), side(COHORTS[2]).alias("pt"), F.first("target_minus_source_mean_weight_share").alias("delta"))
        real = F.col("topic_id") != "unassigned"
        up, down = F.when(real, F.struct("delta", "topic_id")), F.when(real, F.struct((-F.col("delta")).alias("delta"), "topic_id"))
        return by.agg(
            F.count_if(real).alias("fitted_topics"), F.round(js_divergence(), 6).alias("jensen_shannon_divergence_bits_mean_topic_weights"), F.round(tv_distance(), 6).alias("total_variation_distance_mean_topic_weights"),
            F.max_by("topic_id", up).alias("most_target_enriched_topic"), F.max(F.when(real, F.col("delta"))).alias("most_target_enriched_topic_delta"), F.max_by("topic_id", down).alias("most_source_enriched_topic"), F.min(F.when(real, F.col("delta"))).alias("most_source_enriched_topic_delta"),
        ).select(direction, F.lit(topics).alias("requested_topics"), F.lit(seed).alias("random_seed"), "*")

    def summary(with_topics: bool) -> DataFrame:
        out = None
        parts = [("vocabulary", "text_representation", "vocabulary_summary"), ("document_length", "text_representation", "document_length_shift"), ("composition", "field", "categorical_shift_summary"), ("domain_exclusion", F.lit("source_domain"), "domain_exclusion_summary")]
        for dimension, component, name in parts + [("topic_proxy", F.lit("full_text"), "topic_proxy_summary")] * with_topics:
            t = bundle[name].select(F.col(component).alias("component") if isinstance(component, str) else component.alias("component"), *[F.col(c).cast("double").alias(c) for c in HEADLINES[dimension]])
            long = t.unpivot(["component"], list(HEADLINES[dimension]), "metric", "value")
            if dimension == "composition":  # only the label has a prevalence
                long = long.where((F.col("component") == "harmonized_label") | ~F.col("metric").endswith("prevalence"))
            row = long.select(direction, F.lit(dimension).alias("dimension"), "component", "metric", "value")
            out = row if out is None else out.unionByName(row)
        return out

    metadata = {
        "direction": f"{source_name}_to_{target_name}", "source_dataset": source_name, "target_dataset": target_name, "comparison_cohorts": {"source": COHORTS[0], "target": COHORTS[2]},
        "parameters": {"random_seed": seed, "vocabulary_max_features": vocabulary_max_features, "vocabulary_minimum_term_count": least, "topic_method": "pooled_tfidf_nmf", "topic_requested_components": topics, "topic_max_features": topic_max_features},
        "interpretation": {"causal_attribution": False, "topic_components_are_validated_narratives": False, "labels_assumed_equivalent": False},
    }
    bundle = Bundle(
        {
            "cohort_profiles": cohort_profiles,
            "domain_exclusion_summary": exclusion,
            "vocabulary_summary": vocabulary_summary,
            "vocabulary_shift_terms": vocabulary_shift_terms,
            "document_length_profiles": document_length_profiles,
            "document_length_shift": document_length_shift,
            "categorical_distributions": categorical_distributions,
            "categorical_shift_summary": categorical_shift_summary,
            "topic_proxy_top_terms": topic_top_terms,
            "topic_proxy_distributions": topic_distributions,
            "topic_proxy_assignments": topic_assignments,
            "topic_proxy_summary": topic_summary,
            "shift_summary": lambda: summary(topics > 0),
        },
        metadata,
    )
    return bundle
