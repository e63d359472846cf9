"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import roles
from catalog.roles import AS_OF, PATTERNS, table
from contrastmill import FeatureSet, FeatureSpec, Settings, batch_by_channel, find_deviations
from contrastmill.functions import scalars, stats
from contrastmill.operators import discovery, items, pairs, patterns, priors, pruning, reports, rules, words
from contrastmill.operators import features as feature_ops
from contrastmill.operators import groups as grouping
from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.items import Layout
from contrastmill.plans.deviations import surviving_items, surviving_pairs
from contrastmill.runtime import materialize, shared_directory
from contrastmill.sinks import results
from contrastmill.sources import dictionaries, records, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Support difference used for the queries about pairs, low enough for many of them.
LOW = 0.05


def order_date() -> Column:
    """As text, so that both engines print it alike."""
    return F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")


def query(f: Query) -> Query:
    """Register under the name of the function; a trailing underscore avoids an imported name."""
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def item_label(prefix: str = "") -> Column:
    return F.concat(F.col(f"{prefix}key"), F.lit("="), F.coalesce(F.col(f"{prefix}value"), F.lit("null")))


def pair_labels() -> list[Column]:
    both = F.array_sort(F.array(item_label("lo_"), item_label("hi_")))
    return [F.get(both, F.lit(0)).alias("item1"), F.get(both, F.lit(1)).alias("item2")]


COUNTS = ["count_group", "count_reference"]
TOTALS = ["total_group", "total_reference"]


# -- sources ---------------------------------------------------------------------------------


@query
def load_population(spark, sf):
    source = roles.event_records(spark, sf)
    df = records.load_population(spark, source, "desktop", ["v1", "v2", "v3"], 14, AS_OF)
    return df.select("event_id", F.col("crash_date").cast("string").alias("crash_date"), "version", "signature")


@query
def prune_platform_columns(spark, sf):
    orders = table(spark, sf, "orders").withColumns(
        {"android_model": F.col("o_orderstatus"), "android_brand": F.col("o_orderpriority")}
    )
    return records.prune_platform_columns(orders, "desktop", ["tablet"]).withColumn("o_orderdate", order_date())


@query
def release_versions(spark, sf):
    return versions.release_versions(*roles.part_versions(spark, sf))


@query
def pattern_dictionary(spark, sf):
    lines = roles.page_lines(spark, sf)
    return dictionaries.pattern_dictionary(lines, queries=["link"], false_hits=["/The"])


@query
def error_dictionary(spark, sf):
    lines = roles.page_lines(spark, sf)
    return dictionaries.error_dictionary(lines, queries=["link", "class", "lang"], false_hits=["ad"])


@query
def name_dimension(spark, sf):
    names = table(spark, sf, "nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")
    )
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return reports.name_dimension(customers, "nation", names, "display")


# -- sinks -----------------------------------------------------------------------------------


def _target(spark) -> str:
    return f"{shared_directory(spark)}/published-{uuid.uuid4().hex}"


def _doc_rules(spark, sf):
    found = find_deviations(
        roles.docs(spark, sf), group_column="lang", features=FeatureSet(edges=roles.DOC_EDGES),
        settings=Settings(min_support_diff=LOW),
    )
    return found, materialize(reports.label_items(found.rules))


@query
def write_group_results(spark, sf):
    found, labelled = _doc_rules(spark, sf)
    path = _target(spark)
    results.write_group_results(labelled, found.totals, path)
    back = spark.read.schema("population string, g string, key string, total bigint, results array<string>").json(path)
    return back.select("g", "key", "total", F.size("results").cast("bigint").alias("rules"))


@query
def write_totals(spark, sf):
    tagged = records.assign_channels(roles.event_records(spark, sf), roles.channels(spark, sf))
    path = _target(spark)
    results.write_totals(grouping.reference_total(tagged.withColumn(GROUP, F.lit(None).cast("string"))), AS_OF, path)
    back = spark.read.schema("date string, totals map<string,bigint>").json(path)
    return back.select("date", F.explode("totals").alias("population", "total_reference"))


@query
def write_related_groups(spark, sf):
    found = _word_rules(spark, sf)
    path = _target(spark)
    results.write_related_groups(found, path)
    back = spark.read.schema("population string, g string, total bigint, addons array<string>").json(path)
    return back.select("g", "total", F.size("addons").cast("bigint").alias("rules"))


def _written_rules(spark, path: str, field: str, *more: str) -> DataFrame:
    """The files as they are, a row for each rule of a list, objects as text."""
    whole = F.parse_json(F.col("value")).alias("whole")
    lines = spark.read.text(path).select(F.variant_get(whole, "$.g", "string").alias("g"), whole)
    rules_ = lines.select("g", *[F.variant_get("whole", f"$.{c}", "string").alias(c) for c in more],
                          F.posexplode(F.variant_get("whole", f"$.{field}", "array<variant>")).alias("place", "rule"))
    text = lambda c: F.to_json(F.variant_get("rule", f"$.{c}", "variant")).alias(c)
    return rules_.select("g", *more, (F.col("place") + 1).cast("bigint").alias("place"), text("item"), text("prior"),
                         *[F.variant_get("rule", f"$.{c}", "bigint").alias(c) for c in COUNTS])


def _crossed_rules(spark, sf):
    found = find_deviations(
        roles.crossed_records(spark, sf), group_column="cross", features=FeatureSet(edges=roles.CROSSED_EDGES)
    )
    return found, materialize(reports.label_items(found.rules))


@query
def write_group_results_text(spark, sf):
    """The files of the groups, every rule of them with its place in the list, as written."""
    found, labelled = _crossed_rules(spark, sf)
    path = _target(spark)
    results.write_group_results(labelled, found.totals, path)
    return _written_rules(spark, path, "results", "key", "total")


@query
def write_related_groups_text(spark, sf):
    """The file of groups related to add-ons, every rule of it with its prior, as written."""
    path = _target(spark)
    results.write_related_groups(_word_rules(spark, sf), path)
    return _written_rules(spark, path, "addons", "total")


@query
def overwrite_publish(spark, sf):
    tagged = records.assign_channels(roles.event_records(spark, sf), roles.channels(spark, sf))
    path = _target(spark)
    counted = tagged.groupBy(POPULATION, "version").count()
    results.overwrite_publish(counted, path)
    later = counted.where("population = 'late'").withColumn("count", F.col("count") + 1000)
    results.overwrite_publish(later, path, keep_other_populations=True)
    return spark.read.schema("population string, version string, count bigint").json(path)


# -- projections, filters, groups --------------------------------------------------------------


@query
def filter_date_window(spark, sf):
    df = records.filter_date_window(roles.event_records(spark, sf), "crash_date", AS_OF, 5)
    return df.select("event_id", F.col("crash_date").cast("string").alias("crash_date"))


@query
def filter_product_version(spark, sf):
    df = roles.event_records(spark, sf)
    return records.filter_product_version(df, "tablet", ["v0", "v2"]).select("event_id", "version")


@query
def group_by_equality(spark, sf):
    df = grouping.group_by_equality(table(spark, sf, "documents"), "source", ["src0", "src3", "src9", "none"])
    return df.select("doc_id", "g")


def _predicates():
    return {
        "long": F.col("n_chars") > 2000,
        "english": F.col("lang") == "en",
        "starts with T": F.col("text").startswith("T"),
    }


@query
def group_by_predicate(spark, sf):
    return grouping.group_by_predicate(table(spark, sf, "documents"), _predicates()).select("doc_id", "g")


def _ship_features(df):
    return df.select("l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_quantity") > 25).alias("many"))


@query
def compare_populations(spark, sf):
    lines = table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp")
    both = grouping.compare_populations(
        _ship_features(lines.where(before)), {"later": _ship_features(lines.where(~before))}
    )
    counted = items.item_counts(both, Layout.of(both), overlapping=True)
    return counted.select("g", "key", "value", *COUNTS)


@query
def cohort_filter(spark, sf):
    return records.cohort_filter(
        table(spark, sf, "part"), {"p_type": "PROMO"}, {"p_name": "s"}, {"p_brand": "Brand#3"}, ["p_partkey", "p_brand"]
    )


@query
def build_date_cut(spark, sf):
    build = F.date_format("l_shipdate", "yyyyMMdd")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", build.alias("build_id"),
        scalars.build_before(build, "20000713").alias("before"),
        scalars.build_before(build, "20000713", componentwise=True).alias("before_componentwise"),
    )


@query
def filter_comments(spark, sf):
    text = F.when(F.col("doc_id") % 7 > 0, F.col("text"))
    locale = F.when(F.col("doc_id") % 5 > 0, F.concat("lang", F.lit("-X")))
    df = table(spark, sf, "documents").select("doc_id", text.alias("user_comments"), locale.alias("useragent_locale"))
    return words.filter_comments(df, "user_comments", "useragent_locale").select("doc_id", "useragent_locale")


@query
def optional_projection(spark, sf):
    specs = [
        FeatureSpec(("o_totalprice",), "dear", F.col("o_totalprice") > 250000),
        FeatureSpec(("o_totalprice", "o_comment"), "absent", F.length("o_comment") > 5),
        FeatureSpec(("o_orderstatus", "o_orderpriority"), "both", F.concat("o_orderstatus", "o_orderpriority")),
    ]
    return feature_ops.optional_projection(table(spark, sf, "orders").withColumn("o_orderdate", order_date()), specs)


@query
def drop_non_features(spark, sf):
    return feature_ops.drop_non_features(table(spark, sf, "orders"), ["o_orderdate", "o_custkey", "not_there"])


@query
def rename_legacy_column(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", order_date()).withColumnRenamed("o_orderstatus", "dom_ipc_enabled")
    return feature_ops.rename_legacy_column(orders, "dom_ipc_enabled", "e10s_enabled")


# -- scalar features ---------------------------------------------------------------------------


@query
def addon_presence(spark, sf):
    df = roles.word_records(spark, sf)
    return df.select("doc_id", scalars.addon_presence(F.col("addons"), "the").alias("present"))


@query
def addon_version(spark, sf):
    df = roles.word_records(spark, sf)
    return df.select("doc_id", scalars.addon_version(F.col("addons"), "the").alias("version"))


@query
def module_presence(spark, sf):
    modules = F.col("json_dump.modules.list")
    df = roles.word_records(spark, sf)
    return df.select("doc_id", scalars.module_presence(modules, "que").alias("present"))


@query
def substring_flags(spark, sf):
    flags = {f"p{i}": scalars.contains_text(F.col("text"), p) for i, p in enumerate(PATTERNS)}
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query
def dual_gpu_flag(spark, sf):
    df = roles.devices(spark, sf)
    return df.select("p_partkey", scalars.contains_text(F.col("app_notes"), "Has dual GPUs").alias("dual"))


@query
def not_null_flag(spark, sf):
    df = roles.devices(spark, sf)
    return df.select("p_partkey", scalars.not_null_flag(F.col("adapter_driver_version")).alias("plugin"))


@query
def os_arch(spark, sf):
    arch = scalars.os_arch(F.col("total_virtual_memory"), F.col("platform"), F.col("platform_version"))
    return roles.devices(spark, sf).select("p_partkey", arch.alias("os_arch"))


@query
def driver_version_clean(spark, sf):
    clean = scalars.driver_version_clean(F.col("adapter_vendor_id"), F.col("adapter_driver_version"))
    return roles.devices(spark, sf).select("p_partkey", clean.alias("clean"))


@query
def cpu_info(spark, sf):
    return roles.devices(spark, sf).select("p_partkey", scalars.cpu_info(F.col("cpu_info")).alias("info"))


@query
def is_multicore(spark, sf):
    return roles.devices(spark, sf).select("p_partkey", scalars.is_multicore(F.col("cpu_info")).alias("multicore"))


@query
def positive_flags(spark, sf):
    return roles.devices(spark, sf).select(
        "p_partkey", scalars.positive_flag(F.col("memory_ghost_windows")).alias("ghosts"),
        scalars.positive_flag(F.col("memory_top_none_detached")).alias("detached"),
    )


# -- discovery ---------------------------------------------------------------------------------


def _by_lang(df):
    return grouping.group_by_equality(df, "lang")


@query
def substring_counts(spark, sf):
    tagged = _by_lang(roles.table(spark, sf, "documents"))
    return discovery.substring_counts(tagged, roles.WORD_TEXTS).select("g", "member", *COUNTS)


@query
def addon_counts(spark, sf):
    tagged = _by_lang(roles.word_records(spark, sf))
    counted = discovery.addon_counts(tagged, roles.WORD_ADDONS)
    return items.min_count_filter(counted).select("g", "member", *COUNTS)


@query
def clamp_counts(spark, sf):
    """Raw entry counts, an entry once per mention, capped at the size of the population."""
    tagged = _by_lang(roles.word_records(spark, sf))
    mentions = F.array_compact(F.transform("addons", scalars.addon_name))
    counted = discovery.member_counts(tagged, mentions).join(grouping.group_totals(tagged), [POPULATION, GROUP])
    return items.min_count_filter(discovery.clamp_counts(counted)).select("g", "member", *COUNTS)


@query
def module_counts(spark, sf):
    tagged = _by_lang(roles.word_records(spark, sf))
    counted = discovery.module_counts(tagged, roles.word_modules(), record_id="doc_id")
    return items.min_count_filter(counted).select("g", "member", *COUNTS)


def _pattern_table(spark, sf):
    """Every different word of the benchmark passages, of one letter and more."""
    word = F.explode(F.split("text", " ")).alias("pattern")
    return table(spark, sf, "benchmark").select(word).where("pattern <> ''").distinct()


@query
def pattern_counts(spark, sf):
    """A dictionary table searched for in every document."""
    tagged = _by_lang(roles.spread(spark, sf, "documents"))
    return patterns.pattern_counts(tagged, "text", _pattern_table(spark, sf)).select("g", "member", *COUNTS)


@query
def pattern_members(spark, sf):
    """The strings of the dictionary that each text holds, as an array; its size and its ends."""
    texts = roles.spread(spark, sf, "documents").select("doc_id", "text")
    found = patterns.with_pattern_members(texts, "text", _pattern_table(spark, sf), "members")
    return found.select(
        "doc_id", F.size("members").cast("bigint").alias("n"), F.array_min("members").alias("first"), F.array_max("members").alias("last")
    )


@query
def module_counts_in_job(spark, sf):
    """The job's own counts of modules by record, where a third of the records come twice."""
    records = roles.word_records(spark, sf).drop("addons", "text")
    twice = records.unionByName(records.where("doc_id % 3 = 0"))
    features = FeatureSet(families=(roles.word_modules("doc_id"),), drop=("doc_id", "n_chars", "json_dump", "source"))
    tagged, families = feature_ops.derive_features(_by_lang(twice).drop("lang"), features)
    counted = items.item_counts(tagged, Layout.of(tagged, families)).where("family = 'module'")
    return items.min_count_filter(counted).select("g", F.col("name").alias("member"), *COUNTS)


def _thresholded(spark, sf):
    tagged = _by_lang(roles.word_records(spark, sf))
    totals = grouping.group_totals(tagged)

    def kept(counts, by_reference, family):
        frequent = items.grouped_support(items.min_count_filter(counts), totals)
        return discovery.feature_threshold(frequent, 0.15, by_reference).withColumn("family", F.lit(family))

    addons = kept(discovery.addon_counts(tagged, roles.WORD_ADDONS), True, "addon")
    modules = kept(discovery.module_counts(tagged, roles.word_modules()), False, "module")
    return addons.unionByName(modules)


@query
def feature_threshold(spark, sf):
    return _thresholded(spark, sf).select("family", "g", "member", *COUNTS)


@query
def feature_ids(spark, sf):
    return discovery.feature_ids(_thresholded(spark, sf), F.upper(F.left("family", F.lit(3))))


# -- items and pairs ---------------------------------------------------------------------------


class Chain:
    """The stages of the mining job on the documents, up to a wanted one."""

    def __init__(self, spark, sf, s=LOW):
        self.s = s
        self.tagged = grouping.group_by_equality(roles.docs(spark, sf), "lang").drop("lang")
        self.layout = Layout.of(self.tagged)

    @property
    def totals(self):
        return grouping.group_totals(self.tagged)

    @property
    def counts(self):
        return items.item_counts(self.tagged, self.layout)

    @property
    def supported(self):
        counted = items.grouped_support(items.min_count_filter(self.counts), self.totals)
        return pruning.prune_support(counted, self.s)

    @property
    def level1(self):
        settings = Settings(min_support_diff=self.s)
        return materialize(surviving_items(self.tagged, self.layout, self.totals, settings, False))

    @property
    def pair_counts(self):
        level1 = self.level1
        candidates = materialize(pairs.pair_candidates(level1))
        return pairs.pair_counts(self.tagged, self.layout, level1, candidates)

    @property
    def supported_pairs(self):
        return pruning.prune_support(pruning.with_parent_supports(self.pair_counts), self.s)

    @property
    def scored(self):
        """Both levels with statistics and significance levels."""
        level1 = self.level1
        settings = Settings(min_support_diff=self.s)
        level2 = materialize(surviving_pairs(self.tagged, self.layout, level1, settings, False))
        return rules.with_statistics(rules.layered_alpha(rules.candidate_levels(level1, level2)))

    def linked(self, spark):
        scored = materialize(self.scored)
        singles = rules.significant(rules.support_difference(scored.where("level = 1"), self.s), 0.03)
        accepted = singles.select(POPULATION, GROUP, F.col("lo").alias("other_id"))
        closure = priors.prior_closure(priors.prior_edges(spark, roles.DOC_EDGES))
        found = priors.possible_priors(scored.where("level = 2"), closure)
        found = found.join(accepted, [POPULATION, GROUP, "other_id"], "left_semi")
        return priors.conditional_support(found)


def items_out(df, *more):
    return df.select("g", item_label().alias("item"), "vtype", *COUNTS, *more)


def pairs_out(df, *more):
    return df.select("g", *pair_labels(), *COUNTS, *more)


@query
def reference_total(spark, sf):
    tagged = grouping.group_by_predicate(table(spark, sf, "documents"), _predicates())
    return grouping.reference_total(tagged, overlapping=True).select("total_reference")


@query
def group_totals(spark, sf):
    tagged = grouping.group_by_equality(table(spark, sf, "documents"), "source")
    return grouping.group_totals(tagged).select("g", *TOTALS)


@query
def min_group_filter(spark, sf):
    tagged = grouping.group_by_equality(table(spark, sf, "documents"), "n_chars")
    large, small = grouping.min_group_filter(grouping.group_totals(tagged))
    both = large.withColumn("skipped", F.lit(False)).unionByName(small.withColumn("skipped", F.lit(True)))
    return both.select("g", "total_group", "skipped")


@query
def top_groups(spark, sf):
    df = records.assign_channels(roles.event_records(spark, sf), roles.channels(spark, sf))
    recent = records.filter_date_window(df, "crash_date", AS_OF, 20)
    top = grouping.top_groups(recent, "signature", 4)
    return top.select("population", "g", "total_group", F.col("rank").cast("bigint").alias("rank"))


@query
def item_counts(spark, sf):
    return items_out(Chain(spark, sf).counts)


@query
def min_count_filter(spark, sf):
    return items_out(items.min_count_filter(Chain(spark, sf).counts))


@query
def zero_fill(spark, sf):
    chain = Chain(spark, sf)
    counted = chain.counts
    reference = counted.groupBy("key", "value", "vtype").agg(F.max("count_reference").alias("count_reference"))
    own = counted.where("count_group > 0").select("key", "value", "vtype", "g", "count_group")
    return items_out(items.zero_fill(reference, own, ["key", "value", "vtype"], ["en", "fr", "de", "es"]))


@query
def sparse_zero_fill(spark, sf):
    """Counts of all items in every bucket of ids, with zeros only for those frequent in the reference."""
    tagged = grouping.group_by_equality(_bucketed(spark, sf), "bucket").drop("bucket")
    counted = items.item_counts(tagged, Layout.of(tagged), many_groups=True)
    totals = grouping.group_totals(tagged)
    reference = counted.groupBy("key", "value", "vtype").agg(F.max("count_reference").alias("count_reference"))
    own = counted.select("key", "value", "vtype", "g", "count_group")
    return items_out(items.sparse_zero_fill(reference, own, ["key", "value", "vtype"], totals, 0.15))


BUCKETS = 50


def _bucketed(spark, sf):
    bucket = (F.col("doc_id") % BUCKETS).cast("string")
    docs = roles.spread(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(bucket.alias("bucket"), *roles.doc_features())


@query
def item_ids(spark, sf):
    """Numbers of the surviving items within their column, where every bucket of ids is a group."""
    tagged = grouping.group_by_equality(_bucketed(spark, sf), "bucket").drop("bucket")
    layout = Layout.of(tagged)
    settings = Settings(min_support_diff=0.15)
    found = surviving_items(tagged, layout, grouping.group_totals(tagged), settings, False, many_groups=True)
    rank = F.col("item_id").bitwiseAND(F.lit((1 << 32) - 1))
    return found.select("key", "value", rank.alias("number")).distinct()


@query
def find_deviations_buckets(spark, sf):
    """The job where every bucket of ids is a group."""
    found = find_deviations(_bucketed(spark, sf), group_column="bucket", settings=Settings(min_support_diff=0.15))
    return rules_out(found.rules)


@query
def pair_counts_buckets(spark, sf):
    """Counts of pairs where every bucket of ids is a group."""
    tagged = grouping.group_by_equality(_bucketed(spark, sf), "bucket").drop("bucket")
    layout, settings = Layout.of(tagged), Settings(min_support_diff=0.15)
    level1 = materialize(surviving_items(tagged, layout, grouping.group_totals(tagged), settings, False, many_groups=True))
    candidates = materialize(pairs.pair_candidates(level1))
    return pairs_out(pairs.pair_counts(tagged, layout, level1, candidates))


@query
def grouped_support(spark, sf):
    chain = Chain(spark, sf)
    supported = items.grouped_support(chain.counts, chain.totals)
    return items_out(supported, r6("support_group").alias("support_group"), r6("support_reference").alias("support_reference"))


@query
def pair_candidates(spark, sf):
    return pairs.pair_candidates(Chain(spark, sf).level1).select("g", *pair_labels())


@query
def pair_constraint(spark, sf):
    chain = Chain(spark, sf)
    kid = next(s.kid for s in chain.layout.slots if s.key == "source")
    return pairs.pair_candidates(chain.level1, {kid: ("has_the", "size")}).select("g", *pair_labels())


@query
def pair_counts(spark, sf):
    return pairs_out(Chain(spark, sf).pair_counts)


# -- pruning -----------------------------------------------------------------------------------


@query
def prune_support(spark, sf):
    return pairs_out(Chain(spark, sf).supported_pairs)


@query
def prune_no_change(spark, sf):
    return pairs_out(pruning.prune_no_change(Chain(spark, sf).supported_pairs, LOW), "clear")


@query
def prune_insignificant(spark, sf):
    changed = pruning.prune_no_change(Chain(spark, sf).supported_pairs, LOW)
    return pairs_out(pruning.prune_insignificant(changed))


@query
def prune_false_flag(spark, sf):
    return items_out(pruning.prune_false_flag(Chain(spark, sf).supported))


@query
def prune_null_value(spark, sf):
    return items_out(pruning.prune_null_value(Chain(spark, sf).supported))


@query
def prune_infobar(spark, sf):
    return items_out(pruning.prune_infobar(Chain(spark, sf).supported, ["long", "toxic"]))


@query
def prune_addon_version(spark, sf):
    tagged, layout = _word_table(spark, sf)
    totals = grouping.group_totals(tagged)
    counted = items.grouped_support(items.min_count_filter(items.item_counts(tagged, layout)), totals)
    kept = discovery.keep_discovered(pruning.prune_support(counted, 0.15), layout, 0.15)
    versioned = kept.where(F.col("family").isin("addon", "addon-version"))
    return items_out(pruning.prune_addon_version(versioned))


# -- statistics --------------------------------------------------------------------------------


def _scored_items(spark, sf):
    chain = Chain(spark, sf)
    return rules.with_statistics(items.grouped_support(chain.counts, chain.totals))


@query
def chi2_yates(spark, sf):
    return items_out(_scored_items(spark, sf), r6("chi2").alias("chi2"))


@query
def chi2_pvalue(spark, sf):
    return items_out(_scored_items(spark, sf), r6("p").alias("p"))


@query
def phi_coefficient(spark, sf):
    return items_out(_scored_items(spark, sf), r6("phi").alias("phi"))


@query
def fisher_exact(spark, sf):
    cells = [F.col(c) for c in ("count_group", "lo_count_group", "hi_count_group", "total_group")]
    found = Chain(spark, sf).supported_pairs
    return pairs_out(
        found,
        r6(stats.fisher_exact(*stats.interaction_cells(*cells))).alias("p"),
        r6(stats.fisher_exact(*stats.interaction_cells(*cells, table="contingency"))).alias("p_contingency"),
    )


@query
def independence_check(spark, sf):
    return pairs_out(rules.independence_check(Chain(spark, sf).supported_pairs))


@query
def support_difference(spark, sf):
    return pairs_out(rules.support_difference(Chain(spark, sf).supported_pairs, LOW))


@query
def layered_alpha(spark, sf):
    levels = Chain(spark, sf).scored
    return levels.select(
        "g", "level", "candidates", F.round("alpha", 9).alias("alpha"), F.round("alpha_first", 9).alias("alpha_first")
    ).distinct()


# -- priors ------------------------------------------------------------------------------------


def _part_edges(spark, sf):
    """A graph with cycles over the attributes of parts: brand to type to size class to brand."""
    part = table(spark, sf, "part")
    size = F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string"))
    one = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))
    two = part.select(F.col("p_type").alias("src"), size.alias("dst"))
    three = part.select(size.alias("src"), F.col("p_brand").alias("dst"))
    return one.union(two).union(three).distinct()


@query
def prior_edges(spark, sf):
    """The edges whose two attributes both occur in the documents."""
    found = items.item_counts(Chain(spark, sf).tagged, Chain(spark, sf).layout).select("key").distinct()
    edges = priors.prior_edges(spark, (*roles.DOC_EDGES, ("absent", "source"), ("size", "absent")))
    ends = edges.join(found.withColumnRenamed("key", "src"), "src", "left_semi")
    return ends.join(found.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "dst")


@query
def prior_closure(spark, sf):
    return priors.prior_closure(_part_edges(spark, sf))


@query
def possible_priors(spark, sf):
    chain = Chain(spark, sf)
    closure = priors.prior_closure(priors.prior_edges(spark, roles.DOC_EDGES))
    found = priors.possible_priors(pairs.pair_candidates(chain.level1), closure)
    return found.select("g", item_label("prior_").alias("prior"), item_label("other_").alias("other"))


def _linked_out(df, *more):
    return df.select("g", item_label("prior_").alias("prior"), item_label("other_").alias("other"), *COUNTS, *more)


@query
def conditional_support(spark, sf):
    linked = Chain(spark, sf).linked(spark)
    return _linked_out(linked, r6("given_group").alias("given_group"), r6("given_reference").alias("given_reference"))


@query
def explained_away(spark, sf):
    linked = materialize(Chain(spark, sf).linked(spark))
    gone = priors.explained_away(linked, LOW).withColumnRenamed("item_id", "other_id")
    found = linked.join(gone, [POPULATION, GROUP, "other_id"], "left_semi")
    return found.select("g", item_label("other_").alias("item")).distinct()


@query
def prior_no_effect(spark, sf):
    return _linked_out(priors.prior_no_effect(Chain(spark, sf).linked(spark), LOW))


@query
def best_prior(spark, sf):
    linked = materialize(Chain(spark, sf).linked(spark))
    effective = priors.prior_no_effect(priors.without_explained(linked, priors.explained_away(linked, LOW)), LOW)
    best = priors.best_prior(effective).withColumnRenamed("item_id", "other_id")
    named = linked.select(POPULATION, GROUP, "other_id", item_label("other_").alias("item")).distinct()
    prior = F.concat(F.col("prior.item.key"), F.lit("="), F.coalesce(F.col("prior.item.value"), F.lit("null")))
    return best.join(named, [POPULATION, GROUP, "other_id"]).select(
        "g", "item", prior.alias("prior"), "prior.count_reference", "prior.count_group",
        "prior.total_reference", "prior.total_group",
    )


# -- the whole job and its reports ---------------------------------------------------------------


def rules_out(found: DataFrame) -> DataFrame:
    """Rules as plain columns."""

    def text(i: Column) -> Column:
        return F.concat(i["key"], F.lit("="), F.coalesce(i["value"], F.lit("null")))

    both = F.array_sort(F.transform("items", text))
    return found.select(
        "g", F.get(both, F.lit(0)).alias("item1"), F.get(both, F.lit(1)).alias("item2"), *COUNTS, *TOTALS,
        r6("chi2").alias("chi2"), r6("phi").alias("phi"),
        F.when(F.col("prior").isNotNull(), text(F.col("prior.item"))).alias("prior"),
        F.col("prior.count_group").alias("prior_count_group"),
        F.col("prior.count_reference").alias("prior_count_reference"),
        F.col("prior.total_group").alias("prior_total_group"),
        F.col("prior.total_reference").alias("prior_total_reference"),
    )


@query
def find_deviations_(spark, sf):
    found = find_deviations(roles.docs(spark, sf), group_column="lang", features=FeatureSet(edges=roles.DOC_EDGES))
    return rules_out(found.rules)


@query
def find_deviations_low(spark, sf):
    return rules_out(_doc_rules(spark, sf)[0].rules)


def _word_table(spark, sf):
    tagged = _by_lang(roles.word_records(spark, sf)).drop("lang")
    prepared, families = feature_ops.derive_features(tagged, roles.word_features())
    return prepared, Layout.of(prepared, families)


def _word_rules(spark, sf):
    found = find_deviations(roles.word_records(spark, sf), group_column="lang", features=roles.word_features())
    return reports.label_items(found.rules, roles.word_features().families)


@query
def find_deviations_families(spark, sf):
    """The job with discovered add-ons, versions, modules and text patterns."""
    return rules_out(_word_rules(spark, sf))


@query
def find_deviations_predicates(spark, sf):
    docs = roles.docs(spark, sf)
    groups = {"long or toxic": F.col("long") | (F.col("toxic") == 1), "french": F.col("lang") == "fr"}
    found = find_deviations(docs, predicates=groups, features=FeatureSet(edges=roles.DOC_EDGES))
    return rules_out(found.rules)


@query
def find_deviations_populations(spark, sf):
    docs = roles.docs(spark, sf)
    found = find_deviations(
        docs.where("lang = 'en'").drop("lang"), others={"not english": docs.where("lang <> 'en'").drop("lang")},
        features=FeatureSet(edges=roles.DOC_EDGES),
    )
    return rules_out(found.rules)


@query
def label_items(spark, sf):
    labelled = _word_rules(spark, sf)
    item = F.explode("items").alias("i")
    return labelled.select("g", item).select("g", "i.label", "i.value").distinct()


@query
def deviation_report(spark, sf):
    _, labelled = _doc_rules(spark, sf)
    report = reports.deviation_report(labelled)
    return report.select("g", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query
def find_deviations_crossed(spark, sf):
    """The job on attributes of every type, with pairs, priors and missing values among the rules."""
    return rules_out(_crossed_rules(spark, sf)[0].rules)


@query
def deviation_report_crossed(spark, sf):
    _, labelled = _crossed_rules(spark, sf)
    return reports.deviation_report(labelled).select("g", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query
def support_chart_crossed(spark, sf):
    _, labelled = _crossed_rules(spark, sf)
    return _chart_out(reports.support_chart_table(labelled))


@query
def support_chart_table(spark, sf):
    _, labelled = _doc_rules(spark, sf)
    return _chart_out(reports.support_chart_table(labelled))


def _chart_out(chart):
    return chart.select(
        "g", F.col("position").cast("bigint").alias("position"), "label",
        r6("percent_group").alias("percent_group"), r6("percent_reference").alias("percent_reference"),
    )


@query
def addon_related_groups(spark, sf):
    related = reports.addon_related_groups(_word_rules(spark, sf))
    rule = F.explode("addons").alias("r")
    return related.select("g", "total_group", rule).select(
        "g", "total_group", F.get("r.items", F.lit(0))["label"].alias("label"), "r.count_group", "r.count_reference"
    )


@query
def batch_by_channel_(spark, sf):
    """All channels in one job: the rules of every channel and group."""
    features = FeatureSet(drop=("event_id", "product", "version", "crash_date"))
    batch = batch_by_channel(
        roles.event_records(spark, sf), roles.channels(spark, sf), group_column="signature", as_of=AS_OF,
        product="desktop", days=30, number=5, comment=None, features=features,
        settings=Settings(min_support_diff=0.03),
    )
    flat = rules_out(batch.rules.withColumn(GROUP, F.concat_ws("|", POPULATION, GROUP)))
    return flat.select("g", "item1", "item2", *COUNTS, *TOTALS, "chi2", "phi")


@query
def batch_all_outputs(spark, sf):
    """All channels in one job, with add-ons and comments: sizes, groups, rules with priors, related
    groups and words."""
    batch = batch_by_channel(
        roles.report_records(spark, sf), roles.report_channels(spark, sf), group_column="signature", as_of=AS_OF,
        product="desktop", days=20, word_days=30, number=3, features=roles.report_features(), stem=False,
    )
    out = batch.rows()
    return out.withColumn("place", F.col("place").cast("bigint"))


# -- words -------------------------------------------------------------------------------------


def _comments(spark, sf):
    df = roles.spread(spark, sf, "documents").select("doc_id", "source", "lang", F.col("text").alias("user_comments"))
    return grouping.group_by_equality(words.filter_comments(df, "user_comments", "lang"), "source")


@query
def tokenize(spark, sf):
    tokens = words.tokenize(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(tokens).cast("bigint").alias("tokens"), F.array_join(tokens, "|").alias("joined")
    )


@query
def distinct_words_per_comment(spark, sf):
    df = grouping.with_population(table(spark, sf, "conversations")).withColumn(GROUP, F.col("role"))
    return words.distinct_words_per_comment(df, "text").groupBy("g", "word").agg(F.count(F.lit(1)).alias("comments"))


@query
def concat_words_per_group(spark, sf):
    raw = words.distinct_words_per_comment(_comments(spark, sf), "user_comments")
    return words.concat_words_per_group(raw).select("g", "word", "tf")


@query
def clean_words(spark, sf):
    raw = words.concat_words_per_group(words.distinct_words_per_comment(_comments(spark, sf), "user_comments"))
    return words.clean_words(raw, stem=False).select("g", "word", "tf")


@query
def clean_words_stemmed(spark, sf):
    raw = words.concat_words_per_group(words.distinct_words_per_comment(_comments(spark, sf), "user_comments"))
    return words.clean_words(raw).select("g", "word", "tf")


@query
def stop_words(spark, sf):
    raw = words.concat_words_per_group(words.distinct_words_per_comment(_comments(spark, sf), "user_comments"))
    return words.stop_words(words.clean_words(raw, stem=False)).select("g", "word", "tf")


@query
def term_counts(spark, sf):
    return words.term_counts(_comments(spark, sf), "user_comments", stem=False).select("g", "word", "tf")


@query
def inverse_doc_frequency(spark, sf):
    comments = _comments(spark, sf)
    idf = words.inverse_doc_frequency(words.term_counts(comments, "user_comments", stem=False), comments)
    return idf.select("word", "df", "corpus_tf", r6("idf").alias("idf"))


@query
def top_words(spark, sf):
    ranked = words.top_words(
        roles.spread(spark, sf, "documents"), "source", [f"src{i}" for i in range(12)], comment="text", locale="lang", stem=False
    )
    return ranked.select("g", F.col("rank").cast("bigint").alias("rank"), "word", "tf", r6("tfidf").alias("tfidf"))


@query
def top_words_stemmed(spark, sf):
    ranked = words.top_words(roles.spread(spark, sf, "conversations"), "role", comment="text", locale=None)
    return ranked.select("g", F.col("rank").cast("bigint").alias("rank"), "word", "tf", r6("tfidf").alias("tfidf"))
