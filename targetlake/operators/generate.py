"""Generation of samples whose facts identify exactly one product.

Targets are tried in a seeded order: the driver shuffles product numbers and asks
for the targets of a chunk by number. A chunk is solved on Spark. Greedy rounds
keep each target's candidates as bitmaps and count every fact on them. The superset
sums of a signature then give every count that dropping redundant facts, choosing a
prefix and partitioning need, so that all scenarios of all targets are expressions.

Which scenario a target gets depends on the successes before it, modulo the number of
scenarios. So each target is a map of as many states, the maps of a range of targets
are composed where they lie, and the driver composes one map a range and is told the
winners.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ID_LIKE, normalize_text, stable_id
from ..functions.vocab import COLORS, MATERIALS, NEGATIVE, NEGATIVE_UNSAFE_KEYS, NUMERIC, OVERRIDE, PROFILE_SUMMARY, SCENARIOS, SOURCE_WEIGHTS
from ..sources.catalog import category_leaf
from ..sources.scratch import written
from .bitmaps import Numbered, and_count, bit_at, bitmaps, both, fact_bitmaps, subset_histogram
from .facts import make_fact, product_facts, render_fact
from .masks import superset_sums
from .predicates import FACT, match_fact
from .validate import SAMPLE


class GenerationError(RuntimeError):
    """The requested samples can't be made."""


@dataclass(frozen=True)
class GeneratorConfig:
    """Bounds of the search."""

    min_initial_candidates: int = 2
    max_initial_candidates: int = 200
    max_signature_facts: int = 8
    max_attempts_per_sample: int = 250
    max_feature_facts_per_product: int = 80
    #: Targets that are solved together at first; each further chunk is twice as large, up to a hundred times this.
    chunk: int = 50
    #: Catalogs beyond this many rows are searched without feature and description facts.
    large_catalog: int = 1000


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a round's small state."""
    return written(df, "generation")


def fact_pool(catalog: DataFrame, config: GeneratorConfig, large: bool) -> DataFrame:
    """(parent_asin, fact, key): the facts that a signature of the product may use."""
    facts = product_facts(catalog)
    long = facts.select("parent_asin", "pos", F.struct(*[c for c in facts.columns if c not in ("parent_asin", "pos")]).alias("fact"))
    prose = F.col("fact.source").isin("features", "description")
    if large:
        long = long.where(~prose)
    text = F.col("fact.source").isin("features", "description", "title")
    order = W.partitionBy("parent_asin", text).orderBy(F.col("fact.source") != "title", F.length("fact.display"), "fact.fact_id")
    bounded = long.withColumn("_r", F.row_number().over(order)).where(~text | (F.col("_r") <= config.max_feature_facts_per_product))
    key = F.concat_ws("\x1f", "fact.field", "fact.operator", F.coalesce(normalize_text(F.col("fact.value_str")), F.col("fact.value_num").cast("string")))
    first = W.partitionBy("parent_asin", "key").orderBy(text, F.when(text, F.col("_r")).otherwise(F.col("pos")))
    return bounded.withColumn("key", key).withColumn("_k", F.row_number().over(first)).where("_k = 1").select("parent_asin", "fact", "key")


def negative_facts(values: DataFrame, starts: DataFrame, posting: DataFrame) -> DataFrame:
    """(target, fact): a true negative statement that narrows the target's pool.

    ``starts``: target and category, the pool being the products of that category or, if it is null, all. Values are
    counted once a category, however many targets have it.
    """
    key = F.substring(F.col("field"), F.lit(8), F.length("field"))
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(key, w))
    attribute = (
        F.when(holds(("color", "colour", "shade")), "color").when(holds(("material", "fabric", "fiber")), "material")
        .when(holds(("size", "sizing", "width", "length")), "size").when(holds(("style", "pattern", "shape", "closure", "neck", "sleeve")), "style")
    )
    details = values.select("parent_asin", F.explode_outer("indexed").alias("v")).select("parent_asin", "v.field", "v.value").where(F.col("field").startswith("detail:") & ~holds(NEGATIVE_UNSAFE_KEYS)).withColumn("attribute", attribute).where("attribute IS NOT NULL")
    words = values.select("parent_asin", F.explode_outer("vals").alias("v")).select("parent_asin", "v.field", "v.value").where(F.col("field").isin("color", "material"))
    words = words.where(F.col("value").isin(*COLORS, *MATERIALS)).withColumn("attribute", F.col("field"))
    every = details.unionByName(words)
    used = starts.select("category").distinct()
    members = posting.where("field = 'category'").select(F.col("value").alias("category"), "parent_asin").join(used.where("category IS NOT NULL"), "category", "left_semi")
    if not used.where("category IS NULL").isEmpty():
        members = members.unionByName(values.select(F.lit(None).cast("string").alias("category"), "parent_asin"))
    big = members.groupBy("category").agg(F.count("*").alias("n")).where("n >= 3").select(F.col("category").alias("_c"))
    counted = members.join(every, "parent_asin").groupBy("category", "field", "value", "attribute").agg(F.count("*").alias("n"))
    counted = counted.join(big, F.col("category").eqNullSafe(F.col("_c")), "left_semi").withColumnRenamed("category", "_c")
    own = every.select(F.col("parent_asin").alias("target"), "field", "value").join(starts.select("target"), "target", "left_semi").groupBy("target", "field").agg(F.collect_set("value").alias("own"))
    pairs = starts.join(counted, F.col("category").eqNullSafe(F.col("_c"))).join(own, ["target", "field"], "left")
    false_here = ~F.exists(F.coalesce("own", F.array().cast("array<string>")), lambda v: F.contains(v, F.col("value")))
    stated = pairs.where(false_here & (F.when(F.col("field").startswith("detail:"), F.col("own").isNotNull()).otherwise(F.col("n") >= 2)))
    place = F.struct(F.when(F.col("field") == "material", 2).when(F.col("field") == "color", 1).otherwise(0).alias("a"), F.col("field").alias("b"), (-F.col("n")).alias("c"), F.col("value").alias("d"))
    best = stated.groupBy("target").agg(F.min_by(F.struct("field", "value", "attribute"), place).alias("b")).select("target", "b.*")
    return best.select("target", make_fact(F.col("field"), "neq", F.col("value"), "cross_catalog", F.col("value"), F.col("attribute"), "negative").alias("fact"))


def signatures(numbered: Numbered, posting: DataFrame, pool: DataFrame, targets: DataFrame, config: GeneratorConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target, variant, facts, fids): identifying facts in the order chosen; variant ``negative`` starts with a negative fact too.

    ``pool`` is the targets' facts (target, fact, key), ``targets``: target and number. Also returns the pool with fact
    numbers and the facts' bitmaps.
    """
    start = targets.join(pool.where("fact.field = 'category'").groupBy("target").agg(F.first("fact").alias("category"), F.first("key").alias("ckey")), "target", "left")
    start = _kept(start)
    negative = _kept(negative_facts(numbered.values, start.select("target", F.col("category.value_str").alias("category")), posting))
    every = pool.select("fact").unionByName(negative.select("fact"))
    same = F.xxhash64(F.to_json(F.struct("fact.field", "fact.operator", "fact.value_str", "fact.value_num")))
    distinct = _kept(every.groupBy(same.alias("fid")).agg(F.first("fact").alias("fact")))
    bits = _kept(fact_bitmaps(numbered, distinct))
    pool = pool.withColumn("fid", same)
    # Only facts whose bitmap has the target are tried.
    at = start.select("target", F.floor(F.col("number") / 32768).alias("block"), (F.col("number") % 32768).alias("at"))
    true = pool.join(at, "target").join(bits, ["fid", "block"]).where(bit_at(F.col("bits"), F.col("at"))).select("target", "key", "fid", "fact")
    true = _kept(true.where(~F.col("fact.display").rlike(ID_LIKE)))
    by_category = start.where("category IS NOT NULL").withColumn("fact", F.col("category")).withColumn("fid", same)
    with_category = by_category.select("target", "fid").join(bits, "fid").select("target", "block", "bits")
    bare = [F.lit(r["target"]) for r in start.where("category IS NULL").select("target").collect()]  # of one chunk: every product is a candidate
    begun = with_category.unionByName(numbered.whole.select(F.explode(F.array(*bare)).alias("target"), "block", "bits")) if bare else with_category
    state = by_category.select("target", F.lit("base").alias("variant"), F.array("category").alias("facts"), F.array("ckey").alias("keys"), F.array("fid").alias("fids"))
    if bare:
        none = start.where("category IS NULL").select("target", F.lit("base").alias("variant"), F.array().cast(f"array<{FACT}>").alias("facts"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<bigint>").alias("fids"))
        state = state.unionByName(none)
    told = negative.withColumn("nfid", same)
    with_negative = state.join(told, "target").select("target", F.lit("negative").alias("variant"), F.concat("facts", F.array("fact")).alias("facts"), "keys", F.concat("fids", F.array("nfid")).alias("fids"))
    cut = begun.join(told.select("target", F.col("nfid").alias("fid")), "target").join(bits.withColumnRenamed("bits", "_bits"), ["fid", "block"]).select("target", "block", both("bits", "_bits").alias("bits"))
    cands = _kept(begun.withColumn("variant", F.lit("base")).unionByName(cut.withColumn("variant", F.lit("negative"))))
    state = _kept(state.unionByName(with_negative))
    source = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("fact.source")), F.lit(0.65))
    for _ in range(config.max_signature_facts):
        sizes = cands.groupBy("target", "variant").agg(F.sum(F.bitmap_count("bits")).alias("current"))
        active = sizes.join(state, ["target", "variant"]).where((F.col("current") > 1) & (F.size("facts") < config.max_signature_facts)).select("target", "variant", "current", "keys")
        tried = _kept(active.join(true, "target").where(~F.array_contains("keys", F.col("key"))).drop("keys"))
        if tried.isEmpty():
            break
        # A row for each fact and block that has both, not for each product.
        shared = cands.join(tried.select("target", "variant", "fid"), ["target", "variant"]).join(bits.withColumnRenamed("bits", "_bits"), ["fid", "block"])
        counted = shared.select("target", "variant", "fid", and_count("bits", "_bits").alias("n")).groupBy("target", "variant", "fid").agg(F.sum("n").alias("n"))
        scored = tried.join(counted, ["target", "variant", "fid"]).where("n < current")
        gain = (F.col("current") - F.col("n")).cast("double")
        ratio = (gain / F.greatest("current", F.lit(1))) * source * F.when(F.col("n") == 1, 0.45).otherwise(1.0)
        score = F.struct(ratio.alias("a"), gain.alias("b"), (-F.col("n")).alias("c"), (-F.length("fact.display")).alias("d"), F.col("fact.fact_id").alias("e"))
        best = _kept(scored.groupBy("target", "variant").agg(F.max_by(F.struct("fact", "key", "fid"), score).alias("b")))
        if best.isEmpty():
            break
        with_best = lambda column, name: F.when(F.col("b").isNotNull(), F.concat(column, F.array(f"b.{name}"))).otherwise(F.col(column)).alias(column)
        state = _kept(state.join(best, ["target", "variant"], "left").select("target", "variant", with_best("facts", "fact"), with_best("keys", "key"), with_best("fids", "fid")))
        chosen = best.select("target", "variant", "b.fid")
        narrowed = cands.join(chosen, ["target", "variant"]).join(bits.withColumnRenamed("bits", "_bits"), ["fid", "block"]).select("target", "block", both("bits", "_bits").alias("bits"), "variant")
        cands = _kept(cands.join(chosen, ["target", "variant"], "left_anti").select("target", "block", "bits", "variant").unionByName(narrowed.where(F.bitmap_count("bits") > 0)))
    # The target satisfies all of its facts, so one candidate is the target.
    single = cands.groupBy("target", "variant").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n = 1")
    return state.join(single, ["target", "variant"], "left_semi").select("target", "variant", "facts", "fids"), pool, bits


def least_values(values: DataFrame, key: str, value: str, k: int, parts: int = 32) -> DataFrame:
    """The rows of the k least distinct values of each key: of each of ``parts`` salted parts first, then of what these leave."""

    def first(rows: DataFrame, *by: Column | str) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(value))).where(F.col("_r") <= k).drop("_r")

    return first(first(values.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(parts))), key, "_part").drop("_part"), key)


def decoys(catalog: DataFrame, posting: DataFrame, found: DataFrame) -> DataFrame:
    """(target, variant, pos, fact): for each signature fact the first value of its field that is false for the target."""
    raw = lambda field, value: catalog.select(F.lit(field).alias("field"), value.alias("raw"))
    details = catalog.select(F.explode("details").alias("e")).select(F.concat(F.lit("detail:"), normalize_text(F.col("e.key"))).alias("field"), F.col("e.value").alias("raw"))
    tokens = catalog.select(F.lit("title_token").alias("field"), F.explode(F.split(F.lower("title"), r"\s+")).alias("raw"))
    every = raw("category", category_leaf(F.col("categories"))).unionByName(raw("store", F.col("store"))).unionByName(details).unionByName(tokens).where("raw <> ''").distinct()
    every = every.withColumn("value", normalize_text(F.col("raw"))).where((F.col("field") != "title_token") | (F.length("value") >= 4))
    every = every.join(posting.select("field", "value").distinct(), ["field", "value"], "left_semi")
    facts = found.select("target", "variant", F.posexplode("facts").alias("pos", "f"))
    # Of a field's values in order, as many as any target has in it and two more hold a false one; forms may share a value.
    mine = _kept(posting.join(found.select(F.col("target").alias("parent_asin")).distinct(), "parent_asin", "left_semi"))
    owned = mine.groupBy("parent_asin", "field").count().agg(F.max("count")).first()[0] or 0
    every = every.groupBy("field", "value").agg(F.min("raw").alias("raw"))
    first = least_values(every, "field", "raw", owned + 2)
    own = mine.select(F.col("parent_asin").alias("target"), "field", F.col("value").alias("own"))
    wanted = facts.select("target", "variant", "pos", "f", F.col("f.field").alias("field")).join(first, "field")
    false_ones = wanted.where(F.col("value") != normalize_text(F.col("f.value_str"))).join(own, (own["target"] == wanted["target"]) & (own["field"] == wanted["field"]) & (F.col("own") == F.col("value")), "left_anti")
    fact = make_fact(F.col("field"), "eq", F.col("value"), "decoy", F.col("raw"), F.col("f.attribute"), "decoy")
    return false_ones.groupBy("target", "variant", "pos").agg(F.min_by(fact, F.col("raw")).alias("fact"))


def solved(numbered: Numbered, catalog: DataFrame, posting: DataFrame, targets: DataFrame, config: GeneratorConfig) -> DataFrame:
    """What composing needs of each target and variant, written.

    (target, number, variant, all, first, counts, decoys, leaf): the signature and after it two true facts that a short
    signature may need for a change of mind, ``first`` being the number of signature facts; counts of all subsets;
    decoys by place.
    """
    mine = catalog.join(targets.select(F.col("target").alias("parent_asin")), "parent_asin", "left_semi")
    facts = _kept(fact_pool(mine, config, numbered.size > config.large_catalog).withColumnRenamed("parent_asin", "target"))
    found, pool, bits = signatures(numbered, posting, facts, targets, config)
    found = _kept(found)
    own = pool.join(numbered.values.withColumnRenamed("parent_asin", "target"), "target").where(match_fact(F.col("fact")))
    order = F.struct(~F.col("fact.source").isin("categories", "details", "store"), F.length("fact.display"), F.col("fact.fact_id"))
    # Of two different facts at least one differs from the single fact that is left of a short signature.
    extras = own.groupBy("target").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("fact").alias("fact"), F.col("fid").alias("fid")))), 1, 2).alias("x"))
    held = found.join(extras, "target", "left")
    none, no_ids = F.array().cast(f"array<{FACT}>"), F.array().cast("array<bigint>")
    held = held.select(
        "target", "variant", F.size("facts").alias("first"), F.concat("facts", F.coalesce(F.transform("x", lambda e: e["fact"]), none)).alias("all"), F.concat("fids", F.coalesce(F.transform("x", lambda e: e["fid"]), no_ids)).alias("fids"),
        F.concat_ws("\x1f", "target", "variant").alias("sample_id"),
    )
    held = _kept(held)
    rows = held.select("sample_id", F.posexplode("fids").alias("pos", "fid")).join(bits, "fid").groupBy("sample_id", "block").agg(F.collect_list(F.struct("pos", "bits")).alias("facts"))
    counts = superset_sums(subset_histogram(rows), config.max_signature_facts + 2)
    false_ones = decoys(catalog, posting, found).groupBy("target", "variant").agg(F.collect_list(F.struct("pos", "fact")).alias("decoys"))
    leaf = mine.select(F.col("parent_asin").alias("target"), category_leaf(F.col("categories")).alias("leaf"))
    out = held.join(counts, "sample_id").join(false_ones, ["target", "variant"], "left").join(leaf, "target").join(targets, "target")
    return _kept(out.select("target", "number", "variant", "all", "first", "counts", "decoys", "leaf"))


def minimal(counts: Column, first: Column, protected: Column) -> Column:
    """Places of the facts that stay when, one after the other, each is dropped if the others still single out one product.

    ``counts`` are superset sums, ``first`` the number of facts, ``protected`` whether each must stay.
    """
    one = F.lit(1).cast("bigint")
    shifted = lambda p: F.call_function("shiftleft", one, p.cast("int"))
    places = F.sequence(F.lit(0), first - 1)

    def dropped(kept: Column, p: Column) -> Column:
        rest = kept.bitwiseAND(F.bitwise_not(shifted(p)))
        return F.when((rest != 0) & ~F.get(protected, p) & (F.get(counts, rest.cast("int")) == 1), rest).otherwise(kept)

    kept = F.aggregate(places, shifted(first) - 1, dropped)
    return F.filter(places, lambda p: kept.bitwiseAND(shifted(p)) != 0)


def count_of(counts: Column, places: Column) -> Column:
    """How many products satisfy the facts at all of some places."""
    zero = F.lit(0).cast("bigint")
    mask = F.aggregate(places, zero, lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p.cast("int"))))
    return F.get(counts, mask.cast("int"))


def prefix_length(prefix: Column, low: int, high: int) -> Column:
    """How many facts are told at first: the longest prefix whose count lies within the bounds and is ambiguous; else one if that is ambiguous, else all."""
    fits = F.transform(prefix, lambda n, k: F.when(n.between(low, high) & (n > 1), k + 1))
    return F.coalesce(F.array_max(fits), F.when(F.get(prefix, 0) > 1, 1).otherwise(F.size(prefix)))


def composed(rows: DataFrame, scenarios: Iterable[str], config: GeneratorConfig) -> DataFrame:
    """The solved rows by scenario, with places of the facts in each part; only those that make a sample."""
    every = F.explode(F.array(*map(F.lit, sorted(set(scenarios))))).alias("scenario")
    s, counts, first = F.col("scenario"), F.col("counts"), F.col("first")
    wanted = rows.select("*", every).where(F.col("variant") == F.when(s == "negative_constraint", "negative").otherwise("base"))
    guard = F.transform("all", lambda f: F.when(s == "negative_constraint", (f["polarity"] == "negative") | f["operator"].isin(*NEGATIVE)).when(s == "budget_rating", f["field"].isin(*NUMERIC)).otherwise(F.lit(False)))
    same = F.transform("all", lambda f: F.to_json(F.struct(f["field"], f["operator"], f["value_str"], f["value_num"])))
    out = wanted.withColumn("_guard", guard).withColumn("_same", same).withColumn("chosen", minimal(counts, first, F.col("_guard")))
    later = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda p: (p >= first) & (F.get(F.col("_same"), p) != F.get(F.col("_same"), F.get(F.col("chosen"), 0))))
    short = (s == "intent_override") & (F.size("chosen") < 2)
    # Written before each use in conditions, which Spark would else push down with all that they are made of.
    out = _kept(out.withColumn("chosen", F.when(short, F.concat("chosen", F.slice(later, 1, 1))).otherwise(F.col("chosen"))).drop("_same", "_guard"))
    facts = F.transform("chosen", lambda p: F.get(F.col("all"), p))
    out = out.where((s != "intent_override") | (F.size("chosen") >= 2))
    out = out.where((s != "budget_rating") | F.exists(facts, lambda f: f["field"].isin("price", "rating"))).where((s != "negative_constraint") | F.exists(facts, lambda f: f["polarity"] == "negative"))
    low, high = config.min_initial_candidates, config.max_initial_candidates
    out = _kept(out.withColumn("_prefix", F.transform("chosen", lambda p, k: count_of(counts, F.slice(F.col("chosen"), F.lit(1), k + 1)))))
    told = prefix_length(F.col("_prefix"), low, high)
    # Something stays hidden, but where all is shown.
    ask = F.when(~s.isin("direct_search", "intent_override") & (told == F.size("chosen")) & (told > 1), 1).otherwise(0)
    out = _kept(out.withColumn("_told", F.when(s == "direct_search", F.size("chosen")).when(s == "intent_override", F.least(told, F.size("chosen") - 1)).otherwise(told - ask)))
    few = F.when((s == "clarification_required") & (F.col("_told") > 2), 1).when(s.isin("profile_hidden", "multi_constraint", "budget_rating") & (F.col("_told") > 1), 1).otherwise(0)
    part = lambda start, length: F.slice("chosen", start, length)
    out = _kept(out.withColumns({
        "initial": F.get("_prefix", F.col("_told") - 1), "query": part(F.lit(1), F.col("_told") - few), "profile": part(F.col("_told") - few + 1, few), "hidden": part(F.col("_told") + 1, F.size("chosen") - F.col("_told")),
        "decoy": F.get(F.filter(F.transform("chosen", lambda p: F.get(F.filter("decoys", lambda d: d["pos"] == p), 0)["fact"]), lambda d: d.isNotNull()), 0), "_left": F.get("_prefix", F.size("chosen") - 1),
    }))
    out = out.where((s != "intent_override") | F.col("decoy").isNotNull()).where((s != "clarification_required") | (F.size("hidden") > 0)).where((s != "profile_hidden") | (F.size("profile") > 0))
    out = out.where((s == "direct_search") | F.col("initial").between(low, high)).where("_left = 1")
    return out.select("number", "target", "scenario", "all", "chosen", "query", "profile", "hidden", "decoy", "initial", "leaf")


def written_out(winners: DataFrame, seed: int) -> DataFrame:
    """Samples (see ``SAMPLE``) from composed rows with ``index``, their place among the samples."""
    index, s = F.col("index").cast("int"), F.col("scenario")
    fact = lambda p: F.get(F.col("all"), p)
    facts = lambda column: F.transform(column, fact)
    said = lambda column, shift, reply=False: F.transform(column, lambda p, k: render_fact(fact(p), k + shift, reply))

    def filled(template: str, **values: Column) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            text, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            pieces += [F.lit(text), values[name]]
        return F.concat(*pieces, F.lit(rest))

    override = s == "intent_override"
    new = fact(F.get("hidden", 0))
    old = F.col("decoy")
    tags = F.transform(said("profile", F.lit(1)), lambda t: F.rtrim(t, F.lit(".")))
    starred = F.filter(facts("profile"), lambda f: (f["field"] == "rating") & f["operator"].isin("ge", "min"))
    stars = F.get(starred, 0)["value_num"]
    text = lambda c: c.cast("string")
    meta = F.create_map(*[x for k, v in {
        "generator": F.lit("deterministic-v1"), "initial_candidate_count": text(F.col("initial")), "full_candidate_count": F.lit("1"), "target_category": F.col("leaf"), "signature_size": text(F.size("chosen")),
        "visible_fact_count": text(F.size("query") + F.size("profile")), "clarification_fact_count": text(F.size("hidden")),
    }.items() for x in (F.lit(k), v)])
    number = lambda n: F.when(n == 0, "").otherwise(n.cast("string"))
    columns = {
        "sample_id": F.format_string("nlb-%05d-%s", index, stable_id(number(F.lit(seed)), number(index), F.col("target"))), "seed": F.lit(seed * 1000003) + F.col("index"), "schema_version": F.lit(1), "scenario_type": s, "target": F.col("target"),
        "query": F.concat(F.array_join(said("query", index), " "), F.when(override, filled(OVERRIDE["query"], old=old["display"])).otherwise("")),
        "user_profile": F.struct(
            F.when(s == "budget_rating", "regular").otherwise("occasional"), stars, F.when(stars.isNull(), "balanced").otherwise("quality-conscious"), tags, F.array_join(F.concat(F.array(F.lit(PROFILE_SUMMARY)), tags), " "),
        ),
        "signature": facts("chosen"), "query_facts": facts("query"), "profile_facts": facts("profile"), "clarification_facts": facts("hidden"),
        "replies": F.zip_with(facts("hidden"), said("hidden", index, True), lambda f, t: F.struct(f["fact_id"], t)),
        "override": F.when(override, F.struct(F.lit(2), old, new, old["fact_id"], filled(OVERRIDE["message"], old=old["display"], new=new["display"]))), "metadata": meta,
    }
    schema = winners.sparkSession.createDataFrame([], SAMPLE).schema
    return winners.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema])


def walked(tried: DataFrame, states: int, done: int, count: int) -> list[tuple[int, int]]:
    """(place, index) of the targets that become samples ``done`` to ``count - 1``.

    ``tried``: place and fits, an array that tells for each of the ``states`` scenarios whether the target makes a sample
    of it. A target is a map of states: one on if it fits the state, else the same. Ranges of places are composed where
    they lie; then the state before each is known, and each tells its winners.
    """
    ranged = written(tried.repartitionByRange("place").withColumn("part", F.spark_partition_id().cast("long")), "walk")

    def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_values("place")
        return rows["place"].to_numpy(), np.array(rows["fits"].tolist(), bool).reshape(-1, states)

    def maps(rows: pd.DataFrame) -> pd.DataFrame:
        places, fits = matrix(rows)
        gained = np.zeros(states, np.int64)
        start = np.arange(states)
        for row in fits[fits.any(axis=1)]:
            gained += row[(start + gained) % states]
        return pd.DataFrame({"first": [int(places[0])], "part": [int(rows["part"].iloc[0])], "gained": [gained.tolist()]})

    composed_maps = sorted(map(tuple, ranged.groupBy("part").applyInPandas(maps, "first long, part long, gained array<long>").collect()))  # a row for each range
    before, known = {}, done
    for _, part, gained in composed_maps:
        before[part] = known
        known += gained[known % states]

    def winners(rows: pd.DataFrame) -> pd.DataFrame:
        places, fits = matrix(rows)
        at, out = before[int(rows["part"].iloc[0])], []
        for place, row in zip(places.tolist(), fits, strict=True):
            if at < count and row[at % states]:
                out.append((place, at))
                at += 1
        return pd.DataFrame(out, columns=["place", "index"])

    return sorted(tuple(r) for r in ranged.groupBy("part").applyInPandas(winners, "place long, index long").collect())  # samples to make, at most


def generated(catalog: DataFrame, posting: DataFrame, count: int, seed: int = 42, config: GeneratorConfig | None = None, scenarios: Iterable[str] = SCENARIOS, require_coverage: bool | None = None) -> DataFrame:
    """``count`` samples (see ``SAMPLE``), the same for the same seed and catalog."""
    config = config or GeneratorConfig()
    spark: SparkSession = catalog.sparkSession
    wanted = tuple(scenarios) or SCENARIOS
    if unknown := sorted(set(wanted) - set(SCENARIOS)):
        raise GenerationError(f"no such scenario: {', '.join(unknown)}")
    if config.max_signature_facts > 14:
        raise GenerationError("a signature has 14 facts at most: all subsets of them are counted")
    if require_coverage is None:
        require_coverage = wanted == SCENARIOS and count >= len(SCENARIOS)
    numbered = Numbered(catalog, posting)
    # The seeded order is one of whole numbers; ids are fetched by number, a chunk at a time.
    order = array("q", range(numbered.size if count > 0 else 0))
    rng = random.Random(seed)
    rng.shuffle(order)
    limit = count * config.max_attempts_per_sample
    chosen: dict[int, tuple[int, str]] = {}  # number: its index and scenario
    parts: list[DataFrame] = []  # composed rows of the targets solved so far
    known: set[int] = set()
    attempts = cursor = before_pass = 0
    size = config.chunk
    while len(order) and len(chosen) < count and attempts < limit:
        if cursor >= len(order):
            if len(chosen) == before_pass:
                attempts = limit  # a pass without a success is followed by others like it
                break
            rng.shuffle(order)
            cursor, before_pass = 0, len(chosen)
        chunk = order[cursor : cursor + min(size, limit - attempts)]
        size = min(2 * size, 100 * config.chunk)
        fresh = [n for n in chunk if n not in known]
        if fresh:
            targets = numbered.ids.join(F.broadcast(spark.createDataFrame([(n,) for n in fresh], "number long")), "number").select(F.col("parent_asin").alias("target"), "number")
            parts.append(_kept(composed(solved(numbered, catalog, posting, _kept(targets), config), wanted, config)))
            known.update(fresh)
        open_places = [(cursor + k, n) for k, n in enumerate(chunk) if n not in chosen]
        won: list[tuple[int, int]] = []
        if open_places:
            asked = F.broadcast(spark.createDataFrame(open_places, "place long, number long"))
            fits = F.collect_set("scenario")
            able = _union(parts).select("number", "scenario").join(asked, "number").groupBy("place").agg(fits.alias("s"))
            won = walked(able.select("place", F.array(*[F.array_contains("s", x) for x in wanted]).alias("fits")), len(wanted), len(chosen), count)
        chosen |= {order[place]: (index, wanted[index % len(wanted)]) for place, index in won}
        tried = len(chunk) if len(chosen) < count else won[-1][0] - cursor + 1
        attempts, cursor = attempts + tried, cursor + tried
    if len(chosen) < count:
        raise GenerationError(f"found {len(chosen)} of {count} samples in {attempts} tries; fewer samples or wider bounds may help")
    if require_coverage and (missing := sorted(set(wanted) - {s for _, s in chosen.values()})):
        raise GenerationError(f"no sample of {', '.join(missing)}")
    if not chosen:
        return spark.createDataFrame([], SAMPLE)
    winners = spark.createDataFrame([(n, i, s) for n, (i, s) in chosen.items()], "number long, index long, scenario string")
    return _kept(written_out(_union(parts).join(winners, ["number", "scenario"]), seed)).orderBy("sample_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
