"""Exact-target metrics over traces.

``trace``: sample_id, scenario_type, target, start_turn, obs_pos, turn, status, recommendations
(array of ids in order). Scores use the first appearance of the target from ``start_turn`` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import MAX_TURNS, TOP_K
from ..sources.scratch import dealt


def target_rank(values: Column, target: Column) -> Column:
    """1-based place of the target among trimmed ids, or null."""
    place = F.array_position(F.transform(values, lambda v: F.trim(v)), target)
    return F.when(place > 0, place)


def exact_rank(values: Column, target: Column) -> Column:
    """1-based place of the target among ids as they are, or null."""
    place = F.array_position(values, target)
    return F.when(place > 0, place)


def first_target(trace: DataFrame) -> DataFrame:
    """One row a sample: ``turn`` and ``rank`` of the target's first appearance, ids being compared as they are, and its revealed turns."""
    rank = exact_rank(F.col("recommendations"), F.col("target"))
    seen = trace.withColumn("_rank", F.when(F.col("turn") >= F.col("start_turn"), rank))
    first = F.min(F.when(F.col("_rank").isNotNull(), F.struct("obs_pos", F.col("turn").alias("turn"), F.col("_rank").alias("rank"))))
    return seen.groupBy("sample_id").agg(
        F.first("scenario_type").alias("scenario_type"), first.alias("f"), F.count_if(F.coalesce(F.col("status") == "revealed", F.lit(False))).alias("clarification_turns"),
    ).select("sample_id", "scenario_type", F.col("f.turn").alias("target_turn"), F.col("f.rank").alias("target_rank"), "clarification_turns")


def scored(firsts: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Hit, top-1, reciprocal rank and turns to completion of each sample."""
    hit = F.coalesce(F.col("target_rank") <= 10, F.lit(False))
    return firsts.withColumns({
        "hit_at_10": hit, "exact_top1": F.coalesce(F.col("target_rank") == 1, F.lit(False)),
        "mrr": F.when(hit, 1.0 / F.col("target_rank")).otherwise(F.lit(0.0)),
        "mttc": F.when(hit, F.col("target_turn")).otherwise(F.lit(max_turns + 1)).cast("double"),
    })


def _means() -> list[Column]:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    number = lambda c: F.col(c).cast("double")
    return [
        F.count("*").alias("count"), mean(number("hit_at_10")).alias("hit_at_10"), mean(number("exact_top1")).alias("exact_top1"), mean(F.col("mrr")).alias("mrr"),
        mean(F.col("mttc")).alias("mttc"), mean(number("clarification_turns")).alias("mean_clarification_turns"),
        F.count_if("hit_at_10").alias("hits"), F.count_if(~F.col("hit_at_10")).alias("misses"),
    ]


def overall(scores: DataFrame) -> DataFrame:
    """One row of means over all samples; zeros for none."""
    return scores.agg(*_means())


def by_scenario(scores: DataFrame) -> DataFrame:
    """Means by scenario; a missing scenario is "unknown"."""
    return scores.groupBy(F.coalesce("scenario_type", F.lit("unknown")).alias("scenario_type")).agg(*_means())


def summarized(scores: DataFrame) -> DataFrame:
    """All samples (scenario null) and each scenario in one pass; no row for no samples."""
    named = scores.withColumn("scenario_type", F.coalesce("scenario_type", F.lit("unknown")))
    return named.groupingSets([[], ["scenario_type"]], "scenario_type").agg(*_means())


#: What is counted over observations, by column of the trace.
COUNTED = ("status", "route_reason", "question_reason", "reply_reason")


def failed_sessions(trace: DataFrame) -> DataFrame:
    """One row: how many sessions have errors of the protocol."""
    return trace.groupBy("sample_id").agg(F.max("errors").alias("errors")).agg(F.count_if(F.col("errors") > 0).alias("error_count"))


def counters(observations: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, value, n) of the non-empty values of some columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns])
    long = observations.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL AND value <> ''")
    return long.groupBy("kind", "value").agg(F.count("*").alias("n"))


def normalized_recommendations(rows: DataFrame, catalog: DataFrame, limit: int = TOP_K, number: int = 0) -> DataFrame:
    """(key, recommendations) from raw (key, pos, id, score): known ids only, first occurrence, in order, at most ``limit``.

    ``number`` is about how many rows there are, if that is known: many are dealt out so that no task holds more of them when there are more.
    """
    known = dealt(rows.withColumn("id", F.trim("id")).where("id <> ''"), number, "id").join(catalog.select(F.col("parent_asin").alias("id")), "id", "left_semi")
    first = dealt(known, number, "key").groupBy("key", "id").agg(F.min_by("score", "pos").alias("score"), F.min("pos").alias("pos"))
    kept = F.slice(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("parent_asin"), "score"))), 1, max(limit, 1))
    return first.groupBy("key").agg(F.transform(kept, lambda x: F.struct(x["parent_asin"].alias("parent_asin"), x["score"].alias("score"))).alias("recommendations"))
