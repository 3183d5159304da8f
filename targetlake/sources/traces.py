"""Recorded sessions (JSON lines) as the trace table that metrics read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import check_json_lines, read_json_lines

TRACE = "sample_id string, scenario_type string, target string, start_turn int, obs_pos int, turn int, status string, recommendations array<string>, route_reason string, question_reason string, reply_reason string, errors int"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _whole(value: Column) -> Column:
    """A number cut towards zero, or a text that is a whole number; null otherwise."""
    kind, text = _kind(value), F.trim(F.try_variant_get(value, "$", "string"))
    number = F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).otherwise(text.try_cast("double").cast("int"))
    return F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d{1,9}$"), text.try_cast("int"))).when(kind.isin("VOID", "ABSENT") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(None)).otherwise(number)


def spoken(value: Column) -> Column:
    """A value as text; null, false, zero and what is empty give the empty text."""
    kind, text = _kind(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    number = F.when(text.try_cast("double") == 0, "").otherwise(text)
    return F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.when(text == "true", "True").otherwise("")).when(kind.isin("VOID", "ABSENT"), "").otherwise(number)


def recommended(payload: Column) -> Column:
    """(parent_asin, score) of each item of a recommendation payload, in order, before unknown and repeated ids are dropped.

    An item is an object with ``parent_asin`` or else ``product_id``, or the id itself; ids are trimmed. Numbers are
    scores, truth values and texts are not. What is no list has no items.
    """
    items = F.when(_kind(payload).startswith("ARRAY"), F.try_variant_get(payload, "$", "array<variant>"))

    def item(x: Column) -> Column:
        of = lambda name: F.try_variant_get(x, f"$.{name}", "variant")
        own, other, score = spoken(of("parent_asin")), spoken(of("product_id")), _kind(of("score"))
        ident = F.when(_kind(x).startswith("OBJECT"), F.when(own != "", own).otherwise(other)).otherwise(spoken(x))
        number = F.when((score == "BIGINT") | (score == "DOUBLE") | score.startswith("DECIMAL") | (score == "FLOAT"), F.try_variant_get(x, "$.score", "double"))
        return F.struct(F.trim(ident).alias("parent_asin"), number.alias("score"))

    return F.coalesce(F.transform(items, item), F.array().cast("array<struct<parent_asin:string,score:double>>"))


def observed(lines: DataFrame) -> DataFrame:
    """Rows of ``TRACE`` from parsed lines (``value``, ``j``), one for each observation.

    A session's observations are its ``trace``, or its ``turns`` if it has no ``trace``.
    Observations that are no objects are left out; one whose recommendations are no
    list has none. A recommendation is a product id or an object that holds it.
    """
    of = lambda at, kind="string": F.try_variant_get("j", at, kind)
    listed = F.when(of("$.trace", "variant").isNotNull(), of("$.trace", "array<variant>")).otherwise(of("$.turns", "array<variant>"))
    start = F.greatest(F.coalesce(_whole(of("$.metrics_start_turn", "variant")), F.lit(1)), F.lit(1))
    sessions = lines.select(
        of("$.sample_id").alias("sample_id"), of("$.scenario_type").alias("scenario_type"), F.coalesce(of("$.target_parent_asin"), F.lit("")).alias("target"), start.alias("start_turn"),
        F.coalesce(listed, F.array().cast("array<variant>")).alias("seen"), F.coalesce(F.size(of("$.errors", "array<variant>")), F.lit(0)).alias("errors"),
    )
    rows = sessions.select("sample_id", "scenario_type", "target", "start_turn", "errors", F.posexplode_outer("seen").alias("obs_pos", "o"))
    at = lambda path, kind="string": F.try_variant_get("o", path, kind)
    ids = F.transform(at("$.recommendations", "array<variant>"), lambda r: F.when(_kind(r).startswith("OBJECT"), F.try_variant_get(r, "$.parent_asin", "string")).otherwise(F.try_variant_get(r, "$", "string")))
    reason = lambda path: spoken(at(f"$.simulator_diagnostics.{path}", "variant"))
    real = F.col("o").isNull() | _kind(F.col("o")).startswith("OBJECT")
    return rows.where(real).select(
        "sample_id", "scenario_type", "target", "start_turn", "obs_pos", F.coalesce(_whole(at("$.turn", "variant")), F.lit(0)).alias("turn"), at("$.simulator_status").alias("status"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("recommendations"), reason("route_reason").alias("route_reason"), reason("question_interpretation.reason").alias("question_reason"),
        reason("reply_reason").alias("reply_reason"), "errors",
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """The trace table of a file of recorded sessions; a session without observations has one empty row."""
    check_json_lines(spark, path)
    return observed(read_json_lines(spark, path))
