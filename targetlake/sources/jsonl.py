"""Samples and reports as JSON lines and JSON: compact, keys sorted, nulls kept."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_number
from ..operators.facts import number_text
from ..operators.predicates import FACT
from ..operators.validate import SAMPLE
from .catalog import check_json_lines, read_json_lines


def fact_json(fact: Column) -> Column:
    """A fact as in the files: one value, a text or a number, keys in order."""
    value = F.when(fact["value_kind"] == "str", F.to_json(F.array(fact["value_str"]))).otherwise(F.concat(F.lit("["), F.when(fact["value_kind"] == "int", fact["value_num"].cast("bigint").cast("string")).otherwise(number_text(fact["value_num"])), F.lit("]")))
    rest = F.to_json(F.struct(*[fact[c].alias(c) for c in ("attribute", "display", "fact_id", "field", "operator", "polarity", "source")]), {"ignoreNullFields": "false"})
    return F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"value":'), F.substring(value, F.lit(2), F.length(value) - 2), F.lit("}"))


def facts_json(facts: Column) -> Column:
    """A list of facts as JSON text."""
    return F.concat(F.lit("["), F.array_join(F.transform(facts, fact_json), ","), F.lit("]"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """(value): one JSON object for each sample."""
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    whole = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    o = F.col("override")
    override = F.when(o.isNull(), "null").otherwise(F.concat(
        F.lit('{"message":'), text(o["message"]), F.lit(',"new_fact":'), fact_json(o["new_fact"]), F.lit(',"old_fact":'), fact_json(o["old_fact"]),
        F.lit(',"replaces_fact_id":'), text(o["replaces_fact_id"]), F.lit(',"turn":'), o["turn"].cast("string"), F.lit("}"),
    ))
    profile = F.struct(*[F.col("user_profile")[c].alias(c) for c in ("average_prior_rating", "preference_tags", "purchase_frequency", "rating_style", "summary")])
    simulator = F.struct(F.col("replies").alias("clarification_replies"), F.lit(10).alias("max_turns"), F.lit("structured_plus_semantic").alias("routing"), F.size("clarification_facts").alias("slot_count"))
    parts = [
        '{"metadata":', whole(F.col("metadata")), ',"override":', override, ',"partitions":{"clarification":', facts_json(F.col("clarification_facts")), ',"profile":', facts_json(F.col("profile_facts")),
        ',"query":', facts_json(F.col("query_facts")), '},"query":', text(F.col("query")), ',"sample_id":', text(F.col("sample_id")), ',"scenario_type":', text(F.col("scenario_type")),
        ',"schema_version":', F.col("schema_version").cast("string"), ',"seed":', F.col("seed").cast("string"), ',"signature":', facts_json(F.col("signature")), ',"simulator":', whole(simulator),
        ',"target_parent_asin":', text(F.col("target")), ',"user_profile":', whole(profile), "}",
    ]
    return samples.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Write samples as a folder of JSON lines."""
    sample_lines(samples).write.mode("overwrite").text(path)


_FACT_IN = "struct<fact_id:string,field:string,operator:string,value:variant,source:string,attribute:string,polarity:string,display:string>"


def _fact_out(f: Column) -> Column:
    """A fact read from a file; lacking fields or a value that is no text or number fail the query."""
    kind = F.schema_of_variant(f["value"])
    is_text = kind == "STRING"
    bad = f["field"].isNull() | f["operator"].isNull() | f["source"].isNull() | f["value"].isNull() | ~(is_text | (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"))
    value = F.try_variant_get(f["value"], "$", "string")
    number = F.when(~is_text, parse_number(value))
    return F.struct(
        f["fact_id"].alias("fact_id"), F.when(bad, F.raise_error(F.lit("fact value must be a string or finite number, and field, operator and source must be present")).cast("string")).otherwise(f["field"]).alias("field"),
        f["operator"].alias("operator"), F.when(is_text, value).alias("value_str"), number.alias("value_num"),
        F.when(is_text, "str").when(kind == "BIGINT", "int").otherwise("float").alias("value_kind"), f["source"].alias("source"),
        F.coalesce(f["attribute"], F.lit("other")).alias("attribute"), F.coalesce(f["polarity"], F.lit("positive")).alias("polarity"), F.coalesce(f["display"], value).alias("display"),
    ).cast(FACT)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON lines in the columns of ``SAMPLE``.

    What is no list of facts is an empty one, and items that are no objects are left out;
    partitions and user_profile must be objects.
    """
    check_json_lines(spark, path)
    of = lambda at, kind: F.try_variant_get("j", at, kind)
    objects = lambda at: F.filter(F.coalesce(of(at, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    facts = lambda at: F.transform(objects(at), lambda x: _fact_out(F.try_variant_get(x, "$", _FACT_IN)))
    needed = lambda at, then: F.when(F.coalesce(F.schema_of_variant(of(at, "variant")).startswith("OBJECT"), F.lit(False)), then).otherwise(F.raise_error(F.lit(f"{at[2:]} of a sample is no object")))
    profile = "struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>"
    change = of("$.override", f"struct<turn:int,old_fact:{_FACT_IN},new_fact:{_FACT_IN},replaces_fact_id:string,message:string>")
    override = F.when(change.isNotNull(), F.struct(change["turn"].alias("turn"), _fact_out(change["old_fact"]).alias("old_fact"), _fact_out(change["new_fact"]).alias("new_fact"), change["replaces_fact_id"].alias("replaces_fact_id"), change["message"].alias("message")))
    columns = {
        "sample_id": needed("$.partitions", of("$.sample_id", "string")), "seed": F.coalesce(of("$.seed", "bigint"), F.lit(0)), "schema_version": F.coalesce(of("$.schema_version", "int"), F.lit(1)), "scenario_type": of("$.scenario_type", "string"),
        "target": of("$.target_parent_asin", "string"), "query": of("$.query", "string"), "user_profile": needed("$.user_profile", of("$.user_profile", profile)), "signature": facts("$.signature"), "query_facts": facts("$.partitions.query"),
        "profile_facts": facts("$.partitions.profile"), "clarification_facts": facts("$.partitions.clarification"), "replies": of("$.simulator.clarification_replies", "array<struct<fact_id:string,message:string>>"),
        "override": override, "metadata": of("$.metadata", "map<string,string>"),
    }
    rows = read_json_lines(spark, path).select(*[v.alias(k) for k, v in columns.items()])
    return rows.to(spark.createDataFrame([], SAMPLE).schema)


def write_json(path: str, value: dict) -> None:
    """A small report as indented JSON."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
