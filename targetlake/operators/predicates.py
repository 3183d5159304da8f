"""Fact predicates over products, as column expressions on a row that holds both.

A row has the product's ``vals`` and ``indexed`` (see ``with_values``), price,
rating and rating_count. A fact is a struct of field, operator, value_str,
value_num and more; see ``FACT``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, parse_number
from ..functions.vocab import AT_LEAST, AT_MOST, EQUAL, HOLDS, NEGATIVE, NUMERIC
from ..sources.scratch import written

FACT = "struct<fact_id:string,field:string,operator:string,value_str:string,value_num:double,value_kind:string,source:string,attribute:string,polarity:string,display:string>"


def actual_number(field: Column) -> Column:
    """The product's number for a numeric field."""
    return F.when(field == "price", F.col("price")).when(field == "rating", F.col("rating")).when(field == "rating_count", F.col("rating_count").cast("double"))


def match_numeric(actual: Column, operator: Column, expected: Column) -> Column:
    """Comparison with the tolerances of the data model; without both numbers only ``neq`` holds."""
    close = F.abs(actual - expected) <= 1e-6
    told = (
        F.when(operator.isin(*EQUAL), close).when(operator.isin(*AT_MOST), actual <= expected + 1e-9)
        .when(operator.isin(*AT_LEAST), actual + 1e-9 >= expected).when(operator == "neq", ~close).otherwise(F.lit(False))
    )
    return F.when(actual.isNull() | expected.isNull(), operator == "neq").otherwise(told)


def expected_number(fact: Column) -> Column:
    """A fact's value as a number."""
    return F.coalesce(fact["value_num"], parse_number(fact["value_str"]))


def _values(field: Column) -> Column:
    of = F.when(field.startswith("detail:"), F.concat(F.lit("detail:"), normalize_text(F.substring(field, F.lit(8), F.length(field))))).otherwise(field)
    return F.transform(F.filter("vals", lambda v: v["field"] == of), lambda v: v["value"])


def match_text(values: Column, operator: Column, expected: Column) -> Column:
    """Equality, containment or their absence among the values of a field."""
    equal, held = F.array_contains(values, expected), F.exists(values, lambda v: F.contains(v, expected))
    return F.when(operator.isin(*EQUAL), equal).when(operator.isin(*HOLDS), held).when(operator.isin(*NEGATIVE), ~held & ~equal).otherwise(F.lit(False))


def match_fact(fact: Column) -> Column:
    """Whether the fact is true of the row's product."""
    numeric = match_numeric(actual_number(fact["field"]), fact["operator"], expected_number(fact))
    return F.when(fact["field"].isin(*NUMERIC), numeric).otherwise(match_text(_values(fact["field"]), fact["operator"], normalize_text(fact["value_str"])))


def member(fact: Column, in_index: Column) -> Column:
    """Whether the product is a candidate under the fact.

    Differs from :func:`match_fact` on text: equality asks the index alone, and a
    negated value that the index has (``in_index``) excludes exact matches only.
    """
    pair = F.struct(fact["field"].alias("field"), normalize_text(fact["value_str"]).alias("value"))
    listed = F.array_contains(F.col("indexed"), pair)
    return (
        F.when(fact["field"].isin(*NUMERIC), match_fact(fact)).when(fact["operator"].isin(*EQUAL), listed)
        .when(fact["operator"].isin(*NEGATIVE) & in_index, ~listed).otherwise(match_fact(fact))
    )


def candidates(catalog: DataFrame, posting: DataFrame, facts: list[tuple[str, str, str]]) -> DataFrame:
    """Ids that satisfy all of a few (field, operator, value) facts: semi and anti joins on the index, a filter for the rest."""
    out = catalog
    # What any of the texts hits is found in one pass over the postings.
    texts = [(field, value) for field, operator, value in facts if field not in NUMERIC and operator in (*EQUAL, *NEGATIVE)]
    asked = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("value") == normalize_text(F.lit(v))) for f, v in texts], F.lit(False))
    hits = written(posting.where(asked), "candidate-hits") if texts else posting
    for field, operator, value in facts:
        text = field not in NUMERIC
        hit = hits.where((F.col("field") == field) & (F.col("value") == normalize_text(F.lit(value)))).select("parent_asin")
        fact = F.struct(F.lit(field).alias("field"), F.lit(operator).alias("operator"), F.lit(value).alias("value_str"), F.lit(None).cast("double").alias("value_num"))
        if text and operator in EQUAL:
            out = out.join(hit, "parent_asin", "left_semi")
        elif text and operator in NEGATIVE and not hit.isEmpty():
            out = out.join(hit, "parent_asin", "left_anti")
        else:
            out = out.where(match_fact(fact))
    return out.select("parent_asin")
