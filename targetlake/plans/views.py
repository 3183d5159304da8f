"""Catalogs, traces and samples derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_text, number_text
from ..functions.vocab import PROFILE_SUMMARY
from ..operators.facts import make_fact, price_ceiling, render_fact, render_facts
from ..sources.scratch import dealt

#: DuckDB's view of the same product columns.
PRODUCT_SQL = """
prod AS (SELECT 'P-' || p_partkey AS parent_asin, p_partkey, p_name, p_type, p_brand, p_size, p_retailprice AS price,
  (10 + coalesce(q, 0) % 41) / CAST(10 AS DOUBLE) AS rating, coalesce(n, 0) AS rating_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Products in one partition at most, as facts and values take much work a row.
PRODUCTS = 50_000


def spread(rows: DataFrame, key: str, number: int) -> DataFrame:
    """``number`` rows dealt out by a key to as many partitions as the session has cores, or more so that none has many. Spark would join small partitions by their bytes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-number // PRODUCTS)), key)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: type is the category, brand the store, size a detail; ratings follow sales."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    part = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    return spread(part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left"), "p_partkey", part.count()).select(
        F.concat(F.lit("P-"), F.col("p_partkey")).alias("parent_asin"), F.col("p_name").alias("title"), F.array("p_type").alias("categories"), none.alias("features"), none.alias("description"),
        F.array(F.struct(F.lit("Size").alias("key"), F.col("p_size").cast("string").alias("value"))).alias("details"), F.col("p_brand").alias("store"), F.col("p_retailprice").alias("price"),
        ((10 + F.coalesce("q", F.lit(0)) % 41) / F.lit(10.0)).alias("rating"), F.coalesce("n", F.lit(0)).cast("bigint").alias("rating_count"),
    )


def catalog_lines(products: DataFrame) -> DataFrame:
    """Products as lines (``value``) of a catalog file: by number, prices as numbers and texts, categories as a list and a text, details as an object, padded ids, and the names that ratings and their counts have."""
    no = F.expr("CAST(substring(parent_asin, 3) AS BIGINT)")
    json = lambda c: F.to_json(F.array(c))
    one = lambda c: F.substring(json(c), F.lit(2), F.length(json(c)) - 2)
    leaf, size, count = F.get("categories", 0), F.get("details", 0)["value"], F.col("rating_count").cast("string")
    parts = {
        "parent_asin": one(F.when(no % 2 == 0, F.concat(F.lit(" "), "parent_asin", F.lit("  "))).otherwise(F.col("parent_asin"))), "title": one(F.col("title")), "store": one(F.col("store")),
        "categories": F.when(no % 3 == 0, F.to_json(F.array(F.lit("Goods"), leaf))).when(no % 3 == 1, one(leaf)).otherwise(json(leaf)),
        "price": F.when(no % 2 == 1, one(F.format_string("$%.2f", "price"))).otherwise(F.col("price").cast("string")),
    }
    rating = F.concat(F.when(no % 5 == 0, '"rating":').otherwise('"average_rating":'), F.col("rating").cast("string"))
    counts = F.when(no % 4 == 0, "").when(no % 4 == 1, F.concat(F.lit(',"rating_count":'), count)).otherwise(F.concat(F.lit(',"rating_number":'), count))
    inner = F.when(no % 4 == 0, F.concat(F.lit(',"Rating Count":"'), count, F.lit(' ratings"'))).otherwise("")
    pairs = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return products.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs, rating), counts, F.lit(',"details":{"Size":'), one(size), inner, F.lit("}}")).alias("value"))


#: Facts of a derived sample, in order.
SAMPLE_FACTS = ("category", "store", "detail:size", "price")


def sample_targets(catalog: DataFrame) -> DataFrame:
    """One target for each category and store: the product with the least number."""
    least = F.min(F.substring("parent_asin", 3, 20).cast("bigint"))  # a number is compared in a hash table, a text would be sorted for
    return catalog.groupBy(F.get("categories", 0).alias("c"), "store").agg(F.concat(F.lit("P-"), least).alias("parent_asin")).select("parent_asin").join(catalog, "parent_asin")


def samples(catalog: DataFrame) -> DataFrame:
    """Samples of :func:`sample_targets`: category and store in the query, size and price hidden."""
    size, ceiling = F.get("details", 0)["value"], price_ceiling(F.col("price"))
    category = make_fact(F.lit("category"), "eq", F.lower(F.get("categories", 0)), "categories", F.get("categories", 0), "category")
    store = make_fact(F.lit("store"), "eq", normalize_text(F.col("store")), "store", F.col("store"), "brand")
    detail = make_fact(F.lit("detail:size"), "eq", size, "details", size, "size")
    price = make_fact(F.lit("price"), "le", ceiling, "price", number_text(ceiling), "budget", number="float")
    profile = F.struct(
        F.lit("occasional").alias("purchase_frequency"), F.lit(None).cast("double").alias("average_prior_rating"), F.lit("balanced").alias("rating_style"),
        F.array().cast("array<string>").alias("preference_tags"), F.lit(PROFILE_SUMMARY).alias("summary"),
    )
    facts = sample_targets(catalog).select(F.col("parent_asin").alias("target"), F.array(category, store).alias("query_facts"), F.array(detail, price).alias("clarification_facts"), profile.alias("user_profile"))
    none = facts.select(F.slice("query_facts", 1, 0).alias("x")).schema["x"].dataType.simpleString()
    fact = none.removeprefix("array<").removesuffix(">")
    return facts.select(
        F.concat(F.lit("s-"), "target").alias("sample_id"), F.lit(1).cast("bigint").alias("seed"), F.lit(1).alias("schema_version"), F.lit("clarification_required").alias("scenario_type"), "target",
        render_facts(F.col("query_facts"), F.lit(0)).alias("query"), "user_profile", F.concat("query_facts", "clarification_facts").alias("signature"), "query_facts",
        F.slice("query_facts", 1, 0).alias("profile_facts"), "clarification_facts",
        F.transform("clarification_facts", lambda f, i: F.struct(f["fact_id"].alias("fact_id"), render_fact(f, i, reply=True).alias("message"))).alias("replies"),
        F.lit(None).cast(f"struct<turn:int,old_fact:{fact},new_fact:{fact},replaces_fact_id:string,message:string>").alias("override"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


TRACE_SQL = """
tr AS (SELECT l_orderkey AS sample_id, o_orderpriority AS scenario_type, l_linenumber AS turn, l_partkey AS id, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_quantity, l_extendedprice) AS pos,
  min(l_partkey) OVER (PARTITION BY l_orderkey) AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw recommendations: the order is the session, the line number the turn."""
    lines = table(spark, sf_dir, "lineitem")
    lines = dealt(lines, lines.count(), "l_orderkey").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    by_turn = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.select(
        F.col("l_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("scenario_type"), F.col("l_linenumber").alias("turn"), F.col("l_partkey").alias("id"), "l_returnflag",
        F.row_number().over(by_turn).alias("pos"), F.min("l_partkey").over(W.partitionBy("l_orderkey")).alias("target"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the orders; a turn whose first line was returned counts as revealed."""
    lists = ranked_lines(spark, sf_dir).groupBy("sample_id", "scenario_type", "turn", "target").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id"), "l_returnflag"))).alias("r"))
    return lists.select(
        "sample_id", "scenario_type", F.col("target").cast("string").alias("target"), F.lit(1).alias("start_turn"), F.col("turn").alias("obs_pos"), "turn",
        F.when(F.get("r", 0)["l_returnflag"] == "R", "revealed").when(F.get("r", 0)["l_returnflag"] == "A", "repeated").otherwise("").alias("status"),
        F.transform("r", lambda x: x["id"]).alias("recommendations"),
    )


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recorded sessions, parsed (``value``, ``j``): turns as numbers and texts, ids as objects and blank-padded texts, starts of 3, reasons and errors."""
    lists = ranked_lines(spark, sf_dir).groupBy("sample_id", "scenario_type", "turn", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "l_returnflag"))).alias("r"))
    key, number = F.col("sample_id"), F.col("turn").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    turn = F.when(key % 5 == 0, quoted(F.concat(number, F.lit(".9")))).when(key % 5 == 1, quoted(number)).otherwise(number)
    ids = F.transform("r", lambda x: F.when(x["pos"] % 2 == 0, quoted(F.concat(F.lit(" "), x["id"].cast("string")))).otherwise(F.concat(F.lit('{"parent_asin":"'), x["id"].cast("string"), F.lit('"}'))))
    status = F.when(F.get("r", 0)["l_returnflag"] == "R", "revealed").otherwise("")
    reasons = F.concat(F.lit('{"route_reason":"route '), F.pmod(key, F.lit(3)).cast("string"), F.lit('","reply_reason":'), F.when(F.col("turn") == 2, '"second"').otherwise("0"), F.lit(',"question_interpretation":{"reason":"asked '), F.pmod("turn", F.lit(2)).cast("string"), F.lit('"}}'))
    seen = F.concat(F.lit('{"turn":'), turn, F.lit(',"recommendations":['), F.array_join(ids, ","), F.lit('],"simulator_status":'), quoted(status), F.lit(',"simulator_diagnostics":'), reasons, F.lit("}"))
    sessions = lists.withColumn("seen", seen).groupBy("sample_id", "scenario_type", "target").agg(F.array_sort(F.collect_list(F.struct("turn", "seen"))).alias("s"))
    start, errors = F.when(key % 4 == 0, "3").otherwise('"1"'), F.when(key % 7 == 0, '["timed out"]').otherwise("[]")
    value = F.concat(
        F.lit('{"sample_id":'), quoted(key.cast("string")), F.lit(',"scenario_type":'), quoted(F.col("scenario_type")), F.lit(',"target_parent_asin":'), quoted(F.col("target").cast("string")), F.lit(',"metrics_start_turn":'), start,
        F.lit(',"errors":'), errors, F.lit(',"trace":["no object",'), F.array_join(F.transform("s", lambda x: x["seen"]), ","), F.lit("]}"),
    )
    return sessions.select(value.alias("value")).withColumn("j", F.parse_json("value"))
