"""Work and memory that grow no faster than the input: plans and partitions."""

import contextlib
import io

from pyspark.sql import functions as F

from targetlake.functions import text as T
from targetlake.operators import bitmaps, facts, generate, masks, metrics, predicates, questions
from targetlake.plans import entries
from targetlake.plans import views as V
from targetlake.sources import catalog as C
from targetlake.sources import scratch

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_folding_looks_for_few_ranges(spark):
    assert T._rare().count("-") <= 12  # each range takes time for every character of every text
    texts = ["Straße ÀÉ", "plain ASCII_1", "ŉ İx ΣΑΣ ſ µ", "ŒUVRE Ÿ", "Жук", "ﬀ ﬃ ΐ", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.casefold(F.col("t")).alias("f"), T.normalize_text(F.col("t")).alias("n")).collect()
    assert [r["f"] for r in got] == [None if t is None else t.casefold() for t in texts]
    every = [chr(c) for c in range(32, 0x250) if chr(c).isalnum()]
    got = spark.createDataFrame([(f"{c}!x",) for c in every], "t string").select("t", T.normalize_text(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got if r["n"] not in (f"{r['t'][0].casefold()} x", r["n"] if not r["t"][0].casefold().isalnum() else None)] == []


def test_question_is_normalised_once(spark):
    turns = spark.createDataFrame([("x",)], "m string").select(questions.text_attributes(F.col("m")).alias("a"))
    assert turns._jdf.queryExecution().analyzed().toString().count("octet_length") <= 2


def test_values_are_made_once_and_dealt_out(spark):
    products = V.products(spark, SF)
    assert products.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert V.spread(spark.range(10), "id", 10 * V.PRODUCTS).rdd.getNumPartitions() == 10
    for df in (C.field_values(products), C.postings(products), facts.product_facts(products)):
        assert "Filter (size(" not in plan(df)  # the values, made before the deal to see if there are some


def test_many_rows_are_dealt_out(spark):
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100).select(F.col("id").alias("key"), F.lit(1).alias("pos"), F.lit("a").alias("id"), F.lit(None).cast("double").alias("score"))
    assert scratch.dealt(rows, scratch.ROWS * shuffles, "key").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert scratch.dealt(rows, scratch.ROWS * shuffles + 1, "key").rdd.getNumPartitions() == shuffles + 1
    found = metrics.normalized_recommendations(rows, spark.createDataFrame([("a",)], "parent_asin string"), 3, scratch.ROWS * 20)
    assert "hashpartitioning(key" in plan(found) and ", 20), REPARTITION_BY_NUM" in plan(found) and found.count() == 100


def test_postings_of_many_products_meet_in_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "PRODUCTS", 20)
    products = V.products(spark, SF)
    products = C.with_values(products.unionByName(products.limit(5)))  # ids may repeat
    got = C.postings(products, products.count())
    assert plan(got).count("REPARTITION_BY_NUM") == plan(products).count("REPARTITION_BY_NUM") + 1 and "Exchange hashpartitioning(field" not in plan(got)  # one by one task's hash table of all its rows before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.postings(products).collect()))
    sizes = []
    monkeypatch.setattr(entries, "written", lambda df, name: sizes.append(plan(df).count("REPARTITION_BY_NUM")) or scratch.written(df, name))
    entries._indexed(spark, SF)
    assert sizes[1] == 1  # the queries' postings are made so


def test_sentences_take_the_facts_of_their_fields_alone(spark):
    assert "p_name" not in plan(entries.render_facts(spark, SF))  # titles are neither read nor cut into tokens
    of = lambda fields: facts.product_facts(V.products(spark, SF), fields).where("field IN ('store', 'price')").drop("pos").collect()
    assert sorted(map(str, of(None))) == sorted(map(str, of(("store", "price")))) != []


def test_items_are_counted_before_they_become_facts(spark):
    assert "HashAggregate(keys=[field" in plan(entries.extract_facts(spark, SF)).split("sha1")[-1]  # ids were made for every product's items
    rows = [{"parent_asin": f"p{i}", "title": "Red running shoe", "categories": ["Shoes", "Trail"], "features": ["Soft woven upper", "soft  woven upper"], "description": [], "details": {"Color": "Red", "color": "red "}, "store": "Acme" if i % 2 else None, "price": [0, 19.5, -1][i % 3], "average_rating": 4.0, "rating_number": i} for i in range(6)]
    catalog = C.catalog_from_records(spark, rows)
    columns = [c for c in facts.product_facts(catalog).columns if c not in ("parent_asin", "pos")]
    of = lambda df, n: {tuple(r)[:-1]: r["n"] for r in df.groupBy(*columns).agg(n.alias("n")).collect()}
    want = of(facts.product_facts(catalog), F.count("*"))
    assert of(facts.counted_facts(catalog), F.sum("n")) == want and len(want) > 10
    assert facts.counted_facts(catalog).count() == len(want)


def test_candidates_make_their_postings_once(spark):
    assert "Generate" not in plan(entries.negation_antijoin(spark, SF))  # hits are read; postings were made for each of them


def test_products_that_facts_don_t_tell_apart_are_one_profile(spark, monkeypatch):
    rows = [{"parent_asin": f"p{i}", "title": f"Thing {i}", "categories": ["Rings"], "features": [], "description": [], "details": {}, "store": "Acme" if i % 2 else "Other", "price": float(i), "average_rating": 4.0, "rating_number": i} for i in range(40)]
    catalog = C.with_values(C.catalog_from_records(spark, rows))
    said = [("a", "p3", [("category", "eq", "rings"), ("store", "neq", "acme"), ("price", "le", "9")]), ("b", "p4", [("category", "eq", "rings"), ("store", "eq", "acme"), ("price", "ge", "30")])]
    kind = "sample_id string, target string, facts array<struct<field:string,operator:string,value_str:string>>"
    samples = spark.createDataFrame(said, kind).withColumn("facts", F.transform("facts", lambda f: f.withField("value_num", F.lit(None).cast("double"))))
    sizes = {}

    def counted(df, name, written=masks.written):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(masks, "written", counted)
    got = {(r["sample_id"], r["mask"][0]): (r["n"], r["target_mask"] is not None) for r in masks.mask_histogram(catalog, C.postings(catalog), samples).collect()}
    want = {}
    for i in range(40):
        for name, mask in (("a", 1 | (i % 2 == 0) << 1 | (i <= 9) << 2), ("b", 1 | (i % 2) << 1 | (i >= 30) << 2)):
            want[name, mask] = want.get((name, mask), 0) + 1
    own = {("a", 1 | 4), ("b", 1)}
    assert got == {k: (n, k in own) for k, n in want.items()}
    assert sizes["mask-profiles"] == 6  # two stores in three ranges of prices, not 40 products


def test_decoys_look_at_the_targets_postings(spark, monkeypatch):
    catalog = C.with_values(V.products(spark, SF))
    sizes = []

    def counted(df, name, written=generate.written):
        out = written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(generate, "written", counted)
    posting = C.postings(catalog)
    found = V.samples(catalog).select("target", F.lit("base").alias("variant"), F.col("signature").alias("facts")).limit(3)
    assert not generate.decoys(catalog, posting, found).isEmpty()
    assert sizes and max(sizes) <= 30  # those of three products


def test_a_block_is_compared_at_once(spark):
    numbers = [1.0, 1.0 + 1e-7, 0.0, -2.5, None, float("nan"), float("inf"), float("-inf"), 7.0]
    values = spark.createDataFrame([(bitmaps.BLOCK - 4 + i, x, x, x) for i, x in enumerate(numbers)], "number long, price double, rating double, rating_count double")
    told = [(i, field, op, x) for i, (field, op, x) in enumerate((f, o, x) for f in ("price", "rating") for o in ("le", "max", "ge", "eq", "neq", "contains") for x in (1.0, 7.0, None))]
    facts_of = spark.createDataFrame(told, "fid long, field string, operator string, expected double")
    rows = values.crossJoin(facts_of).where(predicates.match_numeric(F.when(F.col("field") == "price", F.col("price")).otherwise(F.col("rating")), F.col("operator"), F.col("expected")))
    want = sorted((r["fid"], r["block"], bytes(r["bits"])) for r in bitmaps.bitmaps(rows, ["fid"]).collect())
    assert sorted((r["fid"], r["block"], bytes(r["bits"])) for r in bitmaps.compared(values, told).collect()) == want != []
    assert "Generate" not in plan(bitmaps.compared(values, told))


def test_changed_samples_are_filtered_after_they_are_written(spark, monkeypatch):
    sizes = []

    def sized(df, name):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return scratch.written(df, name)

    monkeypatch.setattr(entries, "written", sized)
    assert entries.sample_files(spark, SF).where("same").count() > 0
    assert max(sizes) < 2_000_000  # 23 MB before, the filter's condition being pushed below all that the samples are made of
