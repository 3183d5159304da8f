"""Candidate counts against direct evaluation: dominance counts, gram joins, many facts, subset sums."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetlake.operators import dominance, masks, predicates, ranks
from targetlake.sources import catalog as C

FACTS = "array<struct<field:string,operator:string,value_str:string,value_num:double>>"


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "é", None, ""]), rng.randrange(40), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, x int, id int, n int").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode(), -r[1], r[2]))
    got = {r["id"]: r["rank"] for r in ranks.ranked(df, F.asc_nulls_last("s"), F.desc("x"), F.col("id")).collect()}
    assert got == {r[2]: i for i, r in enumerate(order)}
    got = {r["id"]: r["upto"] for r in ranks.prefix_sums(df, "n", F.asc_nulls_last("s"), F.desc("x"), F.col("id")).collect()}
    assert got == dict(zip([r[2] for r in order], np.cumsum([r[3] for r in order]).tolist(), strict=True))
    assert ranks.ranked(df.limit(0), F.col("id")).count() == ranks.prefix_sums(df.limit(0), "n", F.col("id")).count() == 0


@pytest.mark.parametrize("dims", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_dominance_counts(spark, dims):
    rng = random.Random(len(dims))
    points = [tuple(rng.choice([0, 0, rng.randrange(30)]) for _ in dims) for _ in range(400)]
    corners = [tuple(rng.randrange(31) for _ in dims) for _ in range(60)] + [(30,) * len(dims), (0,) * len(dims)]
    schema = ", ".join(f"{d} long" for d in dims)
    p, c = spark.createDataFrame(points, schema).withColumn("n", F.lit(2).cast("long")), spark.createDataFrame(corners, schema)
    got = {tuple(r[d] for d in dims): r["below"] for r in dominance.dominated(p, c, dims, dict.fromkeys(dims, 31)).collect()}
    want = {k: 2 * sum(all(a <= b for a, b in zip(x, k, strict=True)) for x in points) for k in corners}
    assert {k: n for k, n in want.items() if n} == {k: n for k, n in got.items() if n}


def make_catalog(spark, n, seed=3):
    rng = random.Random(seed)
    words = ["red", "blue", "trail", "runner", "walker", "shoe", "rain", "stripe", "a", "ab", "abc", "ring", "earring"]
    records = []
    for i in range(n):
        records.append({
            "parent_asin": f"Q{i:04d}", "title": " ".join(rng.sample(words, 3)), "categories": ["Shoes", rng.choice(["Trail", "Town", "Ring"])], "features": [" ".join(rng.sample(words, 4))], "description": [],
            "details": {"Color": rng.choice(["Red", "Deep blue", "ab"]), "Size": str(rng.randrange(8, 12))}, "store": rng.choice(["Ridge", "Town", "A", None]),
            "price": rng.choice([None, 20, 20.000001, 20.0000005, 49.99, 79, round(rng.random() * 90, 2)]), "average_rating": rng.choice([None, 4.5, 3.1, 4.5000005]), "rating_number": rng.choice([None, 0, 10, 10, 1200]),
        })
    return C.catalog_from_records(spark, records)


TEXTS = [
    ("store", "eq", "Ridge"), ("store", "neq", "town"), ("store", "not", "own"), ("store", "contains", "id"), ("feature", "has", "trail r"), ("feature", "not_contains", "ring"), ("title_token", "has", "ing"), ("title_token", "not", "a"),
    ("detail:Color", "contains", "e"), ("detail:color", "eq", "deep blue"), ("detail:color", "contains", "abcd"), ("color", "contains", ""), ("category", "exact", "ring"), ("feature", "contains", "xyz"), ("store", "like", "x"),
]
NUMBERS = [
    ("price", "le", "20"), ("price", "max", "20.0000005"), ("price", "ge", "20.000001"), ("price", "eq", "20"), ("price", "neq", "20"), ("price", "eq", "20.0000015"), ("price", "ge", "1e300"), ("price", "le", "-5"), ("price", "eq", "none"), ("price", "neq", "none"),
    ("price", "not", "20"), ("rating", "ge", "4.5"), ("rating", "min", "4.500002"), ("rating", "neq", "3.1"), ("rating_count", "max", "10"), ("rating_count", "ge", "11"), ("rating_count", "eq", "0"), ("price", "min", "49.99"), ("price", "le", "78.999999999"),
]


def fact_rows(spark, samples):
    return spark.createDataFrame([(s, t, [(*f, None) for f in facts]) for s, t, facts in samples], f"sample_id string, target string, facts {FACTS}")


def direct(spark, catalog, posting, samples):
    """Histogram and target mask of every sample by evaluating each of its facts on each product."""
    held = {(r["field"], r["value"]) for r in posting.collect()}
    every = sorted({f for *_, facts in samples for f in facts})
    norm = {r["v"]: r["n"] for r in spark.createDataFrame([(v,) for v in {f[2] for f in every}], "v string").select("v", predicates.normalize_text(F.col("v")).alias("n")).collect()}
    column = lambda f: F.struct(*[F.lit(x).alias(c) for c, x in zip(("field", "operator", "value_str"), f, strict=True)], F.lit(None).cast("double").alias("value_num"))
    rows = C.with_values(catalog).select("parent_asin", *[F.coalesce(predicates.member(column(f), F.lit((f[0], norm[f[2]]) in held)), F.lit(False)).alias(str(i)) for i, f in enumerate(every)]).collect()
    at = {f: str(i) for i, f in enumerate(every)}
    out = {}
    for s, target, facts in samples:
        own = {r["parent_asin"]: frozenset(i for i, f in enumerate(facts) if r[at[f]]) for r in rows}
        for m, n in Counter(own.values()).items():
            out[s, m] = (n, own.get(target) == m)
    return out


def places(mask):
    return frozenset(masks.BITS * w + b for w, x in enumerate(mask) for b in range(masks.BITS) if x >> b & 1)


def test_histograms(spark):
    catalog = make_catalog(spark, 150).cache()
    posting = C.postings(catalog).cache()
    rng = random.Random(2)
    samples = [("none", "gone", []), ("texts", "Q0001", TEXTS), ("numbers", "Q0002", NUMBERS), ("one", "Q0003", [NUMBERS[3]]), ("two", "Q0004", [NUMBERS[0], NUMBERS[11]])]
    samples += [(f"s{i}", f"Q{i:04d}", rng.sample(TEXTS, 3) + rng.sample(NUMBERS, 4)) for i in range(25)]
    samples += [("long", "Q0007", [rng.choice(TEXTS + NUMBERS) for _ in range(200)])]
    got = {(r["sample_id"], places(r["mask"])): (r["n"], r["target_mask"] is not None) for r in masks.mask_histogram(catalog, posting, fact_rows(spark, samples)).collect()}
    assert got == direct(spark, catalog, posting, samples)


def test_products_are_their_own_index(spark, monkeypatch):
    """Without postings none are written, and products that agree in what is asked for are one row; counts and target masks stay."""
    catalog = make_catalog(spark, 150).cache()
    samples = [
        ("a", "Q0003", [("store", "eq", "Ridge"), ("store", "neq", "town"), ("price", "le", "20")]), ("b", "Q0003", [("category", "exact", "ring")]),
        ("c", "Q0007", [("store", "contains", "id"), ("detail:Color", "neq", "red"), ("price", "ge", "49.99")]), ("none", "gone", []), ("lost", "gone", [("store", "not", "own"), ("price", "eq", "20")]),
    ]
    sizes = {}

    def counted(df, name, written=masks.written):
        out = written(df, name)
        sizes[name] = out.count() if name == "mask-rows" else None
        return out

    monkeypatch.setattr(masks, "written", counted)
    got = {(r["sample_id"], places(r["mask"])): (r["n"], r["target_mask"] is not None) for r in masks.mask_histogram(catalog, None, fact_rows(spark, samples)).collect()}
    assert got == direct(spark, catalog, C.postings(catalog), samples)
    assert "mask-postings" not in sizes and "mask-products" not in sizes
    alike = catalog.select("store", F.get("categories", 1), F.get("details", 0), "price").distinct().count()
    assert sizes["mask-rows"] == alike + 2 < 150  # one more for each target


def test_superset_sums(spark):
    hist = [("s", [0b101], 3), ("s", [0b111], 2), ("s", [0], 7), ("t", [0b10], 1)]
    got = {r["sample_id"]: r["counts"] for r in masks.superset_sums(spark.createDataFrame(hist, "sample_id string, mask array<bigint>, n long"), 3).collect()}
    want = {s: [sum(n for x, (m,), n in hist if x == s and m & k == k) for k in range(8)] for s in "st"}
    assert got == want


def test_parts_are_compared_with_few_values(spark):
    """Candidates are those that share the rarest grams; a field with one common word stays split by value."""
    values = [("f", f"common word number {i:04d}") for i in range(2000)] + [("g", "common word number 0007"), ("f", "ab"), ("f", "")]
    parts = [("f", "number 0007"), ("f", "r 19"), ("g", "common"), ("f", "zzz"), ("f", "b"), ("g", ""), ("h", "x")]
    v, p = spark.createDataFrame(values, "field string, value string"), spark.createDataFrame(parts, "field string, part string")
    got = Counter(map(tuple, masks.containing(p, v).select("field", "part", "value").collect()))
    assert got == Counter((f, part, value) for f, part in parts for g, value in values if f == g and part in value)


def test_ten_thousand_samples(spark):
    """Rows follow products + thresholds, not products x samples: 10,000 samples on 100,000 products, checked by sorting."""
    products = spark.range(100_000).select(
        F.concat(F.lit("P"), "id").alias("parent_asin"), F.array().cast("array<struct<field:string,value:string>>").alias("vals"), (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 100.0).alias("price"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 10.0).alias("rating"), F.lit(None).cast("long").alias("rating_count"),
    )
    fact = lambda field, op, number: F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), F.lit(None).cast("string").alias("value_str"), number.alias("value_num"))
    samples = spark.range(10_000).select(F.col("id").cast("string").alias("sample_id"), F.lit("P0").alias("target"), F.array(fact("price", "le", F.col("id") / 20.0), fact("rating", "ge", (F.col("id") % 50) / 10.0)).alias("facts"))
    hist = masks.mask_histogram(products, spark.createDataFrame([], "field string, value string, parent_asin string"), samples)
    got = {(int(r["sample_id"]), r["mask"][0]): r["n"] for r in hist.collect()}
    price, rating = (np.array(x) for x in zip(*[(r["price"], r["rating"]) for r in products.select("price", "rating").collect()], strict=True))
    for i in range(0, 10_000, 97):
        mask = (price <= i / 20.0 + 1e-9) + 2 * (rating + 1e-9 >= i % 50 / 10.0)
        assert {k: n for k in range(4) if (n := got.get((i, k), 0))} == dict(Counter(mask.tolist()))
