"""Generation against plain loops: greedy signatures, least values, the walk over scenarios."""

import random

import pandas as pd
from pyspark.sql import functions as F

from targetlake.functions.vocab import SOURCE_WEIGHTS
from targetlake.operators import bitmaps, generate
from targetlake.sources import catalog as C
from test_masks import make_catalog


def test_walk_equals_the_loop(spark):
    rng = random.Random(8)
    for states, count, done in ((7, 40, 3), (2, 1000, 0), (1, 5, 2)):
        rows = [(10 * i, [rng.random() < 0.3 for _ in range(states)]) for i in range(300)]
        at, want = done, []
        for place, fits in rows:
            if at < count and fits[at % states]:
                want.append((place, at))
                at += 1
        rng.shuffle(rows)
        tried = spark.createDataFrame(rows, "place long, fits array<boolean>").repartition(5)
        assert generate.walked(tried, states, done, count) == want


def test_least_values(spark):
    rng = random.Random(6)
    rows = pd.DataFrame({"field": [rng.choice(["hot"] * 9 + ["b"]) for _ in range(3000)], "raw": [f"v{rng.randrange(2500):05d}" for _ in range(3000)]}).drop_duplicates()
    got = sorted(tuple(r) for r in generate.least_values(spark.createDataFrame(rows), "field", "raw", 4).collect())
    assert got == sorted((f, v) for f in ("hot", "b") for v in sorted(rows[rows.field == f].raw)[:4])


def members(rows, fact):
    """Products of a fact by plain comparison."""
    field, op, value, number = fact["field"], fact["operator"], fact["value_str"], fact["value_num"]
    if number is not None:
        actual = lambda r: r[field] if field != "rating_count" or r[field] is None else float(r[field])
        return {r["parent_asin"] for r in rows if actual(r) is not None and (actual(r) <= number + 1e-9 if op == "le" else actual(r) + 1e-9 >= number)}
    if op == "neq":
        return {r["parent_asin"] for r in rows if (field, value) not in {(v["field"], v["value"]) for v in r["indexed"]}}
    if op == "contains":
        return {r["parent_asin"] for r in rows if any(v["field"] == field and value in v["value"] for v in r["vals"])}
    return {r["parent_asin"] for r in rows if (field, value) in {(v["field"], v["value"]) for v in r["indexed"]}}


def greedy(rows, target, facts, config, first):
    """A signature by the rule: the best gain by share and source, until one candidate is left."""
    chosen, keys = list(first), set()
    cands = {r["parent_asin"] for r in rows}
    for f, key in facts:
        if f["field"] == "category" and not any(x is f for x in chosen):
            chosen.insert(0, f)
            keys.add(key)
            break
    for f in chosen:
        cands &= members(rows, f)
    while len(cands) > 1 and len(chosen) < config.max_signature_facts:
        best = None
        for f, key in facts:
            inside = cands & members(rows, f)
            if key in keys or target not in inside or len(inside) == len(cands):
                continue
            gain = float(len(cands) - len(inside))
            ratio = gain / len(cands) * SOURCE_WEIGHTS.get(f["source"], 0.65) * (0.45 if len(inside) == 1 else 1.0)
            score = (ratio, gain, -len(inside), -len(f["display"]), f["fact_id"])
            best = max(best or (score, f, key, inside), (score, f, key, inside), key=lambda x: x[0])
        if best is None:
            break
        _, f, key, cands = best
        chosen.append(f)
        keys.add(key)
    return [f["fact_id"] for f in chosen] if cands == {target} else None


def test_signatures_by_brute_force(spark):
    config = generate.GeneratorConfig()
    catalog = C.with_values(make_catalog(spark, 60, seed=11)).cache()
    posting = C.postings(catalog).cache()
    rows = catalog.collect()
    pool = generate.fact_pool(catalog, config, large=False).withColumnRenamed("parent_asin", "target").cache()
    numbered = bitmaps.Numbered(catalog, posting)
    targets = numbered.ids.select(F.col("parent_asin").alias("target"), "number").where("number % 2 = 0")
    found, *_ = generate.signatures(numbered, posting, pool, targets, config)
    got = {(r["target"], r["variant"]): [f["fact_id"] for f in r["facts"]] for r in found.collect()}
    facts = {}
    for r in pool.collect():
        facts.setdefault(r["target"], []).append((r["fact"], r["key"]))
    starts = catalog.select(F.col("parent_asin").alias("target"), C.normalize_text(C.category_leaf(F.col("categories"))).alias("category"))
    negative = {r["target"]: r["fact"] for r in generate.negative_facts(catalog, starts, posting).collect()}
    want = {}
    for t in (r["target"] for r in targets.collect()):
        for variant, first in (("base", []), ("negative", [negative[t]] if t in negative else None)):
            if first is not None and (ids := greedy(rows, t, facts.get(t, []), config, first)):
                want[t, variant] = ids
    assert got == want and {v for _, v in want} == {"base", "negative"}
