"""Catalog, facts, masks, generation, validation, traces and metrics on a catalog of four products."""

import json
import random

import pytest
from pyspark.sql import functions as F

from targetlake import cli
from targetlake.functions import text as T
from targetlake.operators import generate, masks, metrics, predicates, questions, validate
from targetlake.plans.entries import QUESTIONS
from targetlake.sources import catalog as C
from targetlake.sources import jsonl, scratch
from targetlake.sources import traces as TR
from targetlake.streaming import traces as streams


def product(ident, title, price, color, size, rating, count, **more):
    """A raw record of a shoe."""
    raw = {
        "parent_asin": ident, "title": title, "features": ["Keeps rain out on long runs", "Bright stripe on the heel"], "description": ["A light trail shoe made for rain."], "price": price,
        "categories": ["Apparel", "Shoes", "Trail Shoes"], "details": {"Color": color, "Material": "Nylon", "Size": size, "Style": "Trail"}, "average_rating": rating, "rating_number": count, "store": "Ridge",
    }
    return raw | more


RECORDS = [
    product("Q000000001", "Ridge Runner Crimson Red", 79.0, "Red", "10", 4.6, 1200), product("Q000000002", "Ridge Runner Deep Blue", 79.0, "Blue", "10", 4.6, 1200),
    product("Q000000003", "Ridge Runner Crimson Red Wide", "$89.00", "Red", "11", 4.7, 1300),
    product("Q000000004", "Town Walker Black", 49.0, "Black", "10", 4.2, 200, categories=["Apparel", "Shoes", "Sneakers"], store="Town", features=["Airy upper of mesh"], description=["A casual sneaker for walks."], details={"Color": "Black", "Material": "Mesh", "Size": "10", "Style": "Casual"}),
]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "catalog.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in RECORDS) + "\n\n")
    return C.read_catalog(spark, str(path)).cache()


@pytest.fixture(scope="module")
def posting(catalog):
    return C.postings(catalog).cache()


@pytest.fixture(scope="module")
def samples(catalog, posting):
    return generate.generated(catalog, posting, 2, 3, scenarios=("intent_override", "negative_constraint")).cache()


def ids(df):
    return sorted(r["parent_asin"] for r in df.collect())


def test_products_and_candidates(spark, catalog, posting):
    first = catalog.where("parent_asin = 'Q000000003'").first()
    assert first["price"] == 89.0 and first["rating_count"] == 1300 and [d["key"] for d in first["details"]] == ["Color", "Material", "Size", "Style"]
    rows = C.with_values(catalog)
    assert ids(predicates.candidates(rows, posting, [("detail:color", "eq", "Red")])) == ["Q000000001", "Q000000003"]
    assert ids(predicates.candidates(rows, posting, [("detail:color", "eq", "Red"), ("price", "le", "80")])) == ["Q000000001"]
    assert ids(predicates.candidates(rows, posting, [("color", "eq", "red")])) == []  # not indexed
    assert ids(predicates.candidates(rows, posting, [("store", "neq", "ridge")])) == ["Q000000004"]
    with pytest.raises(ValueError, match="duplicate"):
        C.catalog_from_records(spark, [RECORDS[0], RECORDS[0]])
    bare = C.catalog_from_records(spark, [{"parent_asin": "X", "price": True, "details": {"Ratings review": "12 of 20"}}]).first()
    assert bare["categories"] == ["None"] and bare["price"] is None and bare["rating_count"] == 12


def test_bad_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"parent_asin": "a"}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        C.products(C.read_json_lines(spark, str(tmp_path / "x.jsonl"))).collect()
    with pytest.raises(ValueError, match=r"x\.jsonl, line 2: not a JSON object: \[1\]"):
        C.read_catalog(spark, str(tmp_path / "x.jsonl"))
    (tmp_path / "y.jsonl").write_text('{"parent_asin": "a"}\n\n' * 2000 + '{"parent_asin": \n')
    with pytest.raises(ValueError, match="line 4001"):
        C.check_json_lines(spark, str(tmp_path / "y.jsonl"))


def test_nested_values_become_text(spark):
    raw = {"parent_asin": "X", "title": ["Red", None, "", "shoe"], "store": {"name": "Ridge", "note": "", "tags": []}, "details": {"Sizes": ["10", "11"], "Care": {"wash": "cold"}, "Note": "[x"}}
    row = C.catalog_from_records(spark, [raw]).first()
    assert row["title"] == "Red shoe" and row["store"] == "name Ridge"
    assert [(d["key"], d["value"]) for d in row["details"]] == [("Sizes", "10 11"), ("Care", "wash cold"), ("Note", "[x")]


def flat(value):
    """A nested value as text, by plain recursion."""
    if isinstance(value, dict):
        return " ".join(f"{k} {flat(x)}" for k, x in value.items() if x is not None and x != "" and x != [])
    return " ".join(flat(x) for x in value if x is not None and x != "") if isinstance(value, list) else str(value)


def test_values_nested_to_any_usual_depth(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["red", "12", 7, "", None, "a b", 2.5])
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind < 0.6 else {f"k{i}": value(depth - 1) for i in range(rng.randint(0, 3))}

    records = [{"parent_asin": f"N{i}", "title": [value(4), "end"], "store": {"in": value(4), "name": "x"}, "features": {"f": value(3), "g": "y"}, "details": {"a": value(5), "b": value(5), "c": "z"}} for i in range(60)]
    want = {r["parent_asin"]: (flat(r["title"]).strip(), flat(r["store"]).strip(), [(k, flat(x).strip()) for k, x in r["details"].items() if x is not None and x != "" and x != [] and flat(x).strip()]) for r in records}
    got = {r["parent_asin"]: (r["title"], r["store"], [tuple(d) for d in r["details"]]) for r in C.catalog_from_records(spark, records).collect()}
    assert got == want


def test_text_forms(spark):
    row = spark.createDataFrame([("Straße ﬁx ΟΔΟΣ µ_1, A", "x -1,234.5 y", "The RED red shoe 12 x9y")], "a string, b string, c string")
    got = row.select(T.normalize_text(F.col("a")).alias("a"), T.parse_number(F.col("b")).alias("b"), T.tokens(F.col("c")).alias("c"), T.compact_text(F.lit(" a   b ")).alias("d"), T.parse_int(F.lit("-2.7")).alias("e")).first()
    assert tuple(got) == ("strasse fix οδοσ μ_1 a", -1234.5, ["red", "shoe", "x9y"], "a b", -2)


def test_generated_samples_are_valid(catalog, posting, samples):
    rows = samples.collect()
    assert [r["scenario_type"] for r in rows] == ["intent_override", "negative_constraint"] and len({r["target"] for r in rows}) == 2
    assert all(r["valid"] for r in validate.validated(catalog, posting, samples).collect())
    with pytest.raises(generate.GenerationError):
        generate.generated(catalog, posting, 1, scenarios=("no_such",))


def test_tampering_is_found(catalog, posting, samples):
    broken = samples.withColumn("query", F.lit("hello")).withColumn("target", F.when(F.col("scenario_type") == "intent_override", "gone").otherwise(F.col("target")))
    found = {r["sample_id"]: r for r in validate.validated(catalog, posting, broken).collect()}
    assert not any(r["valid"] for r in found.values())
    assert any("query[0].unsaid" in r["errors"] for r in found.values())
    assert any(r["errors"] == ["unknown_target"] and r["diagnostics"] is None for r in found.values())
    assert all(e.rpartition(".")[2] in validate.RULES for r in found.values() for e in r["errors"])
    whole = validate.rolled_up(validate.validated(catalog, posting, broken)).first()
    assert not whole["valid"] and whole["invalid_count"] == 2


def test_samples_survive_files(spark, catalog, posting, samples, tmp_path):
    jsonl.write_samples(samples, str(tmp_path / "out"))
    back = jsonl.read_samples(spark, str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.select("sample_id", "query", "signature", "override", "replies").collect()))
    assert key(back) == key(samples)
    line = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert list(line) == sorted(line) and "override" in line


def test_bad_samples_from_files(spark, samples, tmp_path):
    line = json.loads(jsonl.sample_lines(samples).first()["value"])
    good = line | {"signature": [*line["signature"], "no fact", None], "override": None}
    (tmp_path / "a.jsonl").write_text(json.dumps(good))
    assert len(jsonl.read_samples(spark, str(tmp_path / "a.jsonl")).first()["signature"]) == len(line["signature"])
    for name in ("partitions", "user_profile"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(line | {name: [1]}))
        with pytest.raises(Exception, match=f"{name} of a sample is no object"):
            jsonl.read_samples(spark, str(tmp_path / f"{name}.jsonl")).collect()
    (tmp_path / "b.jsonl").write_text(json.dumps(line | {"signature": [{"field": "store", "operator": "eq", "value": True, "source": "store"}]}))
    with pytest.raises(Exception, match="fact value must be"):
        jsonl.read_samples(spark, str(tmp_path / "b.jsonl")).collect()


STATED = [
    ("store", "eq", "ridge"), ("store", "neq", "Ridge"), ("store", "not", "idg"), ("store", "contains", "ow"), ("color", "eq", "red"), ("color", "not", "red"), ("feature", "has", "rain out"), ("detail:Color", "contains", "bl"),
    ("detail:color", "eq", "Black"), ("price", "le", "79"), ("price", "eq", "79.0000005"), ("price", "neq", "49"), ("rating", "ge", "4.6"), ("rating_count", "max", "1200"), ("price", "neq", "none"), ("store", "like", "ridge"), ("title_token", "not", "blue"),
]


def test_masks_against_predicates(spark, catalog, posting):
    """Every product's mask by direct evaluation of each fact."""
    held = {(r["field"], r["value"]) for r in posting.collect()}
    fact = lambda f: F.struct(*[F.lit(x).alias(c) for c, x in zip(("field", "operator", "value_str"), f, strict=True)], F.lit(None).cast("double").alias("value_num"))
    rows = C.with_values(catalog)
    listed = [(f[0], spark.range(1).select(T.normalize_text(F.lit(f[2]))).first()[0]) in held for f in STATED]
    own = rows.select("parent_asin", *[F.coalesce(predicates.member(fact(f), F.lit(flag)), F.lit(False)).alias(str(i)) for i, (f, flag) in enumerate(zip(STATED, listed, strict=True))]).collect()
    samples = spark.createDataFrame([("all", "Q000000001"), ("none", "gone")], "sample_id string, target string").withColumn("facts", F.when(F.col("sample_id") == "all", F.array(*[fact(f) for f in STATED])).otherwise(F.array(fact(STATED[0])).cast("array<struct<field:string,operator:string,value_str:string,value_num:double>>")))
    samples = samples.withColumn("facts", F.when(F.col("sample_id") == "none", F.slice("facts", 1, 0)).otherwise(F.col("facts")))
    got = {(r["sample_id"], r["mask"][0]): (r["n"], r["target_mask"] and r["target_mask"][0]) for r in masks.mask_histogram(catalog, posting, samples).collect()}
    want = {}
    for r in own:
        mask = sum(1 << i for i in range(len(STATED)) if r[str(i)])
        n, target = want.get(("all", mask), (0, None))
        want["all", mask] = (n + 1, mask if r["parent_asin"] == "Q000000001" else target)
    assert got == want | {("none", 0): (4, None)}
    many = samples.where("sample_id = 'all'").withColumn("facts", F.array_repeat(F.get("facts", 0), 70))
    assert {tuple(r["mask"]): r["n"] for r in masks.mask_histogram(catalog, posting, many).collect()} == {(0, 0): 1, ((1 << 62) - 1, (1 << 8) - 1): 3}


def session(ident, target, observations, **more):
    return {"sample_id": ident, "scenario_type": "direct_search", "target_parent_asin": target, "trace": observations} | more


TURNS = [{"turn": 1, "recommendations": [{"parent_asin": "b"}, " a "], "simulator_status": "revealed"}, "no object", {"turn": "2", "recommendations": ["a"]}, {"turn": None, "recommendations": "a"}]


def test_traces_and_metrics(spark, tmp_path):
    lines = [session("1", "a", TURNS), session("2", "z", TURNS), session("3", "a", TURNS, metrics_start_turn="2"), session("4", "a", []), session("6", "a", "x", turns=TURNS)]
    turns = session("5", "a", None, turns=TURNS)
    del turns["trace"]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in [*lines, turns]))
    trace = TR.read_traces(spark, str(tmp_path / "t.jsonl")).cache()
    assert trace.where("sample_id = '1'").count() == 3
    got = {r["sample_id"]: (r["target_turn"], r["target_rank"], r["clarification_turns"]) for r in metrics.first_target(trace).collect()}
    assert got == {"1": (2, 1, 1), "2": (None, None, 1), "3": (2, 1, 1), "4": (None, None, 0), "5": (2, 1, 1), "6": (None, None, 0)}
    summary = cli.report(trace)["summary"]
    assert (summary["count"], summary["hits"], summary["mrr"]) == (6, 3, 0.5) and summary["statuses"] == {"revealed": 4}
    assert "direct_search" in cli.format_report({"summary": summary})
    assert summary["error_count"] == 0 and "protocol errors" not in cli.format_report({"summary": summary})
    # The same from a stream of files.
    query = streams.first_targets(spark, str(tmp_path)).writeStream.format("memory").queryName("first_hits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_state")).start()
    query.awaitTermination(120)
    assert {r["sample_id"]: (r["target_turn"], r["target_rank"], r["clarification_turns"]) for r in spark.table("first_hits").collect()} == got


def test_payloads_turns_and_reasons(spark):
    payload = [{"parent_asin": " a ", "score": 1}, {"parent_asin": "", "product_id": "b", "score": True}, {"product_id": 7, "score": "2"}, None, "  c", 12, 0, True, {"score": 3.5}, ["x"]]
    lines = spark.createDataFrame([(json.dumps({"p": payload}),), (json.dumps({"p": "a"}),), (json.dumps({"p": {"a": 1}}),)], "value string").withColumn("j", F.parse_json("value"))
    got = [[tuple(x) for x in r["r"]] for r in lines.select(TR.recommended(F.try_variant_get("j", "$.p", "variant")).alias("r")).collect()]
    assert got[0][:9] == [("a", 1.0), ("b", None), ("7", None), ("", None), ("c", None), ("12", None), ("", None), ("True", None), ("", 3.5)] and got[1:] == [[], []]
    seen = lambda turn, reasons: {"turn": turn, "recommendations": ["t"], "simulator_status": "", "simulator_diagnostics": reasons}
    sessions = [
        session("1", "t", [seen("7.9", {"route_reason": "r", "reply_reason": 0, "question_interpretation": {"reason": "q"}}), seen(" 3 ", {"route_reason": "r"}), seen(4, "x")], errors=["timed out"], metrics_start_turn=3),
        session("2", " t", [seen(True, {}), seen(2.7, None)], errors=[], metrics_start_turn="x"), session("3", "t", [{"turn": 1, "recommendations": [" t "]}]),
    ]
    trace = TR.observed(spark.createDataFrame([(json.dumps(x),) for x in sessions], "value string").withColumn("j", F.parse_json("value"))).cache()
    assert [r["turn"] for r in trace.orderBy("sample_id", "obs_pos").collect()] == [0, 3, 4, 1, 2, 1]
    assert {r["sample_id"]: (r["target_turn"], r["target_rank"]) for r in metrics.first_target(trace).collect()} == {"1": (3, 1), "2": (None, None), "3": (None, None)}
    summary = cli.report(trace)["summary"]
    assert summary["error_count"] == 1 and summary["simulator"] == {"status_counts": {}, "route_reason_counts": {"r": 2}, "question_reason_counts": {"q": 1}, "reply_reason_counts": {}}
    assert "sessions with protocol errors  1" in cli.format_report({"summary": summary})


def test_case_folding_of_all_characters(spark):
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = [("".join(map(chr, points[i : i + 500])),) for i in range(0, len(points), 500)] + [("Straße ᾳ̈ ﬃ ŉ İ",), ("",)]
    got = spark.createDataFrame(rows, "t string").select("t", T.casefold(F.col("t")).alias("f")).collect()
    assert [r["t"] for r in got if r["t"].casefold() != r["f"]] == []


def test_line_numbers_in_files_of_several_splits(spark, tmp_path):
    """One pass parses; the number counts the lines of the splits before."""
    lines = [json.dumps({"parent_asin": f"A{i}", "title": "x" * 50}) for i in range(5000)]
    (tmp_path / "ok.jsonl").write_text("\n".join(lines))
    lines[4321] = "[]"
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    lines[4321], lines[17] = lines[0].replace("A0", "Z"), '{"title": "no id"}'
    (tmp_path / "none.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert C.read_catalog(spark, str(tmp_path / "ok.jsonl")).count() == 5000
        with pytest.raises(ValueError, match=r"bad\.jsonl, line 4322: not a JSON object: \[\]"):
            C.read_catalog(spark, str(tmp_path / "bad.jsonl"))
        with pytest.raises(ValueError, match=r"none\.jsonl, line 18: a catalog row without parent_asin"):
            C.read_catalog(spark, str(tmp_path / "none.jsonl"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_commands(spark, catalog, posting, samples, tmp_path, capsys):
    (tmp_path / "catalog.jsonl").write_text("\n".join(json.dumps(r) for r in RECORDS))
    jsonl.write_samples(samples, str(tmp_path / "set"))
    made = samples.collect()
    lines = [session(r["sample_id"], "ignored", [{"turn": 1, "recommendations": ["x", r["target"]]}]) for r in made]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    common = ["--catalog", str(tmp_path / "catalog.jsonl"), "--dataset", str(tmp_path / "set")]
    assert cli.main(["validate", *common, "--output", str(tmp_path / "v.json")], spark) == 0 and json.loads((tmp_path / "v.json").read_text())["valid"]
    assert cli.main(["evaluate", *common, "--traces", str(tmp_path / "t.jsonl"), "--output", str(tmp_path / "e.json")], spark) == 0
    assert json.loads((tmp_path / "e.json").read_text())["summary"]["mrr"] == 0.5 and "2 of 2 samples are valid" in capsys.readouterr().out
    (tmp_path / "t2.jsonl").write_text(json.dumps(lines[0]))
    assert cli.main(["evaluate", *common, "--traces", str(tmp_path / "t2.jsonl"), "--output", str(tmp_path / "e.json")], spark) == 1


def test_questions(spark):
    asked = spark.createDataFrame([(i, m, a) for i, (m, a, *_) in enumerate(QUESTIONS)], "i int, m string, a string")
    got = {r["i"]: (",".join(r["q"]["resolved"]), r["q"]["reason"], r["q"]["signature"]) for r in asked.select("i", questions.interpreted(F.col("m"), F.col("a")).alias("q")).collect()}
    assert got == {i: tuple(q[2:]) for i, q in enumerate(QUESTIONS)}


def test_scratch(spark):
    assert scratch.written(spark.range(3), "t").count() == 3
