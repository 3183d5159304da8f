"""What whole texts ask for, however long they are."""

import random
import re
import time

from pyspark.sql import functions as F

import __spark_entry__
from targetlake.functions.text import normalize_text
from targetlake.functions.vocab import ASKED_FOR, ATTRIBUTE_ALIASES, ATTRIBUTES
from targetlake.operators import questions


def test_the_end_of_a_long_text_counts(spark, tmp_path):
    import duckdb

    said = ["so it is. " * 120, "so it is. " * 120 + "Which company makes it?", "so it is. " * 5000 + "Anything else?", "Which style? " + "so it is. " * 120 + "How much can you spend?", "x" * 1196 + " price", None, ""]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {("unsupported", "unsupported"): 3, ("natural_language", "ask:brand"): 1, ("broad_question", "ask:broad"): 1, ("natural_language", "ask:budget+style"): 1, ("natural_language", "ask:budget"): 1}
    got = {(r["reason"], r["signature"]): r["n"] for r in __spark_entry__.queries()["conversation_questions"](spark, str(tmp_path)).collect()}
    assert got == want
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rows = db.sql(__spark_entry__.oracle_sql()["conversation_questions"])
    assert {(r["reason"], r["signature"]): r["n"] for r in (dict(zip(rows.columns, x, strict=True)) for x in rows.fetchall())} == want


def test_linear_patterns_find_what_the_plain_ones_do(spark):
    rng = random.Random(4)
    words = ["what", "for", "where", "use", "when", "wear", "What", "USE", "somewhat", "fort", "who", "should", "it", "come", "be", "from", "é", "."]
    blanks = [" "] * 4 + ["\n"] * 3 + ["", "\t", "\r", "  ", " \n", "\n ", "\n\n", " \n \n"]
    texts = {"".join(x for _ in range(rng.randint(1, 9)) for x in (rng.choice(words), rng.choice(blanks), rng.choice(blanks))) for _ in range(6000)}
    for a, b in (("what", "for"), ("where", "use"), ("when", "wear")):
        texts |= {f"{m}{a}{r}{x}{s}{b}{e}" for m in ("", "a ", f"{a}\n", f"{a} ") for r in blanks for x in ("", "x", f"{a}", f"x {a}", "x\ny") for s in blanks for e in ("", "x", " x")}
    texts |= {f"{a}{r}{x}{s}{b} from{e}" for a in ("who", "where") for r in blanks for x in ("", "should it", "does  it", "would\nit", "it") for s in blanks for b in ("be", "come") for e in ("", "x")}
    every = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").repartition(4)
    for attribute in ("use_case", "brand"):
        got = {r["t"]: r["hit"] for r in every.select("t", F.col("t").rlike("(?iu)" + questions.linear(ASKED_FOR[attribute])).alias("hit")).collect()}
        want = {t: any(re.search(p, t, re.IGNORECASE) for p in ASKED_FOR[attribute]) for t in texts}
        assert {t for t in texts if got[t] != want[t]} == set() and 200 < sum(want.values()) < len(texts) - 200
    assert {a for a in ASKED_FOR if questions.linear(ASKED_FOR[a]) != "(?:" + "|".join(ASKED_FOR[a]) + ")"} == {"use_case", "brand"}


def test_a_long_line_is_looked_through_once(spark):
    lines = ["what when where " * 60_000, "who" + " " * 300_000 + "x", "what" + " " * 300_000 + "x", "where\n" * 60_000, "what" + " \n" * 150_000 + "x", "what " * 60_000 + "for"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, m string").repartition(4)
    began = time.time()
    got = {r["i"]: r["a"] for r in asked.select("i", questions.interpreted(F.col("m"), F.lit(None).cast("string"))["text"].alias("a")).collect()}
    assert [i for i in range(len(lines)) if "use_case" in got[i]] == [5] and time.time() - began < 60


def test_texts_that_name_nothing_are_told_at_once(spark):
    rng = random.Random(5)
    words = sorted({w for a in ATTRIBUTES[:-1] for p in (*ASKED_FOR[a], *ATTRIBUTE_ALIASES[a]) for w in re.findall(r"[a-z口碑]+", re.sub(r"\\.", " ", p))})
    texts = {"".join(rng.choice((w, w, w.upper(), w.title())) + rng.choice((" ", "  ", "\n", ". ", "s ", "-")) for w in rng.choices(words, k=rng.randint(1, 4))) for _ in range(4000)}
    texts |= {f" {a}." for x in ATTRIBUTES[:-1] for a in ATTRIBUTE_ALIASES[x]} | {"KİND of \u0131tem", "\u017fize", "ma\u212aer", "the \ufb01t of it", "口碑", "x口碑", ""}
    every = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").repartition(4)
    alone = F.array_compact(F.array(*[F.when(F.col("t").rlike("(?iu)(?:" + "|".join(ASKED_FOR[a]) + ")"), F.lit(a)) for a in ATTRIBUTES[:-1]]))
    normal = F.concat(F.lit(" "), normalize_text(F.col("t")), F.lit(" "))
    aliased = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(f" {x} ") for x in ATTRIBUTE_ALIASES[a]]), lambda x: F.contains(normal, x)), F.lit(a)) for a in ATTRIBUTES[:-1]]))
    rows = every.select("t", questions.text_attributes(F.col("t")).alias("got"), alone.alias("alone"), aliased.alias("aliased"), F.col("t").rlike("(?iu)" + questions.any_asked()).alias("some")).collect()
    assert [r for r in rows if r["some"] != bool(r["alone"]) or set(r["got"]) != {*r["alone"], *r["aliased"]}] == []
    assert 500 < sum(not r["got"] for r in rows) < len(rows) - 500 and {a for r in rows for a in r["alone"]} == set(ATTRIBUTES[:-1])
