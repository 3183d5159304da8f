"""Mixing, filter audit and fill-in-middle against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from targetlake.llm import fill_in_middle, filter_audit, mixing

DOCS = "doc_id long, text string, lang string, source string, form string, taken string, part int, _row string, epoch string"


def make_rows(seed=9):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "GAMMA", "d1", "é", "ßx", "😀", "#", "a|b", "the", "of"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 60, 199, 200, 201, 400]))) for _ in range(60)]
    texts += [texts[3]] * 9 + ["", None, None, "   ", "\n\t", "x", "ab<P>c", "<S>", "a<M", "é" * 50, "same same " * 150, "Aa1\n" * 90, "q " * 30_000]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "b", "c", "", None]), "clash", "clash", 3, "clash", "clash") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "hot", *rows[0][4:]), (None, texts[3], "de", "b", *rows[0][4:])]
    rows += [rows[5], rows[5], rows[5], (5, "another text of five", "en", None, *rows[0][4:]), (3, texts[3], "fr", "c", *rows[0][4:])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def fim(ident, text):
    """(n, form, prefix, middle, output) by the plain rule."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs, rows, empty):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(map(tuple, fill_in_middle.digest(docs).collect()))
    want = Counter()
    for i, text, *_ in rows:
        n, form, p, m, out = fim(i, text)
        want[i, n, form, p, m, sha(out), sha(text or "")] += 1
    assert got == want and {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.digest(empty).count() == 0
    whole = fill_in_middle.transformed(docs)
    assert whole.columns == [*(c for c in docs.columns if c != "form"), "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter((r["doc_id"], r["text"], r["output"]) for r in whole.collect()) == Counter((i, t, fim(i, t)[-1]) for i, t, *_ in rows)


def test_fill_in_middle_kernel_at_every_cut():
    """All cuts of texts whose neighbours end and begin in letters, marks cut in two and empty texts."""
    texts = ["ab", "cd1e", "", "é<", "P>x", "😀😀a", None, "z"]
    for a in range(6):
        for b in range(6):
            h = pa.array([[a, b, 0, 50]] * len(texts)).flatten().to_numpy().reshape(-1, 4)
            n, form, p, m, out = (x.to_pylist() for x in fill_in_middle.kernel(pa.array(texts), h))
            for k, t in enumerate(texts):
                u = units(t or "")
                x, y = sorted((a % (len(u) + 1), b % (len(u) + 1)))
                if not t:
                    assert (n[k], form[k], p[k], m[k], out[k]) == (0, "plain", None, None, "")
                else:
                    pre, mid, suf = "".join(u[:x]), "".join(u[x:y]), "".join(u[y:])
                    assert (n[k], form[k], p[k], m[k], out[k]) == (len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def failures(rows):
    """The filters that each row fails."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^ \t-\r]+", text)
        test = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        out.append({k for k, v in test.items() if v})
    return out


def test_filter_audit(spark, docs, rows, empty):
    rng = random.Random(4)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, table).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    want, shapley, parts = {}, Counter(), {r[2] or "" for r in rows}
    fails = failures(rows)
    assert {frozenset(x) for x in fails} > {frozenset(), frozenset("E")} or any("E" in x for x in fails)
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                before = set(order[: step - 1])
                want[part, order, step] = [len(left), len(gone), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, x] += len(gone)
    want = {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert got == want and len(got) == 600 * len(parts)
    assert filter_audit.audit(empty, table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:2] == (0, 0)


def test_copies_are_counted_before_they_meet(spark):
    """A third of all rows with one text: what is compared within it are its counted groups."""
    some = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {r["mask"]: r["n"] for r in filter_audit.mask_counts(some, none).collect()}
    assert sum(n for m, n in counts.items() if m & filter_audit.COPY) == 999 and sum(counts.values()) == 3000


def water_fill(sizes):
    """Targets by raising the level by hand."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        share = {s: (budget - sum(2 * sizes[x] for x in full)) * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] for s in full} | share
        full |= over


def n_words(text):
    return len(re.findall(r"[^ \t-\r]+", text or ""))


def weight_of(text):
    lines = text.split("\n")
    return max(0.05, 1 - 20 * len(re.findall(r"[#*$%&|<>]", text)) / (len(text) + 1)) * max(0.05, len(set(lines)) / len(lines))


def expected_mix(rows):
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += n_words(text)
    target, out = water_fill(dict(sizes)), Counter()
    for s in sizes:
        own = []
        for i, text, _, source, *_ in rows:
            if source == s:
                t = text or ""
                u = (int(hashlib.sha256(f"11:{'' if i is None else i}:{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-math.log(u) / weight_of(t), i, n_words(t)))
        words = min(math.floor(target[s] + 0.5), 2 * sizes[s])
        epochs = words // sizes[s] if sizes[s] else 0
        rest = words - epochs * sizes[s]
        for _, i, size in sorted(own, key=lambda x: x[0]):
            part = min(size, rest)
            rest -= part
            out[i, size, sizes[s], round(target[s], 6), epochs * size + part] += 1
    return out


def test_mixing(spark, docs, rows, empty):
    got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.digest(docs).collect())
    assert got == expected_mix(rows)
    assert mixing.digest(empty).count() == 0
    again = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.digest(docs.repartition(7)).collect())
    assert again == got
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.digest(blank).collect()] == [(0, 0.0, 0)] * 2


def test_mixture_repeats_and_cuts(docs, rows):
    mix = mixing.mixed(docs)
    assert mix.columns == [c for c in docs.columns if c != "epoch"] + ["epoch"]
    taken, texts = Counter(), defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1] or "")
    for r in mix.collect():
        taken[r["doc_id"]] += n_words(r["text"])
        assert any(t.startswith(r["text"] or "") for t in texts[r["doc_id"]]) and r["taken"] == "clash"
    want = Counter()
    for (i, *_, words), n in expected_mix(rows).items():
        want[i] += words * n
    assert +taken == +want


def test_finer_cells_and_repeated_rows(spark, rows, monkeypatch):
    """Cells of one document force all passes; rows that are equal share a key to the last digit."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    some = rows + [(7000, "one two three", "en", "b", *rows[0][4:])] * 40 + [(7001, "four five", "en", "twins", *rows[0][4:])] * 31 + [(7002, "w " * 400, "en", s, *rows[0][4:]) for s in ("zz", "zy")]
    docs = spark.createDataFrame(some, DOCS).repartition(5)
    got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.digest(docs).collect())
    assert got == expected_mix(some)


def test_weights_draw_the_better_documents(spark):
    """Of equal documents, those of four times the weight are taken more often, as the law says."""
    text = " ".join(f"w{k}" for k in range(10))
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit(" "), "id").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    got = mixing.digest(docs, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("doc_id >= 2000")
    share = {r["odd"]: r["s"] - 1 for r in got.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg(F.col("taken") / F.col("size")).alias("s")).collect()}
    # a stops at two epochs; b gets one and a third. A key under t is drawn with 1 - exp(-weight t).
    left = 1 - share[1]
    assert share[0] + share[1] == pytest.approx(2 / 3, abs=0.001) and share[0] == pytest.approx(1 - left**4, abs=0.03)
