"""Candidate counts of all subsets of a sample's facts from one pass over the catalog.

Each product has a bit mask of the facts of a sample that it satisfies; products
are counted by (sample, mask). The count of any subset S is the sum over masks
that hold S. Masks are arrays of bigints, ``BITS`` facts a word, as many words as the
longest sample needs.

No product is held against every sample. Statements about texts are equi-joins with
the index or, for parts of texts, with the field's distinct values that share their
rarest trigrams; a negated one is true by default and its hits turn it off, so only
hits are rows. A statement about numbers is an interval between two places in the
order of the field's values. A sample's own places cut each field into cells, and
the products in each box of cells follow from counts of products at or below its
corners, see :mod:`.dominance`: rows are near (products + thresholds) x log. Products
that texts have hit are then taken out of their sample's default. Those that the same
texts hit and whose numbers lie between the same places are counted as one profile, so
that hits are rows of a profile and a sample, however many products share it. Without
an index of their own, products are first counted by their values and numbers in the
fields that are asked for, and one row stands for all that agree in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..functions.vocab import AT_LEAST, AT_MOST, EQUAL, HOLDS, NEGATIVE, NUMERIC
from ..sources.catalog import with_values
from ..sources.scratch import written
from .dominance import dominated
from .predicates import expected_number, match_numeric
from .ranks import prefix_sums

#: Facts in one word of a mask.
BITS = 62
#: Parts of 2**-16 in which a number is looked for near a threshold: wider than any tolerance.
NEAR = 65536.0
#: Names of fields that a product's values are narrowed to at most; with more of them asked for, all values stay.
FIELDS = 1000
#: Trigrams, the rarest, that a value must share with a part before it is compared.
PROBES = 2


def has(mask: Column, place: Column) -> Column:
    """Whether a mask holds the fact at a place."""
    word = F.coalesce(F.get(mask, F.floor(place / BITS).cast("int")), F.lit(0).cast("bigint"))
    return F.call_function("shiftright", word, (place % BITS).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % BITS).cast("int"))


def _either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def _stated(samples: DataFrame) -> DataFrame:
    """(sample_id, pos, kind, field, value, operator, number): the samples' facts, each normalised once."""
    facts = samples.where(F.size("facts") > 0).select("sample_id", F.posexplode("facts").alias("pos", "fact"))
    field, operator = F.col("fact.field"), F.col("fact.operator")
    kind = (
        F.when(field.isin(*NUMERIC), "number").when(operator.isin(*EQUAL), "equal").when(operator.isin(*HOLDS), "holds").when(operator.isin(*NEGATIVE), "lacks").otherwise("never")
    )
    return facts.select("sample_id", "pos", kind.alias("kind"), field.alias("field"), normalize_text(F.col("fact.value_str")).alias("value"), operator.alias("operator"), expected_number(F.col("fact")).alias("number"))


def _words_of(places: Column, words: int) -> list[Column]:
    """Aggregates of the words of a mask that holds the places of all rows."""
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(F.bit_or(F.when(F.floor(places / BITS) == w, _bit(places))), zero) for w in range(words)]


def _grams(text: Column, size: int) -> Column:
    """Distinct parts of ``size`` characters; a shorter text has none."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(parts: DataFrame, values: DataFrame) -> DataFrame:
    """(field, part, value): the distinct values of a field that hold a part of a text.

    ``parts``: field and part; ``values``: field and value, both distinct. Every gram of the part occurs in such a
    value, so those that have the part's rarest grams are fetched from gram postings, and only they are compared.
    Parts of fewer than three characters are one gram, and the empty one is in every value.
    """
    of_part = F.when(F.length("part") >= 3, _grams(F.col("part"), 3)).otherwise(F.array("part"))
    asked = parts.select("field", "part", F.explode(of_part).alias("gram"))
    sizes = sorted(r["n"] for r in asked.select(F.length("gram").alias("n")).distinct().collect())  # 0 to 3
    every = F.flatten(F.array(*[F.array(F.lit("")) if n == 0 else _grams(F.col("value"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    key = F.xxhash64("field", "value")
    posting = values.select("field", key.alias("key"), F.explode(every).alias("gram")).join(asked.select("field", "gram").distinct(), ["field", "gram"], "left_semi")
    posting = written(posting, "gram-postings")
    common = posting.groupBy("field", "gram").agg(F.count("*").alias("n"))
    told = asked.join(common, ["field", "gram"], "left").groupBy("field", "part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    probes = told.where(F.get("g", 0)["n"] > 0).select("field", "part", F.size("g").alias("grams"), F.explode(F.slice("g", 1, PROBES)).alias("p"))
    probes = probes.select("field", "part", F.least("grams", F.lit(PROBES)).alias("need"), F.col("p.gram").alias("gram"))
    shared = probes.join(posting, ["field", "gram"]).groupBy("field", "part", "key").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    return shared.join(values.withColumn("key", key), ["field", "key"]).where(F.contains("value", F.col("part"))).select("field", "part", "value")


def _of_values(field: Column) -> Column:
    """A stated field as the values have it."""
    return F.when(field.startswith("detail:"), F.concat(F.lit("detail:"), normalize_text(F.substring(field, F.lit(8), F.length(field))))).otherwise(field)


def _asked_for(catalog: DataFrame, stated: DataFrame, some_parts: bool) -> DataFrame:
    """(parent_asin, indexed, vals, price, rating, rating_count): the products' values and numbers in the fields that are asked for; the numbers of others are null."""
    said = stated.where("kind <> 'number'").select(F.explode(F.array_distinct(F.array("field", _of_values(F.col("field"))))).alias("field")).where("field IS NOT NULL").distinct()
    fields = sorted(r["field"] for r in said.limit(FIELDS + 1).collect())
    numbers = {r["field"] for r in stated.where("kind = 'number'").select("field").distinct().collect()}  # three at most
    narrowed = lambda c: F.filter(c, lambda v: v["field"].isin(fields)) if len(fields) <= FIELDS else F.col(c)
    parts = narrowed("vals") if some_parts else F.array().cast("array<struct<field:string,value:string>>")
    return with_values(catalog).select("parent_asin", narrowed("indexed").alias("indexed"), parts.alias("vals"), *[(F.col(f) if f in numbers else F.lit(None)).cast("double").alias(f) for f in NUMERIC])


def _counted(catalog: DataFrame, stated: DataFrame, samples: DataFrame, some_parts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the facts don't tell apart counted as one row (row, indexed, vals, price, rating, rating_count, n), the index of these (field, value, row), and the targets' rows (target, row)."""
    key = ["indexed", "vals", *NUMERIC]
    rows = _asked_for(catalog, stated, some_parts).groupBy(*key).agg(F.count("*").alias("n")).withColumn("target", F.lit(None).cast("string"))
    # A target has a row of its own, which counts for none.
    targets = catalog.join(samples.select(F.col("target").alias("parent_asin")).distinct(), "parent_asin", "left_semi")
    own = _asked_for(targets, stated, some_parts).select(F.col("parent_asin").alias("target"), *key, F.lit(0).cast("bigint").alias("n"))
    rows = written(rows.unionByName(own).withColumn("row", F.monotonically_increasing_id()), "mask-rows")
    index = rows.select(F.explode_outer("indexed").alias("v"), "row").where("v IS NOT NULL").select("v.field", "v.value", "row")
    return rows, index, rows.where("target IS NOT NULL").select("target", "row")


def _text_hits(products: DataFrame, posting: DataFrame, stated: DataFrame, words: int, some_parts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The statements about texts by number (sample_id, pos, text), what hits each distinct one (text, row), and the bits (sample_id, default) that are true without a hit."""
    said = stated.where("kind IN ('equal', 'holds', 'lacks')")
    default = said.where("kind = 'lacks'").groupBy("sample_id").agg(F.array(*_words_of(F.col("pos"), words)).alias("default"))
    index = posting.select(F.col("field").alias("_field"), F.col("value").alias("_value"), "row")
    same = (F.col("field") == F.col("_field")) & (F.col("value") == F.col("_value"))
    if some_parts:
        # A negated value that the index has excludes exact matches, any other one what holds it.
        listed = index.join(said.where("kind = 'lacks'").select(F.col("field").alias("_field"), F.col("value").alias("_value")), ["_field", "_value"], "left_semi").select("_field", "_value").distinct().withColumn("_listed", F.lit(True))
        marked = said.join(listed, same, "left").drop("_field", "_value").withColumn("exact", (F.col("kind") == "equal") | ((F.col("kind") == "lacks") & F.col("_listed").isNotNull())).drop("_listed")
    else:
        marked = said.withColumn("exact", F.lit(True))
    marked = written(marked, "mask-said")
    texts = written(marked.select("exact", "field", "value").distinct().withColumn("text", F.monotonically_increasing_id()), "mask-texts")
    told = marked.join(texts, ["exact", "field", "value"]).select("sample_id", "pos", "text")
    hits = texts.where("exact").join(index, same).select("text", "row")
    if some_parts and not texts.where("NOT exact").isEmpty():
        part = texts.where("NOT exact").select("text", _of_values(F.col("field")).alias("field"), F.col("value").alias("part"))
        values = products.select("row", F.explode("vals").alias("v")).select("row", "v.field", "v.value")
        values = written(values.join(part.select("field").distinct(), "field", "left_semi"), "mask-values")
        found = containing(part.select("field", "part").distinct(), values.select("field", "value").distinct())
        held = found.join(values, ["field", "value"]).select("field", "part", "row")
        hits = hits.unionByName(part.join(held, ["field", "part"]).select("text", "row"))
    return told, hits, default


def _bucket(value: Column) -> Column:
    """Where a number is looked for; very large ones share a place."""
    most = float(1 << 62)
    return F.floor(F.least(F.greatest(value * NEAR, F.lit(-most)), F.lit(most)))


def _intervals(products: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Statements as intervals of coordinates, the values' coordinates, and each field's highest one.

    (field, operator, number, lo, hi, turned): true for what has a number above ``lo`` up to ``hi``, or with ``turned``
    for all else. A product without a number has the coordinate 0, the others 1 plus the cuts below their value.
    """
    actual = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in NUMERIC])).alias("x")
    values = products.select(actual).select("x.field", "x.v").where("v IS NOT NULL").join(told.select("field").distinct(), "field", "left_semi").distinct()
    values = written(values.withColumn("bucket", _bucket(F.col("v"))), "mask-numbers")
    compared = told.where("number IS NOT NULL").where(F.col("operator").isin(*AT_MOST, *AT_LEAST, *EQUAL, "neq"))
    around = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: _bucket(F.col("number")) + k)).alias("bucket")
    kind = F.when(F.col("operator").isin(*AT_MOST), "le").when(F.col("operator").isin(*AT_LEAST), "ge").otherwise("eq")
    near = compared.select("field", "operator", "number", kind.alias("kind"), around).join(values, ["field", "bucket"], "left")
    match = F.coalesce(match_numeric(F.col("v"), F.when(F.col("kind") == "eq", "eq").otherwise(F.col("operator")), F.col("number")), F.lit(False)) & F.col("v").isNotNull()
    below = ~match & F.col("v").isNotNull() & ((F.col("kind") != "eq") | (F.col("v") < F.col("number")))
    # Where no value is near, a cut lies just below the parts that were looked at.
    edge = F.struct((F.min("bucket") / NEAR).alias("at"), F.lit(-1).alias("side"))
    cut = lambda test: F.coalesce(F.max(F.when(test, F.struct(F.col("v").alias("at"), F.lit(1).alias("side")))), edge)
    cuts = near.groupBy("field", "operator", "number", "kind").agg(cut(match).alias("upto"), cut(below).alias("from"))
    cuts = cuts.withColumn("upto", F.when((F.col("kind") == "eq") & (F.col("upto.side") == -1), F.col("from")).otherwise(F.col("upto")))
    cuts = written(cuts, "mask-cuts")
    places = cuts.where("kind <> 'ge'").select("field", "upto.*").unionByName(cuts.where("kind <> 'le'").select("field", "from.*")).distinct()
    both = places.withColumn("cut", F.lit(1)).unionByName(values.select("field", F.col("v").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("cut")))
    placed = prefix_sums(both, "cut", F.col("field"), F.col("at"), F.col("side"))
    offset, upto = {}, 0
    for r in sorted(placed.groupBy("field").agg(F.sum("cut").alias("n")).collect()):  # three fields at most
        offset[r["field"]], upto = upto, upto + r["n"]
        offset[r["field"], "n"] = r["n"]
    highest = {f: offset.get((f, "n"), 0) + 1 for f in NUMERIC}
    start = reduce(lambda out, f: F.when(F.col("field") == f, offset.get(f, 0)).otherwise(out), NUMERIC, F.lit(0))
    corner = (F.col("upto") - start).cast("long")
    axis = placed.where("cut = 0").select("field", F.col("at").alias("v"), (corner + 1).alias("x"))
    at = placed.where("cut = 1").select("field", "at", "side", corner.alias("corner"))
    top = reduce(lambda out, f: F.when(F.col("field") == f, F.lit(highest[f])).otherwise(out), NUMERIC, F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")

    def joined(rows: DataFrame, c: str, name: str) -> DataFrame:
        key = at.select(F.col("field").alias("_f"), F.col("at").alias("_a"), F.col("side").alias("_s"), F.col("corner").alias(name))
        return rows.join(key, (F.col("field") == F.col("_f")) & (F.col(f"{c}.at") == F.col("_a")) & (F.col(f"{c}.side") == F.col("_s")), "left").drop("_f", "_a", "_s")

    ends = joined(joined(cuts, "upto", "_hi"), "from", "_lo")
    known = ends.select("field", "operator", "number", F.when(F.col("kind") == "le", zero).otherwise(F.col("_lo")).alias("lo"), F.when(F.col("kind") == "ge", top).otherwise(F.col("_hi")).alias("hi"))
    return known.withColumn("turned", F.col("operator") == "neq"), axis, highest


def _placed(rows: DataFrame, axis: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with the coordinate of each field's value, ``x_`` and the field."""
    for f in fields:
        of = axis.where(F.col("field") == f).select(F.col("v").alias("_v"), F.col("x").alias("_x"))
        rows = rows.join(of, F.col(f) == F.col("_v"), "left").withColumn(f"x_{f}", F.coalesce("_x", F.lit(0).cast("long"))).drop("_v", "_x")
    return rows


def _points(products: DataFrame, axis: DataFrame, fields: list[str]) -> DataFrame:
    """Products by their coordinates in some fields."""
    return _placed(products.groupBy(*fields).agg(F.sum("n").alias("n")), axis, fields).select(*[F.col(f"x_{f}").alias(f) for f in fields], "n")


def _profiles(held: DataFrame, measured: DataFrame, axis: DataFrame | None, fields: list[str]) -> DataFrame:
    """(profile, texts, n, price, rating, rating_count): products by the texts that hit them and their coordinates in the fields that are asked for, with one product's numbers; written.

    Products of one coordinate satisfy the same comparisons, so any of their numbers stands for all.
    """
    out = held.join(measured, "row").groupBy("texts", *fields).agg(F.sum("n").alias("n"))
    if fields:
        out = _placed(out, axis, fields).groupBy("texts", *[f"x_{f}" for f in fields]).agg(F.sum("n").alias("n"), *[F.first(f).alias(f) for f in fields])
    numbers = [F.col(f) if f in fields else F.lit(None).cast("double").alias(f) for f in NUMERIC]
    return written(out.select(F.monotonically_increasing_id().alias("profile"), "texts", "n", *numbers), "mask-profiles")


def _boxes(products: DataFrame, numbers: DataFrame, axis: DataFrame, highest: dict[str, int], words: int) -> DataFrame:
    """(sample_id, own, n): products by the numeric facts of each sample that they satisfy.

    ``numbers``: sample_id, pos, field, lo, hi, turned.
    """
    ends = numbers.select("sample_id", "field", F.explode(F.array("lo", "hi")).alias("c"))
    top = reduce(lambda out, f: F.when(F.col("field") == f, F.lit(highest[f])).otherwise(out), NUMERIC, F.lit(0)).cast("long")
    corners = ends.groupBy("sample_id", "field").agg(F.collect_set("c").alias("c")).withColumn("c", F.array_sort(F.array_union("c", F.array(F.lit(0).cast("long"), top))))
    cells = corners.select("sample_id", "field", F.posexplode("c").alias("cell", "c"))
    true = (F.col("lo") < F.col("c")) & (F.col("c") <= F.col("hi"))
    marked = cells.join(numbers, ["sample_id", "field"]).groupBy("sample_id", "field", "cell", "c").agg(F.array(*_words_of(F.when(true != F.col("turned"), F.col("pos")), words)).alias("mask"))
    rows = marked.groupBy("sample_id", "field").agg(F.array_sort(F.collect_list(F.struct("cell", "c", "mask"))).alias("m"))
    # A corner counts for its own cell and against the next one.
    signed = F.transform("m", lambda e, i: F.struct(e["c"].alias("c"), F.array_compact(F.array(
        F.struct(e["mask"].alias("mask"), F.lit(1).alias("sign")), F.when(i + 1 < F.size("m"), F.struct(F.get("m", i + 1)["mask"].alias("mask"), F.lit(-1).alias("sign"))),
    )).alias("s")))
    by_field = [F.max(F.when(F.col("field") == f, signed)).alias(f) for f in NUMERIC]
    wide = written(rows.groupBy("sample_id").agg(*by_field, F.array_sort(F.collect_set("field")).alias("fields")), "mask-cells")
    out = None
    for fields in sorted(r["fields"] for r in wide.select("fields").distinct().collect()):  # seven at most
        own = wide.where(F.col("fields") == F.array(*map(F.lit, fields))).select("sample_id", *fields)
        for f in fields:
            own = own.withColumn("_e", F.explode(f)).withColumn(f, F.col("_e.c")).withColumn(f"_{f}", F.col("_e.s")).drop("_e")
        dims = sorted(fields, key=lambda f: -highest[f])  # what has the most cuts is sorted, the others are divided
        below = dominated(_points(products, axis, fields), own, dims, highest)
        part = own.join(below, fields).withColumn("sign", F.col("below")).withColumn("own", F.array(*[F.lit(0).cast("bigint")] * words))
        for f in fields:
            part = part.withColumn("_e", F.explode(f"_{f}")).withColumn("own", _either(F.col("own"), F.col("_e.mask"))).withColumn("sign", F.col("sign") * F.col("_e.sign"))
        part = part.select("sample_id", "own", F.col("sign").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _own(words: int) -> Column:
    """The mask of the comparisons (``numbers``: pos, field, operator, number) that the row's price, rating and rating_count satisfy."""
    actual = lambda f: F.when(f["field"] == "price", F.col("price")).when(f["field"] == "rating", F.col("rating")).otherwise(F.col("rating_count"))
    holds = lambda f: F.coalesce(match_numeric(actual(f), f["operator"], f["number"]), F.lit(False))
    zero = F.lit(0).cast("bigint")
    some = F.coalesce("numbers", F.array().cast("array<struct<pos:int,field:string,operator:string,number:double>>"))
    word = lambda w: F.aggregate(F.filter(some, lambda f: F.floor(f["pos"] / BITS) == w), zero, lambda m, f: m.bitwiseOR(F.when(holds(f), _bit(f["pos"])).otherwise(zero)))
    return F.array(*[word(w) for w in range(words)])


def mask_histogram(catalog: DataFrame, posting: DataFrame | None, samples: DataFrame) -> DataFrame:
    """(sample_id, mask, n, target_mask): products by mask, and the target's own mask on its row.

    ``samples``: sample_id, target, facts, of any number. Without ``posting`` the products' own values are the index, and none is written;
    ids are then taken to be unique.
    """
    # Each is read several times below, and texts are to be normalised once.
    samples = written(samples.select("sample_id", "target", "facts"), "mask-samples")
    stated = written(_stated(samples), "mask-facts")
    told_of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    last, some_numbers, some_parts = stated.agg(F.max("pos"), told_of("number"), told_of("holds", "lacks")).first()
    words = (last or 0) // BITS + 1
    none = F.array(*[F.lit(0).cast("bigint")] * words)
    if posting is None:
        products, posting, targets = _counted(catalog, stated, samples, some_parts > 0)
    else:
        products = written(catalog if "vals" in catalog.columns else with_values(catalog), "mask-products").withColumn("row", F.col("parent_asin")).withColumn("n", F.lit(1).cast("bigint"))
        posting, targets = written(posting, "mask-postings").withColumnRenamed("parent_asin", "row"), samples.select("target", F.col("target").alias("row")).distinct()
    said, hits, default = _text_hits(products, posting, stated, words, some_parts > 0)
    held = written(hits.groupBy("row").agg(F.array_sort(F.collect_set("text")).alias("texts")), "mask-held")
    told = stated.where("kind = 'number'")
    numbers = told.groupBy("sample_id").agg(F.collect_list(F.struct("pos", "field", "operator", "number")).alias("numbers"))
    asked = samples.select("sample_id", "target").join(default, "sample_id", "left").join(numbers, "sample_id", "left").withColumn("default", F.coalesce("default", none))
    asked = written(asked, "mask-asked")
    measured = products.select("row", "n", "price", "rating", F.col("rating_count").cast("double").alias("rating_count"))
    number = products.agg(F.sum("n")).first()[0] or 0
    bare = asked.where("numbers IS NULL").select("sample_id", F.col("default").alias("mask"), F.lit(number).cast("bigint").alias("n"))
    whole, axis, fields = bare, None, []
    if some_numbers:
        fields = sorted(r["field"] for r in told.select("field").distinct().collect())  # three at most
        intervals, axis, highest = _intervals(measured, told.select("field", "operator", "number").distinct())
        same = [F.col("field") == F.col("_f"), F.col("operator") == F.col("_o"), F.col("number") == F.col("_n")]
        known = told.join(intervals.select(F.col("field").alias("_f"), F.col("operator").alias("_o"), F.col("number").alias("_n"), "lo", "hi", "turned"), same, "left")
        zero = F.lit(0).cast("long")
        # What can't be compared is false, or true of all if it is negated.
        known = written(known.select("sample_id", "pos", "field", F.coalesce("lo", zero).alias("lo"), F.coalesce("hi", zero).alias("hi"), (F.col("operator") == "neq").alias("turned")), "mask-intervals")
        boxes = _boxes(measured, known, axis, highest, words)
        whole = whole.unionByName(boxes.join(asked, "sample_id").select("sample_id", _either(F.col("default"), F.col("own")).alias("mask"), "n"))
    flip = F.array(*_words_of(F.col("pos"), words)).alias("flip")
    profiles = _profiles(held, measured, axis, fields)
    flips = profiles.select("profile", F.explode("texts").alias("text")).join(said, "text").groupBy("sample_id", "profile").agg(flip)
    touched = flips.join(asked, "sample_id").join(profiles.drop("texts"), "profile").withColumn("own", _own(words))
    turned = F.zip_with("default", "flip", lambda x, y: x.bitwiseXOR(y))
    moved = F.array(
        F.struct(_either(turned, F.col("own")).alias("mask"), F.col("n").alias("n")),
        F.struct(_either(F.col("default"), F.col("own")).alias("mask"), (-F.col("n")).alias("n")),
    )
    counted = whole.unionByName(touched.select("sample_id", F.explode(moved).alias("m")).select("sample_id", "m.mask", "m.n")).groupBy("sample_id", "mask").agg(F.sum("n").alias("n")).where("n > 0")
    on_target = asked.select("sample_id", "target").join(targets, "target").join(held, "row").select("sample_id", F.explode("texts").alias("text")).join(said, ["sample_id", "text"]).groupBy("sample_id").agg(flip)
    own = asked.join(targets, "target").join(measured, "row").join(on_target, "sample_id", "left")
    target = own.select("sample_id", _either(F.zip_with("default", F.coalesce("flip", none), lambda x, y: x.bitwiseXOR(y)), _own(words)).alias("mask"), F.lit(True).alias("_own"))
    return counted.join(target, ["sample_id", "mask"], "left").select("sample_id", "mask", "n", F.when(F.col("_own"), F.col("mask")).alias("target_mask"))


def subset_count(places: list[int], mask: str = "mask", n: str = "n") -> Column:
    """Aggregate over a sample's histogram: products that satisfy all facts at some places."""
    held = reduce(lambda out, p: out & has(F.col(mask), F.lit(p)), places, F.lit(True))
    return F.coalesce(F.sum(F.when(held, F.col(n))), F.lit(0))


def superset_sums(hist: DataFrame, facts: int) -> DataFrame:
    """(sample_id, counts): for each subset of the first ``facts`` facts, as a number of 2**facts, how many products satisfy all of it.

    One addition of shifted counts a fact turns the counts by mask into those of all subsets.
    """
    by_mask = hist.select("sample_id", (F.get("mask", 0).bitwiseAND(F.lit((1 << facts) - 1))).alias("m"), "n").groupBy("sample_id", "m").agg(F.sum("n").alias("n"))
    found = by_mask.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("by"))
    zero = F.lit(0).cast("bigint")
    out = found.select("sample_id", F.transform(F.sequence(zero, F.lit((1 << facts) - 1).cast("bigint")), lambda m: F.coalesce(F.try_element_at(F.col("by"), m), zero)).alias("counts"))
    for k in range(facts):
        bit = 1 << k
        out = out.select("sample_id", F.transform("counts", lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) == 0, F.get(F.col("counts"), i + bit)).otherwise(zero)).alias("counts"))  # noqa: B023
    return out
