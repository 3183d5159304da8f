"""How filters overlap: survivors of every subset of five filters, by subset-zeta transform.

Every document gets a mask of the filters it fails. The masks are counted by
part; beyond that no document is looked at again. A zeta transform over subsets
(one addition of shifted counts a filter) turns the 32 counts of a part into the
documents whose failures lie within each set, so the survivors of a set of filters
are those within its complement. A step of a filter order is the difference of two
neighbouring sets, as are the lost good and toxic documents; the Shapley sum adds
a filter's differences over all orders.

The fifth filter fails a text that a smaller id has too. Texts are known by their
SHA-256. Rows are counted by (id, text, part), then by (text, part, labels) with
the least id, so that a text's copies, however many, are summed before they meet:
what is compared within a text are its counted groups.

Nulls: a null text is empty (and equal to empty ones), a null lang is the part
'', a null id is no smaller than any and has none smaller. Repeated rows count
one by one; rows that share their id don't fail by each other. A document's label
is that of any row of its id in the labels. A part without documents has no
rows, an empty table gives none. Extra columns are passed by.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality_rules import word_array

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")


def own_failures(text: Column, words: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for bit, test in enumerate(failed):
        mask = mask + F.when(test, 1 << bit).otherwise(0)
    return mask


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Add good and toxic; rows without an id have no labels. Spark splits a hot id (or null) in the left side."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return counted.join(flags, "doc_id", "left").fillna(False, ["good", "toxic"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text")).withColumn("_words", word_array(F.col("_text")))
    rows = rows.select("doc_id", "part", own_failures(F.col("_text"), F.col("_words")).alias("own"), F.unhex(F.sha2("_text", 256)).alias("text_key"))
    counted = rows.groupBy("doc_id", "text_key", "part", "own").agg(F.count("*").alias("n"))
    groups = labelled(counted, labels).groupBy("text_key", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.isnull("doc_id"), F.col("n"))), F.lit(0)).alias("without_id"),
        F.min(F.when(F.isnotnull("doc_id"), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(W.partitionBy("text_key"))  # a text has a row for each part and label at most
    firsts = F.col("without_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).select("part", "own", "good", "toxic", "n", firsts.alias("firsts"))
    both = F.array(F.struct(F.col("own").alias("mask"), F.col("firsts").alias("m")), F.struct((F.col("own") + COPY).alias("mask"), (F.col("n") - F.col("firsts")).alias("m")))
    pairs = split.select("part", "good", "toxic", F.inline(both))
    return pairs.groupBy("part", "mask").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("m")).otherwise(0)).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays over the filter sets 0 to 31, of the documents that pass all of a set."""
    names = ("n", "good", "toxic")
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    within = counts.groupBy("part").agg(*(F.array(*(at(c, m) for m in range(ALL + 1))).alias(c) for c in names))
    for k in range(len(FILTERS)):
        bit = 1 << k
        add = lambda c: F.transform(c, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) > 0, x + F.get(F.col(c), i - bit)).otherwise(x)).alias(c)  # noqa: B023, E731
        within = within.select("part", *(add(c) for c in names))
    # What fails only filters of the complement passes those of the set.
    return within.select("part", *(F.reverse(c).alias(c) for c in names))


def steps() -> Column:
    """Every (filter_order, step, bit, before): the filter of the step as a bit, and the set of those applied before it."""
    bits = {x: 1 << k for k, x in enumerate(FILTERS)}
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    mask = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), b).otherwise(0) for x, b in bits.items()), F.lit(0))

    def of(order: Column, step: Column) -> Column:
        return F.struct(order.alias("filter_order"), step.alias("step"), mask(F.substr(order, step, F.lit(1))).alias("bit"), mask(F.substr(order, F.lit(1), step - 1)).alias("before"))

    return F.flatten(F.transform(orders, lambda order: F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda step: of(order, step))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step keeps, removes and loses."""
    passed = survivors(mask_counts(docs, labels))
    rows = passed.select("*", F.inline(steps()))
    survive = lambda c, s: F.get(F.col(c), s)
    before, after, none, bit = F.col("before"), F.col("before") + F.col("bit"), F.lit(0), F.col("bit")
    lost = lambda c: survive(c, before) - survive(c, after)
    rows = rows.select(
        "part", "filter_order", "step", "bit", survive("n", after).alias("kept"), lost("n").alias("removed"),
        (survive("n", none) - survive("n", bit) - lost("n")).alias("redundant"), (survive("n", ALL - bit) - survive("n", F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    # All rows of a part are its 600 steps.
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")
