"""Quality rules with thresholds that adapt to each language and source.

Each document's base measures are taken from its whole text by DataFrame
expressions. For every measure a mergeable quantile sketch is built per
(language, source): counts over logarithmic buckets of fixed relative width, so
that merging is adding counts, the result doesn't depend on the order of rows,
and any quantile is known to ``GAMMA``. Quantiles are read from sketches shrunk
towards the wider group: a source's counts are mixed with ``PRIOR`` documents'
worth of its language's, and those with ``PRIOR`` of the whole table's, so that
large groups speak for themselves, small ones follow the wider group, and no size
is treated apart.

A fence lies some spreads beyond a tail quantile, the spread being the distance
of two quantiles of the group. Where both quantiles are equal, the spread is what
one event makes in the group's median document, from the sketches of document
sizes, and never less than the quantiles' own error. The documents are joined to
the fences and filtered.

Nulls: a null text has no words and fails the base rule; a null language or
source is a group of its own. Repeated rows are measured and returned one by
one; ties with a fence are inside. Columns beyond those named are passed by. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Relative width of the sketch's buckets.
GAMMA = 1.02
#: Documents' worth of the wider group's sketch in a narrower one's.
PRIOR = 200.0
#: measure: (lower quantile, tail quantile, spreads beyond the tail, sketch of document sizes, parts that one event makes)
UPPER = {
    "symbols": (0.5, 0.9, 3.0, "chars", 1.0),
    "dup_lines": (0.5, 0.99, 1.0, "lines", 1.0),
    "repeats": (0.5, 0.99, 1.0, "words", 3.0),
    "word_length": (0.1, 0.9, 2.0, "words", 0.0),
}
#: Measures with a lower fence too: as many spreads below the lower quantile.
LOWER = ("word_length",)
#: Error of the difference of two quantiles, as a share of the larger one.
ERROR = 2 * (GAMMA - 1)
#: Scale of the measures that are shares.
SCALE = 10000.0


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though lambdas refer to it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Equal windows are found by sorting, never by comparing all pairs: the sorted
    (window hash, place) pairs put them side by side, and the places of the
    repeated ones, sorted again, cover min(3, gap to the next) words each.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def repeated(sorted_pairs: Column) -> Column:
        same = F.filter(
            sorted_pairs,
            lambda e, i: F.coalesce(F.get(sorted_pairs, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(sorted_pairs, i + 1)["h"] == e["h"], F.lit(False)),
        )
        return bound(F.sort_array(F.transform(same, lambda e: e["p"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound(pairs, repeated))

    hashes = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), 1, F.size(words) - 2)
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound(hashes, windows))


def measured(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Base measures of every document, one row each, without the text; ``keys`` are columns kept with them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    of_words = bound(
        word_array(text),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("r")),
    )
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return docs.select(
        "doc_id", *keys, "lang", "source", of_words.alias("w"), of_lines.alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    ).select(
        "doc_id", *keys, "lang", "source", F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"), "n_symbols",
        F.col("l.d").cast("long").alias("n_dup_lines"), F.col("w.r").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def _share(part: str, whole: str) -> Column:
    return F.col(part) * F.lit(SCALE) / F.greatest(F.col(whole), F.lit(1))


def ratios() -> dict[str, Column]:
    """The measures that have fences."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "word_length": F.col("word_chars") * F.lit(1000.0) / F.greatest(F.col("n_words"), F.lit(1)),
    }


def sizes() -> dict[str, Column]:
    """Sizes of a document that tell what one event makes."""
    return {"chars": F.col("word_chars").cast("double"), "lines": F.col("n_lines").cast("double"), "words": F.col("n_words").cast("double")}


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative value: 0 below 1, else one for each step of ``GAMMA``."""
    return F.when(value < 1, F.lit(0)).otherwise(F.floor(F.ln(value) / F.ln(F.lit(GAMMA))) + 1).cast("int")


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the documents that pass the base rule; merging is adding ``n``."""
    every = ratios() | sizes()
    long = measures.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in every.items()])).alias("m")
    )
    return long.select("lang", "source", "m.*").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _upto(sketch: DataFrame, keys: list[str], buckets: DataFrame) -> DataFrame:
    """(keys, measure, bucket, upto, docs): documents of each group up to each of the table's buckets, and all of its documents."""
    counts = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    grid = counts.groupBy(*keys, "measure").agg(F.sum("n").alias("docs")).join(F.broadcast(buckets), "measure")  # a few thousand buckets at most, by GAMMA
    same = F.expr(" AND ".join(f"g.{k} <=> c.{k}" for k in (*keys, "measure", "bucket")))
    filled = grid.alias("g").join(counts.alias("c"), same, "left").select(*[f"g.{k}" for k in (*keys, "measure", "bucket", "docs")], F.coalesce("c.n", F.lit(0)).alias("n"))
    return filled.withColumn("upto", F.sum("n").over(W.partitionBy(*keys, "measure").orderBy("bucket"))).drop("n")


def quantiles(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(lang, source, measure, q) with ``q`` a map of quantiles of the group's sketch, shrunk to its language's and the table's."""
    buckets = sketch.select("measure", "bucket").distinct()
    whole = _upto(sketch, [], buckets).select("measure", "bucket", (F.col("upto") / F.col("docs")).alias("all_share"))
    shrunk = lambda wider: (F.col("upto") + F.lit(prior) * F.col(wider)) / (F.col("docs") + F.lit(prior))
    by_lang = _upto(sketch, ["lang"], buckets).join(F.broadcast(whole), ["measure", "bucket"]).select(
        F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), F.col("bucket").alias("_bucket"), shrunk("all_share").alias("lang_share")
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure")) & (F.col("bucket") == F.col("_bucket"))
    own = _upto(sketch, ["lang", "source"], buckets).join(by_lang, same).withColumn("share", shrunk("lang_share"))
    middle = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - F.lit(0.5)))
    wanted = sorted({0.5} | {q for low, tail, *_ in UPPER.values() for q in (low, tail)})
    at = [x for q in wanted for x in (F.lit(str(q)), F.min(F.when(F.col("share") >= F.lit(q), middle)))]
    return own.groupBy("lang", "source", "measure").agg(F.create_map(*at).alias("q"))


def fences(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>) of every group; a low fence that isn't used is null."""
    by = quantiles(sketch, prior).groupBy("lang", "source").pivot("measure", [*UPPER, "chars", "lines", "words"]).agg(F.first("q"))
    out = []
    for name, (low, tail, spreads, size, events) in UPPER.items():
        at = lambda q, of=name: F.col(of)[str(q)]
        unit = F.lit(events * SCALE) / F.greatest(at(0.5, size), F.lit(1.0))
        width = F.greatest(at(tail) - at(low), unit, at(tail) * F.lit(ERROR)) * F.lit(spreads)
        out += [(at(low) - width if name in LOWER else F.lit(None).cast("double")).alias(f"low_{name}"), (at(tail) + width).alias(f"high_{name}")]
    return by.select("lang", "source", *out)


def judged(docs: DataFrame, prior: float = PRIOR, keys: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict of every document: ``kept`` is false beyond its group's fences or if the base rule fails; ``broken`` names the fences."""
    measures = written(measured(docs, keys), "quality-measures")
    limits = fences(sketches(measures), prior)
    joined = measures.alias("d").join(limits.alias("f"), F.expr("d.lang <=> f.lang AND d.source <=> f.source"), "left")
    broken = F.array_compact(F.array(*[
        F.when((value > F.col(f"high_{name}")) | F.coalesce(value < F.col(f"low_{name}"), F.lit(False)), F.lit(name)) for name, value in ratios().items()
    ]))
    return joined.select(
        "d.doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit("")).otherwise(F.array_join(broken, ",")).alias("broken"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
