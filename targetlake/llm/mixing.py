"""Mixing sources to target weights by weighted sampling without replacement.

1. Each source gets a target: its share of the budget by weight, at most
   ``MOST_EPOCHS`` times its size; what capped sources leave goes to the others
   by weight until none is above. The level (words a unit of weight) rises by
   rounds, each one aggregate over the table of sources.
2. Complete epochs come first: every document of the source is taken as often as
   its size fits into the target. The rest of the target is a fraction of an epoch.
3. For that, every document has an exponential key, divided by its quality weight
   (Efraimidis and Spirakis): the order of the keys is a weighted sample without
   replacement, of which the first documents fill the rest. The document at the
   edge is cut to the words that are left.

No source is sorted. Words are summed by (source, leading digits of the key), the
prefix sums of these few rows tell in which cell the rest of the target ends, and
only that cell is cut finer, until it has ``EDGE_ROWS`` documents at most, which
are then ordered. All else is decided by comparing keys. A hot source thus takes
part in partial aggregates alone.

Keys come from hashes of id and text, so reruns agree, however rows are dealt.
Only rows that are equal in both share a key; which of them is taken makes no
difference, and their row numbers part them.

Nulls: a null text has no words (taken is 0), a null source is the last one, a
null id hashes as the empty string. Repeated rows are taken one by one. Sources
of no words have the target 0. An empty table gives no rows. Extra columns are
kept by :func:`mixed` (but for the names of its results) and left out of :func:`digest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .quality_rules import word_array
from .scratch import written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a share of all sizes, and the most epochs of a source.
BUDGET, MOST_EPOCHS = 1.5, 2
#: Documents of a source that are ordered in one group, at most.
EDGE_ROWS = 10_000
#: Bits of a key's digit: a source is cut into so many cells a pass.
DIGIT = 10
#: Keys are whole numbers of so many bits.
KEY_BITS = 60


def quality_weight(text: Column) -> Column:
    """Between 0.0025 and 1: lower for symbols among the characters and for repeated lines."""
    clean = F.lit(1.0) - F.lit(20.0) * (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))) / (F.length(text) + 1)
    lines = F.split(text, "\n")
    return F.greatest(F.lit(0.05), clean) * F.greatest(F.lit(0.05), F.size(F.array_distinct(lines)) / F.size(lines))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """Order-preserving whole number of an exponential variable of rate ``weight``, from the hash of id and text.

    The logarithm of the variable lies between -37 and 44 for weights down to 10**-17.
    """
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text), 256), 1, 13)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.floor((F.ln(-F.ln(unit)) - F.ln(weight) + 64.0) * float(1 << (KEY_BITS - 7))).cast("long")


def sized(docs: DataFrame, weight: Column | None = None, seed: int = 11, row: Column | None = None) -> DataFrame:
    """(doc_id, source, size, key, row) of every document, written; ``weight`` is an expression over the columns of ``docs``, 1e-17 at least."""
    text = F.coalesce("text", F.lit(""))
    weight = quality_weight(text) if weight is None else weight
    row = F.monotonically_increasing_id() if row is None else row
    size = F.size(word_array(text)).cast("long")
    return written(docs.select("doc_id", "source", size.alias("size"), exponential_key(F.col("doc_id"), text, weight, seed).alias("key"), row.alias("row")), "mixing-sizes")


def level(sources: DataFrame, budget: float) -> float:
    """Words a unit of weight, so that the targets, capped, add up to the budget."""
    cap = F.col("source_size") * float(MOST_EPOCHS)
    out = 0.0
    while True:
        capped = F.col("weight") * F.lit(out) > cap
        full, free = sources.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped & (F.col("source_size") > 0), F.col("weight")))).first()
        if not free:
            return out
        higher = (budget - (full or 0.0)) / free
        if higher <= out:
            return out
        out = higher


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = BUDGET) -> DataFrame:
    """(source, source_size, target) of every source, written."""
    sizes = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"), name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    at = level(sources, share * words)
    return written(sources.select("source", "source_size", F.least(F.col("weight") * at, F.col("source_size") * float(MOST_EPOCHS)).alias("target")), "mixing-targets")


def _with(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows with their source's state; Spark broadcasts the written table if it is small, and splits hot sources else."""
    named = state.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def edges(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources, written, with epochs, rest (words beyond them), and the cell of keys in which the rest ends.

    A cell is the keys that begin with ``cell``, ``shift`` bits apart from their end; it has ``docs`` documents,
    and ``before`` words have smaller keys.
    """
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST_EPOCHS)
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    none = F.lit(0).cast("long")
    begun = sources.select("*", epochs.alias("epochs")).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    state = begun.select("source", "rest", none.alias("cell"), none.alias("before"), none.alias("docs")).where("rest > 0")
    shift = KEY_BITS
    while shift > 0:
        finer = shift - DIGIT
        inside = _with(rows, state).where(F.shiftright("key", shift) == F.col("cell"))
        cells = inside.groupBy("source", "rest", "before", F.shiftright("key", finer).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        # At most 2**DIGIT cells a source.
        upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("cell"))
        ending = cells.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        state = written(ending.select("source", "rest", "cell", (F.col("upto") - F.col("words")).alias("before"), "docs"), "mixing-cells")
        shift = finer
        if (state.agg(F.max("docs")).first()[0] or 0) <= EDGE_ROWS:
            break
    found = state.drop("rest").withColumnRenamed("source", "_source")
    every = begun.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return written(every.fillna({"cell": -1, "before": 0, "docs": 0}).withColumn("shift", F.lit(shift)), "mixing-edges")


def taken(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Add to every document its source's state and ``part``, its words in the fraction of an epoch."""
    known = _with(rows, state).withColumn("place", F.expr("shiftright(key, shift)"))
    part = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    decided = known.where("place <> cell").withColumn("part", F.when(F.col("place") < F.col("cell"), F.col("size")).otherwise(0))
    edge = known.where("place = cell")
    order = W.partitionBy("source").orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)
    few = edge.where(F.col("docs") <= EDGE_ROWS).withColumn("part", part(F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))))
    out = decided.unionByName(few)
    if (state.agg(F.max("docs")).first()[0] or 0) > EDGE_ROWS:
        # Cut to the last digit, such a cell holds repeated rows alone, of one size.
        many = ranked(edge.where(F.col("docs") > EDGE_ROWS), F.col("source"), F.col("row"), name="rank")
        first = many.groupBy("source").agg(F.min("rank").alias("first"))
        out = out.unionByName(_with(many, first).withColumn("part", part(F.col("before") + (F.col("rank") - F.col("first")) * F.col("size"))).drop("rank", "first"))
    return out.drop("place", "cell", "before", "docs", "shift")


def digest(docs: DataFrame, weight: Column | None = None, seed: int = 11) -> DataFrame:
    """Size, target of its source and words taken of every document."""
    rows = sized(docs, weight, seed)
    out = taken(rows, edges(rows, targets(rows)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its nth word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+"), F.lit(0)), 1, n), "")


def mixed(docs: DataFrame, weight: Column | None = None, seed: int = 11) -> DataFrame:
    """The mixture: each document once for every complete epoch and once for its part of the next, cut there if it is at the edge; ``epoch`` counts from 0."""
    weight = quality_weight(F.coalesce("text", F.lit(""))) if weight is None else weight
    numbered = written(docs.select(F.struct("*").alias("_whole"), weight.alias("_weight"), F.monotonically_increasing_id().alias("_row")), "mixing-docs")
    rows = sized(numbered.select("_whole.doc_id", "_whole.text", "_whole.source", "_weight", "_row"), F.col("_weight"), seed, F.col("_row"))
    chosen = taken(rows, edges(rows, targets(rows))).select("row", "size", "part", F.col("epochs").cast("int").alias("times")).where("times > 0 OR part > 0")
    joined = numbered.drop("_weight").join(chosen, F.col("_row") == F.col("row"))
    times = F.when(F.col("part") > 0, F.col("times")).otherwise(F.col("times") - 1)
    rows = joined.select("_whole", "times", "part", "size", F.explode(F.sequence(F.lit(0), times)).alias("epoch"))
    cut = (F.col("epoch") == F.col("times")) & (F.col("part") < F.col("size"))
    text = F.when(cut, first_words(F.col("_whole.text"), F.col("part").cast("int"))).otherwise(F.col("_whole.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("_whole").getField(c).alias(c) for c in docs.columns if c != "epoch"), "epoch")
