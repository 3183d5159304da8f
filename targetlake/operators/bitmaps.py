"""Bitmaps of products by fact and block, and what is counted on them.

Products have numbers, and ``BLOCK`` neighbouring numbers are a block. The products
that satisfy a fact are one bitmap a block that has any; a conjunction is the AND of
its facts' bitmaps and its size the number of bits, so that a target's candidates
are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..functions.text import normalize_text
from ..functions.vocab import AT_LEAST, AT_MOST, EQUAL, HOLDS, NEGATIVE, NUMERIC
from ..sources.catalog import with_values
from ..sources.scratch import written
from .masks import containing
from .predicates import expected_number
from .ranks import ranked

#: Products of a block; Spark's bitmaps have as many bits.
BLOCK = 32_768
_BYTES = BLOCK // 8


def _place(number: Column) -> list[Column]:
    return [F.floor(number / BLOCK).alias("block"), (number % BLOCK).alias("at")]


def bit_at(bits: Column, at: Column) -> Column:
    """Whether a bitmap has a bit."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def _matrix(bits: pa.Array) -> np.ndarray:
    """Bitmaps as rows of bytes."""
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(-1, _BYTES)


def _arrow_and_count(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.bitwise_count(_matrix(a) & _matrix(b)).sum(axis=1, dtype=np.int64))


def _arrow_and(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for x in _matrix(a) & _matrix(b)], pa.binary())


def _arrow_and_not(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for x in _matrix(a) & ~_matrix(b)], pa.binary())


and_count = F.arrow_udf(_arrow_and_count, LongType())
both = F.arrow_udf(_arrow_and, BinaryType())
without = F.arrow_udf(_arrow_and_not, BinaryType())


class Numbered:
    """A catalog with product numbers in the order of the ids: ids, values, postings and the blocks' whole bitmaps, all written."""

    def __init__(self, catalog: DataFrame, posting: DataFrame):
        self.ids = written(ranked(catalog.select("parent_asin"), F.col("parent_asin"), name="number"), "numbered-ids")
        self.size = self.ids.count()
        of = with_values(catalog).select("parent_asin", "vals", "indexed", "price", "rating", F.col("rating_count").cast("double").alias("rating_count"))
        self.values = written(of.join(self.ids, "parent_asin"), "numbered-values")
        self.posting = written(posting.join(self.ids, "parent_asin").select("field", "value", "number"), "numbered-postings")
        self.whole = written(bitmaps(self.ids, []), "numbered-blocks")


def bitmaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, bits) of rows with product numbers."""
    return rows.select(*keys, *_place(F.col("number"))).groupBy(*keys, "block").agg(F.bitmap_construct_agg("at").alias("bits"))


def _satisfied(actual: pa.ChunkedArray, operator: str, expected: float | None) -> np.ndarray:
    """:func:`.predicates.match_numeric` of many numbers."""
    null = actual.is_null().to_numpy()
    if expected is None:
        return np.full(len(null), operator == "neq")
    # Spark holds NaN to be above all numbers.
    v = np.nan_to_num(actual.to_numpy().astype(np.float64), nan=np.inf, posinf=np.inf, neginf=-np.inf)
    close = np.abs(v - expected) <= 1e-6
    told = close if operator in EQUAL else v <= expected + 1e-9 if operator in AT_MOST else v + 1e-9 >= expected if operator in AT_LEAST else ~close if operator == "neq" else np.zeros(len(v), bool)
    return np.where(null, operator == "neq", told)


def compared(values: DataFrame, told: list[tuple[int, str, str, float | None]]) -> DataFrame:
    """(fid, block, bits): the products that satisfy each of a chunk's comparisons (fid, field, operator, expected).

    A block's numbers are held against all of them at once, so that no product is a row for each comparison.
    """

    def held(rows: pa.Table) -> pa.Table:
        at, fids, bits = rows["at"].to_numpy().astype(np.int64), [], []
        for fid, field, operator, expected in told:
            hit = at[_satisfied(rows[field], operator, expected)]
            if len(hit):
                ones = np.zeros(BLOCK, np.uint8)
                ones[hit] = 1
                fids.append(fid)
                bits.append(np.packbits(ones, bitorder="little").tobytes())
        blocks = np.full(len(fids), rows["block"][0].as_py(), np.int64)
        return pa.table({"fid": pa.array(fids, pa.int64()), "block": pa.array(blocks), "bits": pa.array(bits, pa.binary())})

    return values.select(*_place(F.col("number")), *NUMERIC).groupBy("block").applyInArrow(held, "fid long, block long, bits binary")


def fact_bitmaps(numbered: Numbered, facts: DataFrame) -> DataFrame:
    """(fid, block, bits): the members of each fact, by the index's semantics.

    ``facts``: fid and fact, of the operators that extraction and negation make. A negated value excludes exact
    matches if the index has its field, and else whatever holds it.
    """
    f = F.col("fact")
    text = facts.where(~f["field"].isin(*NUMERIC)).select("fid", f["field"].alias("field"), f["operator"].alias("operator"), normalize_text(f["value_str"]).alias("value"))
    exact = text.where(F.col("operator").isin(*EQUAL) | (F.col("operator").isin(*NEGATIVE) & F.col("field").startswith("detail:")))
    hits = exact.join(numbered.posting, ["field", "value"]).select("fid", "operator", "number")
    part = text.join(exact.select("fid"), "fid", "left_anti").where(F.col("operator").isin(*HOLDS, *NEGATIVE))
    if not part.isEmpty():
        values = numbered.values.select("number", F.explode("vals").alias("v")).select("number", "v.field", "v.value").join(part.select("field").distinct(), "field", "left_semi")
        found = containing(part.select("field", F.col("value").alias("part")).distinct(), values.select("field", "value").distinct())
        held = found.join(values, ["field", "value"]).select("field", F.col("part").alias("value"), "number").distinct()
        hits = hits.unionByName(part.join(held, ["field", "value"]).select("fid", "operator", "number"))
    said = bitmaps(hits.where(~F.col("operator").isin(*NEGATIVE)), ["fid"])
    negative = text.where(F.col("operator").isin(*NEGATIVE)).select("fid")
    if not negative.isEmpty():
        off = bitmaps(hits.where(F.col("operator").isin(*NEGATIVE)), ["fid"]).withColumnRenamed("bits", "off")
        every = numbered.whole.withColumn("fid", F.explode(F.array(*[F.lit(r["fid"]) for r in negative.collect()])))  # of one chunk: true of all blocks
        said = said.unionByName(every.join(off, ["fid", "block"], "left").withColumn("bits", F.when(F.col("off").isNull(), F.col("bits")).otherwise(without("bits", F.coalesce("off", "bits")))).select("fid", "block", "bits"))
    numbers = facts.where(f["field"].isin(*NUMERIC)).select("fid", f["field"].alias("field"), f["operator"].alias("operator"), expected_number(f).alias("expected"))
    if not numbers.isEmpty():
        told = [(r["fid"], r["field"], r["operator"], r["expected"]) for r in numbers.collect()]  # of one chunk
        said = said.unionByName(compared(numbered.values, told))
    return said


def subset_histogram(rows: DataFrame) -> DataFrame:
    """(sample_id, mask, n): products by the facts that they satisfy, from (sample_id, block, facts: pos and bits); those of no fact are left out."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks, ns = [], [], []
            for ident, facts in zip(batch.column("sample_id").to_pylist(), batch.column("facts").to_pylist(), strict=True):
                code = np.zeros(BLOCK, np.int64)
                for f in facts:
                    code |= np.unpackbits(np.frombuffer(f["bits"], np.uint8), bitorder="little").astype(np.int64) << f["pos"]
                values, n = np.unique(code[code > 0], return_counts=True)
                ids += [ident] * len(values)
                masks += [[int(v)] for v in values]
                ns += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(masks, pa.list_(pa.int64())), pa.array(ns, pa.int64())], names=["sample_id", "mask", "n"])

    made = rows.select("sample_id", "facts").mapInArrow(counts, "sample_id string, mask array<bigint>, n long")
    return made.groupBy("sample_id", "mask").agg(F.sum("n").alias("n"))


