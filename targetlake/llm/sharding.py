"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Every row gets a number; its source block is the input partition it sits in.
2. The rows that each block sends to each shard are drawn exactly: for a uniform
   permutation the counts follow the multivariate hypergeometric law given the
   block sizes and the shard sizes (at most one apart).
3. Each block permutes its rows locally and deals them out by its matrix row.
4. The rows move to their shards and are permuted again there.

Only block sizes (at most ``max_blocks`` numbers) pass through the driver. All
work on rows is DataFrame expressions.

Nulls: a null text has size 1 and the checksum of the empty text; a null or
repeated id is a row like any other. Extra columns are left out of the digest
and kept by :func:`shuffled`. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import partitions, written


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard, for a uniform random permutation.

    Row sums are ``block_rows``; column sums differ by one at most.
    """
    total = sum(block_rows)
    left = np.array([(total + shards - 1 - j) // shards for j in range(shards)], dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    rng.shuffle(left)  # which shards get the odd rows is random too
    out = np.zeros((len(block_rows), shards), dtype=np.int64)
    for i, n in enumerate(block_rows):
        need, rest = n, int(left.sum())
        for j in range(shards):
            rest -= int(left[j])
            if rest == 0:
                out[i, j] = need
            elif need and left[j]:
                out[i, j] = _hypergeometric(rng, int(left[j]), rest, need)
            need -= int(out[i, j])
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken from an urn are good ones, by inversion around the mode, for urns of any size.

    The law's ratios of neighbours are quotients of whole numbers below 2**53, so the
    weights are right to double precision, without log-factorials. What lies beyond
    nine standard deviations (and 60 rows) is less than the step of a uniform double.
    """
    n = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    reach = 60 + int(9 * (draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5)
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # steps from k to k + 1
    with np.errstate(divide="ignore"):
        step = np.log((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)))
    weight = np.append(0.0, np.cumsum(step))
    weight = np.exp(weight - weight.max())
    upto = np.cumsum(weight)
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def _unit(seed: int, salt: str, row: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), row)


def assigned(numbered: DataFrame, row: str, shards: int = 16, seed: int = 7, max_blocks: int = 65536) -> DataFrame:
    """Add ``shard`` and ``slot`` to a written table with a unique long column ``row``.

    ``row`` is ``monotonically_increasing_id()``; its upper bits are the source partition.
    """
    spark = numbered.sparkSession
    blocks = numbered.withColumn("_block", F.pmod(F.shiftright(row, 33), F.lit(max_blocks)))
    sizes = sorted((r["_block"], r["n"]) for r in blocks.groupBy("_block").agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    cuts = spark.createDataFrame(
        [(b, [int(x) for x in line]) for (b, _), line in zip(sizes, matrix.cumsum(axis=1), strict=True)],
        "_block long, _cuts array<long>",
    )
    local = W.partitionBy("_block").orderBy(_unit(seed, "local", F.col(row)), row)
    dealt = (
        blocks.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "_block")  # at most max_blocks rows of `shards` numbers
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int"))
        .drop("_block", "_cuts", "_rank")
    )
    return _slots(dealt, row, seed)


def _slots(dealt: DataFrame, row: str, seed: int) -> DataFrame:
    """Gapless places in each shard in the order of a second hash.

    A shard is cut into ranges of that hash, so that no shard is sorted in one task:
    a row's place is the size of the ranges before its own, plus its place there.
    """
    cuts = max(4, partitions(dealt.sparkSession))
    unit = _unit(seed, "slot", F.col(row))
    cut = dealt.withColumn("_unit", unit).withColumn("_cut", F.floor((F.shiftrightunsigned("_unit", 1) / F.lit(2.0**63)) * cuts))
    before = (
        cut.groupBy("shard", "_cut").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy("shard").orderBy("_cut")) - F.col("_n"))
        .drop("_n")
    )
    inner = W.partitionBy("shard", "_cut").orderBy(F.shiftrightunsigned("_unit", 1), row)
    return (
        cut.withColumn("_place", F.row_number().over(inner) - 1)
        .join(before, ["shard", "_cut"])
        .withColumn("slot", (F.col("_before") + F.col("_place")).cast("long"))
        .drop("_unit", "_cut", "_place", "_before")
    )


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """Shard and slot of every document, with its size and checksum but not its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = assigned(written(digest, "shard-digest"), "_row", shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shuffled(rows: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The whole rows with ``shard`` and ``slot``; a clashing column of that name is replaced."""
    numbered = rows.drop("shard", "slot").select(F.struct("*").alias("_whole"), F.monotonically_increasing_id().alias("_row"))
    return assigned(written(numbered, "shard-rows"), "_row", shards, seed).select("_whole.*", "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 7) -> None:
    """Write one folder a shard, its rows in the order of their slots within each file."""
    placed = shuffled(rows, shards, seed)
    placed.repartitionByRange(partitions(rows.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
