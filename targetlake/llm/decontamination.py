"""Benchmark decontamination by winnowed fingerprints.

Texts are runs of alphanumerics, lower-cased. Both sides are winnowed: of the
hashes of all k-word grams in each sliding window of w grams the least is kept.
Any shared span of at least k + w - 1 words holds a whole window, so both sides
keep the same gram of it; with k + w - 1 equal to the benchmark window of ten
words none is missed. Shared fingerprints are extended to the windows around
them, and a document word inside a matching window is hit. Items of fewer words
than a window are one window of their own length, winnowed with w = 1.

The benchmark is a stated query set. Long items are cut into overlapping segments,
and all into blocks of about ``BLOCK_WINDOWS`` windows. One block at a time is
fetched, broadcast, joined to the fingerprints of all documents in one pass over
them, and released; the hits of several blocks are written and merged by document.

Nulls and texts without words have no hits and match nothing; repeated rows are
reported one by one; items with equal texts are all named. An empty benchmark
hits nothing; an empty table gives no rows. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import alphanumeric, slices

WINDOW = 10
GRAM = 5
#: Windows of the benchmark that one broadcast holds; each takes about 40 bytes.
BLOCK_WINDOWS = 1_000_000
#: Windows of an item's segment, at most.
SEGMENT = 50_000


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash in each sliding window of ``w`` grams, the rightmost of equals, once each."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, back = grams[w - 1 :].copy(), np.zeros(n, np.int8)
    for i in range(1, w):
        other = grams[w - 1 - i : len(grams) - i]
        less = other < best
        np.copyto(best, other, where=less)
        back[less] = i
    place = np.arange(w - 1, len(grams)) - back
    return place[np.append(True, np.diff(place) > 0)]


def item_windows(items: pd.DataFrame) -> pd.DataFrame:
    """(size, h, item_id): every distinct window of the items; a short item is one window."""
    words = alphanumeric(pa.array(items["text"], pa.string()))
    out = []
    for size in sorted({min(int(n), WINDOW) for n in words.counts if n}):
        grams = words.grams(size)
        for i, item in enumerate(items["item_id"]):
            a, b = int(words.offsets[i]), int(words.offsets[i + 1])
            if min(b - a, WINDOW) == size and b > a:
                out.append(pd.DataFrame({"size": size, "h": grams[a : b - size + 1], "item_id": item}))
    return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"size": [], "h": [], "item_id": []})


class Matcher:
    """Windows of one benchmark block, ready to be found in documents."""

    def __init__(self, items: pd.DataFrame):
        words = alphanumeric(pa.array(items["text"], pa.string()))
        windows = item_windows(items)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, group in windows.groupby("size"):
            k = min(GRAM, size) if size == WINDOW else size
            prints, all_grams = [], words.grams(k)
            for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
                if min(b - a, WINDOW) == size:
                    grams = all_grams[a : b - k + 1]
                    prints.append(grams[winnowed(grams, size - k + 1)])
            group = group.sort_values("h")
            hashes = group["h"].to_numpy(np.uint64)
            distinct, first = np.unique(hashes, return_index=True)
            self.sizes[int(size)] = (np.unique(np.concatenate(prints)), distinct, np.append(first, len(hashes)), group["item_id"].to_numpy())

    def hits(self, words) -> tuple[np.ndarray, dict[int, set]]:
        """Which words of a batch are hit, and the items by the text's number."""
        hit = np.zeros(len(words.h), dtype=bool)
        found: dict[int, set] = {}
        for size, (prints, windows, first, item_ids) in self.sizes.items():
            k = GRAM if size == WINDOW else size
            grams = words.grams(k)
            if not len(grams):
                continue
            chosen = winnowed(grams, size - k + 1)
            chosen = chosen[_member(grams[chosen], prints)]
            if not len(chosen):
                continue
            # Extend: the windows that hold a shared fingerprint, inside one text.
            starts = np.unique((chosen[:, None] - np.arange(size - k + 1)).ravel())
            whole = words.grams(size)
            starts = starts[(starts >= 0) & (starts < len(whole))]
            text = np.searchsorted(words.offsets, starts, side="right") - 1
            inside = starts + size <= words.offsets[text + 1]
            starts, text = starts[inside], text[inside]
            at = np.searchsorted(windows, whole[starts])
            at[at == len(windows)] = 0
            same = windows[at] == whole[starts]
            starts, text, at = starts[same], text[same], at[same]
            for i in range(size):
                hit[starts + i] = True
            for t, a in set(zip(text.tolist(), at.tolist(), strict=True)):
                found.setdefault(t, set()).update(item_ids[first[a] : first[a + 1]].tolist())
        return hit, found


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table; most are ruled out by one bit each."""
    bits = np.zeros(1 << 22, dtype=bool)
    low = np.uint64((1 << 22) - 1)
    bits[table & low] = True
    out = bits[values & low]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    out[maybe] = table[at] == values[maybe]
    return out


def segments(benchmark: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(item_id, text, n): items as words with single blanks, each in parts of at most ``most`` windows, all windows of an item in one of them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_remove(F.split(F.translate("text", upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    worded = benchmark.select("item_id", words.alias("words")).where(F.size("words") > 0)
    n = F.greatest(F.size("words") - WINDOW + 1, F.lit(1))
    part = F.slice("words", F.col("at") * most + 1, F.lit(most + WINDOW - 1))
    cut = worded.withColumn("at", F.explode(F.sequence(F.lit(0), F.ceil(n / most).cast("int") - 1)))
    return cut.select("item_id", F.array_join(part, " ").alias("text"), F.least(n - F.col("at") * most, F.lit(most)).cast("long").alias("n"))


def _blocks(benchmark: DataFrame, block_windows: int) -> list[DataFrame]:
    """The benchmark's segments in parts of about ``block_windows`` windows."""
    cut = segments(benchmark, min(SEGMENT, block_windows))
    windows = cut.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(1, -(-windows // block_windows))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [cut.where(part == i) if parts > 1 else cut for i in range(parts)]


RUNS = "array<struct<a:bigint,b:bigint>>"


def _spans(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(doc_id, text_hash, n_words, runs, items) for one block; a run has the first word that is hit and the one after the last."""
    run = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in (part for whole in batches for part in slices(whole)):
            words = alphanumeric(batch.column("text"))
            hit, found = matcher.hits(words)
            runs = [[] for _ in range(batch.num_rows)]
            named = [[] for _ in range(batch.num_rows)]
            for t, ids in found.items():
                a, b = int(words.offsets[t]), int(words.offsets[t + 1])
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
                runs[t], named[t] = [{"a": x, "b": y} for x, y in edges.tolist()], sorted(map(str, ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(words.counts.astype(np.int64)), pa.array(runs, pa.list_(run)), pa.array(named, pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "runs", "items"],
            )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return keyed.mapInArrow(search, f"doc_id long, text_hash long, n_words long, runs {RUNS}, items array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document: ``n_words``, ``runs`` of hit words and ``items``."""
    return _hits(docs, benchmark, block_windows).drop("text_hash")


def _hits(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """:func:`hits` with ``text_hash``."""
    blocks, context = _blocks(benchmark, block_windows), docs.sparkSession.sparkContext
    if len(blocks) == 1:
        return _spans(docs, context.broadcast(blocks[0].select("item_id", "text").toPandas()))
    every, found = None, None
    for block in blocks:
        sent = context.broadcast(block.select("item_id", "text").toPandas())  # about block_windows windows
        part = _spans(docs, sent)
        part = written(part if every is None else part.where(F.size("runs") > 0), "benchmark-hits")
        sent.destroy()
        every = part.select("doc_id", "text_hash", "n_words") if every is None else every
        found = part.where(F.size("runs") > 0) if found is None else found.unionByName(part)
    # Equal rows have equal hits, so they may meet in one group.
    merged = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.flatten(F.collect_set("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )

    def joined(out, x):
        """Runs so far with one more, which may overlap the last."""
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when(F.size(out) == 0, F.array(x)).when(last["b"] >= x["a"], longer).otherwise(F.concat(out, F.array(x)))

    union = merged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.aggregate("runs", F.array().cast(RUNS), joined).alias("runs"), "items")
    both = every.join(union, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return both.select("doc_id", "text_hash", "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words, items and verdict of every document."""
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda total, run: total + run["b"] - run["a"])
    return hits(docs, benchmark).select(
        "doc_id", "n_words", length.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Whole rows of the documents without a hit word."""
    dirty = _hits(docs, benchmark).where(F.size("runs") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    whole = docs.select(F.struct("*").alias("_doc"), "doc_id", F.xxhash64("text").alias("_own"))  # so that no name can clash
    return whole.join(dirty, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_anti").select("_doc.*")
