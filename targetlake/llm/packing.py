"""Packing of documents into sequences: dominance reduction, then best fit.

Documents are tokenized, an end id is added and only documents beyond the
capacity are cut. What is packed are lengths, of which there are at most
``capacity`` kinds, so the instance is the histogram of lengths however many
documents there are. Martello and Toth's dominance reduction permanently fixes
small sets of pieces that provably dominate every other filling of a sequence;
best fit decreasing packs what is left. The driver sees the histogram alone; the
plan says which ranks of each length go to which sequences, and every piece
finds its place from its length and rank.

Tokens come from the public tokenizer file at ``tokenizer``. Its pre-tokenizer
never joins letters, digits and other signs, nor anything across blanks, so a
text is cut into such runs, each distinct run of a batch is tokenized once, and
the ids are put together again.

Nulls: a null text is empty and has the end id alone. Repeated rows are packed
one by one. Extra columns are passed by. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import partitions, written
from .words import blank_separated, slices

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces, at most on average, of a part of one length that is ranked in one task.
PART_PIECES = 500_000
#: Distinct runs whose ids a worker remembers at most; beyond that it starts anew.
REMEMBERED = 200_000


# ---------------------------------------------------------------- tokens


class RunTokenizer:
    """Ids of whole texts, by their distinct runs."""

    #: Letters (ASCII or of the Latin-1 block, which composition leaves alone), digits, other ASCII signs.
    _RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^\x00-\x200-9a-z\x7f-\U0010ffff]+")
    #: A blank-separated word that may be cut into runs; apostrophes and bars start contractions and special tokens.
    _PLAIN = re.compile("[!-&(-{}~ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(path)
        self._model = self._all.model
        self._ids: dict[str, bytes] = {}
        self._bytes = _byte_signs()

    def _run(self, run: str) -> bytes:
        return np.array([t.id for t in self._model.tokenize(run.encode().decode("latin-1").translate(self._bytes))], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one lower-cased word, 4 bytes each."""
        ids = self._ids.get(word)
        if ids is None:
            if self._PLAIN.fullmatch(word):
                ids = b""
                for run in self._RUNS.findall(word):
                    part = self._ids.get(run)
                    if part is None:
                        part = self._ids[run] = self._run(run)
                    ids += part
            else:
                ids = np.array(self._all.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self._ids) >= REMEMBERED:
                self._ids.clear()
            self._ids[word] = ids
        return ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and each text's start and the end of the last."""
        words = blank_separated(texts)
        each = [self.word(w) for w in words.distinct.to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        begins = np.append(0, np.cumsum(sizes))
        per_word = sizes[words.index] if len(words.index) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(per_word))
        shift = np.repeat(begins[words.index] - ends[:-1], per_word) if len(words.index) else np.zeros(0, np.int64)
        return flat[shift + np.arange(ends[-1])], ends[words.offsets]


def _byte_signs() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _tokenizer(path: str) -> RunTokenizer:
    """The worker process's tokenizer, loaded once and kept between tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_by_path", {})
    if path not in kept:
        kept[path] = RunTokenizer(path)
    return kept[path]


def default_tokenizer() -> str:
    """Path of the vocabulary file that the packing queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the checksum of their ids (little-endian, 32 bits each)."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path)
        for whole in batches:
            for batch in slices(whole):
                ids, offsets = tokens.texts(batch.column("text"))
                rows: list[list[int]] = [[], [], [], [], []]
                doc_ids = batch.column("doc_id").to_pylist()
                for doc, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- plan


@dataclass
class Run:
    """``count`` sequences, from number ``first`` on, each with ``each`` pieces of ``length`` from ``offset`` on; the pieces have the ranks from ``rank`` on."""

    length: int
    rank: int
    first: int
    count: int
    each: int
    offset: int


@dataclass
class _Group:
    """Open sequences with equal filling."""

    count: int
    room: int
    filling: tuple  # (length, rank, each) of what was put in, in order


def reduced(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets and take them out of ``counts``: (lengths of a set, how many sequences have it).

    For a piece j with room R beside it and k the largest other piece that fits,
    {j} is best if nothing fits, and {j, k} dominates every other filling if
    k = R, if no two other pieces fit together, or if no three do and no two
    that fit are larger than k together (k can take the place of both).

    Taking pieces away only takes fillings away, so a set that dominates goes on to do
    so until its j or k run out. Each step therefore fixes all of them at once: there
    are at most two steps a length, however many pieces there are.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(counts)

    def take(length: int, times: int) -> None:
        counts[length] -= times
        if not counts[length]:
            del counts[length]
            lengths.pop(bisect_left(lengths, length))

    def others(j: int, n: int) -> int:
        """Pieces of length n other than one j."""
        return counts[n] - (n == j)

    changed = True
    while changed:
        changed = False
        for j in reversed(lengths.copy()):
            while counts.get(j):
                room = capacity - j
                fit = bisect_right(lengths, room) - 1
                if fit >= 0 and not others(j, lengths[fit]):
                    fit -= 1
                if fit < 0:
                    found, times = (j,), counts[j]
                else:
                    k = lengths[fit]
                    small: list[int] = []
                    for n in lengths[: fit + 1]:
                        small += [n] * min(others(j, n), 3 - len(small))
                        if len(small) == 3:
                            break
                    pair_fits = len(small) > 1 and small[0] + small[1] <= room
                    triple_fits = len(small) > 2 and sum(small) <= room
                    if k != room and pair_fits and (triple_fits or _best_pair({n: others(j, n) for n in lengths[: fit + 1] if others(j, n)}, room) > k):
                        break
                    found, times = (j, k), counts[j] // 2 if k == j else min(counts[j], counts[k])
                fixed.append((found, times))
                for n in found:
                    take(n, times)
                changed = True
    return fixed


def _best_pair(others: dict[int, int], room: int) -> int:
    """Largest sum of two pieces that fit together."""
    lengths = sorted(others)
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total <= room and (low != high or others[lengths[low]] > 1):
            best = max(best, total)
        if total <= room:
            low += 1
        else:
            high -= 1
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go, by rank within the length."""
    counts = {n: c for n, c in histogram.items() if c}
    ranks = dict.fromkeys(counts, 0)
    done: list[_Group] = []

    def put(group: _Group, length: int, each: int) -> None:
        group.filling += ((length, ranks[length], each),)
        ranks[length] += each * group.count
        group.room -= each * length

    for lengths, times in reduced(counts, capacity):
        group = _Group(times, capacity, ())
        for n in lengths:
            put(group, n, 1)
        done.append(group)

    rooms: dict[int, list[_Group]] = {}  # open groups by what room they have
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = [r for r in rooms if r >= length]
            if fitting:
                room = min(fitting)
                group = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            else:
                room = capacity
                group = _Group(-(-left // (capacity // length)), capacity, ())
            each = min(room // length, left)
            whole = min(group.count, left // each)
            if whole < group.count:
                rest = _Group(group.count - whole, room, group.filling)
                rooms.setdefault(room, []).append(rest)
                group.count = whole
            # The ranks of a shared filling are dealt in order: the part that was split off has the later ones.
                group, rest.filling = group, _later(group.filling, whole)
            put(group, length, each)
            left -= each * whole
            rooms.setdefault(group.room, []).append(group)
    done += [g for groups in rooms.values() for g in groups]
    runs, first = [], 0
    for group in done:
        if not group.filling:
            continue
        offset = 0
        for length, rank, each in group.filling:
            runs.append(Run(length, rank, first, group.count, each, offset))
            offset += each * length
        first += group.count
    return runs


def _later(filling: tuple, sequences: int) -> tuple:
    return tuple((length, rank + each * sequences, each) for length, rank, each in filling)


# ---------------------------------------------------------------- placing


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(histogram, capacity)
    if not runs:
        return cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # Rank within a length: pieces of one length are dealt to parts, so that no length is sorted in one task.
    parts = max(8, 2 * partitions(spark), -(-sum(histogram.values()) // PART_PIECES))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("_part")
    dealt = cut.select("*", part)
    before = (
        dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    )
    inner = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("_place", F.row_number().over(inner) - 1)
        .join(before, ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_place"))
    )
    runs.sort(key=lambda r: (r.length, r.rank))
    # Each length has at most two steps of the reduction and two new groups of the best fit: some runs for each of at most `capacity` lengths.
    table = spark.sparkContext.broadcast(np.array([(r.length, r.rank, r.first, r.each, r.offset) for r in runs], dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, each, offset = table.value.T
        key = length << 48 | rank
        for batch in batches:
            own, own_rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(key, own << 48 | own_rank, side="right") - 1
            inside = own_rank - rank[at]
            found = pa.array(first[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * own)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
