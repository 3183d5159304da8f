"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform law.

P(w | h) = l2(b) c(h,w)/c(h) + l1(b) c(w)/N + l0(b) / (V + 1), where b is the
bucket of the context's frequency c(h) by powers of two. The weights of each
bucket are learned by expectation-maximisation on counts that were held out:
training documents of one fold are scored by the counts of the others. The
scores then use the counts of all training documents.

Texts become chunks: one row for some megabytes of documents of one role, with
local word numbers. A chunk sends its distinct words and distinct pairs to
buckets by hash. A bucket adds up what all chunks sent and answers each with the
corpus counts in the order asked, so a frequent word is one number from each
chunk, and no vocabulary is broadcast or collected. Counts have 64 bits, and the
number of buckets follows the number of tokens. EM sees a histogram of
log-scaled probabilities, whose size is fixed by its grid.

Tokens: ASCII-lower-cased words and one end for each text; a null text is empty.
A null id counts as the empty string when folds are dealt. Repeated rows count
as often as they occur. Extra columns are passed by. With no training documents
N and V are 0 and every weight falls on the uniform law.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import _packed48, _unpacked48
from .scratch import partitions, written
from .words import blank_separated, mixed, slices

FOLDS = 7
#: Fold that is never learned from, and fold on which the weights are learned.
TEST_FOLD, DEV_FOLD = 2, 6
START = np.uint64(0x5354415254000001)
END = np.uint64(0x454E440000000002)
TRAIN, DEV, TEST = 0, 1, 2
#: Tokens (of one side of the exchange) that a part of it holds on average, at most.
PART_TOKENS = 4_000_000
_CHUNK = "chunk long, role int, ids array<long>, lengths binary, tokens binary, vocab binary, size long"
_ASK = "part int, chunk long, role int, keys binary, counts binary"
_ANSWER = "chunk long, kind int, part int, first binary, whole binary, n long, v long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
GRID = 4.0  # steps of the histogram for each factor of two
BUCKETS = 40


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(schema))


def chunked(docs: DataFrame) -> DataFrame:
    """Texts as rows of ``_CHUNK``: word numbers by falling frequency, and the words' hashes."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most_rows=20_000)):
            words = blank_separated(batch.column("text"))
            folds = batch.column("fold").to_numpy()
            roles = np.where(folds == TEST_FOLD, TEST, np.where(folds == DEV_FOLD, DEV, TRAIN))
            counts = words.counts
            role_of = np.repeat(roles, counts)
            ids = batch.column("doc_id").to_pylist()
            for role in np.unique(roles).tolist():
                index = words.index[role_of == role]
                used, local, number = np.unique(index, return_inverse=True, return_counts=True)
                order = np.argsort(-number, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                tokens = rank[local]
                tokens = tokens.astype("<u2") if len(used) < 65536 else tokens.astype("<u4")
                mine = np.flatnonzero(roles == role)
                vocab = words.distinct_h[used[order]] if len(used) else np.zeros(0, np.uint64)
                row = (uuid.uuid4().int >> 65, role, [ids[i] for i in mine], counts[mine].astype("<u4").tobytes(), tokens.tobytes(), vocab.tobytes(), len(tokens) + len(mine))
                yield _batch([row], _CHUNK)

    return docs.select("doc_id", "text", fold.cast("int").alias("fold")).mapInArrow(chunk, _CHUNK)


class _Chunk:
    """Tokens of a chunk as numbers into ``words``: its vocabulary, then the end, then the start."""

    def __init__(self, row: dict):
        vocab = np.frombuffer(row["vocab"], np.uint64)
        raw = np.frombuffer(row["tokens"], "<u2" if len(vocab) < 65536 else "<u4").astype(np.int64)
        self.words = np.concatenate([vocab, [END, START]])
        self.ids, self.lengths = row["ids"], np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        end, start = len(vocab), len(vocab) + 1
        size = self.lengths + 1
        last = np.cumsum(size) - 1
        self.token = np.full(int(size.sum()), end, np.int64)
        inside = np.ones(len(self.token), dtype=bool)
        inside[last] = False
        self.token[inside] = raw
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[last + 1 - size] = start
        self.text = np.repeat(np.arange(len(size)), size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs' 48-bit keys, each token's index in them, and how often they occur."""
        both = self.context * len(self.words) + self.token
        distinct, index, number = np.unique(both, return_inverse=True, return_counts=True)
        h, w = self.words[distinct // len(self.words)], self.words[distinct % len(self.words)]
        with np.errstate(over="ignore"):
            return mixed(h * np.uint64(0x9E3779B97F4A7C15) + w) >> np.uint64(16), index, number

    def unigrams(self) -> np.ndarray:
        """How often each word occurs; the start counts texts."""
        number = np.bincount(self.token, minlength=len(self.words))
        number[-1] = len(self.ids)
        return number


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by part, and where each part begins."""
    part = (mixed(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _counts_out(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them all, up to 64 bits."""
    most = int(counts.max()) if len(counts) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return counts.astype(f"<u{width}").tobytes()


def _counts_in(data: bytes, n: int) -> np.ndarray:
    """``n`` counts; their width follows from the length."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def added(index: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by index, in 64 bits (``np.bincount`` would go through doubles)."""
    out = np.zeros(size, np.int64)
    np.add.at(out, index, counts)
    return out


def _corpus_counts(chunks: DataFrame, parts: int, pairs: bool) -> DataFrame:
    """Answers (``_ANSWER``) to each chunk for its words or pairs, in the order of ``_dealt``."""
    kind = int(pairs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row)
                keys, number = c.pairs()[::2] if pairs else (c.words, c.unigrams())
                order, edges = _dealt(keys, parts)
                rows = []
                for p in range(parts):
                    own = order[edges[p] : edges[p + 1]]
                    if len(own):
                        counts = _counts_out(number[own]) if row["role"] != TEST else None
                        rows.append((p, row["chunk"], row["role"], _packed48(keys[own]) if pairs else keys[own].tobytes(), counts))
                yield _batch(rows, _ASK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(row["chunk"], row["role"], row["part"], row["keys"], row["counts"]) for batch in batches for row in batch.to_pylist()]
        if not asked:
            return
        keys = [_unpacked48(x[3]) if pairs else np.frombuffer(x[3], np.uint64) for x in asked]
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_counts_in(x[4], len(k)) if x[4] else np.zeros(len(k), np.int64) for x, k in zip(asked, keys, strict=True)])
        role = np.repeat([x[1] for x in asked], [len(k) for k in keys])
        first = added(index[role == TRAIN], counts[role == TRAIN], len(distinct))
        whole = first + added(index[role == DEV], counts[role == DEV], len(distinct))
        real = np.ones(len(distinct), dtype=bool) if pairs else distinct != START
        at = 0
        rows = [(-1, kind, asked[0][2], None, None, int(whole[real].sum()), int((whole[real] > 0).sum())), (-2, kind, asked[0][2], None, None, int(first[real].sum()), int((first[real] > 0).sum()))]
        for (chunk, own_role, part, _, _), k in zip(asked, keys, strict=True):
            own = index[at : at + len(k)]
            at += len(k)
            rows.append((chunk, kind, part, _counts_out(first[own]) if own_role == DEV else None, _counts_out(whole[own]), None, None))
            if len(rows) >= 64:
                yield _batch(rows, _ANSWER)
                rows = []
        yield _batch(rows, _ANSWER)

    return chunks.mapInArrow(ask, _ASK).repartitionById(parts, F.col("part")).mapInArrow(answer, _ANSWER)


def _restored(c: _Chunk, answers: list[dict], kind: int, field: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """Counts in the order of ``keys``."""
    order, edges = _dealt(keys, parts)
    out = np.empty(len(keys), np.float64)
    for a in answers:
        if a["kind"] == kind:
            own = order[edges[a["part"]] : edges[a["part"] + 1]]
            out[own] = _counts_in(a[field], len(own))
    return out


def _probabilities(row: dict, field: str, parts: int, n: int) -> tuple[_Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: c(h), c(w), p2 and p1."""
    c = _Chunk(row)
    words = _restored(c, row["answers"], 0, field, c.words, parts)
    keys, index, _ = c.pairs()
    pair = _restored(c, row["answers"], 1, field, keys, parts)[index]
    ch, cw = words[c.context], words[c.token]
    return c, ch, cw, pair / np.maximum(ch, 1), cw / max(n, 1)


def _bucket(ch: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(ch + 1)), BUCKETS - 1).astype(np.int64)


def learned(cells: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, [l2, l1, l0]) by EM; ``cells`` rows are bucket, p2, p1, count."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    if not len(cells):
        weights[:] = [0, 0, 1]
        return weights
    bucket = cells[:, 0].astype(int)
    p = np.column_stack([cells[:, 1], cells[:, 2], np.full(len(cells), 1.0 / (v + 1))])
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (cells[:, 3] / part.sum(axis=1))[:, None]
        # One event for each component keeps the weights of rare buckets from zero.
        new = np.column_stack([np.bincount(bucket, part[:, k], minlength=BUCKETS) for k in range(3)]) + np.where(weights > 0, 1.0, 0.0)
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """Base and model scores (log10) of every document, in the columns of ``RESULT``."""
    chunks = written(chunked(docs), "lm-chunks")
    size = chunks.agg(F.sum("size").alias("n")).first()["n"] or 0
    parts = max(partitions(docs.sparkSession), -(-size // PART_TOKENS))  # so that a part stays small however large the table is
    words = written(_corpus_counts(chunks, parts, pairs=False), "lm-words")
    pairs = written(_corpus_counts(chunks, parts, pairs=True), "lm-pairs")
    totals = {r["chunk"]: (r["n"] or 0, r["v"] or 0) for r in words.where("chunk < 0").groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    (n, v), (n_in, v_in) = totals.get(-1, (0, 0)), totals.get(-2, (0, 0))
    every = words.unionByName(pairs).where("chunk >= 0")

    def answers(field: str) -> DataFrame:
        """Each chunk's answers with one of the counts; only development chunks have both."""
        return every.where(F.col(field).isNotNull()).groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", field)).alias("answers"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, ch, _, p2, p1 = _probabilities(row, "first", parts, n_in)
                grid = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * GRID), 1).astype(np.int64)
                key, number = np.unique(np.column_stack([_bucket(ch), grid(p2), grid(p1)]), axis=0, return_counts=True)
                yield _batch([(int(b), int(x), int(y), int(k)) for (b, x, y), k in zip(key, number, strict=True)], "b long, x long, y long, k long")

    dev = chunks.where(F.col("role") == DEV).join(answers("first"), "chunk").mapInArrow(cells, "b long, x long, y long, k long")
    found = dev.groupBy("b", "x", "y").agg(F.sum("k").alias("k")).collect()  # at most the histogram's grid
    real = lambda x: 0.0 if x > 0 else 2.0 ** (x / GRID)
    weights = learned(np.array([(r["b"], real(r["x"]), real(r["y"]), r["k"]) for r in found], float).reshape(-1, 4), v_in)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, ch, cw, p2, p1 = _probabilities(row, "whole", parts, n)
                l2, l1, l0 = weights[_bucket(ch)].T
                rest = np.where(ch > 0, 0.0, l2)  # a context never seen leaves its share to the lower orders
                model = np.log10(l2 * p2 + (l1 + rest) * p1 + l0 / (v + 1)) if n else np.full(len(p1), 0.0)
                base = np.log10((cw + 1) / (n + v + 1))
                add = lambda x: np.bincount(c.text, x, minlength=len(c.ids))
                known = add((cw > 0).astype(float)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.ids, pa.int64()), pa.array(np.full(len(c.ids), row["role"] == TEST)), pa.array(c.lengths + 1), pa.array(known),
                        pa.array(np.full(len(c.ids), n, np.int64)), pa.array(add(base)), pa.array(add(model)),
                    ],
                    names=_names(RESULT),
                )

    return chunks.join(answers("whole"), "chunk").mapInArrow(score, RESULT)
