"""Document quality by hierarchical empirical Bayes.

A document's own evidence is a logistic regression on surface measures and on what
its words and word pairs say. Hashed words and pairs are counted by label in how
many learned texts they occur; a bucket's weight is the log of the ratio of its
shares in good and bad texts, and a text has the mean of its buckets' weights and
their sum over the root of their number. Learned texts fall into ``FOLDS`` by their
id, and the weights for a text of one fold come from the others, so that the
regression is fitted on evidence that doesn't know the label. The regression's
Newton steps are sums over the learned rows in Spark. Texts are learned from if
their label is among the ``LABELS`` that have the least hashes of their ids.

Posteriors are summed by host (the source) and path (source and language). The
strength of the prior is estimated from how much hosts differ beyond what the spread
within them explains; hosts shrink towards the global rate and paths towards their
host, so that sparse sites follow the wider group. Posteriors under these rates give
new sums, for some rounds. A document's final log-odds are its own plus what its
path's rate adds to the global one.

Nulls: a null text has the measures of the empty text, and no words; null sources or
languages are groups of their own; a null id has no label. Repeated rows are scored
and, if labelled, learned from one by one; an id with several labels is good if one of
them says so. Without learned texts of both kinds the measures are not used and every
document has the log-odds 0. An empty table gives no rows. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import Words, blank_separated, raw_texts, slices

#: Labels that are learned from, at most: those with the least hash of their id. Their ids are broadcast.
LABELS = 100_000
#: Buckets of hashed words and word pairs, and folds of the learned texts.
BUCKETS = 1 << 17
FOLDS = 4
#: Width of the cells of log-odds that groups are counted by, and rounds of new rates.
CELL = 0.25
ROUNDS = 4
FEATURES = ("words", "length", "types", "types_by_words", "symbols", "digits", "capitals", "marks", "grams", "grams_by_root")


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, letters in (("symbols", b"#*$%&|<>"), ("digits", b"0123456789"), ("capitals", bytes(range(65, 91))), ("marks", b"!?")):
        out[name] = np.zeros(256, np.int32)
        out[name][list(letters)] = 1
    return out


def surface(texts: pa.Array, words: Words) -> np.ndarray:
    """A row of the surface measures among ``FEATURES`` for each text."""
    n = np.maximum(words.counts, 1)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    pairs = np.unique(owner << 32 | words.index.astype(np.int64)) if len(owner) else np.zeros(0, np.int64)
    types = np.bincount(pairs >> 32, minlength=len(n)) / n
    raw, bounds = raw_texts(texts, lower=False)
    size = np.maximum(np.diff(bounds), 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[raw], dtype=np.int64))
        return (total[bounds[1:]] - total[bounds[:-1]]) / size

    by = {k: share(v) for k, v in _classes().items()}
    logged = np.log1p(n)
    return np.column_stack([logged, np.log1p(size / n), types, types * logged, np.log1p(1000 * by["symbols"]), np.log1p(1000 * by["digits"]), by["capitals"], np.log1p(1000 * by["marks"])])


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct buckets of each text's words and word pairs, in order."""
    owner = np.repeat(np.arange(len(words.counts), dtype=np.int64), words.counts)
    pairs = words.grams(2)
    inside = owner[:-1] == owner[1:]  # no pair goes across texts
    texts, h = np.concatenate([owner, owner[:-1][inside]]), np.concatenate([words.h, pairs[inside]])
    held = np.unique(texts * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    return held // BUCKETS, held % BUCKETS


def learned_ids(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """At most ``most`` labels (doc_id, quality, fold): those with the least hash of their id.

    Which hashes are low enough follows from how many labels there are, so that no more
    than the labels wanted, and a few to be sure that they are enough, are sorted.
    """
    told = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    told = written(told.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)), "quality-labels")
    n = told.count()
    wanted = most + 6 * most**0.5 + 10
    low = told if n <= wanted else told.where(F.col("h") < F.lit(int(wanted / n * 2**63)))
    low = low if n <= most else low.orderBy("h", "doc_id").limit(most)
    return written(low.select("doc_id", F.col("quality").cast("int").alias("quality"), (F.col("h") % FOLDS).cast("int").alias("fold")), "quality-learned")


def _rows(docs: DataFrame, learned: DataFrame, how: str) -> DataFrame:
    """(doc_id, host, path, text, quality, fold) of the documents; ``learned`` has ``LABELS`` rows at most."""
    return docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text").join(F.broadcast(learned), "doc_id", how)


def gram_counts(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(bucket, n0, n1, ...): in how many learned texts of each fold and label (twice the fold, plus 1 if good) a bucket occurs; bucket -1 counts the texts."""
    cells = [f"n{i}" for i in range(2 * FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS + 1) * len(cells), np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            text, bucket = buckets(blank_separated(batch.column("text")))
            total += np.bincount((bucket + 1) * len(cells) + cell[text], minlength=len(total))
            total[: len(cells)] += np.bincount(cell, minlength=len(cells))
        table = total.reshape(-1, len(cells))
        at = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part - 1), *(pa.array(table[part, k]) for k in range(len(cells)))], names=["bucket", *cells])

    cell = F.col("fold").cast("long") * 2 + (F.col("quality") > 0).cast("long")
    counted = _rows(docs, learned, "inner").select("text", cell.alias("cell")).mapInArrow(count, ", ".join(f"{c} long" for c in ("bucket", *cells)))
    return written(counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cells]), "quality-grams")


def gram_weights(counted: DataFrame) -> np.ndarray:
    """The weight of each bucket, by column: as told by the texts outside a fold, and in the last column by all."""
    out = np.zeros((BUCKETS, FOLDS + 1), np.float32)
    texts = counted.where("bucket = -1").first()
    if texts is None:
        return out
    columns = []
    for fold in range(FOLDS + 1):
        share = []
        for good in (0, 1):
            cells = [f"n{2 * k + good}" for k in range(FOLDS) if k != fold]
            share.append(F.log((sum(map(F.col, cells), F.lit(0)) + 1) / (sum(texts[c] for c in cells) + 2)))
        columns.append((share[1] - share[0]).cast("float").alias(f"w{fold}"))
        none = [sum(texts[f"n{2 * k + good}"] for k in range(FOLDS) if k != fold) for good in (0, 1)]
        out[:, fold] = np.log((none[0] + 2) / (none[1] + 2))  # buckets that no learned text has
    held = counted.where("bucket >= 0").select(F.col("bucket").cast("int").alias("bucket"), *columns).toPandas()  # FOLDS + 1 numbers a bucket
    out[held["bucket"].to_numpy()] = held.drop(columns="bucket").to_numpy()
    return out


def featured(docs: DataFrame, learned: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, host, path, quality, x) of every document; x by ``FEATURES``, quality null where it is not learned from."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # FOLDS + 1 numbers a bucket

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = blank_separated(batch.column("text"))
            fold = batch.column("fold").fill_null(FOLDS).to_numpy(zero_copy_only=False)
            text, bucket = buckets(words)
            total = np.bincount(text, sent.value[bucket, fold[text]], len(fold))
            n = np.maximum(np.bincount(text, minlength=len(fold)), 1)
            x = np.column_stack([surface(batch.column("text"), words), total / n, total / np.sqrt(n)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path", "quality")), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "host", "path", "quality", "x"])

    return _rows(docs, learned, "left").mapInArrow(rows, "doc_id long, host string, path string, quality int, x array<double>")


def regression(rows: DataFrame, penalty: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, scale, weights with the constant first) of a ridge logistic regression of ``quality`` on ``x``; None without both kinds.

    A Newton step is one sum over the rows: of each partition, the loss, the gradient and the
    curvature's number for each pair of features. A step that makes the loss greater is halved until it does not.
    """
    n = len(FEATURES)
    x = [F.get("x", i) for i in range(n)]
    learned = rows.where("quality IS NOT NULL")
    first = learned.agg(F.count("*"), F.sum((F.col("quality") > 0).cast("int")), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    if not first[0] or first[1] in (0, first[0]):
        return None
    mean, scale = np.array(first[2 : 2 + n], float), np.array(first[2 + n :], float) + 1e-9
    held = learned.select((F.col("quality") > 0).cast("double").alias("y"), "x")
    ridge = np.diag([1e-6] + [penalty] * n)
    below = np.tril_indices(n + 1)
    names = [f"s{i}" for i in range(n + 2 + len(below[0]))]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names))
            for batch in batches:
                y = batch.column("y").to_numpy(zero_copy_only=False)
                z = np.column_stack([np.ones(len(y)), (batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), n) - mean) / scale])
                odds = z @ w
                p = 1 / (1 + np.exp(-odds))
                curve = (z * (p * (1 - p))[:, None]).T @ z
                total += np.concatenate([[np.sum(np.logaddexp(0, odds) - y * odds)], z.T @ (y - p), curve[below]])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

        got = held.mapInArrow(part, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
        curve = np.zeros((n + 1, n + 1))
        curve[below] = got[n + 2 :]
        curve = curve + np.tril(curve, -1).T
        return got[0] + w @ ridge @ w / 2, np.array(got[1 : n + 2]) - ridge @ w, curve + ridge

    w = np.zeros(n + 1)
    loss, gradient, curve = sums(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, gradient)
        if np.abs(step).max() < 1e-6:
            break
        new = sums(w + step)
        while new[0] > loss + 1e-9 and np.abs(step).max() > 1e-6:
            step = step / 2
            new = sums(w + step)
        w, (loss, gradient, curve) = w + step, new
    return mean, scale, w


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(inside / (1 - inside))


def _good(own: Column, rate: Column, m: float) -> Column:
    """Posterior of a document whose own log-odds hold for the global rate ``m``, under a group's rate."""
    return 1 / (1 + F.exp(-(own + _logit(rate) - F.lit(float(np.log(m / (1 - m)))))))


def rates(scored: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """(g_host, g_path, host_rate, path_rate) of every group, and the global rate, by grouped aggregation.

    A group is held as its counts by cells of its documents' log-odds, a bounded number
    each. A round takes the posteriors under the rates so far, adds them up by path and
    host, and shrinks: hosts to the global rate, paths to their host. How strongly is
    told by how much hosts differ beyond what the spread within them explains.
    """
    cell = F.round(F.col("own") / CELL).cast("int")
    groups = scored.groupBy("host", "path", cell.alias("cell")).agg(F.count("*").alias("n")).groupBy("host", "path").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    groups = written(groups, "quality-groups")
    add = lambda of: F.aggregate("cells", F.lit(0.0), lambda total, c: total + of(c))
    first = groups.agg(F.sum(add(lambda c: c["n"] / (1 + F.exp(-c["cell"] * CELL)))).alias("s"), F.sum(add(lambda c: c["n"].cast("double"))).alias("n")).first()
    m = min(max(first["s"] / first["n"], 1e-4), 1 - 1e-4) if first["n"] else 0.5
    rated = groups.withColumn("path_rate", F.lit(m))
    for _ in range(rounds):
        p = lambda c: _good(c["cell"] * CELL, F.col("path_rate"), m)  # noqa: E731, B023
        paths = rated.select(
            "host", "path", "cells", add(lambda c: c["n"].cast("double")).alias("n"), add(lambda c: c["n"] * p(c)).alias("s"), add(lambda c: c["n"] * p(c) * p(c)).alias("q")  # noqa: B023
        )
        hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
        rate = F.col("host_s") / F.col("host_n")
        t = hosts.agg(
            F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_n")).alias("inverse"), (F.sum(F.col("host_q") - F.col("host_s") * rate) / F.greatest(F.sum(F.col("host_n") - 1), F.lit(1.0))).alias("within")
        ).first()
        within = max(float(t["within"] or 0), 1e-9)
        between = max(float(t["v"] or 0) - within * float(t["inverse"] or 0), 1e-6)
        strength = min(max(within / between, 1.0), 1e6)
        shrunk = hosts.select(F.col("host").alias("_host"), ((F.col("host_s") + m * strength) / (F.col("host_n") + strength)).alias("host_rate"))
        both = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_host")))
        rated = written(both.select("host", "path", "cells", "host_rate", ((F.col("s") + F.col("host_rate") * strength) / (F.col("n") + strength)).alias("path_rate")), "quality-rates")
    return rated.select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), "host_rate", "path_rate"), m


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Posterior of good quality of every document, and what it was made of."""
    learned = learned_ids(labels)
    rows = written(featured(docs, learned, gram_weights(gram_counts(docs, learned))), "quality-features")
    own = F.lit(0.0)
    if model := regression(rows):
        mean, scale, w = model
        for i in range(len(FEATURES)):
            own = own + (F.get("x", i) - float(mean[i])) * float(w[i + 1] / scale[i])
        own = own + float(w[0])
    own = F.least(F.greatest(own, F.lit(-12.0)), F.lit(12.0))
    scored = rows.select("doc_id", "host", "path", own.alias("own"))
    rated, m = rates(scored)
    both = scored.join(rated, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")))
    return both.select(
        "doc_id", F.col("host").alias("source"), F.col("path").alias("lang"), F.col("own").alias("document_logit"), "host_rate", "path_rate",
        _good(F.col("own"), F.col("path_rate"), m).alias("posterior"),
    ).withColumn("kept", F.col("posterior") >= 0.5)
