"""Language identification by Bayesian evidence fusion.

Evidence of a row: the likelihood of its text under each language's byte trigrams,
the language declared in the markup or metadata, the suffix of its address, and a
prior of its host. Trigram counts are added up over all rows with a declared
language; every declared primary subtag has a model, and the languages are scored in
broadcast blocks, one pass over the texts each, that meet again by row. How often a declared language or a suffix goes
with a language, and the priors of hosts, are grouped sums of text posteriors;
a host is smoothed towards its domain and that towards all rows, so that small
hosts follow the larger group.

Declarations are reduced to primary subtags. One that names no language has no model
and no posterior of its own; how often it goes with each language is evidence all the same.

Nulls: a null text has no likelihood evidence and a null declaration, address or
host none of its kind; with no evidence at all the global prior decides. Repeated
rows are counted and returned one by one; of equally probable languages the first
by name is the answer. A host that is met under two domains is two hosts. A table
without any declared language gives a null language, an empty one no rows. Extra
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_extraction import host
from .scratch import written
from .words import raw_texts, slices

GRAMS = 1 << 16
#: Languages whose models one broadcast holds (GRAMS numbers each); all declared ones are told apart.
BLOCK = 64
#: What a declaration looks like that names a language, after :func:`primary`; so there are fewer than 36**3 of them. Others are evidence alone.
LANGUAGE = r"^[a-z][a-z0-9]{1,2}$"
#: Weight of the text's log likelihood, as neighbouring trigrams repeat each other.
TEMPER = 0.25
#: Rows' worth of the wider group that a host's and a domain's prior hold.
STRENGTH = 20.0


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of a batch, and each text's bounds in them; trigrams across texts are left out."""
    raw, bounds = raw_texts(texts)
    raw = raw.astype(np.uint32)
    size = np.maximum(np.diff(bounds) - 2, 0)
    n = max(len(raw) - 2, 0)
    gram = ((raw[:n] * np.uint32(0x9E3779B1)) ^ (raw[1 : n + 1] * np.uint32(0x85EBCA77)) ^ (raw[2 : n + 2] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)
    inside = np.zeros(n + 1, np.int32)
    start = bounds[:-1]
    np.add.at(inside, start[size > 0], 1)
    np.add.at(inside, (start + size)[size > 0], -1)
    return gram[np.cumsum(inside[:-1]) > 0], np.append(0, np.cumsum(size))


def trigram_counts(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """All declared languages, and the counts (i, g, n) of gram bucket g in language i, from all rows (``text``, ``declared``)."""
    named = rows.where(F.col("declared").rlike(LANGUAGE))
    languages = sorted(r["declared"] for r in named.select("declared").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}

    def emitted(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, counts in total.items():
            g = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int64()), pa.array(g, pa.int64()), pa.array(counts[g])], names=["i", "g", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            gram, bounds = _grams(batch.column("text"))
            label = np.array([number[x] for x in batch.column("declared").to_pylist()])
            of = np.repeat(label, np.diff(bounds))
            for i in np.unique(label).tolist():
                if i not in total and len(total) == BLOCK:  # sums so far go on to the shuffle
                    yield from emitted(total)
                    total = {}
                total[i] = total.get(i, 0) + np.bincount(gram[of == i], minlength=GRAMS)
        yield from emitted(total)

    counted = named.select("text", "declared").mapInArrow(count, "i long, g long, n long").groupBy("i", "g").agg(F.sum("n").alias("n"))
    return languages, written(counted, "language-grams")


def trigram_model(counted: DataFrame, first: int, size: int) -> np.ndarray:
    """Log probabilities (gram bucket, language) of ``size`` languages from number ``first`` on."""
    table = np.full((GRAMS, size), 0.5)
    held = counted.where((F.col("i") >= first) & (F.col("i") < first + size)).toPandas()  # at most BLOCK * GRAMS numbers
    table[held["g"].to_numpy(np.int64), held["i"].to_numpy(np.int64) - first] += held["n"].to_numpy(np.float64)
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def _scored(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Each row with ``ll``: the log likelihood of its text by language of one block."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # at most GRAMS * BLOCK numbers
    size = model.shape[1]
    names = [c for c in rows.columns if c != "text"]
    kind = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", ll array<double>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            gram, bounds = _grams(batch.column("text"))
            out = np.zeros((batch.num_rows, size))
            for i in range(size):
                total = np.append(0.0, np.cumsum(sent.value[gram, i], dtype=np.float64))
                out[:, i] = total[bounds[1:]] - total[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out.tolist(), pa.list_(pa.float64()))], names=[*names, "ll"])

    return rows.select(*names, "text").mapInArrow(score, kind)


def _evidence(rows: DataFrame, counted: DataFrame, languages: int) -> DataFrame:
    """Each row with ``ll``: the tempered log likelihood of its text by every language, the greatest being 0."""
    starts = range(0, languages, BLOCK)
    if len(starts) == 1:
        scored = _scored(rows, trigram_model(counted, 0, languages))
    else:
        keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "language-rows")
        names = [c for c in rows.columns if c != "text"]
        parts = None
        for a in starts:
            block = _scored(keyed.select("_row", "text"), trigram_model(counted, a, min(BLOCK, languages - a)))
            part = written(block.select("_row", F.struct(F.lit(a).alias("a"), "ll").alias("part")), "language-block")
            parts = part if parts is None else parts.unionByName(part)
        whole = parts.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ll"])).alias("ll"))
        scored = keyed.select("_row", *names).join(whole, "_row").drop("_row")
    top = scored.withColumn("_top", F.array_max("ll"))
    return top.withColumn("ll", F.transform("ll", lambda x: (x - F.col("_top")) * TEMPER)).drop("_top")


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the text posteriors by ``keys``, as ``s``."""
    names = F.posexplode("post").alias("_i", "_x")
    summed = rows.select(*keys, names).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    lists = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("s"))
    return lists.select(*keys, F.transform("s", lambda e: e["_x"]).alias("s"))


def _normal(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` (ids, text, declared, suffix, host, domain) without text, with ``language``, ``probability`` and ``kept``."""
    languages, counted = trigram_counts(rows)
    ids = [c for c in rows.columns if c not in ("text", "suffix", "host", "domain")]
    if not languages:
        return rows.select(*ids, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("kept"))
    size = len(languages)
    scored = _evidence(rows, counted, size)
    seen = written(scored.withColumn("post", _normal(F.col("ll"))), "language-evidence")
    total = _sums(seen, []).first()
    mass = np.array(total["s"]) + 1
    prior = F.array(*[F.lit(float(x)) for x in mass / mass.sum()])
    smooth = lambda s, towards: F.zip_with(s, towards, lambda a, b: (a + b * STRENGTH) / (F.aggregate(s, F.lit(0.0), lambda t, x: t + x) + STRENGTH))
    domains = _sums(seen, ["domain"]).select(F.col("domain").alias("_domain"), smooth(F.col("s"), prior).alias("p_domain"))
    hosts = _sums(seen.where("host IS NOT NULL"), ["host", "domain"]).join(domains, F.col("domain").eqNullSafe(F.col("_domain")), "left").select(
        F.col("host").alias("_host"), F.col("domain").alias("_host_domain"), smooth(F.col("s"), F.coalesce("p_domain", prior)).alias("p_host")
    )

    def likelihood(column: str) -> DataFrame:
        """log P(value | language): the value's share of each language's mass, smoothed by one row."""
        values = _sums(seen, [column])
        whole = F.array(*[F.lit(float(x)) for x in mass])
        return values.select(column, F.zip_with("s", whole, lambda a, b: F.log((a + 1.0) / (b + 2.0))).alias(f"l_{column}"))

    both = seen
    for column in ("declared", "suffix"):
        table = likelihood(column).withColumnRenamed(column, f"_{column}")
        both = both.join(table, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
    both = both.join(hosts, (F.col("host") == F.col("_host")) & F.col("domain").eqNullSafe(F.col("_host_domain")), "left").drop("_host", "_host_domain")
    zero = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("ll"), F.coalesce("l_declared", zero)), add(F.coalesce("l_suffix", zero), F.transform(F.coalesce("p_host", prior), lambda x: F.log(x))))
    fused = both.withColumn("_p", _normal(logs))
    named = F.array(*[F.lit(x) for x in languages])
    best = F.array_max("_p")
    return fused.select(*ids, F.get(named, F.array_position("_p", best).cast("int") - 1).alias("language"), best.alias("probability")).withColumn("kept", F.col("probability") >= 0.5)


def primary(declared: Column) -> Column:
    """A declaration's primary subtag, in lower case (en of en-US and en_gb); what names no language stays as it is, and what is empty is null."""
    plain = F.lower(F.trim(declared))
    tag = F.regexp_extract(plain, r"^([a-z][a-z0-9]{1,2})(?:[-_].*)?$", 1)
    return F.nullif(F.when(tag != "", tag).otherwise(plain), F.lit(""))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows for :func:`identified`: the source is the host; there is no address."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", primary(F.col("lang")).alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows for :func:`identified`: markup is taken off the text, the declaration is the root's ``lang``."""
    name = host(F.col("url"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([^\s"'>]+)""", 1)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", text.alias("text"), primary(declared).alias("declared"),
        F.regexp_extract(name, r"([^.]+)$", 1).alias("suffix"), name.alias("host"), F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )
