"""Incremental secret scans over a content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger
names the (blob, rule version) pairs that were scanned, with what they hold.
A run scans only pairs that the ledger lacks, one copy of each blob, appends
them, and joins the findings back to every path that has the blob.

Spans are kind:start:end in code points, end exclusive. Matches are leftmost and
do not overlap within a kind. Places come from the text between matches: the
pieces that the pattern splits the text into and the matches themselves
alternate, so their running lengths give every start and end.

Two runs that share a ledger may both append a blob that neither had seen; readers
take one of such equal rows.

Nulls: a null text is the empty text. Repeated rows and equal texts are scanned
once and reported for each row. Extra columns are passed by. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_dir, written

#: Unseen blobs that are broadcast at most, 64 characters each.
SENT = 1_000_000
# Kinds in the order in which equal starts are listed.
#: kind: (pattern, capture group that is measured, its least length)
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
}
BASE = ("assign", "access", "hex")
#: Changes with the rules, so that no finding of other rules is taken for theirs.
RULE_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def _spans(text: Column, order: int, kind: str) -> Column:
    """The kind's spans in a text: array<struct<start, kind order, text of the span>>."""
    pattern, group, least = RULES[kind]
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    measured = F.regexp_extract_all(text, regex, F.lit(group)) if group else matches
    between = F.split(text, pattern, -1)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,n:int>>").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("s"), end.alias("e"), F.length(piece["part"]).alias("n"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    # The pieces are computed once: lambdas would split the text anew for each match.
    found = F.element_at(
        F.transform(
            F.array(F.struct(matches.alias("m"), measured.alias("p"), between.alias("b"))),
            lambda x: F.aggregate(
                F.arrays_zip(x["m"].alias("match"), x["p"].alias("part"), F.transform(F.slice(x["b"], 1, F.size(x["m"])), lambda b: F.length(b)).alias("gap")),
                step, add, lambda state: state["out"],
            ),
        ),
        1,
    )
    kept = F.filter(found, lambda x: x["n"] >= least)
    labelled = F.transform(
        kept,
        lambda x: F.struct(
            x["s"].alias("start"), F.lit(order).alias("kind"),
            F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")).alias("span"),
        ),
    )
    nothing = F.array().cast("array<struct<start:int,kind:int,span:string>>")
    return F.when(text.rlike(pattern), labelled).otherwise(nothing)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: x["span"]), ",")


def scanned(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of blobs (``blob``, ``text``)."""
    kinds = {k: _spans(F.col("text"), i, k) for i, k in enumerate(RULES)}
    found = blobs.select("blob", *[v.alias(f"_{k}") for k, v in kinds.items()])
    return found.select(
        "blob", F.lit(rule_version).alias("rule_version"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        _joined(F.concat(*[F.col(f"_{k}") for k in BASE])).alias("base_spans"),
        _joined(F.concat(*[F.col(f"_{k}") for k in RULES])).alias("spans"),
    )


def unseen(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """One copy of each blob of ``versions`` (``blob``, ``text``) that the ledger lacks under this rule version.

    Hashes meet the ledger first, and texts are fetched by what is left of them. Up to ``SENT`` unseen blobs are
    broadcast, so that no text that was seen before is moved; beyond, copies meet task by task and one of each is moved.
    """
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
    if seen.isEmpty():
        return versions.groupBy("blob").agg(F.first("text").alias("text"))
    new = written(versions.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen-blobs")
    if new.count() <= SENT:
        return versions.join(F.broadcast(new), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    return versions.groupBy("blob").agg(F.first("text").alias("text")).join(new, "blob", "left_semi")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one if nothing was written there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row of ``docs`` (``doc_id``, ``text``), scanning only what the ledger at ``ledger_path`` lacks.

    Without a path the ledger is a new one in the shared scratch folder.
    """
    return by_blob(docs, ledger_path, rule_version).drop("blob")


def scan_in_parts(docs: DataFrame, parts: int = 2) -> DataFrame:
    """Findings of every row, scanned as so many increments that share one new ledger: each scans what those before it didn't hold."""
    path = f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))  # a null id has one too
    for k in range(parts):
        update(docs.where(part == k), path)
    # Read once when all is written: Spark takes two reads of a folder for one, whatever it held at each time.
    return findings(docs, path).drop("blob")


def _versions(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))


def update(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> None:
    """Append to the ledger what it lacks of the rows' texts."""
    ledger = _read(docs.sparkSession, path)
    scanned(unseen(_versions(docs).select("blob", "text"), ledger, rule_version), rule_version).write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """What the ledger holds of each row's text."""
    ledger = docs.sparkSession.read.schema(LEDGER).parquet(path).where(F.col("rule_version") == rule_version)
    held = ledger.where(F.length("spans") > 0).drop("rule_version").dropDuplicates(["blob"])  # runs at the same time may both have scanned a blob
    none = F.sha2(F.lit("").cast("binary"), 256)
    return _versions(docs).select("doc_id", "blob").join(held, "blob", "left").select(
        "doc_id", "blob",
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.coalesce(F.sha2(F.encode("base_spans", "UTF-8"), 256), none).alias("base_sha256"),
        F.coalesce(F.col("spans"), F.lit("")).alias("spans"),
    )


def by_blob(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """:func:`scan` with the ``blob`` of each row's text."""
    path = ledger_path or f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
    update(docs, path, rule_version)
    return findings(docs, path, rule_version)


def redacted(docs: DataFrame, findings: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets that the rules find replaced in their texts, whole rows kept.

    Only documents with findings are rewritten; ``findings`` has a row for each of them.
    They are known by their texts if ``findings`` names blobs, else by their ids, null being one.
    """
    name = "blob" if "blob" in findings.columns else "doc_id"
    key = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256) if name == "blob" else F.col("doc_id")
    hit = findings.where(F.length("spans") > 0).select(F.col(name).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    clean = F.col("text")
    for pattern, group, least in RULES.values():
        if group:
            pattern = pattern.replace("[A-Za-z0-9+/_.=-]+", f"[A-Za-z0-9+/_.=-]{{{least},}}+")
        clean = F.regexp_replace(clean, pattern, mask)
    # Whole rows travel as one column, so that none of their names can clash.
    whole = docs.select(F.struct("*").alias("_doc"), "text", key.alias("_own"))
    both = whole.join(hit, F.col("_own").eqNullSafe(F.col("_key")), "left")
    masked = F.when(F.col("_hit"), clean).otherwise(F.col("text"))
    return both.select(*[masked.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
