"""Fill-in-middle transformation of whole Arrow batches.

A text is a row of units, ``[A-Za-z]+|[^A-Za-z]`` over code points. Two hashes of
the id choose two cuts between units; the parts are prefix, middle and suffix.
The kernel works on the UTF-8 bytes of a batch at once: a lookup gives each byte
its class, a unit begins where a byte that is no continuation is no letter or
follows no letter of the same text, cumulative sums count units and code points,
and one ``searchsorted`` finds the cuts of all rows. The parts are neighbours in
the same buffer, so they are slices of it, and Arrow joins them with the marks.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle), each part behind its mark. A text with a mark in it
stays plain, so that marks in the output of the other forms are unambiguous and
:func:`restored` gives back the text exactly.

Nulls: a null text is empty and stays plain; a null id hashes as the empty
string. Repeated rows get equal results. Texts of any length are whole; a batch
is worked off in slices of a few MB (one text at least). Extra columns are kept
by :func:`transformed` (those with the names of its results are replaced) and
left out of :func:`digest`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .words import raw_texts, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of the texts that stay plain, and of the others that take the form spm.
PLAIN, SPM = 10, 20

_LETTER, _INNER = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:0xC0] = _INNER

#: Columns that the kernel makes.
RESULTS = (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType()))


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_counts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units and code points that begin before each byte of all texts (and at the end), counted from the first text on."""
    kind = _CLASS[raw]
    letter = kind == _LETTER
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edge = bounds[:-1][bounds[:-1] < len(raw)]
    begins[edge] = letter[edge]  # a text's first letter begins a unit, whatever ends the text before
    begins |= kind == 0
    width = np.int32 if len(raw) < 2**31 - 1 else np.int64
    units, chars = np.zeros(len(raw) + 1, width), np.zeros(len(raw) + 1, width)
    np.cumsum(begins, out=units[1:])
    np.cumsum(kind != _INNER, out=chars[1:])
    return units, chars


def kernel(texts: pa.Array, h: np.ndarray) -> list[pa.Array]:
    """The columns ``RESULTS`` for all texts; ``h`` has four columns of hashes."""
    raw, bounds = raw_texts(texts, lower=False)
    units, chars = unit_counts(raw, bounds)
    base = units[bounds].astype(np.int64)
    n = np.diff(base)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # A cut after k units is where the next one begins: the last byte place before which k units have begun.
    at = np.searchsorted(units, (base[:-1, None] + cuts).ravel().astype(units.dtype), side="right") - 1
    at = np.clip(at.reshape(-1, 2), bounds[:-1, None], bounds[1:, None])
    before = chars[np.column_stack([bounds[:-1], at])].astype(np.int64)
    prefix_chars, middle_chars = np.diff(before, axis=1).T
    edges = np.append(np.column_stack([bounds[:-1], at]).ravel(), bounds[-1])
    parts = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.match_substring_regex(whole, "|".join((PREFIX, SUFFIX, MIDDLE))).to_numpy(zero_copy_only=False)
    plain = marked | (n == 0) | (h[:, 2] % 100 >= 100 - PLAIN)
    spm = ~plain & (h[:, 3] % 100 < SPM)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    text = lambda x: pa.scalar(x, pa.large_string())
    none = text("")
    psm_out = pc.binary_join_element_wise(text(PREFIX), prefix, text(SUFFIX), suffix, text(MIDDLE), middle, none)
    spm_out = pc.binary_join_element_wise(text(SUFFIX), suffix, text(PREFIX), prefix, text(MIDDLE), middle, none)
    output = pc.if_else(pa.array(plain), whole, pc.if_else(pa.array(spm), spm_out, psm_out))
    return [pa.array(n), pa.array(form, pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), output]


def transformed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows with n, form, prefix_chars, middle_chars (null if plain) and output; the text stays as it is."""
    results = [name for name, _ in RESULTS]
    rows = docs.drop(*results, "_h").withColumn("_h", F.array(*hashes(F.col("doc_id"), seed)))
    kept = rows.drop("_h").schema
    schema = StructType([*kept.fields, *(StructField(k, t) for k, t in RESULTS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h = part.column("_h").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                made = kernel(part.column("text"), h)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept.names), *made[:-1], made[-1].cast(part.schema.field("text").type)], names=schema.names)

    return rows.mapInArrow(work, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a form was made of."""

    def between(start: str, end: str) -> Column:
        begin = F.locate(start, output) + len(start)
        return F.substr(output, begin, F.locate(end, output) - begin)

    middle = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Cuts and form of every document, with the digests of its output and of the text restored from it."""
    made = transformed(docs.select("doc_id", "text"), seed)
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
