"""Words of many texts at once, as Arrow and numpy arrays inside a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 8_000_000, most_rows: int = 4000):
    """The batch in parts of few rows and bytes each, so that arrays over a part's words stay small; no row is left out."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (total + size > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


class Words:
    """Words of a batch of texts: 64-bit hashes ``h`` in order, ``offsets`` by text, the distinct words and each word's index in them."""

    def __init__(self, words: pa.Array, offsets: np.ndarray):
        encoded = words.dictionary_encode()
        self.distinct = encoded.dictionary
        self.index = encoded.indices.to_numpy(zero_copy_only=False)
        self.distinct_h = hashed(self.distinct)
        self.h = self.distinct_h[self.index] if len(self.index) else np.zeros(0, np.uint64)
        self.offsets = offsets

    @property
    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.offsets)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on; the last k - 1 places of the batch have none."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = self.h[:n].copy()
            for i in range(1, k):
                out = mixed(out * _B + self.h[i : i + n])
        return out


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.cast(pa.string()).to_numpy(zero_copy_only=False), categorize=False)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def raw_texts(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, A to Z lower-cased if asked, and each text's bounds in them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return _LOWER[raw] if lower else raw, bounds - bounds[0]


def blank_separated(texts: pa.Array, lower: bool = True) -> Words:
    """Runs of anything but space and 0x09 to 0x0D; a null text has none."""
    return _by_class(texts, _BLANK, lower)


def alphanumeric(texts: pa.Array) -> Words:
    """Runs of digits, lower-cased ASCII letters and anything beyond ASCII; a null text has none."""
    return _by_class(texts, _ALNUM, True)


_BLANK = np.ones(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_ALNUM[0x41:0x5B] = True


def _by_class(texts: pa.Array, inside: np.ndarray, lower: bool) -> Words:
    raw, bounds = raw_texts(texts, lower)
    mask = inside[raw]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edge = bounds[(bounds > 0) & (bounds < len(raw))]
    first[edge] = mask[edge]  # a text's start begins a word even without a blank before it
    starts = np.flatnonzero(first)
    kept = raw[mask]
    # Offsets of the words in the bytes that are inside words.
    inner = np.cumsum(mask, dtype=np.int64)
    at = inner[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    offsets = np.append(at, len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return Words(words, np.searchsorted(starts, bounds))
