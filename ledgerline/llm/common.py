"""What the operators of this subpackage share: reading tables, staging, hashing, word scanning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.staging import shared_folder, staged, stages  # noqa: F401  (for the operators)

# Whole texts reach Python in Arrow batches, which Spark bounds by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by
# default) as well as by rows; so no operator has to change a setting of the session.

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc32(column) -> F.Column:
    """CRC-32 of an id written as text, the number that folds are made from; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# --- words and shingles of bytes ------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of x over the result."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS = np.cumprod(np.full(size, _ODD, np.uint64))
    return _POWERS[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text after lower-casing A-Z, in order.

    A word's hash is a polynomial over its bytes, made for all words at once from prefix sums, and then mixed.
    """
    if not text:
        return np.empty(0, np.uint64)
    b = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    inside = np.flatnonzero(~space)
    place = inside - np.repeat(start, length)
    value = mix64(b[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; with fewer words, of the whole sequence as one; else empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        h = mix64(h * _ODD + w[j : len(w) - k + 1 + j])
    return np.unique(h)
