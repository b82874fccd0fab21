"""Words, shingles and windows of whole texts as arrays of hashes, for Python tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93  # odd
CACHED_WORDS = 200_000
BROADCAST_IDS = 1_000_000  # a broadcast table of ids may have so many rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """The hash of each word, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(BASE)
        total += hashes[k : k + n]
    return mix(total)


def shingle_set(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text, A-Z in lower case; a shorter text is one shingle."""
    found = hashes.of(text.lower().split())
    if 0 < len(found) < width:
        return windows(found, len(found)) ^ np.uint64(len(found))
    return np.unique(windows(found, width))


def texts(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[list[tuple]]:
    """The rows of the batches as tuples, the text last, in lists of bounded size."""
    rows, size = [], 0
    for batch in batches:
        # One at a time, so that a batch of long texts is not held twice.
        for row in (tuple(value.as_py() for value in values) for values in zip(*batch.columns)):
            rows.append(row)
            size += len(row[-1])
            if size >= most_bytes:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def packed(values: np.ndarray) -> bytes:
    """Integers as deflated byte planes: small ones cost about a byte."""
    size = values.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose ``key`` is one of ``ids`` (distinct, counted here), or with ``left_anti`` the
    others. The ids are broadcast only when there are few; beyond that the rows are shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)
