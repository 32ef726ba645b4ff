"""What several of the pipeline operators need: shared storage, Arrow batch bounds, word splitting, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

from tidegraph.storage import filesystem, fresh_path, release, salted, saved, scratch, shared_dir

__all__ = ["WordHashes", "bound_batches", "filesystem", "fresh_path", "keeps", "mix", "release", "salted", "saved", "scratch", "shared_dir", "shingle_hashes", "take_turn", "utf8"]

#: Bytes of input that one Arrow batch may carry to a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that a few very long texts can't fill a worker. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except Exception:  # noqa: BLE001  the default may be spelled with a unit
        now = 1 << 62
    if now > limit:
        spark.conf.set(key, str(limit))


_kept: dict[str, Callable[[], object]] = {}
_turn: list[str] = [""]


def keeps(name: str, forget: Callable[[], object]) -> None:
    """Say how to forget what an operator remembers in a worker."""
    _kept[name] = forget


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    """The C library, told to map large blocks apart, so that they go back to the system as they are freed; None where it isn't glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(ctypes.c_int(-3), ctypes.c_int(1 << 20))  # M_MMAP_THRESHOLD
        libc.malloc_trim
    except (OSError, AttributeError):
        return None
    return libc


def take_turn(name: str) -> None:
    """Of the operators that remember things in this worker, only one does so at a time, and what others held goes back to the system: workers outlive their stages."""
    if _turn[0] != name:
        _turn[0] = name
        for other, forget in _kept.items():
            if other != name:
                forget()
        gc.collect()
    if libc := _libc():
        pa.set_memory_pool(pa.system_memory_pool())
        libc.malloc_trim(0)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The values' UTF-8 bytes, one at a time."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from utf8(chunk)
        return
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for x in binary:
        yield x.as_py()


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and odd multiplications)."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all k-word shingles; with 1 to k-1 words, of the whole sequence; without words, none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            h = mix(h * _M1 + words[j : n - width + 1 + j])
    return np.unique(h)
