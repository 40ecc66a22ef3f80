"""Helpers that the corpus operators share: words, hashing, written stages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from listinglake.operators.order import passing as passing
from listinglake.operators.order import written as written

#: Bytes of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F], A-Z lower-cased; every other byte becomes a space.
#: Bytes from 0x80 belong to multi-byte characters, which are word characters, so UTF-8 can be cut bytewise.
WORD_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a whole text; null and empty give none."""
    return utf8(text).translate(WORD_TABLE).split()


STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict[bytes, int]):
    """64-bit hashes of words, kept as long as there is room."""

    ROOM = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-word window; of all words where there are fewer."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * STEP + hashes[j : j + len(out)]
    return mix64(out + np.uint64(k))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@contextmanager
def one_at_a_time(shared: list[Broadcast], k: int) -> Iterator[Any]:
    """A shared value from its file; where there are several, it is forgotten after use, so that a task holds one of them."""
    yield shared[k].value
    if len(shared) > 1:
        vars(shared[k]).pop("_value", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
