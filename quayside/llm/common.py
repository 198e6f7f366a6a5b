"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import cut_lineage, ship_package, stored_by

__all__ = ["table", "held_out", "text_class", "words_of", "cut_lineage", "ship_package", "stored_by", "word_hashes", "shingle_hashes", "hash_pieces", "mix64"]

U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(column, parts: int, remainder: int):
    """True where crc32 of the id's text falls on ``remainder``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == remainder


def text_class(column: str = "text"):
    """A number for a text; null counts as empty."""
    return F.xxhash64(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8 bytes; null and empty texts have none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_STEP = U64(0xD1342543DE82EF95)
_POWERS = np.ones(1 << 12, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.ones(2 * n, dtype=np.uint64)
    if _POWERS[1] == 1:
        with np.errstate(over="ignore"):
            _POWERS[1:] = _STEP
            np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts in order.

    Returns the hashes, the number of words of each text, and the first and last+1 byte of each word in the joined texts.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    owner = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, owner))
    if not len(starts):
        return np.empty(0, np.uint64), counts, starts, ends
    lengths = ends - starts
    inside = ~space
    place = np.arange(len(joined))[inside] - np.repeat(starts, lengths)
    values = _LETTERS[joined[inside]] * _powers(int(lengths.max()) + 1)[place]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64)), counts, starts, ends


_WEIGHTS = mix64(np.arange(101, 133, dtype=np.uint64)) | U64(1)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of every run of ``width`` words, by first word; fewer words than that make one shingle of them all."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _WEIGHTS[k]
    return mix64(total)


def hash_pieces(texts: list, size: int = 1_000_000):
    """Cut a list of texts (null: empty) into runs of whole texts of about ``size`` bytes; yields (first index, bytes).

    Hashing a run takes about fifty times its bytes of memory, which a worker does not give back.
    """
    part: list[bytes] = []
    first = held = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if part and held + len(raw) > size:
            yield first, part
            part, first, held = [], i, 0
        part.append(raw)
        held += len(raw)
    if part:
        yield first, part
