"""Shared pieces of the corpus operators: Arrow text blocks, vectorised hashing, Bloom maps.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, hashed over their UTF-8 bytes with
position-independent polynomials modulo a prime, so a block of text costs a fixed number of NumPy passes
and no Python loop over words. Hashes are 64 bit and equal on every machine.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import join_unique, partitions, shared_dir, stored

__all__ = ["join_unique", "partitions", "shared_dir", "stored"]  # for the operators here

#: Bytes of text in a block: a worker holds some twenty arrays of eight times this size at once.
BLOCK_BYTES = 1 << 19
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1_000_003)) * MULT)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: The modulus of the polynomials: a Mersenne prime, so that a remainder is a shift and an addition, and no two words are known to
#: collide for every base, as they are modulo a power of two.
PRIME = (1 << 31) - 1
_P, _FOLD = np.uint64(PRIME), np.uint64(31)
#: Two bases, so a hash has 62 bits before the last mixing.
BASES = (0x2545F491, 0x5851F42D)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint32), np.ones(1, np.uint32)) for _ in BASES]


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, but for a few bits."""
    return (x & _P) + (x >> _FOLD)


def _run(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo PRIME, by doubling."""
    out = np.ones(n, np.uint32)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m].astype(np.uint64) * np.uint64(pow(base, k, PRIME)) % _P
        k += m
    return out


def _upto(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses, at least n of each."""
    if len(_powers[0][0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        _powers[:] = [(_run(b, n), _run(pow(b, -1, PRIME), n)) for b in BASES]
    return _powers


class SpanHasher:
    """Hashes of byte ranges of one block: polynomials modulo a prime in two bases."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.lanes = []
        value = data.astype(np.uint64) + np.uint64(1)
        for power, inverse in _upto(n + 1):
            prefix = np.zeros(n + 1, dtype=np.uint64)
            term = prefix[1:]
            np.multiply(value, power[:n], out=term)
            if n > 1 << 24:  # a term has 39 bits, so the sum of 2**24 of them fits
                term[:] = _fold(term)
            np.cumsum(term, out=term)
            self.lanes.append((prefix, inverse))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = []
        for prefix, inverse in self.lanes:
            x = _fold(_fold(_fold(_fold(prefix[end] - prefix[start])) * inverse[start]))
            h.append(np.where(x >= _P, x - _P, x))
        return mix((h[0] | (h[1] << _FOLD)) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column of a batch, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, end row, bytes, offsets of the rows in them.

    A row longer than limit is a block of its own.
    """
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    n = len(col)
    if not n:
        return
    off = np.frombuffer(bufs[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the row of each word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    edge[0] = edge[n] = True
    first = edge[:n].copy()
    first[1:] |= ~solid[:-1]
    last = edge[1:].copy()
    last[:-1] |= ~solid[1:]
    start, end = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


_ORDER = seeds(64, 11) | np.uint64(1)


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each row, and their rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n] * _ORDER[0]
    for i in range(1, k):
        out += hashes[i : n + i] * _ORDER[i]
    own = row[:n] == row[k - 1 :]
    return mix(out[own]), row[:n][own]


def per_row(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each row's run in an ascending row array."""
    at = np.searchsorted(row, np.arange(n + 1))
    return at[:-1], at[1:]


#: What operators keep in a worker between tasks; settle() empties it.
KEPT: list[dict] = []


def settle() -> None:
    """Gives back to the system what earlier maps of this worker kept or freed. Called where a map begins: workers live on through all stages of a job."""
    for memory in KEPT:
        memory.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def row_hash(docs: DataFrame) -> Column:
    """The hash of a row's doc_id and text: rows that repeat both have the same."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))


def tasks(df: DataFrame, each: int = 128 << 20) -> int:
    """Tasks for a shuffle of what df makes: twice the shuffle partitions, or more where Catalyst expects more than ``each`` bytes a task."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(2 * partitions(df.sparkSession), math.ceil(size / each) if size < 1 << 60 else 0)  # beyond it, it is not known


class Bloom:
    """A set of 64-bit hashes in a bit map of a fixed size at most, so it can be broadcast however large the set is: a fuller map lets
    more strangers pass, and what passes is still to be joined with the set."""

    MOST = 1 << 26  # bits
    PROBES = 4

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: one column of longs; n: their number, about."""
        spark, bits = hashes.sparkSession, 1 << 10
        while bits < min(16 * n, self.MOST):
            bits *= 2
        self.words = bits // 64
        h = F.col(hashes.columns[0])
        probes = F.explode(F.array(*(F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(self.PROBES))))
        seen = hashes.select(probes.alias("b")).groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("m"))
        table = np.zeros(self.words, np.uint64)
        got = seen.toArrow()  # a row for each word of the map at most
        table[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
        self.table = spark.sparkContext.broadcast(table)

    def __getstate__(self):
        return {"words": self.words, "table": self.table}

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which of the int64 hashes are in the set, and a few others."""
        out, n = np.ones(len(h), bool), np.uint64(64 * self.words)
        for i in range(self.PROBES):
            b = spark_hash_long(h, i)
            b = (b.view(np.int64) % np.int64(n)).astype(np.uint64)
            out &= (self.table.value[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return out


class BitMap:
    """The same as an expression: the map is a one-row subquery, which the plan reads as a constant."""

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: one column of longs; n: their number, about."""
        self.bits = 1 << 10
        while self.bits < min(16 * n, Bloom.MOST):
            self.bits *= 2
        spots = hashes.select(F.explode(F.array(*self._probes(F.col(hashes.columns[0])))).alias("b"))
        set_ = spots.select(F.shiftright("b", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int")).alias("m"))
        words = hashes.sparkSession.range(self.bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("m")).unionAll(set_).groupBy("w").agg(F.bit_or("m").alias("m"))
        self.words = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("words")).scalar()

    def _probes(self, h: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(self.bits).cast("long")) for i in range(Bloom.PROBES)]

    def has(self, h: Column) -> Column:
        """Whether a hash is in the set, or passes for one that is."""
        out = F.lit(True)
        for b in self._probes(h):
            out &= F.call_function("getbit", F.get(self.words, F.shiftright(b, 6).cast("int")), (b % 64).cast("int")) == 1
        return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose row_hash is not in gone, a stored table of one column without repeats. Rows that the map of gone lets through are not
    shuffled; the others are joined."""
    (name,) = gone.columns
    map_, row = BitMap(gone, gone.count()), row_hash(docs)
    maybe = docs.filter(map_.has(row))
    return docs.filter(~map_.has(row)).unionByName(maybe.join(gone.hint("merge"), row_hash(maybe) == gone[name], "left_anti"))


_X1, _X2, _X3, _X4, _X5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _X2
    h = (h ^ (h >> np.uint64(29))) * _X3
    return h ^ (h >> np.uint64(32))


def spark_hash_long(values: np.ndarray, salt: int) -> np.ndarray:
    """F.xxhash64(values, F.lit(salt)) of a column of longs and an int: XXH64 of eight bytes, then of four with that as its seed."""
    x = values.view(np.uint64)
    h = np.uint64(42 + int(_X5) + 8) ^ (_rotated(x * _X2, 31) * _X1)
    h = _avalanche(_rotated(h, 27) * _X1 + _X4)
    h = h + _X5 + np.uint64(4)
    h = h ^ np.uint64(salt * int(_X1) & (1 << 64) - 1)
    return _avalanche(_rotated(h, 23) * _X2 + _X3)
