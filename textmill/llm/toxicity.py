"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first four, five and six bytes, hashed into ``2**bits`` buckets. Labelled rows pick the buckets
that go with the label (chi-square, at most ``terms``), and a second-order factorization machine is fitted to their presence:

    score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)   over the chosen terms of the text

so pairs of terms count beyond their single weights. Labels come from at most ``rows`` labelled rows (in hash order of
doc_id), and never from rows whose crc32(doc_id as text) mod 4 is 2; every document is scored over its whole text.

Defined results: a null text is an empty one; a text without a chosen term gets the intercept's score; a null doc_id counts as
held out false; labels null are left out; without labelled rows of both kinds every score is 0; repeated rows get equal scores; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, blocks, text_of


@dataclass(frozen=True)
class FMParams:
    rows: int = 20_000
    bits: int = 18
    terms: int = 512
    least_chi2: float = 10.83
    factors: int = 6
    epochs: int = 25
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 17


_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_buckets(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every term of a block, rows ascending."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    accent = np.zeros(n, dtype=bool)  # U+00C0 to U+00DE
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[accent] += 32
    part, edge = _TERM[data], np.zeros(n + 1, dtype=bool)
    edge[off] = True
    edge[0] = edge[n] = True
    first, last = edge[:n].copy(), edge[1:].copy()
    first[1:] |= ~part[:-1]
    last[:-1] |= ~part[1:]
    start, end = np.flatnonzero(part & first), np.flatnonzero(part & last) + 1
    h, row = SpanHasher(low), np.searchsorted(off, start, "right") - 1
    found = [h.spans(start, end)]
    rows = [row]
    for k in (4, 5, 6):
        long = end - start > k
        found.append(h.spans(start[long], start[long] + k) ^ np.uint64(k))
        rows.append(row[long])
    bucket, rows = np.concatenate(found) & np.uint64((1 << bits) - 1), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return bucket.astype(np.int64)[order], rows[order]


def distinct_terms(bucket: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << bits) | bucket)
    return both & ((1 << bits) - 1), both >> bits


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, p: FMParams) -> DataFrame:
    """(doc_id, text, y) of the training rows; their ids, at most p.rows, are broadcast."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.rows)
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], "doc_id long, y int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def choose_terms(rows: DataFrame, p: FMParams) -> np.ndarray:
    """Ascending buckets of the terms with the largest chi-square; one count vector leaves each task."""
    size = 1 << p.bits

    def count(batches):
        seen, n = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1).to_pylist(), np.int64)
            for lo, hi, data, off in blocks(text_of(batch)):
                b, r = distinct_terms(*term_buckets(data, off, p.bits), p.bits)
                for v in (0, 1):
                    seen[v] += np.bincount(b[y[lo:hi][r] == v], minlength=size).astype(np.int32)
            n += np.bincount(y, minlength=2)[:2]
        k = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(seen[0][k], n[0]), pa.int64()), pa.array(np.append(seen[1][k], n[1]), pa.int64())], ["b", "c0", "c1"])

    got = rows.select("doc_id", "y", "text").mapInArrow(count, "b long, c0 long, c1 long").groupBy("b").agg(F.sum("c0"), F.sum("c1")).filter("b < 0 or sum(c1) > 0").collect()
    n0, n1 = next(((r[1], r[2]) for r in got if r[0] < 0), (0, 0))
    if not n0 or not n1:
        return np.zeros(0, np.int64)
    b, a0, a1 = (np.array([r[i] for r in got if r[0] >= 0], float) for i in range(3))
    k, n = a0 + a1, n0 + n1
    chi = n * (a1 * (n0 - a0) - a0 * (n1 - a1)) ** 2 / np.maximum(k * (n - k) * n0 * n1, 1)
    good = np.flatnonzero((chi >= p.least_chi2) & (a1 * n0 > a0 * n1))
    good = good[np.lexsort((b[good], -chi[good]))][: p.terms]
    return np.sort(b[good]).astype(np.int64)


@dataclass
class FM:
    buckets: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n rows from (term, row) pairs; term is the place among the buckets."""
        s = np.zeros((n, self.v.shape[1]))
        q, out = np.zeros(n), np.full(n, self.b)
        np.add.at(s, row, self.v[term])
        np.add.at(q, row, (self.v[term] ** 2).sum(axis=1))
        np.add.at(out, row, self.w[term])
        return out + 0.5 * ((s**2).sum(axis=1) - q)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(terms: np.ndarray, x: list[np.ndarray], y: np.ndarray, p: FMParams) -> FM:
    """Adam on the log loss, full passes over shuffled batches of 512 rows; fixed seed."""
    rng = np.random.default_rng(p.seed)
    fm = FM(terms, 0.0, np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), p.factors)))
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    fm.b = float(np.log(rate / (1 - rate)))
    moment = {k: [0.0, 0.0] for k in "bwv"}
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            pick = order[at : at + 512]
            row = np.repeat(np.arange(len(pick)), [len(x[i]) for i in pick])
            term = np.concatenate([x[i] for i in pick]) if len(pick) else np.zeros(0, np.int64)
            e = (sigmoid(fm.raw(term, row, len(pick))) - y[pick]) / len(pick)
            s = np.zeros((len(pick), p.factors))
            np.add.at(s, row, fm.v[term])
            grad = {"b": e.sum(), "w": np.bincount(term, e[row], len(terms)) + p.decay * fm.w, "v": np.zeros_like(fm.v)}
            np.add.at(grad["v"], term, e[row, None] * (s[row] - fm.v[term]))
            grad["v"] += p.decay * fm.v
            step += 1
            for k, g in grad.items():
                m = moment[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g**2
                now = getattr(fm, k) - p.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                setattr(fm, k, now)
    return fm


def fit(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams()) -> FM | None:
    """Learns from the labelled sample: its chosen terms come to the driver, at most p.rows * p.terms * 2 bytes."""
    rows = labelled(docs, labels, p)
    terms = choose_terms(rows, p)
    if not len(terms):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def hits(batches):
        for batch in batches:
            out = []
            for lo, hi, data, off in blocks(text_of(batch)):
                b, r = distinct_terms(*term_buckets(data, off, p.bits), p.bits)
                at = np.searchsorted(shared.value, b)
                known = (at < len(shared.value)) & (shared.value[np.minimum(at, len(shared.value) - 1)] == b)
                at, r = at[known].astype("<u2"), r[known]
                cut = np.searchsorted(r, np.arange(hi - lo + 1))
                out += [at[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "terms"])

    got = sorted(map(tuple, rows.select("doc_id", "y", "text").mapInArrow(hits, "doc_id long, y int, terms binary").collect()))
    return train(terms, [np.frombuffer(r[2], "<u2").astype(np.int64) for r in got], np.array([r[1] for r in got], float), p)


def score(docs: DataFrame, fm: FM | None, p: FMParams = FMParams(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fm)

    def run(batches):
        fm = shared.value
        place = np.full(1 << p.bits, -1, np.int32)
        if fm is not None:
            place[fm.buckets] = np.arange(len(fm.buckets))
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for lo, hi, data, off in blocks(text_of(batch)) if fm is not None else ():
                b, r = term_buckets(data, off, p.bits)
                known = place[b] >= 0
                b, r = distinct_terms(b[known], r[known], p.bits)
                s[lo:hi] = sigmoid(fm.raw(place[b], r, hi - lo))
            s = np.round(s, 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams()) -> DataFrame:
    return score(docs, fit(docs, labels, p), p)
