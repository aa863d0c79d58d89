"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over ``buckets`` hashed byte n-grams are counted: one over the texts of trusted
rows, one over every document. A document's score is the mean clipped log ratio of its
n-grams (so long texts weigh as short ones), and every document below ``threshold`` goes. There is no
sampling in the decision: equal texts always get equal verdicts.

Defined results: a null text is an empty one; a text without n-grams scores 0; rows are judged one by
one, so repeated rows get equal verdicts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, blocks, code_points, grams, mix, per_row, settle, text_of, words

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityParams:
    """n: bytes in an n-gram. trusted_rows: bound on the labelled rows that make the target.
    clip: largest weight of one n-gram. threshold: lowest mean log ratio that stays."""

    n: int = 3
    buckets: int = 1 << 16
    trusted_rows: int = 20_000
    clip: float = 3.0
    smoothing: float = 1.0
    threshold: float = -0.4
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def _gram_buckets(data: np.ndarray, off: np.ndarray, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram inside a row, and the row's bounds among them."""
    n = len(data) - p.n + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = np.zeros(n, dtype=np.uint32)
    for i in range(p.n):
        h = h * np.uint32(0x01000193) + data[i : i + n]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    own = np.ones(n, dtype=bool)
    for i in range(1, p.n):
        at = off[1:-1] - i
        own[at[(at >= 0) & (at < n)]] = False
    bucket = (h & np.uint32(p.buckets - 1)).astype(np.int64)
    seen = np.concatenate([[0], np.cumsum(own)])
    return bucket[own], seen[np.minimum(off, n)]


def count_grams(docs: DataFrame, trusted: set, p: QualityParams) -> DataFrame:
    """(bucket, raw, target) over all documents; trusted: at most p.trusted_rows ids."""

    def count(batches):
        settle()
        raw, target = np.zeros(p.buckets, np.int64), np.zeros(p.buckets, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, off in blocks(text_of(batch)):
                b, at = _gram_buckets(data, off, p)
                raw += np.bincount(b, minlength=p.buckets)
                for i in range(lo, hi):
                    if ids[i] in trusted:
                        target += np.bincount(b[at[i - lo] : at[i - lo + 1]], minlength=p.buckets)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], ["bucket", "raw", "target"])

    part = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame, p: QualityParams) -> set:
    """Ids of the trusted rows: those of quality 1, in hash order up to the bound."""
    rows = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return {r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.trusted_rows).collect()}


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> np.ndarray:
    """Log ratio of each bucket (a vector of p.buckets floats, whatever the corpus). Without trusted rows it is 0."""
    raw, target = np.zeros(p.buckets), np.zeros(p.buckets)
    for r in count_grams(docs, trusted_ids(labels, p), p).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.sum():
        return np.zeros(p.buckets, np.float32)
    rate = lambda x: (x + p.smoothing) / (x.sum() + p.smoothing * p.buckets)
    return np.clip(np.log(rate(target) / rate(raw)), -p.clip, p.clip).astype(np.float32)


def _line_repeats(data: np.ndarray, off: np.ndarray, start: np.ndarray, hasher: SpanHasher) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    n, rows = len(data), len(off) - 1
    brk = data == 10
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begin = edge[:n].copy()
    begin[0] = True
    begin[1:] |= brk[:-1]
    first = np.flatnonzero(begin)
    end = np.append(first[1:], n)
    end = end - brk[end - 1]
    full = np.searchsorted(start, end) > np.searchsorted(start, first)
    first, end = first[full], end[full]
    row = np.searchsorted(off, first, "right") - 1
    key = mix(hasher.spans(first, end) + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[at] = False
    return np.bincount(row[again], minlength=rows)


def _window_repeats(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Per row, the words inside k-word windows that the row holds twice or more."""
    g, r = grams(h, row, k)
    if not len(g):
        return np.zeros(rows, np.int64)
    key = mix(g + r.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    n = len(h)
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return np.bincount(row[np.cumsum(cover[:n]) > 0], minlength=rows)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
#: Weights are whole multiples of 1 / UNIT, so sums are exact: a row's score can't depend on its neighbours in a block.
UNIT = 1 << 24


def figures(col: pa.Array, ratio: np.ndarray, p: QualityParams) -> dict[str, np.ndarray]:
    """Base figures, failure, verdict and score of each text of a column."""
    n = len(col)
    out = {c: np.zeros(n, np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    w, score = np.round(ratio.astype(np.float64) * UNIT).astype(np.int64), np.zeros(n)
    for lo, hi, data, off in blocks(col):
        rows = hi - lo
        if not len(data):
            continue
        start, end, row = words(data, off)
        hasher = SpanHasher(data)
        h = hasher.spans(start, end)
        solid = np.concatenate([[0], np.cumsum(code_points(data) & ~np.isin(data, np.array([32, 9, 10, 11, 12, 13], np.uint8)))])
        signs = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
        out["n_words"][lo:hi] = np.bincount(row, minlength=rows)
        out["word_chars"][lo:hi] = solid[off[1:]] - solid[off[:-1]]
        out["n_symbols"][lo:hi] = signs[off[1:]] - signs[off[:-1]]
        out["n_dup_lines"][lo:hi] = _line_repeats(data, off, start, hasher)
        out["n_repeat_words"][lo:hi] = _window_repeats(h, row, rows, p.window)
        b, at = _gram_buckets(data, off, p)
        total = np.concatenate([[0], np.cumsum(w[b])])
        score[lo:hi] = (total[at[1:]] - total[at[:-1]]) / np.maximum(at[1:] - at[:-1], 1) / UNIT
    out["base_failed"] = (out["n_words"] < p.min_words) | (100 * out["n_repeat_words"] > p.max_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & (score >= p.threshold)
    return out | {"score": score}


def judge(docs: DataFrame, ratio: np.ndarray, p: QualityParams = QualityParams()) -> DataFrame:
    """Base figures, score and verdict of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # p.buckets floats

    def run(batches):
        settle()
        for batch in batches:
            out = figures(text_of(batch), shared.value, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out.values())], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Fits on all of docs and labels, then judges every row of docs. A null text is an empty one; an empty table gives an empty result."""
    return judge(docs, fit(docs, labels, p), p)


def keep_good(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The verdict is computed beside the row, so nothing is joined and clashing column names don't matter.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        settle()
        for batch in batches:
            texts = text_of(pa.RecordBatch.from_arrays([batch.column(at)], ["text"]))
            yield batch.filter(pa.array(figures(texts, ratio.value, p)["kept"]))

    return docs.mapInArrow(run, schema)
