"""Language scores: byte-trigram profiles of several languages, and probabilities with a fitted temperature.

A profile is the smoothed distribution of the hashed byte trigrams of a language's texts, lower-cased. A text's mean log-likelihood under each profile, times a
temperature, gives by softmax the probability of each language. Profiles count every text of the training rows; the temperature is the one of a grid with the least
log loss on the calibration rows. Both are aggregations; the driver gets one number for each language and bucket, and one for each temperature.

Rows are split by crc32 of their key: a quarter for tests alone, a quarter for the temperature, the rest for the profiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
#: Bytes that are looked at at once, and languages at most (a model has a float for each language and bucket).
PIECE, MOST = 1 << 20, 256
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def held_out(key: str) -> Column:
    return part(key) == 0


def part(key: str) -> Column:
    """0: tests, 1: temperature, 2 and 3: profiles. A null key is in 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4, F.lit(2).cast("long"))


def _trigrams(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of the trigrams of the texts, some texts at a time; a long text comes in parts that share two bytes."""
    col = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")).cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, "right")) - 1)
        for at in range(int(off[lo]), int(off[hi]), PIECE if hi == lo + 1 else int(off[hi])):
            end = min(int(off[hi]), at + PIECE + 2) if hi == lo + 1 else int(off[hi])
            d = data[at:end].astype(np.uint32)
            if len(d) > 2:
                row = np.searchsorted(off[lo : hi + 1], np.arange(at, end), "right") - 1 + lo
                whole = row[:-2] == row[2:]
                yield row[:-2][whole], ((((d[:-2] << 16) | (d[1:-1] << 8) | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS))[whole].astype(np.int64)
        lo = hi


@dataclass
class Profiles:
    """Languages, their log-probabilities by bucket, and the temperature."""

    languages: list[str]
    logp: np.ndarray
    temperature: float = 1.0


def _counts(docs: DataFrame, languages: list[str], text: str, lang: str) -> np.ndarray:
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        for batch in batches:
            own = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            total = np.zeros(len(place) << BITS, np.int64)
            for row, b in _trigrams(batch.column(0)):
                b, at = b[own[row] >= 0], own[row][own[row] >= 0]
                total += np.bincount((at << BITS) | b, minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(len(languages) << BITS)
    sums = docs.select(F.col(text).cast("string"), F.col(lang)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(len(languages), 1 << BITS)


def likelihoods(docs: DataFrame, model: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """keep, and _fits: the mean log-likelihood of the row's text under each profile, null for a text without a trigram. Texts of any length, one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model.logp.astype(np.float32))

    def run(batches):
        for batch in batches:
            n, logp = batch.num_rows, shared.value
            total, grams = np.zeros((n, len(logp))), np.zeros(n)
            for row, b in _trigrams(batch.column(0)):
                first, last = int(row[0]), int(row[-1]) + 1
                grams[first:last] += np.bincount(row - first, minlength=last - first)
                for i, p in enumerate(logp):
                    total[first:last, i] += np.bincount(row - first, p[b], last - first)
            fits = [list(t / g) if g else None for t, g in zip(total, grams, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fits, pa.list_(pa.float64()))], [*keep, "_fits"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(run, f"{schema}, _fits array<double>")


def softmax(fits: Column, temperature: float) -> Column:
    """Probabilities of the likelihoods."""
    top = F.array_max(fits)
    parts = F.transform(fits, lambda x: F.exp((x - top) * temperature))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, y: a + y))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> Profiles:
    """Profiles of the languages of docs, and their temperature. Rows with a null language teach nothing."""
    known = docs.filter(F.col(lang).isNotNull())
    languages = [r[0] for r in known.select(F.col(lang).cast("string")).distinct().orderBy(lang).limit(MOST + 1).collect()]
    if len(languages) > MOST:
        raise ValueError(f"more than {MOST} languages")
    n = _counts(known.filter(part(key) >= 2), languages, text, lang) + smoothing
    model = Profiles(languages, np.log(n / n.sum(axis=1, keepdims=True)))
    place = F.array_position(F.array(*map(F.lit, languages)), F.col(lang)).cast("int") - 1 if languages else F.lit(0)
    fits = likelihoods(known.filter(part(key) == 1), model, [lang], text).filter("_fits is not null")
    loss = lambda t: F.avg(-F.log(F.greatest(F.get(softmax(F.col("_fits"), t), place), F.lit(1e-12))))
    got = fits.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    losses = [x if x is not None else float("inf") for x in got]
    model.temperature = TEMPERATURES[int(np.argmin(losses))]
    return model


def scored(docs: DataFrame, model: Profiles, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with language (the likeliest) and language_score (the probability of the language that the row claims, of the likeliest where it claims none; 0 for one
    without a profile). Both are null for a text without a trigram."""
    names = F.array(*map(F.lit, model.languages)) if model.languages else F.array().cast("array<string>")
    rows = likelihoods(docs, model, docs.columns, text).withColumn("_fits", F.when(F.size("_fits") > 0, F.col("_fits")))
    p = softmax(F.col("_fits"), model.temperature)
    rows = rows.select(*docs.columns, F.inline(F.array(F.struct(p.alias("_p")))))
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    own = F.coalesce(F.get("_p", F.array_position(names, F.col(lang)).cast("int") - 1), F.lit(0.0))
    score = F.when(F.col("_p").isNotNull(), F.when(F.col(lang).isNull(), F.array_max("_p")).otherwise(own))
    return rows.select(*docs.columns, F.get(names, best).alias("language"), score.alias("language_score"))


def held_out_accuracy(rows: DataFrame, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(lang, n, right): of scored rows that no fit has seen."""
    return rows.filter(held_out(key) & F.col(lang).isNotNull() & F.col("language").isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("language") == F.col(lang)).alias("right"))
