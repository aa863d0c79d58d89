"""Nearest neighbours by inverted lists with product-quantised residuals, and exact distances at the end.

The index is a table: each vector's list (its nearest coarse centre) and a code of one byte for each few dimensions of its residual. Centres and codebooks are fitted to a
bounded sample; every vector is indexed. A query looks through the lists of its nearest centres by sums of table look-ups, keeps ``shortlist`` candidates, and joins
them with the vectors for their exact distances.

Lists are searched in pairs of blocks, of at most about BLOCK codes with QUERIES queries, so neither a list that a third of all vectors are in nor one that most queries ask
for is in one task. Vectors and queries that are null, have a null or infinite part or another dimension are left out. Equal distances go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Vectors that centres and codebooks are fitted to, at most, and dimensions for each byte of a code.
SAMPLE, PART = 20_000, 4
BLOCK, QUERIES = 8192, 512


@dataclass
class Codebook:
    centres: np.ndarray  # lists x dimensions
    codes: np.ndarray  # parts x codes x PART
    probes: int  # lists that a query looks through


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x; a centre that loses all its rows is put on the row that is farthest from its own."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        far = np.argsort(-((x - centres[at]) ** 2).sum(axis=1))
        centres[n == 0] = x[far[: int((n == 0).sum())]]
    return centres


def _clean(vectors: DataFrame, key: str, column: str, dim: int | None = None) -> DataFrame:
    """(id, v): the vectors that can be compared."""
    v = F.col(column).cast("array<float>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)
    return rows if dim is None else rows.filter(F.size("v") == dim)


def _probes(x: np.ndarray, centres: np.ndarray, share: float, queries: int = 200, k: int = 10) -> int:
    """The fewest of a query's nearest lists that hold a share of its k nearest rows of x, over the first rows as queries."""
    at, ranks = _nearest(x, centres), []
    for q in x[:queries]:
        near = np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:k]
        order = np.argsort(((centres - q) ** 2).sum(axis=1), kind="stable")
        ranks += np.argsort(order)[at[near]].tolist()
    return int(np.quantile(ranks, share, method="higher")) + 1


def fit(vectors: DataFrame, key: str, column: str, lists: int | None = None, share: float = 0.97, seed: int = 1) -> Codebook | None:
    """Centres and codebooks from at most SAMPLE vectors, those with the smallest hashes of their ids; None if there is no vector. The dimension is the sample's most
    frequent; lists: about the square root of the vectors, 1024 at most; share: of the sample's own neighbours, what the probes have to reach."""
    rows = _clean(vectors, key, column)
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"].to_pylist()
    if not got:
        return None
    dims, n = np.unique([len(v) for v in got], return_counts=True)
    dim = int(dims[n.argmax()])
    x = np.array([v for v in got if len(v) == dim], np.float64)
    lists = lists or min(1024, max(1, round(rows.count() ** 0.5)))
    centres = k_means(x, min(lists, len(x)), seed)
    left = x - centres[_nearest(x, centres)]
    parts = -(-dim // PART)
    left = np.pad(left, ((0, 0), (0, parts * PART - dim)))
    codes = np.stack([k_means(left[:, i * PART : (i + 1) * PART], min(256, len(x)), seed + i) for i in range(parts)])
    return Codebook(centres, codes, _probes(x, centres, share))


def index(vectors: DataFrame, key: str, column: str, book: Codebook) -> DataFrame:
    """(id, list, code) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    dim, parts = book.centres.shape[1], len(book.codes)

    def run(batches):
        b = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dim)
            at = _nearest(x, b.centres)
            left = np.pad(x - b.centres[at], ((0, 0), (0, parts * PART - dim)))
            code = np.stack([_nearest(left[:, i * PART : (i + 1) * PART], b.codes[i]) for i in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "list", "code"])

    return _clean(vectors, key, column, dim).mapInArrow(run, "id long, list int, code binary")


def _asked(queries: DataFrame, book: Codebook, probes: int) -> DataFrame:
    """(query, list, v): each query once for each of the lists that it looks through."""
    shared = queries.sparkSession.sparkContext.broadcast(book.centres)
    probes = min(probes, len(book.centres))

    def run(batches):
        c = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, c.shape[1])
            near = np.argsort((c**2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(x)), probes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(near.reshape(-1), pa.int32()), batch.column(1).take(pa.array(rows))], ["query", "list", "v"])

    return queries.mapInArrow(run, "query long, list int, v array<float>")


def _matched(book: Codebook, shortlist: int):
    """For a block of codes and a block of queries of one list: each query's best by the look-up tables."""
    none = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})

    def run(codes: pa.Table, asked: pa.Table) -> pa.Table:
        if not codes.num_rows or not asked.num_rows:
            return none
        centre, parts = book.centres[codes["list"][0].as_py()], len(book.codes)
        ids = codes["id"].to_numpy()
        code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), parts)
        left = np.array(asked["v"].to_pylist(), np.float64) - centre
        left = np.pad(left, ((0, 0), (0, parts * PART - left.shape[1])))
        total = np.zeros((len(left), len(ids)))
        for i in range(parts):
            table = ((left[:, None, i * PART : (i + 1) * PART] - book.codes[i][None]) ** 2).sum(axis=2)
            total += table[:, code[:, i]]
        keep = min(shortlist, len(ids))
        best = np.stack([np.lexsort((ids, row))[:keep] for row in total])
        rows = np.repeat(np.arange(len(left)), keep)
        return pa.table({"query": asked["query"].to_numpy()[rows], "id": ids[best.reshape(-1)], "near": total[rows, best.reshape(-1)]})

    return run


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _best(rows: DataFrame, by: str, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(by, "id"))).filter(F.col("rank") <= n)


def search(vectors: DataFrame, queries: DataFrame, key: str, column: str, book: Codebook, codes: DataFrame, k: int = 10, probes: int | None = None, shortlist: int = 200) -> DataFrame:
    """(query, rank, id, distance): the k nearest vectors of each query by squared Euclidean distance, as far as its probes hold them.

    codes: the stored table of index(). Queries that repeat an id count once, with one of its vectors.
    """
    dim = book.centres.shape[1]
    asked = stored(_asked(_clean(queries, key, column, dim).withColumnRenamed("id", "query").dropDuplicates(["query"]), book, probes or book.probes), "asked")
    # a row for each list: how many blocks its codes and its queries come in
    counts = codes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
    blocks = F.broadcast(stored(counts.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("bn"), F.ceil(F.col("m") / QUERIES).cast("int").alias("bm")), "blocks"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = codes.join(blocks, "list").select("list", own("id", "bn").alias("x"), every("bm").alias("y"), "id", "code")
    right = asked.join(blocks, "list").select("list", every("bn").alias("x"), own("query", "bm").alias("y"), "query", "v")
    pairs = left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(_matched(book, shortlist), "query long, id long, near double")
    short = stored(_best(pairs, "near", shortlist).select("query", "id"), "short")
    texts = asked.select("query", "v").dropDuplicates(["query"])
    met = short.join(_clean(vectors, key, column, dim).withColumnRenamed("v", "_w"), "id").join(texts, "query")
    exact = met.select("query", "id", squared(F.col("v"), F.col("_w")).alias("distance"))
    return _best(exact, "distance", k).select("query", "rank", "id", "distance")


def exact_search(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int = 10, most: int = 20_000) -> DataFrame:
    """The same by comparing every query with every vector, for measuring recall over at most ``most`` queries, which are broadcast; each task keeps k of its vectors for each."""
    q = _clean(queries, key, column).limit(most + 1).toArrow()
    if q.num_rows > most:
        raise ValueError(f"recall is measured over {most} queries at most")
    q = q.rename_columns(["query", "v"])
    names, x = np.array(q["query"].to_pylist()), np.array(q["v"].to_pylist(), np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((names, x))

    def run(batches):
        names, x = shared.value
        for batch in batches:
            ids, w = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, x.shape[1])
            for at in range(0, len(x), 64):
                d = ((x[at : at + 64, None, :] - w[None, :2048]) ** 2).sum(axis=2) if len(w) <= 2048 else np.concatenate([((x[at : at + 64, None, :] - w[None, i : i + 2048]) ** 2).sum(axis=2) for i in range(0, len(w), 2048)], axis=1)
                for name, row in zip(names[at : at + 64], d, strict=True):
                    best = np.lexsort((ids, row))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), name)), pa.array(ids[best]), pa.array(row[best])], ["query", "id", "distance"])

    return _best(_clean(vectors, key, column, x.shape[1]).mapInArrow(run, "query long, id long, distance double"), "distance", k).select("query", "rank", "id", "distance")
