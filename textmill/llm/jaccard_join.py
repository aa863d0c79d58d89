"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles (all words as one shingle if there are fewer). Texts of equal sets are one node. Each node's set is embedded as
``coordinates`` min-wise hashes, a sample of its tokens such that two sets of similarity s share each one with probability s.

A run is a tree. At a tree node, one or two coordinates (1 / 0.8 on average) are chosen by the node's path; sets that share the chosen token
go to one child. Buckets of at most ``bucket`` sets are brute-forced on their embeddings; larger ones are split again, to
``depth`` levels. What is still large then (sets that can hardly be told apart) is brute-forced in pairs of blocks, each a task's of its own, at a cost
that is the square of such a bucket. runs() has the number of runs that finds a pair at the threshold with the target recall, over
what its embeddings agree in by chance, since all runs choose among the same coordinates.

Candidates become components; within a component every pair is verified on the exact sets, in blocks that go to tasks of their
own, so links are counted and classes joined without a pair being emitted. There is one plan for every size: the sets of candidates are made
from the texts again, of which a Bloom map of bounded size picks the rows.

Defined results: a null text is an empty one; texts without words have equal sets; a class has the smallest doc_id of its
members, null if none has one; rows that repeat count as documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, SpanHasher, blocks, grams, join_unique, mix, per_row, row_hash, seeds, settle, stored, tasks, text_of, without, words
from .components import components, groups, local_components


@dataclass(frozen=True)
class JoinParams:
    """similarity: numerator and denominator of the threshold. recall: of pairs at the threshold, by the runs.
    bucket: largest that is brute-forced before the last level. slab: sets in a block of a larger one at the last level.
    block: sets in a block of the exact verification."""

    k: int = 5
    similarity: tuple[int, int] = (4, 5)
    coordinates: int = 64
    bucket: int = 128
    depth: int = 3
    recall: float = 0.999
    slab: int = 2048
    block: int = 512

    def _agreeing(self, k: int) -> float:
        """The probability that a pair at the threshold agrees in k coordinates."""
        s = self.similarity[0] / self.similarity[1]
        return math.comb(self.coordinates, k) * s**k * (1 - s) ** (self.coordinates - k)

    def runs(self) -> int:
        """Runs after which a pair at the threshold has met with probability recall, even if all its buckets split to the end."""
        one, runs, found = 2 - self.similarity[1] / self.similarity[0], 0, 0.0
        met = []
        for k in range(self.coordinates + 1):
            x = 1.0
            for _ in range(self.depth):
                y = k / self.coordinates * x
                x = one * y + (1 - one) * (1 - (1 - y) ** 2)
            met.append(x)
        while found < self.recall:
            runs += 1
            found = sum(self._agreeing(k) * (1 - (1 - x) ** runs) for k, x in enumerate(met))
        return runs

    def agreement(self) -> int:
        """Places in which embeddings of a candidate agree at least: a pair at the threshold falls short with a tenth of the
        probability that the runs may miss it, by the binomial law."""
        short = 0.0
        for k in range(self.coordinates + 1):
            short += self._agreeing(k)
            if short > (1 - self.recall) / 10:
                return k
        return self.coordinates


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and the rows' bounds."""
    start, end, row = words(data, off)
    h = SpanHasher(data).spans(start, end)
    rows = len(off) - 1
    g, r = grams(h, row, k)
    n = np.bincount(row, minlength=rows)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        a, _ = per_row(row, rows)
        whole = np.array([int(mix(np.array([(h[a[i] : a[i] + n[i]] * seeds(int(n[i]), 3)).sum()], np.uint64))[0]) for i in few], np.uint64)
        g, r = np.concatenate([g, whole]), np.concatenate([r, few])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[new], r[new]
    a, b = per_row(r, rows)
    return g, np.append(a, b[-1] if rows else 0)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(s).tobytes()) - (1 << 63)


def embedded(docs: DataFrame, p: JoinParams) -> DataFrame:
    """(doc_id, row, node, emb) of every row: the node is the hash of its set."""
    turn = seeds(p.coordinates, 23) | np.uint64(1)

    def run(batches):
        settle()
        for batch in batches:
            nodes, embs = [], []
            for lo, hi, data, off in blocks(text_of(batch)):
                g, at = shingle_sets(data, off, p.k)
                full = np.flatnonzero(at[1:] > at[:-1])
                emb = np.zeros((hi - lo, p.coordinates), np.uint32)
                for t in range(p.coordinates if len(g) else 0):
                    emb[full, t] = np.minimum.reduceat(g * turn[t], at[:-1][full]) >> np.uint64(32)
                nodes += [set_key(g[at[i] : at[i + 1]]) for i in range(hi - lo)]
                embs += [e.tobytes() for e in emb]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(embs, pa.binary())], ["doc_id", "row", "node", "emb"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), "text").mapInArrow(run, "doc_id long, row long, node long, emb binary")


def _embs(col, coordinates: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, coordinates)


def _children(path: np.ndarray, emb: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Child paths of the rows, and the row of each: the path chooses the coordinates."""
    u = mix(path + np.uint64(0x51))
    c = np.uint64(p.coordinates)
    first = (u % c).astype(np.int64)
    step = mix(u + np.uint64(1))
    second = (first + 1 + (step % (c - np.uint64(1))).astype(np.int64)) % p.coordinates
    two = (step >> np.uint64(40)).astype(float) / (1 << 24) < p.similarity[1] / p.similarity[0] - 1
    rows = np.arange(len(path))
    row, at = np.concatenate([rows, rows[two]]), np.concatenate([first, second[two]])
    return mix(path[row] * np.uint64(0x9E3779B97F4A7C15) + emb[row, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(33))), row


def _emit(path: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node)], ["path", "node"])


def _roots(p: JoinParams):
    def run(batches):
        root = seeds(p.runs(), 31)
        for batch in batches:
            emb, node = _embs(batch.column(1), p.coordinates), batch.column(0).to_numpy(zero_copy_only=False)
            for r in root:
                path, row = _children(np.full(len(node), r), emb, p)
                yield _emit(path, node[row])

    return run


def _split(p: JoinParams):
    def run(batches):
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node, emb = batch.column(1).to_numpy(zero_copy_only=False), _embs(batch.column(2), p.coordinates)
            child, row = _children(path, emb, p)
            yield _emit(child, node[row])

    return run


def _agreeing(emb: np.ndarray, path: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of equal paths (sorted) whose embeddings agree in least places; in slices of constant memory. For small groups."""
    a, b = [], []
    n = len(path)
    end = np.searchsorted(path, path, "right")
    size = int((end - np.searchsorted(path, path, "left")).max()) if n else 0
    for k in range(1, size):
        i = np.flatnonzero(end > np.arange(n) + k)
        for s in range(0, len(i), 4096):
            j = i[s : s + 4096]
            ok = (emb[j] == emb[j + k]).sum(axis=1) >= least
            a.append(j[ok])
            b.append(j[ok] + k)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _forest_of(emb: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Labels of the rows' components by the agreeing pairs of left with right (or of left, if they are the same)."""
    label, same = np.arange(len(emb)), left is right
    a, b = [], []
    for at, i in enumerate(left):  # one row against the others
        rest = right[at + 1 :] if same else right
        j = rest[(emb[rest] == emb[i]).sum(axis=1) >= least]
        a.append(np.full(len(j), i))
        b.append(j)
        if len(a) == 256 or at == len(left) - 1:  # fold what is known into a forest
            known = np.flatnonzero(label != np.arange(len(emb)))
            label = local_components(np.concatenate([known, *a]), np.concatenate([label[known], *b]), len(emb))
            a, b = [], []
    return label


def _brute(p: JoinParams):
    """A spanning forest of the candidates of the buckets at hand: an edge for each set at most, however many buckets it is in."""

    def run(batches):
        settle()
        for t in groups(batches):
            path, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            a, b = _agreeing(_embs(t.column(2), p.coordinates), path, p.agreement())
            nodes, at = np.unique(node, return_inverse=True)
            label = local_components(at[a], at[b], len(nodes))
            i = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[label[i]])], ["a", "b"])

    return run


def _brute_slabs(p: JoinParams):
    """The same of pairs of blocks (path, bi, bj) of the large buckets."""

    def run(batches):
        for t in groups(batches, 3):
            path, bi, bj, nb, node = (t.column(i).to_numpy() for i in range(5))
            emb = _embs(t.column(5), p.coordinates)
            cuts = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(path)), strict=True):
                left = np.flatnonzero(nb[lo:hi] == bi[lo])
                right = left if bi[lo] == bj[lo] else np.flatnonzero(nb[lo:hi] == bj[lo])
                label = _forest_of(emb[lo:hi], left, right, p.agreement())
                i = np.flatnonzero(label != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][i]), pa.array(node[lo:hi][label[i]])], ["a", "b"])

    return run


def block_pairs(df: DataFrame, block: str, last: str) -> DataFrame:
    """df with bi and bj: each row for each pair of blocks that its own is in, of blocks 0 to last."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(last))).alias("other")
    return df.select("*", other).withColumn("bi", F.least(block, "other")).withColumn("bj", F.greatest(block, "other")).drop("other")


def candidates(nodes: DataFrame, p: JoinParams, deal: int) -> DataFrame:
    """Edges (a, b) whose components hold all candidate pairs; nodes: a stored table (node, emb) without repeats."""
    front = stored(nodes.select("node", "emb").mapInArrow(_roots(p), "path long, node long"), "paths")
    found = []

    def brute(leaves: DataFrame) -> None:
        full = leaves.join(nodes, "node").select("path", "node", "emb")
        found.append(full.repartition(deal, "path").sortWithinPartitions("path", "node").mapInArrow(_brute(p), "a long, b long"))

    for depth in range(1, p.depth + 1):
        sizes = front.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = stored(join_unique(front, stored(sizes, "sizes"), "path", "size"), "buckets")
        brute(met.filter(F.col("size") <= p.bucket))
        large = met.filter(F.col("size") > p.bucket)
        if not large.limit(1).count():
            break
        if depth < p.depth:
            front = stored(large.join(nodes, "node").select("path", "node", "emb").mapInArrow(_split(p), "path long, node long"), "paths")
            continue
        last = F.floor((F.col("size") - 1) / p.slab).cast("long")
        slabs = block_pairs(large.select("path", "node", F.pmod(F.xxhash64("node"), last + 1).alias("nb"), last.alias("last")), "nb", "last")
        full = slabs.join(nodes, "node").select("path", "bi", "bj", "nb", "node", "emb")
        found.append(full.repartition(deal, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "node").mapInArrow(_brute_slabs(p), "a long, b long"))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionAll(more)
    return edges.distinct()


def overlap(left: list[np.ndarray], right: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of the intersections of two lists of ascending distinct token arrays, as a matrix."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    tokens, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, len(tokens), step):
        i, j = np.searchsorted(at, [first, first + step])
        m = np.zeros((len(left) + len(right), step), np.float32)
        m[row[i:j], at[i:j] - first] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _verify(p: JoinParams):
    up, down = p.similarity

    def run(batches):
        settle()
        for t in groups(batches, 3):
            comp, bi, bj, nb, node, copies = (t.column(i).to_numpy() for i in range(6))
            raw = t.column(6).to_pylist()
            key = np.rec.fromarrays([comp, bi, bj])
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out = []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(comp)), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in raw[lo:hi]]
                size = np.array([len(s) for s in sets])
                block = nb[lo:hi]
                left, right = np.flatnonzero(block == bi[lo]), np.flatnonzero(block == bj[lo])
                both = overlap([sets[i] for i in left], [sets[i] for i in right])
                linked = down * both >= up * (size[left][:, None] + size[right][None, :] - both)
                if bi[lo] == bj[lo]:
                    np.fill_diagonal(linked, False)
                a, b = np.nonzero(linked)
                label = local_components(left[a], right[b], hi - lo)
                links = np.zeros(hi - lo, np.int64)
                links[left] += (linked * copies[lo:hi][right][None, :]).sum(axis=1)
                if bi[lo] != bj[lo]:
                    links[right] += (linked * copies[lo:hi][left][:, None]).sum(axis=0)
                out.append((comp[lo:hi], node[lo:hi], links, node[lo:hi][label]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["comp", "node", "links", "root"])

    return run


def exact_sets(docs: DataFrame, wanted: DataFrame, p: JoinParams) -> DataFrame:
    """(node, raw): the sets of the wanted (w_row, node), a stored table, as bytes, from the texts of the rows w_row."""
    rows = Bloom(wanted.select("w_row"), wanted.count())

    def run(batches):
        settle()
        for batch in batches:
            own = batch.filter(pa.array(rows.has(batch.column(0).to_numpy())))
            nodes, raw = [], []
            for lo, hi, data, off in blocks(text_of(own)):
                g, at = shingle_sets(data, off, p.k)
                for i in range(hi - lo):
                    raw.append(g[at[i] : at[i + 1]].tobytes())
                    nodes.append(set_key(g[at[i] : at[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["node", "raw"])

    return docs.select(row_hash(docs).alias("row"), "text").mapInArrow(run, "node long, raw binary")


def _judged(docs: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, node) of every row, and (node, root, class_id, n_links, copies) of every set; stored tables."""
    deal = tasks(docs)
    rows = stored(embedded(docs, p), "embedded")
    nodes = stored(rows.select("node", "emb").dropDuplicates(["node"]), "nodes")
    copies = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("w_row"), F.count(F.lit(1)).alias("copies")), "copies")
    comp = components(candidates(nodes, p, deal))
    sizes = stored(comp.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "sizes")
    sized = join_unique(comp, sizes, "root", "members").withColumn("last", F.floor((F.col("members") - 1) / p.block).cast("long"))
    wanted = sized.join(copies, "node").select("w_row", "node", F.col("root").alias("comp"), F.pmod(F.xxhash64("node"), F.col("last") + 1).alias("nb"), "last", "copies")
    wanted = stored(wanted, "wanted")
    sets = exact_sets(docs, wanted, p).join(wanted.drop("w_row"), "node").dropDuplicates(["node"])
    dealt = block_pairs(sets, "nb", "last").select("comp", "bi", "bj", "nb", "node", "copies", "raw").repartition(deal, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "node")
    checked = stored(dealt.mapInArrow(_verify(p), "comp long, node long, links long, root long"), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = copies.join(links, "node", "left").join(root, "node", "left").select("node", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    per = stored(per, "per_node")
    named = stored(per.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("sets")), "named")
    per = join_unique(per, named, "root", "sets").select("node", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies")
    return rows, stored(per, "judged")


def classes(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the smallest doc_id of its class, and the other documents linked to it."""
    rows, per = _judged(docs, p)
    return join_unique(rows.select("doc_id", "node"), per, "node", "copies").select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """The rows of docs that are the first of their class by (doc_id, set hash, row hash), with all their columns; rows without doc_id come last.
    Rows are judged by id and text, so rows of one id and different texts have each their own verdict. Rows that repeat both the id and the
    text of the first stay with it, but of a class that has no id, one row stays."""
    names = docs.columns
    m_row = "_m_row"
    while m_row in {c.lower() for c in names}:
        m_row = f"_{m_row}"
    rows, per = _judged(docs, p)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "row")
    pairs = stored(join_unique(rows.select("doc_id", "node", "row"), per.select("node", "root", "copies"), "node", "copies").select("doc_id", "node", "row", "root").distinct(), "rows")
    first = pairs.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    gone = join_unique(pairs, stored(first, "firsts"), "root", "n_rows").filter(order != F.col("first")).select(F.col("row").alias(m_row))
    kept = without(docs, stored(gone.distinct(), "gone"))
    # what is left without an id and has one hash is one row's repeats
    lone = kept.filter("doc_id is null").withColumn(m_row, row_hash(kept)).dropDuplicates([m_row])
    return kept.filter("doc_id is not null").unionByName(lone.select(*names))
