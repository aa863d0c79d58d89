"""The queries that SQL can't say, against plain Python over the same table."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex

from textmill.operators import bpe, dedup, model, objectives
from textmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def shingles(texts):
    out = {}
    for d, t in texts.items():
        w = regex.findall(r"[\p{L}\p{N}_]+", t.lower())
        out[d] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}
    return out


MASK = (1 << 64) - 1


def mixed(z):
    z = (z + 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return z ^ (z >> 31)


@pytest.fixture(scope="module")
def signatures(shingles):
    """By the definition, one slot after another; NumPy only holds the numbers."""
    offsets = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 64, size=128, dtype=np.uint64)]
    out = {}
    for d, s in shingles.items():
        base = np.array([zlib.crc32(x.encode()) for x in s], np.uint64)
        slots = []
        for o in offsets:
            z = base + np.uint64((o + 0x9E3779B97F4A7C15) & MASK)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            slots.append(int((z ^ (z >> np.uint64(31))).min()) if len(base) else MASK)
        out[d] = slots
    some = min(d for d, s in shingles.items() if s)
    assert out[some][7] == min(mixed((zlib.crc32(x.encode()) + offsets[7]) & MASK) for x in shingles[some])
    return out


@pytest.fixture(scope="module")
def edges(signatures):
    buckets = defaultdict(list)
    for d, s in signatures.items():
        for b in range(16):
            buckets[b, tuple(s[8 * b : 8 * b + 8])].append(d)
    return buckets, {(min(m), d) for m in buckets.values() for d in m if d != min(m)}


def estimate(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / 128


@pytest.fixture(scope="module")
def components(signatures, edges):
    root = {d: d for d in signatures}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in edges[1]:
        if estimate(signatures[a], signatures[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in signatures}


def test_shingle_base_hash(spark, shingles):
    got = {r.doc_id: (r.low, r.high) for r in catalogue.QUERIES["shingle_base_hash"](spark, SF).collect()}
    want = {d: [zlib.crc32(x.encode()) for x in s] for d, s in shingles.items()}
    assert got == {d: (min(h, default=None), max(h, default=None)) for d, h in want.items()}


def test_minhash_signatures(spark, signatures):
    rows = dedup.signatures(catalogue.indexed(spark, SF)).collect()
    assert {r.doc_idx: [x & MASK for x in r.signature] for r in rows} == signatures
    got = {r.doc_idx: r.first_slot & MASK for r in catalogue.QUERIES["minhash_signatures"](spark, SF).collect()}
    assert got == {d: s[0] for d, s in signatures.items()}


def test_lsh_buckets_and_edges(spark, signatures, edges):
    buckets, candidates = edges
    got = Counter(tuple(r) for r in catalogue.QUERIES["lsh_buckets"](spark, SF).select("band", "anchor", "members").collect())
    assert got == Counter((b, min(m), len(m)) for (b, _), m in buckets.items() if len(m) > 1)
    assert {(r.src, r.dst) for r in catalogue.QUERIES["lsh_candidate_edges"](spark, SF).collect()} == candidates
    sure = {(a, b): estimate(signatures[a], signatures[b]) for a, b in candidates}
    got = {(r.src, r.dst): r.estimate for r in catalogue.QUERIES["lsh_confirmed_edges"](spark, SF).collect()}
    assert got == {k: v for k, v in sure.items() if v >= 0.8}


def test_anchor_jaccard(spark, shingles, edges):
    got = {(r.anchor, r.doc_id): r.jaccard for r in catalogue.QUERIES["anchor_jaccard"](spark, SF).collect()}
    assert got == {(a, b): round(len(shingles[a] & shingles[b]) / max(len(shingles[a] | shingles[b]), 1), 6) for a, b in edges[1]}


def test_clusters_and_winners(spark, texts, components):
    assert {r.doc_idx: r.component for r in catalogue.QUERIES["dedup_clusters"](spark, SF).collect()} == components
    best = {}
    for d, c in components.items():
        best[c] = min(best.get(c, (1, 0)), (-len(texts[d]), d))
    kept = {d for _, d in best.values()}
    assert {r.doc_idx for r in catalogue.QUERIES["dedup_keep"](spark, SF).collect()} == kept
    r = catalogue.QUERIES["dedup_stats"](spark, SF).first()
    chars = sum(map(len, texts.values()))
    assert (r.docs, r.kept_docs, r.chars, r.kept_chars) == (len(texts), len(kept), chars, sum(len(texts[d]) for d in kept))
    assert r.removed_docs_pct == round(100 * (1 - len(kept) / len(texts)), 4)
    good = {r.doc_id for r in catalogue.QUERIES["quality_filter"](spark, SF).collect()}
    left = {r.doc_idx for r in catalogue.QUERIES["dedup_filtered_keep"](spark, SF).collect()}
    assert left <= good and kept & good <= left  # a winner of all is one of those that pass, if it passes


def test_json_budget_cut(spark, texts):
    import json

    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    want, at = {}, 0
    for d, *own in rows:
        if at >= 1_000_000:
            break
        line = json.dumps({k: v for k, v in zip(("text", "lang", "source"), own, strict=True) if v is not None}, ensure_ascii=False, separators=(",", ":"))
        want[d] = len(line.encode()) + 1
        at += want[d]
    assert {r.doc_id: r.line_bytes for r in catalogue.QUERIES["json_budget_cut"](spark, SF).collect()} == want


def test_generator_split(spark, texts):
    g = np.random.default_rng(0)
    want = {d: "val" if g.random() < 0.005 else "train" for d in sorted(texts)}
    assert {r.doc_id: r.split for r in catalogue.QUERIES["generator_split"](spark, SF).collect()} == want


@pytest.fixture(scope="module")
def merges(texts):
    hist = Counter(c for t in texts.values() for c in regex.findall(bpe.PATTERN, t))
    return bpe.train_naive(hist, 512)


def test_bpe_queries(spark, texts, merges):
    rows = catalogue.QUERIES["bpe_merges"](spark, SF).orderBy("new_id").collect()
    assert [(r.a, r.b) for r in rows] == merges and [r.new_id for r in rows] == list(range(256, 256 + len(merges)))
    rank, known = {p: 256 + i for i, p in enumerate(merges)}, {}

    def length(c):
        if c not in known:
            ids = tuple(c.encode())
            for p in merges:
                if len(ids) > 1 and p in set(zip(ids, ids[1:], strict=False)):
                    ids = bpe.merged(ids, p, rank[p])
            known[c] = len(ids)
        return known[c]

    want = {d: sum(length(c) for c in regex.findall(bpe.PATTERN, t)) for d, t in texts.items()}
    assert {r.doc_id: r.n_ids for r in catalogue.QUERIES["bpe_encode_lengths"](spark, SF).collect()} == want
    r = catalogue.QUERIES["compression_ratio"](spark, SF).first()
    chars = sum(map(len, texts.values()))
    assert (r.chars, r.tokens, r.chars_per_token) == (chars, sum(want.values()), round(chars / sum(want.values()), 3))


def test_categorical_sample_follows_the_softmax(spark):
    """Draws by key from one distribution come as often as it says."""
    from pyspark.sql import functions as F

    logits = [0.0, 1.0, 2.0, -1.0]
    p = np.exp(logits) / np.exp(logits).sum()
    rows = spark.range(20_000).select(objectives.categorical(F.array(*map(F.lit, logits)), F.col("id")).alias("i")).groupBy("i").count().collect()
    assert all(abs(r["count"] / 20_000 - p[r.i]) < 0.015 for r in rows) and len(rows) == 4


def plain_logits(w, c, ids):
    """The decoder by the definition: a loop over places, heads and earlier places."""
    unit = lambda v, gain: v / np.sqrt((v * v).mean() + c.norm_eps) * gain
    half = c.head_dim // 2

    def turned(v, place):
        out = np.empty_like(v)
        for j in range(half):
            angle = place * c.rope_theta ** (-j / half)
            out[j] = v[j] * np.cos(angle) - v[j + half] * np.sin(angle)
            out[j + half] = v[j] * np.sin(angle) + v[j + half] * np.cos(angle)
        return out

    xs = [w["tok_emb"][i].astype(float) for i in ids]
    for layer in range(c.n_layers):
        own = lambda k, layer=layer: w[f"blocks.{layer}.{k}"].astype(float)
        hs = [unit(x, own("norm1")) for x in xs]
        ks = [[turned(k, t) for k in (h @ own("k")).reshape(c.n_kv_heads, -1)] for t, h in enumerate(hs)]
        vs = [(h @ own("v")).reshape(c.n_kv_heads, -1) for h in hs]
        new = []
        for t, h in enumerate(hs):
            parts = []
            for head, q in enumerate((h @ own("q")).reshape(c.n_heads, -1)):
                g = head // (c.n_heads // c.n_kv_heads)
                s = np.array([turned(q, t) @ ks[u][g] / np.sqrt(c.head_dim) for u in range(t + 1)])
                p = np.exp(s - s.max())
                parts.append(sum(a * vs[u][g] for u, a in enumerate(p / p.sum())))
            x = xs[t] + np.concatenate(parts) @ own("o")
            y = unit(x, own("norm2"))
            gate = y @ own("gate")
            new.append(x + (gate / (1 + np.exp(-gate)) * (y @ own("up"))) @ own("down"))
        xs = new
    head = w["tok_emb"].T if c.tie_embeddings else w["lm_head"]
    return np.array([unit(x, w["final_norm"]) @ head for x in xs])


def test_model_queries(spark):
    """The seeded decoder's scores and texts by the loops above."""
    c, r = catalogue._TINY, random.Random(0)
    w = model.initial_weights(c)
    for k in ("q", "k", "v"):  # large enough for attention to matter
        w["blocks.0." + k] = w["blocks.0." + k] * 20
    ids = [r.randrange(c.vocab_size) for _ in range(12)]
    assert np.allclose(model.forward(w, c, ids), plain_logits(w, c, ids), atol=1e-3)
    w = model.initial_weights(c)
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 2").fetchall())
    scored = {r.row_id: r for r in catalogue.QUERIES["model_loglikelihood"](spark, SF).collect()}
    said = {r.row_id: r.ids for r in catalogue.QUERIES["model_generate"](spark, SF).collect()}
    for k, t in items.items():
        own = [259, *t.encode()]
        x = plain_logits(w, c, own[:-1])
        p = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        assert abs(sum(p[i, own[i + 1]] for i in range(len(own) - 1)) - scored[k].logp) < 0.05
        assert scored[k].greedy == all(p[i].argmax() == own[i + 1] for i in range(len(own) - 1))
        ids = list(t.encode())[-128:]
        for i in said[k][:3]:
            assert int(plain_logits(w, c, ids)[-1].argmax()) == i
            ids.append(i)
