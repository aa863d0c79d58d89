"""A decoder's forward pass and generation in NumPy, for scoring rows in Arrow maps with small models.

Training (gradients, optimisers) is no Spark operator; its inputs and metrics are in pack, chat and objectives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Tokenizer
from .chat import ChatFormat, byte_ids, rollout_row
from .evaluate import generation_context, loglikelihood, rolling_chunks, with_empty
from .objectives import ModelConfig
from .reward import prompt as prompt_text
from .reward import reward, rollouts

Weights = dict[str, np.ndarray]


def initial_weights(c: ModelConfig, seed: int = 0) -> Weights:
    """Normal weights of deviation 0.02, unit gains."""
    g = np.random.default_rng(seed)
    draw = lambda *shape: g.normal(0, 0.02, shape).astype(np.float32)
    kv = c.n_kv_heads * c.head_dim
    w = {"tok_emb": draw(c.vocab_size, c.dim), "final_norm": np.ones(c.dim, np.float32)}
    for i in range(c.n_layers):
        w |= {f"blocks.{i}.{k}": v for k, v in {
            "norm1": np.ones(c.dim, np.float32), "norm2": np.ones(c.dim, np.float32), "q": draw(c.dim, c.dim), "k": draw(c.dim, kv), "v": draw(c.dim, kv), "o": draw(c.dim, c.dim),
            "gate": draw(c.dim, c.hidden_dim), "up": draw(c.dim, c.hidden_dim), "down": draw(c.hidden_dim, c.dim),
        }.items()}
    if not c.tie_embeddings:
        w["lm_head"] = draw(c.dim, c.vocab_size)
    return w


def rms_norm(x: np.ndarray, gain: np.ndarray, eps: float) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * gain


def rotate(x: np.ndarray, first: int, theta: float) -> np.ndarray:
    """Rotary positions on (heads, places, width), halves paired."""
    half = x.shape[-1] // 2
    angle = np.outer(np.arange(first, first + x.shape[1]), theta ** (-np.arange(half) / half))
    cos, sin = np.cos(angle).astype(np.float32), np.sin(angle).astype(np.float32)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * cos - b * sin, a * sin + b * cos], axis=-1)


class Cache:
    """Keys and values of the places seen so far, for each layer."""

    def __init__(self, layers: int):
        self.kv: list[tuple[np.ndarray, np.ndarray] | None] = [None] * layers

    @property
    def offset(self) -> int:
        return 0 if self.kv[0] is None else self.kv[0][0].shape[1]

    def extend(self, layer: int, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kv[layer] is not None:
            k, v = (np.concatenate([old, new], axis=1) for old, new in zip(self.kv[layer], (k, v), strict=True))
        self.kv[layer] = (k, v)
        return k, v


def forward(w: Weights, c: ModelConfig, ids: list[int], cache: Cache | None = None) -> np.ndarray:
    """Logits of each place; with a cache, ids continue what it holds."""
    cache = cache or Cache(c.n_layers)
    first, n = cache.offset, len(ids)
    x = w["tok_emb"][np.asarray(ids)]
    heads = lambda y, k: y.reshape(n, k, c.head_dim).transpose(1, 0, 2)
    for i in range(c.n_layers):
        own = lambda k, i=i: w[f"blocks.{i}.{k}"]
        h = rms_norm(x, own("norm1"), c.norm_eps)
        q = rotate(heads(h @ own("q"), c.n_heads), first, c.rope_theta)
        k, v = cache.extend(i, rotate(heads(h @ own("k"), c.n_kv_heads), first, c.rope_theta), heads(h @ own("v"), c.n_kv_heads))
        share = c.n_heads // c.n_kv_heads
        score = q @ np.repeat(k, share, axis=0).transpose(0, 2, 1) / np.sqrt(c.head_dim)
        late = np.arange(k.shape[1])[None, :] > (first + np.arange(n))[:, None]
        score = np.where(late, -np.inf, score)
        p = np.exp(score - score.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)
        x = x + (p @ np.repeat(v, share, axis=0)).transpose(1, 0, 2).reshape(n, c.dim) @ own("o")
        h = rms_norm(x, own("norm2"), c.norm_eps)
        gate = h @ own("gate")
        x = x + (gate / (1 + np.exp(-gate)) * (h @ own("up"))) @ own("down")
    x = rms_norm(x, w["final_norm"], c.norm_eps)
    return x @ (w["tok_emb"].T if c.tie_embeddings else w["lm_head"])


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def pick(logits: np.ndarray, seen: set[int], temperature: float, top_k: int | None, penalty: float, g: np.random.Generator) -> int:
    """The next id: penalty on seen ids, then the largest, or a draw among the top_k."""
    x = logits.astype(np.float64).copy()
    if penalty != 1.0 and seen:
        at = np.fromiter(seen, np.int64)
        x[at] = np.where(x[at] > 0, x[at] / penalty, x[at] * penalty)
    if temperature == 0:
        return int(x.argmax())
    x /= temperature
    if top_k is not None:
        x[x < np.sort(x)[-top_k]] = -np.inf
    p = np.exp(log_softmax(x))
    return int(g.choice(len(p), p=p / p.sum()))


def generate(w: Weights, c: ModelConfig, prompt: list[int], n: int, eot: int | None = None, temperature: float = 0.0, top_k: int | None = None, penalty: float = 1.0, seed: int = 0) -> list[int]:
    """Up to n new ids; the end id ends and is not returned. The prompt's ids and those generated are penalised, the end id never."""
    g, cache, out = np.random.default_rng(seed), Cache(c.n_layers), []
    logits = forward(w, c, prompt, cache)[-1]
    while len(out) < n:
        i = pick(logits, {*prompt, *out} - {eot}, temperature, top_k, penalty, g)
        if i == eot:
            break
        out.append(i)
        logits = forward(w, c, [i], cache)[-1]
    return out


def score_rows(rows: DataFrame, w: Weights, c: ModelConfig, key: str = "row_id") -> DataFrame:
    """(key, pos, logp, is_argmax) of the ids after start of rows (key, ids, start): a small model is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast((w, c))

    def run(batches):
        w, c = shared.value
        for batch in batches:
            out = []
            for k, ids, start in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if len(ids) < 2:
                    continue
                p = log_softmax(forward(w, c, ids[:-1]))
                out += [(k, i, float(p[i, ids[i + 1]]), bool(p[i].argmax() == ids[i + 1])) for i in range(start, len(ids) - 1)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.bool_()), strict=True)], [key, "pos", "logp", "is_argmax"])

    return rows.select(key, "ids", "start").mapInArrow(run, f"{key} long, pos int, logp double, is_argmax boolean")


def generate_rows(rows: DataFrame, w: Weights, c: ModelConfig, n: int, eot: int | None, key: str = "row_id", **how) -> DataFrame:
    """(key, ids): what the model adds to each prompt of rows (key, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast((w, c))

    def run(batches):
        w, c = shared.value
        for batch in batches:
            ids = [generate(w, c, p, n, eot, **how) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return rows.select(key, "ids").mapInArrow(run, f"{key} long, ids array<int>")


def generate_until(rows: DataFrame, w: Weights, c: ModelConfig, tok: Tokenizer, until: list[str], n: int = 256, eot: int | None = None, key: str = "row_id") -> DataFrame:
    """(key, n_ids, text): greedy text after each prompt of rows (key, ids), up to n ids, an end id, or the first id with which the text has a stop
    string; the first listed that it has is cut off with what follows. Prompts are cut from the left to leave room."""
    shared = rows.sparkSession.sparkContext.broadcast((w, c, tok))
    stops = [s for s in until if s]

    def one(w: Weights, c: ModelConfig, tok: Tokenizer, prompt: list[int]) -> tuple[int, str]:
        cache, ids, text = Cache(c.n_layers), [], ""
        logits = forward(w, c, prompt, cache)[-1]
        while len(ids) < n and (i := int(logits.argmax())) != eot:
            ids.append(i)
            text = tok.decode(ids)
            hit = next((s for s in stops if s in text), None)
            if hit is not None:
                return len(ids), text.split(hit)[0]
            logits = forward(w, c, [i], cache)[-1]
        return len(ids), text

    def run(batches):
        for batch in batches:
            out = [one(*shared.value, p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], [key, "n_ids", "text"])

    cut = rows.select(key, generation_context(F.col("ids"), c.max_seq_len, n).alias("ids"))
    return cut.mapInArrow(run, f"{key} long, n_ids long, text string")


def rolling_loglikelihood(rows: DataFrame, w: Weights, c: ModelConfig, eot: int, key: str = "row_id") -> DataFrame:
    """(key, logp): whole texts (key, ids) scored in chunks of the model's length, each after the last id of the one before; 0 of none."""
    chunks = rolling_chunks(rows, key, "ids", c.max_seq_len, eot)
    request = chunks.select(key, F.concat("context", "continuation").alias("ids"), F.lit(0).alias("start"))
    return with_empty(rows, loglikelihood(score_rows(request, w, c, key), key), key).select(key, "logp")


def rollout(prompts: DataFrame, w: Weights, c: ModelConfig, tok: Tokenizer, f: ChatFormat, per_prompt: int, n: int, length: int, encode=byte_ids, key: str = "row_id", **how) -> DataFrame:
    """(key, sample_idx, ids, mask, text, reward) of per_prompt completions of each (key, question, gold), packed to length; **how is generate()'s
    (temperature 0 and per_prompt 1 for a greedy evaluation). Each sample draws by its own seed."""
    start = F.concat(F.array(F.lit(f.user)), encode(prompt_text(F.col("question"))), F.array(F.lit(f.end), F.lit(f.assistant)))
    rows = rollouts(prompts.select(key, "gold", start.alias("prompt_ids")), per_prompt)
    shared = prompts.sparkSession.sparkContext.broadcast((w, c, tok))

    def run(batches):
        w, c, tok = shared.value
        for batch in batches:
            own = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            ids = [generate(w, c, p, n, f.end, **({"seed": k * per_prompt + s} | how)) for k, s, p in zip(own[key].to_pylist(), own["sample_idx"].to_pylist(), own["prompt_ids"].to_pylist(), strict=True)]
            added = [pa.array(ids, pa.list_(pa.int32())), pa.array([tok.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "new_ids", "text"])

    said = rows.select(F.col(key).cast("long").alias(key), "gold", "prompt_ids", "sample_idx").mapInArrow(run, f"{key} long, gold string, prompt_ids array<int>, sample_idx int, new_ids array<int>, text string")
    packed = said.withColumn("_r", rollout_row(F.col("prompt_ids"), F.col("new_ids"), f.end, length))
    return packed.select(key, "sample_idx", "_r.ids", "_r.mask", "text", reward(F.col("text"), F.col("gold")).alias("reward"))


def successor_weights(c: ModelConfig) -> Weights:
    """A decoder that says i + 1 after i (0 after the last), 16 nats above all else: what it scores and says is known beforehand. dim is vocab_size, a power of 4."""
    w = {k: np.zeros_like(v) if k.startswith("blocks") and v.ndim > 1 else v for k, v in initial_weights(c).items()}
    w["tok_emb"], w["lm_head"] = np.eye(c.vocab_size, dtype=np.float32), np.roll(np.eye(c.vocab_size, dtype=np.float32), 1, axis=1) * np.float32(16 / np.sqrt(c.dim))
    return w
