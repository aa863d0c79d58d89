"""Training objectives, schedules and sampling rules as expressions over stored log-probabilities and logits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def softplus(x: Column) -> Column:
    """log(1 + e**x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cross_entropy(rows: DataFrame, logp: str = "logp") -> DataFrame:
    """Mean negative log-probability of all tokens, and its exponential."""
    n = F.greatest(F.sum(F.size(logp)), F.lit(1))
    return rows.agg((-F.sum(total(F.col(logp))) / n).alias("loss")).withColumn("perplexity", F.exp("loss"))


def masked_cross_entropy(rows: DataFrame, logp: str = "logp", mask: str = "mask") -> DataFrame:
    """Negative log-probability for each masked token; 0 where the mask is empty."""
    hit = F.zip_with(logp, mask, lambda p, m: p * m)
    return rows.agg((-F.sum(total(hit)) / F.greatest(F.sum(total(F.col(mask))), F.lit(1.0))).alias("loss"))


def sequence_logp(logp: Column, mask: Column) -> Column:
    """Sum of the log-probabilities of masked targets; mask has one place more, for the first token."""
    return total(F.zip_with(logp, F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0))), lambda p, m: p * m))


def dpo_rows(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """rows (policy_chosen, policy_rejected, ref_chosen, ref_rejected) with rewards, margin, loss and accuracy."""
    out = rows.withColumn("chosen_reward", beta * (F.col("policy_chosen") - F.col("ref_chosen"))).withColumn("rejected_reward", beta * (F.col("policy_rejected") - F.col("ref_rejected")))
    out = out.withColumn("margin", F.col("chosen_reward") - F.col("rejected_reward"))
    return out.withColumns({"loss": softplus(-F.col("margin")), "accuracy": (F.col("margin") > 0).cast("double")})


def means(rows: DataFrame, *metrics: str) -> DataFrame:
    """The mean of each metric, not-a-number of no rows."""
    return rows.agg(*(F.coalesce(F.avg(m), F.lit(float("nan"))).alias(m) for m in metrics))


def grpo_loss(rows: DataFrame, beta_kl: float = 0.04) -> DataFrame:
    """(loss, kl, mean_advantage) of rows (policy_logp, ref_logp, mask, advantage): masked token means of
    -advantage * logp + beta * kl, where kl is exp(d) - d - 1 of d = ref - policy."""
    kl = F.transform(F.zip_with("ref_logp", "policy_logp", lambda r, p: r - p), lambda d: F.exp(d) - d - 1)
    masked = lambda xs: total(F.zip_with(xs, F.col("mask"), lambda x, m: x * m))
    sums = rows.select("advantage", masked(F.col("policy_logp")).alias("lp"), masked(kl).alias("kl"), total(F.col("mask")).alias("m"))
    n = F.greatest(F.sum("m"), F.lit(1.0))
    return sums.agg(((F.sum(-F.col("advantage") * F.col("lp")) + beta_kl * F.sum("kl")) / n).alias("loss"), (F.sum("kl") / n).alias("kl"), F.avg("advantage").alias("mean_advantage"))


DECAYS = {
    "linear": lambda t: 1 - t,
    "cosine": lambda t: 0.5 * (1 + F.cos(F.lit(math.pi) * t)),
    "sqrt": lambda t: 1 - F.sqrt(t),
}


def wsd_lr(step: Column, peak: float, steps: int, warmup: int = 2000, decay_frac: float = 0.2, final_frac: float = 0.0, shape: str = "cosine") -> Column:
    """Warm-up to peak, flat, then decay over the last share of steps to final_frac * peak."""
    if shape not in DECAYS:
        raise ValueError(f"unknown decay shape {shape!r}")
    tail = max(1, int(steps * decay_frac))
    begin, low = steps - tail, peak * final_frac
    t = F.greatest((step - begin) / tail, F.lit(0.0))
    falling = low + (peak - low) * DECAYS[shape](F.least(t, F.lit(1.0)))
    return F.when(step < warmup, peak * (step + 1) / max(warmup, 1)).when(step < begin, F.lit(peak)).when(step >= steps, F.lit(low)).otherwise(falling)


def wsd_schedule(step: Column, peak: float, steps: int, warmup: int = 2000, decay_frac: float = 0.2, final_frac: float = 0.0) -> Column:
    """The schedule as joined pieces: a line from peak / warmup to peak, flat, and a cosine; no decay if decay_frac is 0 or less."""
    first = peak / max(warmup, 1)
    rise = first + (peak - first) * F.least(step / max(warmup, 1), F.lit(1.0))
    if decay_frac <= 0:
        return F.when(step < warmup, rise).otherwise(F.lit(peak))
    tail = max(1, int(steps * decay_frac))
    begin, low = warmup + max(1, steps - warmup - tail), peak * final_frac
    t = F.least((step - begin) / tail, F.lit(1.0))
    return F.when(step < warmup, rise).when(step < begin, F.lit(peak)).otherwise(low + (peak - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * t)))


@dataclass(frozen=True)
class ModelConfig:
    """Shape of a decoder with grouped-query attention and gated feed-forward layers."""

    vocab_size: int = 32769
    dim: int = 576
    n_layers: int = 30
    n_heads: int = 9
    n_kv_heads: int = 3
    hidden_dim: int = 1536
    tie_embeddings: bool = True
    max_seq_len: int = 2048
    rope_theta: float = 10000.0
    norm_eps: float = 1e-5

    def __post_init__(self) -> None:
        if self.dim % self.n_heads or self.n_heads % self.n_kv_heads:
            raise ValueError("heads must divide the width, and key heads the heads")

    @property
    def head_dim(self) -> int:
        return self.dim // self.n_heads


# The presets.
PRESETS = {
    "135m": ModelConfig(),
    "360m": ModelConfig(dim=960, n_layers=32, n_heads=15, n_kv_heads=5, hidden_dim=2560),
    "tiny": ModelConfig(dim=128, n_layers=4, n_heads=4, n_kv_heads=2, hidden_dim=352, max_seq_len=256),
}


def presets(spark: SparkSession) -> DataFrame:
    rows = [(k, c.vocab_size, c.dim, c.n_layers, c.n_heads, c.n_kv_heads, c.hidden_dim, c.tie_embeddings) for k, c in PRESETS.items()]
    return spark.createDataFrame(rows, "name string, vocab_size long, dim long, n_layers long, n_heads long, n_kv_heads long, hidden_dim long, tied boolean")


def tensor_sizes(configs: DataFrame) -> DataFrame:
    """(name, part, size): parameters by component, over all layers."""
    c = F.col
    kv = (c("dim") / c("n_heads")).cast("long") * c("n_kv_heads")
    parts = {
        "embedding": c("vocab_size") * c("dim"),
        "attention": c("n_layers") * (2 * c("dim") * c("dim") + 2 * c("dim") * kv),
        "feed_forward": c("n_layers") * 3 * c("dim") * c("hidden_dim"),
        "block_norms": c("n_layers") * 2 * c("dim"),
        "final_norm": c("dim"),
        "lm_head": F.when(c("tied"), F.lit(0)).otherwise(c("vocab_size") * c("dim")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("part"), v.cast("long").alias("size")) for k, v in parts.items()))
    return configs.select("name", F.inline(rows))


def component_of(tensor: Column) -> Column:
    """The component that a tensor's dotted name belongs to: for tensors of blocks, their kind and part."""
    bits = F.split(tensor, "\\.")
    return F.when(tensor.startswith("tok_emb"), "embedding").when(tensor.startswith("final_norm"), "final_norm").when(tensor.startswith("lm_head"), "lm_head").when(tensor.startswith("blocks"), F.concat_ws(".", F.get(bits, F.lit(1)), F.get(bits, F.lit(3)))).otherwise(tensor)


def ema(rows: DataFrame, value: str, order: str, group: str, keep: float = 0.9) -> DataFrame:
    """(group, ema): the fold keep * last + (1 - keep) * x in order, begun by the first value. As a sum: the value k places before the last
    weighs (1 - keep) * keep**k, the first one keep**k; so a group is sorted, but never held."""
    last = Window.partitionBy(group).orderBy(F.desc(order))
    at = rows.select(group, F.col(value).cast("double").alias("_x"), (F.row_number().over(last) - 1).alias("_k"), F.lead(F.lit(1)).over(last).isNull().alias("_first"))
    weight = F.pow(F.lit(keep), F.col("_k")) * F.when(F.col("_first"), F.lit(1.0)).otherwise(F.lit(1 - keep))
    return at.groupBy(group).agg(F.sum(weight * F.col("_x")).alias("ema"))


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen ids lowered: divided if positive, else multiplied."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def greedy(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def top_k(logits: Column, k: int, temperature: float = 1.0) -> Column:
    """Scaled logits; those below the k-th largest are minus infinity, ties with it stay."""
    scaled = F.transform(logits, lambda x: x / temperature)
    kth = F.get(F.sort_array(scaled, asc=False), F.lit(k - 1))
    return F.transform(scaled, lambda x: F.when(x < kth, F.lit(float("-inf"))).otherwise(x))


def categorical(logits: Column, key: Column, seed: int = 0) -> Column:
    """A draw by the softmax of logits: the largest after Gumbel noise from hashes of (key, place, seed)."""
    unit = lambda i: (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return greedy(F.transform(logits, lambda x, i: x.cast("double") - F.log(-F.log(unit(i)))))


def quantize(values: Column, bits: int = 4, group: int = 64) -> Column:
    """Groups of (scale, bias, codes): codes round (x - bias) / scale to bits; a constant group has scale 0."""
    if bits not in (2, 3, 4, 6, 8):
        raise ValueError("bits must be 2, 3, 4, 6 or 8")
    n = F.ceil(F.size(values) / group).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.slice(values, g * group + 1, group))

    def one(p: Column) -> Column:
        low, high = F.array_min(p).cast("double"), F.array_max(p).cast("double")
        scale = (high - low) / ((1 << bits) - 1)
        code = F.transform(p, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.floor((x.cast("double") - low) / F.when(scale == 0, 1.0).otherwise(scale) + 0.5)).cast("int"))
        return F.struct(scale.alias("scale"), low.alias("bias"), code.alias("codes"))

    return F.transform(parts, one)


def dequantize(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: F.transform(g["codes"], lambda c: c * g["scale"] + g["bias"])))


def quantized_bytes(n: Column, bits: int = 4, group: int = 64, scale_bytes: int = 2) -> Column:
    """Bytes of n values quantised, with a scale and a bias for each group."""
    return F.ceil(n * bits / 8) + F.ceil(n / group) * 2 * scale_bytes


def throughput(log: DataFrame, tokens: str = "tokens", elapsed: str = "elapsed_s") -> DataFrame:
    return log.withColumn("tokens_per_s", F.col(tokens) / F.greatest(F.col(elapsed), F.lit(1e-9)))


def first_set(*values: Column) -> Column:
    """Of settings in order of precedence, the first that is given."""
    return F.coalesce(*values)
