"""Scoring of continuations, rolling windows, stop strings, and accuracy over choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_context(context: Column, continuation: Column, length: int) -> Column:
    """The last ids of the context that leave room for the continuation within length + 1 ids."""
    room = F.greatest(F.lit(length + 1) - F.size(continuation), F.lit(0))
    n = F.least(F.size(context), room)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.slice(context, F.size(context) - n + 1, n))


def generation_context(context: Column, length: int, generate: int = 256) -> Column:
    """The last ids that leave room to generate; one at least."""
    budget = max(length - generate, 1)
    return F.when(F.size(context) > budget, F.slice(context, -budget, budget)).otherwise(context)


def scoring_request(context: Column, continuation: Column, length: int, eot: int) -> Column:
    """(ids, start): the model's input and where the continuation's scores begin; an empty context is the end id."""
    anchor = F.when(F.size(context) == 0, F.array(F.lit(eot))).otherwise(context)
    kept = cut_context(anchor, continuation, length)
    return F.struct(F.concat(kept, continuation).alias("ids"), F.greatest(F.size(kept) - 1, F.lit(0)).alias("start"))


def loglikelihood(tokens: DataFrame, key: str) -> DataFrame:
    """(key, logp, greedy) from a row for each continuation token (logp, is_argmax)."""
    return tokens.groupBy(key).agg(F.sum("logp").alias("logp"), F.bool_and("is_argmax").alias("greedy"))


def with_empty(requests: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Every request with its score; those without a token score 0 and count as greedy."""
    return requests.select(key).join(scored, key, "left").select(key, F.coalesce("logp", F.lit(0.0)).alias("logp"), F.coalesce("greedy", F.lit(True)).alias("greedy"))


def rolling_chunks(rows: DataFrame, key: str, ids: str, length: int, eot: int) -> DataFrame:
    """(key, chunk, context, continuation): whole texts in chunks of length, each after the last id of the one before."""
    n = F.ceil(F.size(ids) / length).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("chunk")
    own = rows.select(key, F.col(ids).alias("_ids"), at)
    before = F.when(F.col("chunk") == 0, F.lit(eot)).otherwise(F.get("_ids", F.col("chunk") * length - 1))
    return own.select(key, "chunk", F.array(before).alias("context"), F.slice("_ids", F.col("chunk") * length + 1, length).alias("continuation"))


def stop_at(text: Column, stops: list[str]) -> Column:
    """The text up to a stop string; the first listed that occurs counts, empty ones don't."""
    out = text
    chain = None
    for s in [s for s in stops if s]:
        hit = F.when(F.contains(text, F.lit(s)), F.substring_index(text, s, 1))
        chain = hit if chain is None else F.coalesce(chain, hit)
    return out if chain is None else F.coalesce(chain, out)


def choice_accuracy(scores: DataFrame, question: str, choice: str, score: str, gold: str) -> DataFrame:
    """The share of questions whose best choice (ties to the lowest) is the gold one."""
    best = scores.groupBy(question).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c"))).alias("_m"), F.first(gold).alias("_gold"))
    return best.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.avg((-F.col("_m.c") == F.col("_gold")).cast("double")), F.lit(0.0)).alias("accuracy"))


def kept_results(results: DataFrame, keys: tuple[str, ...] = ("results", "configs", "n-shot")) -> DataFrame:
    """The parts of an evaluation's result that are stored, those present."""
    return results.select(*[F.col(f"`{k}`") for k in keys if k in results.columns])
