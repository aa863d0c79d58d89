"""Conversations, preference pairs and rollouts as token ids with loss masks, in array expressions over tokenised turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Tokenizer, bytes_of
from .pack import prefix_sum


@dataclass(frozen=True)
class ChatFormat:
    """Ids of the tags that open a user's and an assistant's turn, and of the end of a turn."""

    user: int
    assistant: int
    end: int

    @classmethod
    def register(cls, tok: Tokenizer) -> ChatFormat:
        return cls(tok.register("<|user|>"), tok.register("<|assistant|>"), tok.register("<|end|>"))


#: The untrained byte vocabulary, with tags above it.
BYTES = ChatFormat(256, 257, 258)
BYTES_EOT = 259


def byte_ids(text: Column) -> Column:
    """Ids of a text under the untrained byte vocabulary."""
    return F.when(F.octet_length(text) > 0, bytes_of(text)).otherwise(F.array().cast("array<int>"))


def _ints(*xs: int) -> Column:
    return F.array(*(F.lit(x) for x in xs))


def turn_ids(role: Column, ids: Column, f: ChatFormat) -> Column:
    """(ids, mask) of a turn. User and system turns are not learnt; an assistant's content and end are. Other roles are an error."""
    own = F.struct(F.concat(_ints(f.user), ids, _ints(f.end)).alias("ids"), F.array_repeat(F.lit(0), F.size(ids) + 2).alias("mask"))
    told = F.struct(F.concat(_ints(f.assistant), ids, _ints(f.end)).alias("ids"), F.concat(_ints(0), F.array_repeat(F.lit(1), F.size(ids) + 1)).alias("mask"))
    bad = F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("struct<ids:array<int>,mask:array<int>>")
    return F.when(role.isin("user", "system"), own).when(role == "assistant", told).otherwise(bad)


def encode_conversations(turns: DataFrame, f: ChatFormat = BYTES, encode=byte_ids) -> DataFrame:
    """(conv_id, ids, mask) from (conv_id, turn, role, text). A conversation is one row afterwards, so its turns meet in one task."""
    rows = turns.select("conv_id", "turn", turn_ids(F.col("role"), encode(F.coalesce("text", F.lit(""))), f).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("ts"))
    return whole.select("conv_id", F.flatten(F.transform("ts", lambda x: x["t"]["ids"])).alias("ids"), F.flatten(F.transform("ts", lambda x: x["t"]["mask"])).alias("mask"))


def sft_verdict(ids: Column, limit: int = 1024) -> Column:
    return F.when(F.size(ids) == 0, "empty").when(F.size(ids) > limit, "too_long").otherwise("kept")


def sft_pack(conversations: DataFrame, eot: int = BYTES_EOT, limit: int = 1024) -> DataFrame:
    """The conversations within the limit, closed by an end id that is not learnt."""
    kept = conversations.filter(sft_verdict(F.col("ids"), limit) == "kept")
    return kept.withColumns({"ids": F.concat("ids", _ints(eot)), "mask": F.concat("mask", _ints(0))})


def pairs_as_turns(df: DataFrame, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """df with turns: a user's and an assistant's, null if either text is empty."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.withColumn("turns", F.when((F.col(prompt) != "") & (F.col(completion) != ""), F.array(turn("user", prompt), turn("assistant", completion))))


def last_content(turns: Column) -> Column:
    return F.try_element_at(turns, F.lit(-1))["content"]


def _padded(ids: Column, pad: int, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def preference_side(prompt: Column, completion: Column, end: int, length: int, pad: int) -> Column:
    """(ids, mask) of prompt, completion and end, padded on the right; null if longer than length."""
    ids = F.concat(prompt, completion, _ints(end))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(completion) + 1))
    return F.when(F.size(ids) <= length, F.struct(_padded(ids, pad, length).alias("ids"), _padded(mask, 0, length).alias("mask")))


def preference_pairs(rows: DataFrame, length: int, f: ChatFormat = BYTES, pad: int | None = None, encode=byte_ids) -> DataFrame:
    """rows (prompt, chosen, rejected) with the four arrays; all null where a side doesn't fit."""
    prompt = F.concat(_ints(f.user), encode(F.col("prompt")), _ints(f.end, f.assistant))
    sides = rows.withColumns({f"_{s}": preference_side(prompt, encode(F.col(s)), f.end, length, f.end if pad is None else pad) for s in ("chosen", "rejected")})
    both = F.col("_chosen").isNotNull() & F.col("_rejected").isNotNull()
    out = {f"{s}_{p}": F.when(both, F.col(f"_{s}.{p}")) for s in ("chosen", "rejected") for p in ("ids", "mask")}
    return sides.withColumns(out).drop("_chosen", "_rejected")


ARRAYS = ("chosen_ids", "chosen_mask", "rejected_ids", "rejected_mask")


def pack_preferences(rows: DataFrame, order: str, split: Column, length: int, most: int = 30_000, **how) -> DataFrame:
    """(order, split, row, arrays): the pairs that fit, numbered in order within their split. Of the training split the first most rows are looked at, of
    val a tenth of that (1000 if that is none); most = 0 means all training rows. Only as many rows as the caps go through a split's window."""
    caps = {"train": most, "val": most // 10 or 1000}
    out = None
    for name, cap in caps.items():
        own = rows.filter(split == name)
        own = own.orderBy(order).limit(cap) if cap else own
        pairs = preference_pairs(own, length, **how).filter("chosen_ids is not null")
        one = dense_index(pairs.select(order, F.lit(name).alias("split"), *ARRAYS), order, "row")
        out = one if out is None else out.unionByName(one)
    return out


def dense_index(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their number in order: counts of ranges of the order column, summed up, and then within each range."""
    return prefix_sum(rows, F.lit(1), order, name)


def write_preferences(packed: DataFrame, path: str) -> None:
    """A folder of Parquet for each split, ids as short integers."""
    packed.write.mode("overwrite").partitionBy("split").parquet(path)


def read_preferences(spark: SparkSession, path: str, split: str, order: str = "order") -> DataFrame:
    """(order, row, arrays) of a split; an error if a mask's length is not its ids'."""
    schema = ", ".join([f"{order} long", *(f"{c} array<int>" for c in ARRAYS), "row long", "split string"])
    rows = spark.read.schema(schema).parquet(path).filter(F.col("split") == split).drop("split")
    same = (F.size("chosen_ids") == F.size("chosen_mask")) & (F.size("rejected_ids") == F.size("rejected_mask"))
    return rows.withColumn("row", F.when(same, F.col("row")).otherwise(F.raise_error(F.lit("a mask has another length than its ids")).cast("long")))


def rollout_row(prompt: Column, completion: Column, pad: int, length: int) -> Column:
    """(ids, mask) of a prompt and completion, cut at length, padded on the right."""
    ids = F.slice(F.concat(prompt, completion), 1, length)
    mask = F.slice(F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(completion))), 1, length)
    return F.struct(_padded(ids, pad, length).alias("ids"), _padded(mask, 0, length).alias("mask"))


def serving_prompts(turns: DataFrame, f: ChatFormat = BYTES, encode=byte_ids) -> DataFrame:
    """(conv_id, ids): the conversation so far and the tag that asks the assistant to speak."""
    return encode_conversations(turns, f, encode).select("conv_id", F.concat("ids", _ints(f.assistant)).alias("ids"))
