"""Rule-based rewards of completions, and advantages relative to a prompt's other completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The answer's marker and the prompt.
ANSWER = r"####\s*(-?[\d,]+(?:\.\d+)?)"
PROMPT = "Solve this math problem step by step. On the final line, write your answer in the exact format: #### <number>\n\n"
TOLERANCE = 1e-4


def prompt(question: Column) -> Column:
    return F.concat(F.lit(PROMPT), question)


def extract_answer(text: Column) -> Column:
    """The number after the last marker, without commas; null if there is none."""
    return F.replace(F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?U){ANSWER}")), F.lit(-1)), F.lit(","), F.lit(""))


def number(text: Column) -> Column:
    """The text as a double, null if it isn't one."""
    return text.try_cast("double")


def reward(completion: Column, gold: Column, format_weight: float = 1.0, correct_weight: float = 3.0) -> Column:
    """0 without an answer; the format's weight with one; the other weight besides if it is the gold number."""
    found = extract_answer(completion)
    right = F.abs(number(found) - number(F.coalesce(extract_answer(gold), gold))) < TOLERANCE
    return F.when(found.isNull(), F.lit(0.0)).otherwise(F.lit(format_weight) + F.when(F.coalesce(right, F.lit(False)), F.lit(correct_weight)).otherwise(F.lit(0.0)))


def max_reward(format_weight: float = 1.0, correct_weight: float = 3.0) -> float:
    return format_weight + correct_weight


def group_advantages(rows: DataFrame, group: str, value: str = "reward", eps: float = 1e-4, group_size: int | None = None) -> DataFrame:
    """rows with advantage: the reward less its group's mean, over the population deviation plus eps.

    The group's figures come from an aggregation with map-side combine, joined back; so a large group needn't fit a task.
    group_size: raise an error where a group has another size.
    """
    n = F.count(F.lit(1))
    ok = F.lit(True) if group_size is None else F.when(n == group_size, True).otherwise(F.raise_error(F.lit("a group has another size")).cast("boolean"))
    figures = rows.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), ok.alias("_ok")).filter("_ok")
    return rows.join(figures, group).withColumn("advantage", (F.col(value) - F.col("_mean")) / (F.col("_std") + eps)).drop("_mean", "_std", "_ok")


def positional_groups(rows: DataFrame, order: str, group_size: int) -> DataFrame:
    """rows with group: consecutive runs of group_size by a dense order; an error if the rows aren't a multiple."""
    if rows.count() % group_size:
        raise ValueError("the rewards aren't a multiple of the group size")
    return rows.withColumn("group", F.floor(F.col(order) / group_size).cast("long"))


def accuracy(rewards: DataFrame, best: float | None = None) -> DataFrame:
    """The share of rewards that are the largest possible; 0 of none."""
    top = max_reward() if best is None else best
    return rewards.agg(F.coalesce(F.avg((F.col("reward") >= top).cast("double")), F.lit(0.0)).alias("accuracy"))


def rollouts(prompts: DataFrame, per_prompt: int) -> DataFrame:
    """(prompt columns, sample_idx): each prompt per_prompt times."""
    return prompts.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(per_prompt - 1))))


def best_of(rows: DataFrame, group: str, value: str = "reward") -> DataFrame:
    """The rows with their rank in the group, best first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), "sample_idx")))
