"""Per-document quality rules, their reports, and the filter. All plans are Catalyst expressions over one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds (fixed values); a null one switches its rule off."""

    min_words: int = 50
    max_words: int = 100_000
    min_mean_word: float = 3.0
    max_mean_word: float = 10.0
    max_symbols: float = 0.10
    min_alpha: float = 0.80
    max_bullets: float = 0.90
    max_ellipses: float = 0.30
    max_dup_lines: float = 0.30
    max_dup_paragraphs: float = 0.30
    min_score: float | None = None
    min_language_score: float | None = 0.65


def with_figures(docs: DataFrame) -> DataFrame:
    """docs with what the rules look at. Words, lines and paragraphs are each split once for a row: the figures come out of a generator, which
    the optimizer neither merges with what is above it nor lets filters through."""
    struct = lambda figures: F.struct(*(v.alias(k) for k, v in figures.items()))
    text = F.col("text")
    parts = F.struct(
        T.bound(T.words(text), lambda w: struct(T.word_figures(w))).alias("_w"), T.bound(T.lines(text), lambda x: struct(T.line_figures(x))).alias("_l"), T.bound(T.paragraphs(text), T.repeated_share).alias("_p")
    )
    out = docs.select("*", F.inline(F.array(parts)))
    names = [F.col("_w")[c].alias(c) for c in ("n_words", "mean_len", "alpha_frac")] + [F.col("_l")[c].alias(c) for c in ("bullet_frac", "ellipsis_frac", "dup_line_frac")]
    return out.select(*docs.columns, *names, F.col("_p").alias("dup_paragraph_frac"), T.symbol_ratio(text, F.col("_w.n_words")).alias("symbol_ratio"))


def _below(column: str, floor: float | None, figures: dict[str, Column]) -> Column | None:
    return figures[column].isNotNull() & (figures[column] < floor) if floor is not None and column in figures else None


def failed_rules(figures: dict[str, Column], cfg: QualityConfig = QualityConfig()) -> Column:
    """The names of the rules that the figures of with_figures() fail, in order; empty: keep."""
    c = figures.__getitem__
    n = c("n_words")
    rules: list[tuple[str, Column | None]] = [
        ("too_short", n < cfg.min_words),
        ("too_long", n > cfg.max_words),
        ("mean_word_len", (n > 0) & ~c("mean_len").between(cfg.min_mean_word, cfg.max_mean_word)),
        ("low_alpha_words", (n > 0) & (c("alpha_frac") < cfg.min_alpha)),
        ("symbol_ratio", c("symbol_ratio") > cfg.max_symbols),
        ("mostly_bullets", c("bullet_frac") > cfg.max_bullets),
        ("ellipsis_lines", c("ellipsis_frac") > cfg.max_ellipses),
        ("dup_lines", c("dup_line_frac") > cfg.max_dup_lines),
        ("dup_paragraphs", c("dup_paragraph_frac") > cfg.max_dup_paragraphs),
        ("low_score", _below("score", cfg.min_score, figures)),
        ("low_language_score", _below("language_score", cfg.min_language_score, figures)),
    ]
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules if hit is not None)))


def check_documents(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """docs with its columns and fails, an array of rule names."""
    figures = with_figures(docs)
    c = [x for x in figures.columns if x not in docs.columns]
    scores = [x for x in ("score", "language_score") if x in docs.columns]
    # one binding of all figures, so that a filter on fails doesn't compute them anew for each rule
    fails = T.bound(F.struct(*c, *scores), lambda r: failed_rules({x: r[x] for x in [*c, *scores]}, cfg))
    return figures.withColumn("fails", fails).select(*docs.columns, "fails")


def quality_filter(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of docs that fail no rule."""
    return check_documents(docs, cfg).filter(F.size("fails") == 0).drop("fails")


def reason_histogram(checked: DataFrame) -> DataFrame:
    """(reason, n_docs): a document counts for each rule it fails."""
    return checked.select(F.explode("fails").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"))


def combination_top(checked: DataFrame, order: str = "doc_id", top: int = 8) -> DataFrame:
    """(combo, n_docs) of the most frequent sets of failed rules; ties go to the one seen first."""
    combo = F.array_join(F.array_sort("fails"), "+")
    seen = checked.filter(F.size("fails") > 0).groupBy(combo.alias("combo")).agg(F.count(F.lit(1)).alias("n_docs"), F.min(order).alias("_first"))
    return seen.orderBy(F.desc("n_docs"), "_first").limit(top).select("combo", "n_docs")


def keep_rate(checked: DataFrame) -> DataFrame:
    """Documents and characters seen and kept, and their shares."""
    kept = F.size("fails") == 0
    chars = F.length("text")
    sums = checked.agg(F.count(F.lit(1)).alias("docs_seen"), F.count_if(kept).alias("docs_kept"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars_seen"), F.coalesce(F.sum(F.when(kept, chars)), F.lit(0)).alias("chars_kept"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return sums.withColumns({"doc_rate": share("docs_kept", "docs_seen"), "char_rate": share("chars_kept", "chars_seen")})
