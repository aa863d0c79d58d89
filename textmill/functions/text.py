"""Text expressions with Python's string semantics, as Catalyst columns.

Java's classes are ASCII unless ``(?U)`` is set, and even then lack U+001C to U+001F among white space, so both are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for use inside a character class under (?U).
SPACE = "\\s\\x1c-\\x1f"
#: What ends a line.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: How a bullet line starts.
BULLETS = "•-*‣◦⁃∙"


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for each row: an expression that is named several times is inlined several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    """The runs of characters that are not white space."""
    return F.regexp_extract_all(text, F.lit(f"(?U)([^{SPACE}]+)"))


def word_tokens(text: Column) -> Column:
    """The lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"))


def word_line(text: Column) -> Column:
    """The word tokens, with a space between any two: no token has one."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " "))


def _solid(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def lines(text: Column) -> Column:
    """The stripped lines that are not empty."""
    return _solid(F.split(text, LINE_BREAK))


def paragraphs(text: Column) -> Column:
    """The stripped parts between blank lines that are not empty."""
    return _solid(F.split(text, f"(?U)\\n[{SPACE}]*\\n"))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or a constant where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / F.greatest(whole, F.lit(1)))


def repeated_share(items: Column) -> Column:
    """The share of items that equal an earlier one."""
    n = F.size(items)
    return F.when(n <= 1, F.lit(0.0)).otherwise((n - F.size(F.array_distinct(items))) / F.greatest(n, F.lit(1)))


def occurrences(text: Column, what: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def word_figures(w: Column) -> dict[str, Column]:
    """Of an array of words: their number, mean length, and the share with a letter."""
    n = F.size(w)
    total = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return {"n_words": n, "mean_len": ratio(total, n, 0.0), "alpha_frac": ratio(F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))), n, 0.0)}


def symbol_ratio(text: Column, n: Column) -> Column:
    """Hash signs and ellipses for each word; 1 where there is no word."""
    return ratio(occurrences(text, "#") + occurrences(text, "...") + occurrences(text, "…"), n, 1.0)


def line_figures(rows: Column) -> dict[str, Column]:
    """Of an array of lines: the shares of bullets, of endings in an ellipsis, and of repeats; 1 each where there is no line."""
    n = F.size(rows)
    bullet = F.size(F.filter(rows, lambda x: F.instr(F.lit(BULLETS), F.substring(x, 1, 1)) > 0))
    ellipsis = F.size(F.filter(rows, lambda x: x.endswith("...") | x.endswith("…")))
    return {"bullet_frac": ratio(bullet, n, 1.0), "ellipsis_frac": ratio(ellipsis, n, 1.0), "dup_line_frac": F.when(n == 0, F.lit(1.0)).otherwise(repeated_share(rows))}


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-word shingles of the word tokens; all words as one if there are fewer; none of an empty text."""
    def cut(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return bound(word_tokens(text), cut)
