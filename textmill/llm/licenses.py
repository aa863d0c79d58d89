"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A-Z are lower-cased; words are runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A block is the 48 words from every 16th word of a
text on (fewer at its end), so that every run of up to 33 words lies in one, however its lines are broken. A template meets a block if the block
has at least 0.9 of the template's different words. The join is exact:

1. Only words of templates count. Their document frequency over the whole corpus orders them, rarest first, in templates and blocks alike.
2. Prefix filter: a template of n words that needs m of them shares with each of its blocks one of its n - m + 1 rarest, which is also among the
   block's |block| - m + 1 rarest. An equi-join on these words finds the candidates. The side of the templates is broadcast; it has as many rows
   as the templates' prefixes, whatever the corpus.
3. Length filter: a block of fewer than m words is none. Positional filter: a match at place i of the template and place j of the block
   leaves at most 1 + min(n - i - 1, |block| - j - 1) words in common, so it is dropped where that is below m.
4. The candidates that are left are verified by their intersection.

The texts are only cut into blocks where the whole text has m words of some template, which any of its blocks would need.

Base phrases are counted wherever their words stand one after another. They are cut out by one expression each, without a row for each word.

Defined results: a null text is an empty one, with no words and no labels; repeated rows get equal results, also where they repeat a doc_id
with another text; null ids are ids; empty tables give an empty result; no templates leave the base labels; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH, STEP, THRESHOLD = 48, 16, 0.9
#: What stands between words, once A-Z are lower-cased.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
#: The contract's phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Sentences of common licenses.
TEMPLATES = (
    Template("agpl", "GNU Affero General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("warranty", "The software is provided as is, without warranty of any kind, express or implied"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a lowered text, in order."""
    return F.array_remove(F.split(text, f"{_BETWEEN}+"), "")


def _words_of(text: str) -> list[str]:
    """The same of a template, which is ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _once(**columns: Column) -> Column:
    """Columns out of a generator, which the optimizer doesn't compute again wherever they are named."""
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))


def phrase_places(text: Column, n_words: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase in a lowered text: how often its words stand one after another, and the words before the first and the last time.

    The text is split at the phrase; no phrase can overlap itself, as its first word comes in it once.
    """
    own = phrase.split()
    word = "[^" + _BETWEEN[1:]
    parts = F.split(text, f"(?<!{word})" + f"{_BETWEEN}+".join(own) + f"(?!{word})")
    n = (F.size(parts) - 1).cast("long")
    has = n > 0
    first, last = F.when(has, _count(F.get(parts, F.lit(0)))), F.when(has, n_words - len(own) - _count(F.get(parts, F.size(parts) - 1)))
    return F.struct(n.alias("n"), first.alias("first"), last.alias("last"))


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, n_base, first_word, last_word, base_labels): base_labels is an array here."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), _once(text=lowered(F.col("text"))))
    rows = rows.select("doc_id", "row", "text", _once(n_words=_count(F.col("text"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    has = lambda p: F.col("text").contains(p.split()[0]) & F.col("text").contains(p.split()[-1])
    found = {f"p{i}": F.when(has(p), phrase_places(F.col("text"), F.col("n_words"), p)).otherwise(none) for i, p in enumerate(PHRASES)}
    rows = rows.select("doc_id", "row", "n_words", _once(**found))
    each = list(zip((F.col(k) for k in found), PHRASES.values(), strict=True))
    labels = F.array_sort(F.array_compact(F.array(*(F.when(p["n"] > 0, F.lit(label)) for p, label in each))))
    return rows.select(
        "doc_id", "row", "n_words", sum((p["n"] for p, _ in each), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array(*(p["first"] for p, _ in each))).alias("first_word"), F.array_max(F.array(*(p["last"] for p, _ in each))).alias("last_word"), labels.alias("base_labels"),
    )


def row_key(docs: DataFrame) -> Column:
    """Two hashes of a text, 128 bits together."""
    return F.struct(F.xxhash64(docs["text"]).alias("a"), F.xxhash64(F.lit(1), docs["text"]).alias("b"))


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The number of rows that have each word of the templates: one number for each, whatever the corpus."""
    own = docs.select(F.explode(F.array_intersect(words(lowered(F.col("text"))), _literal(vocabulary))).alias("w"))
    return {r.w: r.n for r in own.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """(row, start, template, label, containment): every block of every different text and every template that it holds to the threshold. start is
    in words, template an index."""
    sets = [sorted(set(_words_of(t.text))) for t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    df = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    known = _literal(order)
    index, enough = [], F.lit(False)
    for k, s in enumerate(sets):
        ranks, m = sorted(rank[w] for w in s), needed(len(s), threshold)
        own = F.array(*map(F.lit, ranks))
        index += [F.struct(F.lit(r).alias("rank"), F.lit(k).alias("template"), F.lit(i).alias("i"), F.lit(len(s)).alias("n"), F.lit(m).alias("m"), own.alias("own"), F.lit(templates[k].label).alias("label")) for i, r in enumerate(ranks[: len(s) - m + 1])]
        enough |= F.size(F.array_intersect("has", F.array(*map(F.lit, s)))) >= m
    if not index:
        return docs.sparkSession.createDataFrame([], "row struct<a:long,b:long>, start int, template int, label string, containment double")
    prefixes = docs.sparkSession.range(1).select(F.inline(F.array(*index)))
    least = min(needed(len(s), threshold) for s in sets)

    texts = docs.select(row_key(docs).alias("row"), _once(words=words(lowered(F.col("text")))))
    some = texts.select("row", "words", _once(has=F.array_intersect("words", known))).filter(enough).select("row", "words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - width) / step).cast("int") * step), F.lit(step))
    cut = lambda at: F.struct(at.alias("start"), F.array_intersect(F.slice("words", at + 1, width), known).alias("has"))
    blocks = some.select("row", F.inline(F.filter(F.transform(starts, cut), lambda b: F.size(b["has"]) >= least)))
    ordered = F.array_sort(F.transform("has", lambda w: (F.array_position(known, w) - 1).cast("int")))
    blocks = blocks.select("row", "start", _once(ranks=ordered))
    probes = blocks.select("row", "start", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - least + 1)).alias("j", "rank"))
    met = probes.join(F.broadcast(prefixes), "rank")
    size = F.size("ranks")
    met = met.filter((size >= F.col("m")) & (F.col("j") <= size - F.col("m")) & (1 + F.least(F.col("n") - F.col("i") - 1, size - F.col("j") - 1) >= F.col("m")))
    both = met.select("row", "start", "template", "label", "m", "n", F.size(F.array_intersect("ranks", "own")).alias("both")).filter("both >= m")
    return both.select("row", "start", "template", "label", (F.col("both") / F.col("n")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels has the templates' besides the base ones. score is the best containment of a template that is met, 1 where a base phrase stands, else 0.
    """
    found = matches(docs, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = stored(found, "licensed")  # one row for each different text that meets a template
    rows = base(docs).join(found, "row", "left")
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def _sql() -> str:
    """Places by word lists, and every block against every template."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    ts = ", ".join(f"('{t.label}', {quoted(sorted(set(_words_of(t.text))))})" for t in TEMPLATES)
    ps = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES.items())
    return f"""WITH t(label, own) AS (VALUES {ts}), p(label, own) AS (VALUES {ps}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
b AS (SELECT u.r, i, p.label FROM u JOIN p ON u.x = p.own[1] JOIN d ON d.r = u.r WHERE d.w[i + 1 : i + len(p.own)] = p.own),
bs AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY r),
k AS (SELECT r, w[i + 1 : i + {WIDTH}] AS own FROM (SELECT r, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - {WIDTH}) / {STEP}.0) AS BIGINT) * {STEP} + 1), {STEP})) AS i FROM d)),
m AS (SELECT k.r, t.label, len(list_intersect(t.own, k.own)) / len(t.own) AS c FROM k, t WHERE len(list_intersect(t.own, k.own)) >= ceil({THRESHOLD} * len(t.own) - 1e-9)),
al AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT r, label FROM m UNION ALL SELECT r, label FROM b) GROUP BY r),
mx AS (SELECT r, max(c) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN al USING (r) LEFT JOIN mx USING (r)"""


ORACLE_SQL = _sql()
