"""The registered queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bpe, chat, dedup, evaluate, language, mainpage, model, objectives, pack, quality, reward, sketches, temporal, vectors
from ..operators.storage import shared_dir, stored
from ..sources import registry, token_bin
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumnRenamed("doc_id", "doc_idx")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: Column | str, name: str) -> Column:
    """Rounded, without a negative zero."""
    return (F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6) + F.lit(0.0)).alias(name)


# ---------------------------------------------------------------- quality rules

# the figures of the rules, for use in a WITH clause
_FIGURES = """
parts AS (
  SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l,
    list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS p
  FROM documents
), counts AS (
  SELECT doc_id, text, len(w) AS n, len(l) AS nl, len(p) AS np, list_sum(list_transform(w, lambda x: length(x))) AS wc,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) AS wa,
    (length(text) - length(replace(text, '#', ''))) + (length(text) - length(replace(text, '...', ''))) // 3 + (length(text) - length(replace(text, '…', ''))) AS sy,
    len(list_filter(l, lambda x: contains('•-*‣◦⁃∙', substr(x, 1, 1)))) AS bu, len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS el,
    len(list_distinct(l)) AS dl, len(list_distinct(p)) AS dp
  FROM parts
), figures AS (
  SELECT doc_id, text, n, CASE WHEN n = 0 THEN 0.0 ELSE CAST(wc AS DOUBLE) / n END AS mean_len, CASE WHEN n = 0 THEN 0.0 ELSE CAST(wa AS DOUBLE) / n END AS alpha_frac,
    CASE WHEN n = 0 THEN 1.0 ELSE CAST(sy AS DOUBLE) / n END AS symbol_ratio, CASE WHEN nl = 0 THEN 1.0 ELSE CAST(bu AS DOUBLE) / nl END AS bullet_frac,
    CASE WHEN nl = 0 THEN 1.0 ELSE CAST(el AS DOUBLE) / nl END AS ellipsis_frac,
    CASE WHEN nl = 0 THEN 1.0 WHEN nl = 1 THEN 0.0 ELSE CAST(nl - dl AS DOUBLE) / nl END AS dup_line_frac,
    CASE WHEN np <= 1 THEN 0.0 ELSE CAST(np - dp AS DOUBLE) / np END AS dup_paragraph_frac
  FROM counts
)"""
_CHECKED = (
    _FIGURES
    + """, checked AS (
  SELECT doc_id, text, list_filter([CASE WHEN n < 50 THEN 'too_short' END, CASE WHEN n > 100000 THEN 'too_long' END, CASE WHEN n > 0 AND NOT (mean_len BETWEEN 3 AND 10) THEN 'mean_word_len' END,
    CASE WHEN n > 0 AND alpha_frac < 0.8 THEN 'low_alpha_words' END, CASE WHEN symbol_ratio > 0.1 THEN 'symbol_ratio' END, CASE WHEN bullet_frac > 0.9 THEN 'mostly_bullets' END,
    CASE WHEN ellipsis_frac > 0.3 THEN 'ellipsis_lines' END, CASE WHEN dup_line_frac > 0.3 THEN 'dup_lines' END, CASE WHEN dup_paragraph_frac > 0.3 THEN 'dup_paragraphs' END], lambda x: x IS NOT NULL) AS fails
  FROM figures
)"""
)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_documents(documents(spark, sf_dir))


@query(f"WITH {_FIGURES} SELECT doc_id, CAST(n AS BIGINT) AS n_words, round(mean_len, 6) AS mean_len, round(alpha_frac, 6) AS alpha_frac FROM figures")
def word_stats(spark, sf_dir):
    return quality.with_figures(documents(spark, sf_dir)).select("doc_id", long("n_words").alias("n_words"), r6("mean_len", "mean_len"), r6("alpha_frac", "alpha_frac"))


@query(f"WITH {_FIGURES} SELECT doc_id, round(symbol_ratio, 6) AS symbol_ratio FROM figures")
def symbol_word_ratio(spark, sf_dir):
    return quality.with_figures(documents(spark, sf_dir)).select("doc_id", r6("symbol_ratio", "symbol_ratio"))


@query(f"WITH {_FIGURES} SELECT doc_id, round(bullet_frac, 6) AS bullet_frac, round(ellipsis_frac, 6) AS ellipsis_frac, round(dup_line_frac, 6) AS dup_line_frac FROM figures")
def line_fracs(spark, sf_dir):
    return quality.with_figures(documents(spark, sf_dir)).select("doc_id", *(r6(c, c) for c in ("bullet_frac", "ellipsis_frac", "dup_line_frac")))


@query(f"WITH {_FIGURES} SELECT doc_id, round(dup_paragraph_frac, 6) AS dup_paragraph_frac FROM figures")
def dup_paragraph_frac(spark, sf_dir):
    return quality.with_figures(documents(spark, sf_dir)).select("doc_id", r6("dup_paragraph_frac", "dup_paragraph_frac"))


@query(f"WITH {_CHECKED} SELECT doc_id, array_to_string(fails, '+') AS fails FROM checked")
def quality_fails(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", F.array_join("fails", "+").alias("fails"))


@query(f"WITH {_CHECKED} SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM checked WHERE len(fails) = 0")
def quality_filter(spark, sf_dir):
    return quality.quality_filter(documents(spark, sf_dir)).select("doc_id", long(F.length("text")).alias("chars"))


@query(f"WITH {_CHECKED} SELECT reason, count(*) AS n_docs FROM (SELECT unnest(fails) AS reason FROM checked) GROUP BY reason")
def quality_reason_histogram(spark, sf_dir):
    return quality.reason_histogram(_checked(spark, sf_dir))


@query(f"WITH {_CHECKED} SELECT combo, n_docs FROM (SELECT array_to_string(list_sort(fails), '+') AS combo, count(*) AS n_docs, min(doc_id) AS f FROM checked WHERE len(fails) > 0 GROUP BY combo) ORDER BY n_docs DESC, f LIMIT 8")
def quality_combo_top8(spark, sf_dir):
    return quality.combination_top(_checked(spark, sf_dir))


_RATE = """count(*) AS docs_seen, count(*) FILTER (len(fails) = 0) AS docs_kept, CAST(sum(length(text)) AS BIGINT) AS chars_seen, CAST(coalesce(sum(length(text)) FILTER (len(fails) = 0), 0) AS BIGINT) AS chars_kept,
  round(count(*) FILTER (len(fails) = 0) / greatest(count(*), 1), 6) AS doc_rate, round(coalesce(sum(length(text)) FILTER (len(fails) = 0), 0) / greatest(sum(length(text)), 1), 6) AS char_rate"""


@query(f"WITH {_CHECKED} SELECT {_RATE} FROM checked")
def quality_keep_rate(spark, sf_dir):
    return quality.keep_rate(_checked(spark, sf_dir))


@query(f"WITH {_CHECKED} SELECT {_RATE} FROM checked WHERE doc_id < 100")
def quality_dry_run(spark, sf_dir):
    """The report on the first hundred documents, as a trial run gives it."""
    return quality.keep_rate(quality.check_documents(pack.head(documents(spark, sf_dir), "doc_id", 100)))


@query(
    f"""WITH {_CHECKED} SELECT c.doc_id, array_to_string(c.fails, '+') || CASE WHEN l.quality IS NOT NULL AND l.quality < 1 THEN CASE WHEN len(c.fails) > 0 THEN '+' ELSE '' END || 'low_score' ELSE '' END
  || CASE WHEN l.toxic = 1 THEN CASE WHEN len(c.fails) > 0 OR l.quality < 1 THEN '+' ELSE '' END || 'low_language_score' ELSE '' END AS fails
FROM checked c LEFT JOIN labels l USING (doc_id)"""
)
def score_filter(spark, sf_dir):
    """The score rules, with labels standing in: quality as score, 1 - toxic as language score; null scores are lenient."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"), (1.0 - F.col("toxic")).alias("language_score"))
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left")
    return quality.check_documents(rows, quality.QualityConfig(min_score=1.0)).select("doc_id", F.array_join("fails", "+").alias("fails"))


@query()
def language_rule(spark, sf_dir):
    """The language rule with a computed score: profiles of the documents' own languages, each document's probability of the one that it claims."""
    docs = documents(spark, sf_dir)
    rows = language.scored(docs.select("doc_id", "text", "lang"), language.train(docs))
    return quality.check_documents(rows).select("doc_id", "language", r6("language_score", "language_score"), F.array_contains("fails", "low_language_score").alias("fails"))


# ---------------------------------------------------------------- sources, caps, budgets

_BUDGET = 1_000_000


@query("SELECT doc_id, CAST(length(trim(text)) AS BIGINT) AS chars FROM documents WHERE length(trim(text)) >= 200")
def min_length_filter(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("text", T.strip(F.col("text"))).filter(F.length("text") >= 200)
    return rows.select("doc_id", long(F.length("text")).alias("chars"))


@query(f"SELECT doc_id, n_bytes FROM (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_bytes, coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < {_BUDGET}")
def byte_budget_cut(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", long(F.octet_length("text") + 1).alias("n_bytes"))
    return pack.budget_cut(rows, F.col("n_bytes"), "doc_id", _BUDGET)


@query()
def json_budget_cut(spark, sf_dir):
    """The budget in bytes of JSON lines, as an ingest counts it."""
    rows = documents(spark, sf_dir).select("doc_id", long(pack.json_line_bytes("text", "lang", "source")).alias("line_bytes"))
    return pack.budget_cut(rows, F.col("line_bytes"), "doc_id", _BUDGET)


@query("SELECT doc_id, text FROM documents WHERE doc_id < 500")
def doc_cap(spark, sf_dir):
    return pack.head(documents(spark, sf_dir), "doc_id", 500).select("doc_id", "text")


@query("SELECT doc_id, text FROM (SELECT doc_id, trim(text) AS text FROM documents WHERE doc_id < 300) WHERE text <> ''")
def flat_text_sample(spark, sf_dir):
    return registry.read_sample_text(documents(spark, sf_dir), "doc_id", 300).select("doc_id", "text")


@query("SELECT doc_id, lang, source FROM documents")
def meta_projection(spark, sf_dir):
    df = documents(spark, sf_dir)
    return df.select("doc_id", *registry.present(df, "id", "url", "lang", "source", "score"))


@query(f"WITH {_CHECKED} SELECT doc_id FROM checked WHERE len(fails) = 0")
def stage_fallback(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return registry.first_stage({"raw": docs, "clean": quality.quality_filter(docs), "dedup": docs.filter("false")}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resume_ingest(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return registry.resumed(docs, docs.filter("doc_id % 3 = 0"), "doc_id")


@query("""SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS prompt_chars, CAST(length(nt) AS BIGINT) AS completion_chars FROM (
  SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant' AND text <> '' AND nt <> ''""")
def sft_sources(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"completion": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    pairs = chat.pairs_as_turns(rows.filter("role = 'user' and next_role = 'assistant'").withColumnRenamed("text", "prompt")).filter("turns is not null")
    at = lambda i: long(F.length(F.col("turns")[i]["content"]))
    return pairs.select("conv_id", "turn", at(0).alias("prompt_chars"), at(1).alias("completion_chars"))


@query("SELECT conv_id, arg_max(text, turn) AS last_content FROM conversations GROUP BY conv_id")
def preference_source(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("chosen"))
    return rows.select("conv_id", chat.last_content(F.col("chosen")).alias("last_content"))


_DRAW = "CAST('0x' || substr(md5('{seed}:' || CAST({i} AS VARCHAR)), 1, 15) AS BIGINT) % ({n})"


@query(f"WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT range AS draw, {_DRAW.format(seed=3, i='range', n='n')} AS spot FROM range(100), n) SELECT draw, doc_id, CAST(length(text) AS BIGINT) + {len(reward.PROMPT)} AS prompt_chars FROM d JOIN documents ON doc_id = spot")
def rl_prompt_sample(spark, sf_dir):
    """A hundred prompts drawn with replacement, by an index table."""
    docs = documents(spark, sf_dir)
    got = pack.drawn_rows(docs, "doc_id", 100, docs.count(), 3)
    return got.select("draw", "doc_id", long(F.length(reward.prompt(F.col("text")))).alias("prompt_chars"))


@query("SELECT doc_id, lang, source, CAST(length(trim(text)) AS BIGINT) AS chars FROM documents WHERE length(trim(text)) >= 200")
def source_ingest(spark, sf_dir):
    """A corpus by its name in the registry, with the columns that it has."""
    return registry.ingest(spark, "documents", root=sf_dir).select("doc_id", "lang", "source", long(F.length("text")).alias("chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def shard_scan(spark, sf_dir):
    """Documents written as shards of JSON lines and read again."""
    path = shared_dir(spark, "jsonl")
    registry.write_shards(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"), path, 200)
    return registry.read_shards(spark, path).select("id", "text")


@query("SELECT doc_id, CAST(length(trim(text)) AS BIGINT) AS chars FROM documents WHERE length(trim(text)) >= 200")
def resumed_ingest(spark, sf_dir):
    """Byte-rotated shards of the documents, taken in by a streaming query that is started three times, each time with more shards in its folder."""
    base = shared_dir(spark, "ingest")
    docs, schema = documents(spark, sf_dir).select("doc_id", "text"), "doc_id long, text string"
    half = docs.agg(F.max("doc_id")).first()[0] // 2
    for k, part in enumerate((docs.filter(F.col("doc_id") <= half), docs.filter(F.col("doc_id") > half), docs.limit(0))):
        registry.write_byte_shards(part, f"{base}/in/{k}", "doc_id", 1 << 20, "doc_id", "text")
        streams.ingest_stream(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").select("doc_id", long(F.length("text")).alias("chars"))


@query("""SELECT b // 100000 AS shard, count(*) AS docs, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT strlen(text) + 1 AS n, CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM documents) GROUP BY 1""")
def byte_shards(spark, sf_dir):
    """Shards that turn over by bytes, in order."""
    rows = documents(spark, sf_dir).select("doc_id", long(F.octet_length("text") + 1).alias("n"))
    return pack.byte_shards(rows, F.col("n"), "doc_id", 100_000).groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("bytes"))


@query("SELECT text, count(*) AS n FROM documents WHERE text <> '' GROUP BY text")
def text_round_trip(spark, sf_dir):
    """Plain text with a blank line after each document, read again."""
    path = shared_dir(spark, "text")
    registry.write_text(documents(spark, sf_dir), path)
    return registry.read_text(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS \"row\", round(CASE WHEN vec_id < (SELECT count(*) // 2 FROM embeddings) THEN list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) ELSE 0 END, 4) + 0.0 AS total FROM embeddings")
def checkpoint_growth(spark, sf_dir):
    """A saved tensor of half the rows read into one of all rows: the rows that are new keep their start values."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("name"), F.col("vec_id").alias("row"), "embedding")
    path = shared_dir(spark, "checkpoint")
    registry.write_checkpoint(rows.filter(F.col("row") < rows.count() // 2).select("name", "row", F.col("embedding").alias("values")), {"step": 1}, path)
    saved, _ = registry.read_checkpoint(spark, path)
    fresh = rows.select("name", "row", F.transform("embedding", lambda x: (x * 0).cast("float")).alias("values"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return registry.resized(fresh, saved).select("row", (F.round(total, 4) + F.lit(0.0)).alias("total"))


@query("SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN round(value, 6) END AS loss, CASE WHEN event_id % 2 = 1 THEN round(value, 6) END AS val_loss FROM events")
def training_log(spark, sf_dir):
    """Two kinds of events appended to one log of JSON lines."""
    rows, path = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").cast("double").alias("v")), shared_dir(spark, "log")
    registry.append_log(rows.filter("step % 2 = 0").select("step", F.col("v").alias("loss")), path)
    registry.append_log(rows.filter("step % 2 = 1").select("step", F.col("v").alias("val_loss")), path)
    return registry.read_log(spark, path).select("step", F.round("loss", 6).alias("loss"), F.round("val_loss", 6).alias("val_loss"))


# ---------------------------------------------------------------- duplicates

_SHINGLES = """toks AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
sh AS (SELECT doc_id, text, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM toks)"""


@query(f"WITH {_SHINGLES} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sh")
def shingle_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", long(F.size(T.shingles(F.col("text")))).alias("n_shingles"))


@query()
def anchor_jaccard(spark, sf_dir):
    """True similarity of each document to the anchors of its LSH buckets, over whole texts: a star, not all pairs."""
    edges = stored(dedup.candidate_edges(dedup.band_keys(_signatures(spark, sf_dir))), "edges")
    return dedup.edge_jaccard(edges, indexed(spark, sf_dir)).select(F.col("dst").alias("doc_id"), F.col("src").alias("anchor"), r6("jaccard", "jaccard"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dup_removal(spark, sf_dir):
    return dedup.exact_dedup(indexed(spark, sf_dir)).select(F.col("doc_idx").alias("doc_id"))


@query("SELECT source, arg_min(doc_id, struct_pack(a := -length(text), b := doc_id)) AS winner, count(*) AS members FROM documents GROUP BY source")
def winner_per_cluster(spark, sf_dir):
    rows = indexed(spark, sf_dir).select("source", "doc_idx", F.length("text").alias("chars"))
    return dedup.winners(rows, "source")


@query("SELECT bands, round(power(1.0 / bands, CAST(bands AS DOUBLE) / 128), 9) AS threshold FROM (VALUES (4), (8), (16), (32), (64)) t(bands)")
def implied_threshold(spark, sf_dir):
    return spark.createDataFrame([(b, round(dedup.implied_threshold(128, b), 9)) for b in (4, 8, 16, 32, 64)], "bands int, threshold double")


def _signatures(spark, sf_dir) -> DataFrame:
    return stored(dedup.signatures(indexed(spark, sf_dir)), "signatures")


@query()
def shingle_base_hash(spark, sf_dir):
    """Smallest and largest base hash of each document's shingles."""
    h = F.transform(T.shingles(F.col("text")), lambda s: F.crc32(F.encode(s, "utf-8")))
    return documents(spark, sf_dir).select("doc_id", h.alias("h")).select("doc_id", F.array_min("h").alias("low"), F.array_max("h").alias("high"))


@query()
def minhash_signatures(spark, sf_dir):
    return dedup.signatures(indexed(spark, sf_dir)).select("doc_idx", F.xxhash64("signature").alias("digest"), F.get("signature", F.lit(0)).alias("first_slot"))


@query()
def lsh_buckets(spark, sf_dir):
    return dedup.buckets(dedup.band_keys(_signatures(spark, sf_dir))).select("band", "anchor", "members")


@query()
def lsh_candidate_edges(spark, sf_dir):
    return dedup.candidate_edges(dedup.band_keys(_signatures(spark, sf_dir)))


@query()
def lsh_confirmed_edges(spark, sf_dir):
    sigs = _signatures(spark, sf_dir)
    return dedup.confirmed_edges(dedup.candidate_edges(dedup.band_keys(sigs)), sigs)


@query()
def dedup_clusters(spark, sf_dir):
    return dedup.clusters(_signatures(spark, sf_dir))


@query()
def dedup_keep(spark, sf_dir):
    return dedup.dedup(indexed(spark, sf_dir)).select("doc_idx")


@query()
def dedup_filtered_keep(spark, sf_dir):
    good = stored(quality.quality_filter(indexed(spark, sf_dir)).select("doc_idx", "text"), "good")  # it is read twice
    return dedup.dedup(good).select("doc_idx")


@query()
def dedup_stats(spark, sf_dir):
    docs = indexed(spark, sf_dir)
    return dedup.dedup_stats(docs, dedup.dedup(docs))


# ---------------------------------------------------------------- tokenizer

_PRETOKENS = "regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+')"
_PAIRS = f"""hist AS (SELECT chunk, count(*) AS freq FROM (SELECT unnest({_PRETOKENS}) AS chunk FROM documents) GROUP BY chunk),
hx AS (SELECT freq, hex(encode(chunk)) AS x FROM hist WHERE strlen(chunk) > 1),
pr AS (SELECT freq, unnest(list_transform(range(0, len(x) // 2 - 1), lambda i: substr(x, CAST(2 * i + 1 AS BIGINT), 4))) AS p FROM hx),
pc AS (SELECT CAST('0x' || substr(p, 1, 2) AS INTEGER) AS a, CAST('0x' || substr(p, 3, 2) AS INTEGER) AS b, CAST(sum(freq) AS BIGINT) AS cnt FROM pr GROUP BY p)"""
_VOCAB = 512


@query(f"SELECT chunk, count(*) AS freq FROM (SELECT unnest({_PRETOKENS}) AS chunk FROM documents) GROUP BY chunk")
def pretoken_histogram(spark, sf_dir):
    return bpe.histogram(documents(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT a, b, cnt FROM pc")
def pair_counts(spark, sf_dir):
    return bpe.pair_counts(bpe.histogram(documents(spark, sf_dir)))


@query(f"WITH {_PAIRS} SELECT a, b, cnt FROM pc ORDER BY cnt DESC, a, b LIMIT 1")
def best_pair(spark, sf_dir):
    return bpe.best_pair(bpe.pair_counts(bpe.histogram(documents(spark, sf_dir))))


_trained: dict[tuple[str, str], list[bpe.Pair]] = {}


def _tokenizer(spark, sf_dir) -> bpe.Tokenizer:
    """Trained once for an application and folder."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _trained:
        _trained[at] = bpe.train(documents(spark, sf_dir), _VOCAB).merges
    return bpe.Tokenizer(list(_trained[at]))


@query()
def bpe_merges(spark, sf_dir):
    rows = [(a, b, 256 + i) for i, (a, b) in enumerate(_tokenizer(spark, sf_dir).merges)]
    return spark.createDataFrame(rows, "a int, b int, new_id int")


@query()
def bpe_encode_lengths(spark, sf_dir):
    ids = bpe.encode_documents(documents(spark, sf_dir), _tokenizer(spark, sf_dir))
    return ids.select("doc_id", long(F.size("ids")).alias("n_ids"), F.xxhash64("ids").alias("digest"))


@query("SELECT doc_id, true AS same FROM documents")
def bpe_round_trip(spark, sf_dir):
    tok, docs = _tokenizer(spark, sf_dir), documents(spark, sf_dir)
    ids = bpe.encode_documents(docs.withColumn("was", F.coalesce("text", F.lit(""))), tok, carry=("was",))
    return bpe.decode_documents(ids, tok, carry=("was",)).select("doc_id", (F.col("text") == F.col("was")).alias("same"))


@query()
def compression_ratio(spark, sf_dir):
    tok, docs = _tokenizer(spark, sf_dir), documents(spark, sf_dir)
    ids = bpe.encode_documents(docs.withColumn("n", F.length("text")), tok, carry=("n",))
    return ids.agg(F.sum("n").alias("chars"), F.sum(F.size("ids")).alias("tokens")).select("chars", "tokens", F.round(F.col("chars") / F.greatest("tokens", F.lit(1)), 3).alias("chars_per_token"))


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS tokens, round(sum(length(text)) / sum(strlen(text)), 3) AS chars_per_token FROM documents")
def byte_compression(spark, sf_dir):
    """The same of the untrained byte vocabulary."""
    sums = documents(spark, sf_dir).agg(F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("tokens"))
    return sums.withColumn("chars_per_token", F.round(F.col("chars") / F.col("tokens"), 3))


@query("SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_ids FROM documents")
def special_token_encode(spark, sf_dir):
    """Each text with an end string after it, under a byte vocabulary in which that string is one id."""
    tok = bpe.Tokenizer([])
    tok.register(tok.END)
    docs = documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(tok.END)).alias("text"))
    return bpe.encode_documents(docs, tok, specials=[tok.END]).select("doc_id", long(F.size("ids")).alias("n_ids"))


@query("""WITH c AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents),
s AS (SELECT substr(text, 1, CAST(2000000 - b AS BIGINT)) AS t FROM c WHERE b < 2000000)
SELECT CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(strlen(t)) AS BIGINT) AS tokens, round(sum(length(t)) / sum(strlen(t)), 3) AS chars_per_token, 4 AS probes_back, 257 AS vocab_size FROM s""")
def tokenizer_report(spark, sf_dir):
    """The report that follows training, of the byte vocabulary: the first two million characters, and the probes."""
    tok = bpe.Tokenizer([])
    tok.register(tok.END)
    return bpe.report(documents(spark, sf_dir), tok)


@query(f"""WITH ch AS (SELECT doc_id, unnest({_PRETOKENS}) AS c FROM documents)
SELECT doc_id, CAST(sum(strlen(c) - (length(c) - length(replace(c, 'th', ''))) // 2 - (length(c) - length(replace(c, 'the', ''))) // 3) AS BIGINT) AS n_ids, 259 AS vocab_size FROM ch GROUP BY doc_id""")
def tokenizer_file(spark, sf_dir):
    """A tokenizer of two merges and an end string, saved and read again, over all documents that have a token."""
    tok, path = bpe.Tokenizer([(116, 104), (256, 101)]), shared_dir(spark, "tokenizer")
    tok.register(tok.END)
    spark.createDataFrame([(tok.dumps(),)], "value string").coalesce(1).write.text(path)
    again = bpe.Tokenizer.loads(spark.read.text(path).first()[0])
    ids = bpe.encode_documents(documents(spark, sf_dir), again).filter(F.size("ids") > 0)
    return ids.select("doc_id", long(F.size("ids")).alias("n_ids"), F.lit(again.vocab_size).alias("vocab_size"))


@query("SELECT * FROM (VALUES ('user', 258), ('assistant', 259), ('end', 260), ('size', 261)) t(tag, id)")
def chat_tags(spark, sf_dir):
    """Ids of the tags of turns above a tokenizer's own; a second registration changes nothing."""
    tok = bpe.Tokenizer([(116, 104), (256, 101)])
    f = chat.ChatFormat.register(tok)
    assert f == chat.ChatFormat.register(tok)
    return spark.createDataFrame([("user", f.user), ("assistant", f.assistant), ("end", f.end), ("size", tok.vocab_size)], "tag string, id int")


@query(f"""WITH h AS (SELECT DISTINCT chunk FROM (SELECT unnest({_PRETOKENS}) AS chunk FROM documents)), x AS (SELECT chunk, hex(encode(chunk)) AS x FROM h WHERE strlen(chunk) > 1),
l AS (SELECT chunk, list_transform(range(0, len(x) // 2), lambda i: substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS l FROM x),
n AS (SELECT chunk, l, string_split(substr(replace(' ' || array_to_string(l, ' '), ' 74 68', ' 100'), 2), ' ') AS m FROM l),
p AS (SELECT chunk, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ',' || l[i + 1])) AS a, list_transform(range(1, len(m)), lambda i: m[i] || ',' || m[i + 1]) AS b FROM n)
SELECT chunk, CAST(len(list_filter(a, lambda v: NOT list_contains(b, v))) AS BIGINT) AS n_lost FROM p""")
def lost_pairs(spark, sf_dir):
    """Of each pre-token, the pairs that the merge of t and h takes away."""
    hist = bpe.histogram(documents(spark, sf_dir)).filter(F.octet_length("chunk") > 1)
    return hist.select("chunk", long(F.size(bpe.lost_pairs(bpe.bytes_of(F.col("chunk")), (116, 104), 256))).alias("n_lost"))


@query("SELECT item_id AS seq_id, text FROM benchmark")
def stream_decode(spark, sf_dir):
    """Benchmark texts decoded byte by byte and joined again."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.posexplode(chat.byte_ids(F.col("text"))).alias("pos", "token_id"))
    pieces = bpe.decode_streams(rows.select("seq_id", long("pos").alias("pos"), "token_id"), bpe.Tokenizer([]))
    whole = pieces.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return whole.select("seq_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


# ---------------------------------------------------------------- packing and windows

_VAL = int(0.005 * (1 << 32))
_COIN = "CASE WHEN CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) < {} THEN 'val' ELSE 'train' END"
_LEN, _BATCH = 128, 8
# a token is a word's length; 0 ends a document
_STREAM = """st AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, id FROM (
  SELECT doc_id, unnest(w || [0]) AS id, unnest(range(len(w) + 1)) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\\S+'), lambda x: CAST(length(x) AS BIGINT)) AS w FROM documents)))"""


def _stream(spark, sf_dir) -> DataFrame:
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    return stored(pack.token_stream(documents(spark, sf_dir), ids, "doc_id", 0), "stream")


def _total(stream: DataFrame) -> int:
    return stream.agg(F.sum(F.size("ids"))).first()[0] or 0


@query(f"SELECT doc_id, {_COIN.format('CAST(doc_id AS VARCHAR)', _VAL)} AS split FROM documents")
def train_val_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", pack.hash_split(F.col("doc_id"), 0.005).alias("split"))


@query()
def generator_split(spark, sf_dir):
    """The coins of one sequential generator, computed row by row."""
    return pack.generator_split(documents(spark, sf_dir).select("doc_id"), "doc_id", 0.005)


@query(f"SELECT split, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT {_COIN.format('CAST(doc_id AS VARCHAR)', _VAL)} AS split, len(regexp_extract_all(text, '\\S+')) + 1 AS n FROM documents) GROUP BY split")
def split_counts(spark, sf_dir):
    """Documents and tokens of each split; a token is a word."""
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    rows = documents(spark, sf_dir).select(pack.hash_split(F.col("doc_id"), 0.005).alias("split"), F.concat(ids, F.array(F.lit(0))).alias("ids"))
    return pack.split_counts(rows)


_BYTE_SUM = "list_sum(list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)))"


@query(f"""WITH s AS (SELECT {_COIN.format('CAST(doc_id AS VARCHAR)', int(0.1 * (1 << 32)))} AS split, doc_id, strlen(text) + 1 AS n, coalesce({_BYTE_SUM.format('text')}, 0) + 256 AS total FROM documents)
SELECT split, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(total) AS BIGINT) AS total, count(*) AS ends FROM s GROUP BY split""")
def pack_corpus(spark, sf_dir):
    """The corpus as token files: encoded, ended, split, written as a file for each task, and read again."""
    docs, path = documents(spark, sf_dir), shared_dir(spark, "bins")
    token_bin.install(spark)
    rows = stored(pack.pack_corpus(bpe.encode_documents(docs, bpe.Tokenizer([])), F.col("ids"), "doc_id", pack.hash_split(F.col("doc_id"), 0.1), 256), "corpus")
    out = None
    for name in sorted(r.split for r in rows.select("split").distinct().collect()):
        own = rows.filter(F.col("split") == name).select("start_pos", "ids").repartitionByRange("start_pos").sortWithinPartitions("start_pos")
        own.write.format("token_bin").mode("overwrite").option("path", f"{path}/{name}").option("dtype", pack.token_dtype(257)).option("eot_id", 256).save()
        back = spark.read.format("token_bin").option("path", f"{path}/{name}").option("seq_len", 16).load()
        total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
        sums = back.agg(F.sum(F.size("ids")).alias("tokens"), F.sum(total).alias("total"), F.sum(F.size(F.filter("ids", lambda x: x == 256))).alias("ends"))
        one = sums.select(F.lit(name).alias("split"), "tokens", "total", "ends")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id, {_COIN.format('CAST(doc_id AS VARCHAR)', int(0.1 * (1 << 32)))} AS split, md5(text) AS digest, true AS ended FROM documents")
def trained_corpus(spark, sf_dir):
    """The whole way: a vocabulary trained on the corpus, which is encoded, ended, split and written as token files; then each document is read back by its own range and decoded."""
    tok, docs, path = _tokenizer(spark, sf_dir), documents(spark, sf_dir), shared_dir(spark, "trained")
    end = tok.end_id
    token_bin.install(spark)
    rows = stored(pack.pack_corpus(bpe.encode_documents(docs, tok), F.col("ids"), "doc_id", pack.hash_split(F.col("doc_id"), 0.1), end), "corpus")
    out = None
    for name in sorted(r.split for r in rows.select("split").distinct().collect()):
        own = rows.filter(F.col("split") == name)
        to = f"{path}/{name}"
        own.select("start_pos", "ids").repartitionByRange("start_pos").sortWithinPartitions("start_pos").write.format("token_bin").mode("overwrite").options(path=to, dtype=pack.token_dtype(tok.vocab_size), eot_id=end, vocab_size=tok.vocab_size).save()
        back = token_bin.spans(own.select(F.col("doc_id").alias("key"), F.col("start_pos").alias("offset"), F.size("ids").alias("n")), to)
        ended = F.get("ids", F.size("ids") - 1) == end
        plain = bpe.decode_documents(back.select(F.col("key").alias("doc_id"), F.slice("ids", F.lit(1), F.size("ids") - 1).alias("ids"), ended.alias("ended")), tok, carry=("ended",))
        one = plain.select("doc_id", F.lit(name).alias("split"), F.md5("text").alias("digest"), "ended")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH enc AS (SELECT conv_id, CAST(sum(strlen(text) + 2) AS BIGINT) AS n_ids, CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 1 ELSE 0 END) AS BIGINT) AS n_learnt FROM conversations GROUP BY conv_id)
SELECT CAST(sum(n_ids + 1) AS BIGINT) AS tokens, CAST(sum(n_learnt) AS BIGINT) AS learnt, count(*) AS ends FROM enc WHERE n_ids <= 1024""")
def masked_token_files(spark, sf_dir):
    """Packed conversations as token files with mask files beside them, read again with their lengths checked."""
    packed, path = chat.sft_pack(_conversations(spark, sf_dir)), shared_dir(spark, "sft")
    token_bin.install(spark)
    rows = pack.prefix_sum(stored(packed, "sft"), F.size("ids"), "conv_id", "start_pos").select("start_pos", "ids", "mask")
    rows.repartitionByRange("start_pos").sortWithinPartitions("start_pos").write.format("token_bin").mode("overwrite").option("path", path).option("masked", "true").option("eot_id", chat.BYTES_EOT).save()
    back = spark.read.format("token_bin").option("path", path).option("masked", "true").option("seq_len", 16).load()
    count = lambda c, v: F.sum(F.size(F.filter(c, lambda x: x == v)))
    return back.agg(F.sum(F.size("ids")).alias("tokens"), count("mask", 1).alias("learnt"), count("ids", chat.BYTES_EOT).alias("ends"))


@query("SELECT doc_id, CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos FROM documents")
def concat_offsets(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length("text") + 1).alias("n"))
    return pack.prefix_sum(rows, F.col("n"), "doc_id", "start_pos").select("doc_id", "start_pos")


@query(f"WITH {_STREAM} SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS tokens, round((SELECT sum(length(text)) FROM documents) / count(*), 3) AS chars_per_token, 0 AS eot_id, 'uint16' AS dtype FROM st")
def pack_metadata(spark, sf_dir):
    words = T.words(F.col("text"))
    rows = documents(spark, sf_dir).select(F.concat(words, F.array(F.lit(""))).alias("ids"), F.length("text").alias("chars"))
    return pack.pack_metadata(rows, F.col("chars"), 0, 1 << 16)


@query(f"""WITH {_STREAM}, t AS (SELECT count(*) AS n FROM st), o AS (SELECT range AS win, {_DRAW.format(seed=1, i='range', n=f'n - {_LEN} - 1')} AS off FROM range(64), t)
SELECT win AS "window", CAST(sum(id) FILTER (pos < off + {_LEN}) AS BIGINT) AS x_sum, CAST(sum(id) FILTER (pos > off) AS BIGINT) AS y_sum, count(*) - 1 AS n FROM o JOIN st ON pos BETWEEN off AND off + {_LEN} GROUP BY win""")
def token_windows(spark, sf_dir):
    """Windows at 64 offsets of the whole stream, drawn with replacement, and the same shifted by one."""
    stream = _stream(spark, sf_dir)
    offsets = pack.drawn_offsets(spark, 64, _total(stream), _LEN, 1)
    sum_of = lambda c: long(F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return pack.windows_at(stream, offsets, _LEN).select("window", sum_of("x").alias("x_sum"), sum_of("y").alias("y_sum"), long(F.size("x")).alias("n"))


def _token_files(spark, sf_dir, masked: bool = False) -> tuple[str, int]:
    """The stream as token files, a file for each task, and its tokens."""
    stream, path = _stream(spark, sf_dir), shared_dir(spark, "stream-bins")
    token_bin.install(spark)
    rows = stream.select("start_pos", "ids", *[F.transform("ids", lambda x: (x > 3).cast("int")).alias("mask")] * masked)
    rows.repartitionByRange(8, "start_pos").sortWithinPartitions("start_pos").write.format("token_bin").mode("overwrite").option("path", path).option("masked", str(masked)).option("dtype", "uint32").option("eot_id", 0).save()
    return path, token_bin.metadata(path)["n_tokens"]


@query(f"""WITH {_STREAM}, t AS (SELECT count(*) AS n FROM st), o AS (SELECT range AS win, {_DRAW.format(seed=1, i='range', n=f'n - {_LEN} - 1')} AS off FROM range(64), t)
SELECT win AS "window", CAST(sum(id) FILTER (pos < off + {_LEN}) AS BIGINT) AS x_sum, CAST(sum(id) FILTER (pos > off) AS BIGINT) AS y_sum, count(*) - 1 AS n FROM o JOIN st ON pos BETWEEN off AND off + {_LEN} GROUP BY win""")
def token_file_windows(spark, sf_dir):
    """The windows of 64 offsets from token files, of which the pushed filter reads the rows that the windows touch."""
    path, total = _token_files(spark, sf_dir)
    offsets, block = pack.drawn_offsets(spark, 64, total, _LEN, 1), 512
    starts = token_bin.row_starts(path, [r.offset for r in offsets.collect()], _LEN, block)
    rows = spark.read.format("token_bin").option("path", path).option("block", block).load().filter(F.col("start_pos").isin(starts))
    sum_of = lambda c: long(F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return pack.windows_at(rows, offsets, _LEN).select("window", sum_of("x").alias("x_sum"), sum_of("y").alias("y_sum"), long(F.size("x")).alias("n"))


@query(f"""WITH {_STREAM}, t AS (SELECT count(*) AS n FROM st), o AS (SELECT win, {_DRAW.format(seed=3, i='win', n=f'n - {_LEN} - 1')} AS off FROM (SELECT unnest(range(0, n // {_LEN})) AS win, n FROM t))
SELECT win AS "window", CAST(sum(id) FILTER (pos < off + {_LEN}) AS BIGINT) AS x_sum, CAST(sum(CASE WHEN id > 3 THEN id ELSE 0 END) FILTER (pos > off) AS BIGINT) AS y_masked FROM o JOIN st ON pos BETWEEN off AND off + {_LEN} GROUP BY win""")
def epoch_windows(spark, sf_dir):
    """As many random windows as the corpus has room for, with their masks, each read from the files by its own byte range."""
    path, total = _token_files(spark, sf_dir, masked=True)
    add = lambda c: long(F.aggregate(c, F.lit(0), lambda a, x: a + x))
    got = token_bin.windows(pack.drawn_offsets(spark, total // _LEN, total, _LEN, 3), path, _LEN, masked=True)
    return got.select("window", add("x").alias("x_sum"), add(F.zip_with("y", "m", lambda y, m: y * m)).alias("y_masked"))


@query(f"""WITH {_STREAM}, t AS (SELECT count(*) AS n FROM st), o AS (SELECT range AS win, {_DRAW.format(seed=2, i='range', n=f'n - {_LEN} - 1')} AS off FROM range(64), t)
SELECT win AS "window", CAST(sum(id) FILTER (pos > off AND id > 3) AS BIGINT) AS y_masked, CAST(count(*) FILTER (pos > off AND id > 3) AS BIGINT) AS m_sum FROM o JOIN st ON pos BETWEEN off AND off + {_LEN} GROUP BY win""")
def masked_windows(spark, sf_dir):
    """Windows with a mask that goes with the targets: here, tokens above 3."""
    stream = _stream(spark, sf_dir).withColumn("mask", F.transform("ids", lambda x: (x > 3).cast("int")))
    offsets = pack.drawn_offsets(spark, 64, _total(stream), _LEN, 2)
    add = lambda c: long(F.aggregate(c, F.lit(0), lambda a, x: a + x))
    got = pack.windows_at(stream, offsets, _LEN, ["mask"])
    return got.select("window", F.nullif(add(F.zip_with("y", "mask", lambda y, m: y * m)), F.lit(-1)).alias("y_masked"), add("mask").alias("m_sum"))


@query(f"""WITH {_STREAM}, s AS (SELECT pos, id, lead(id) OVER (ORDER BY pos) AS y FROM st), t AS (SELECT (count(*) - 1) // {_BATCH * _LEN} AS steps FROM st)
SELECT pos // {_BATCH * _LEN} AS step, (pos // {_LEN}) % {_BATCH} AS row, CAST(sum(id) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum FROM s, t WHERE pos < steps * {_BATCH * _LEN} GROUP BY 1, 2""")
def val_sweep(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    add = lambda c: long(F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return pack.sweep(stream, _total(stream), _BATCH, _LEN).select("step", "row", add("x").alias("x_sum"), add("y").alias("y_sum"))


@query("""SELECT doc_id, CAST(coalesce(list_sum(w[:-2]), 0) AS BIGINT) AS x_sum, CAST(coalesce(list_sum(w[2:]), 0) AS BIGINT) AS y_sum FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\\S+'), lambda x: length(x)) AS w FROM documents)""")
def next_token_shift(spark, sf_dir):
    x, y = pack.shifted(F.transform(T.words(F.col("text")), lambda w: F.length(w)))
    add = lambda c: long(F.aggregate(c, F.lit(0), lambda a, v: a + v))
    return documents(spark, sf_dir).select("doc_id", add(x).alias("x_sum"), add(y).alias("y_sum"))


@query("SELECT vec_id, vec_id // 32 AS step FROM embeddings WHERE vec_id // 32 < (SELECT count(*) // 32 FROM embeddings)")
def preference_batches(spark, sf_dir):
    return pack.row_batches(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 32)


# ---------------------------------------------------------------- conversations and preferences

_ENC = "enc AS (SELECT conv_id, CAST(sum(strlen(text) + 2) AS BIGINT) AS n_ids, CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 1 ELSE 0 END) AS BIGINT) AS n_learnt FROM conversations GROUP BY conv_id)"


def _conversations(spark, sf_dir) -> DataFrame:
    return chat.encode_conversations(table(spark, sf_dir, "conversations"))


def _ones(mask: str) -> Column:
    return long(F.aggregate(mask, F.lit(0), lambda a, x: a + x))


@query(f"WITH {_ENC} SELECT conv_id, n_ids, n_learnt FROM enc")
def conversation_encode(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", long(F.size("ids")).alias("n_ids"), _ones("mask").alias("n_learnt"))


@query("SELECT conv_id, turn, role, CAST(strlen(text) + 2 AS BIGINT) AS n_ids, CAST(CASE WHEN role = 'assistant' THEN strlen(text) + 1 ELSE 0 END AS BIGINT) AS n_learnt FROM conversations")
def turn_mask_counts(spark, sf_dir):
    t = chat.turn_ids(F.col("role"), chat.byte_ids(F.col("text")), chat.BYTES)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("t"))
    return rows.select("conv_id", "turn", "role", long(F.size("t.ids")).alias("n_ids"), _ones("t.mask").alias("n_learnt"))


@query(f"WITH {_ENC} SELECT conv_id, n_ids + 1 AS n_ids, n_learnt, {_COIN.format('CAST(conv_id AS VARCHAR)', int(0.02 * (1 << 32)))} AS split FROM enc WHERE n_ids <= 1024")
def sft_pack(spark, sf_dir):
    rows = chat.sft_pack(_conversations(spark, sf_dir))
    return rows.select("conv_id", long(F.size("ids")).alias("n_ids"), _ones("mask").alias("n_learnt"), pack.hash_split(F.col("conv_id"), 0.02).alias("split"))


@query(f"WITH {_ENC} SELECT CASE WHEN n_ids = 0 THEN 'empty' WHEN n_ids > 1024 THEN 'too_long' ELSE 'kept' END AS verdict, count(*) AS n FROM enc GROUP BY 1")
def skip_accounting(spark, sf_dir):
    return _conversations(spark, sf_dir).groupBy(chat.sft_verdict(F.col("ids")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ENC} SELECT round(sum(n_learnt) / greatest(sum(n_ids), 1), 6) AS trainable FROM enc")
def trainable_fraction(spark, sf_dir):
    rows = _conversations(spark, sf_dir)
    return rows.agg(r6(F.sum(_ones("mask")) / F.greatest(F.sum(F.size("ids")), F.lit(1)), "trainable"))


@query(f"""WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'code' ELSE 'chat' END AS source FROM conversations),
r AS (SELECT conv_id, source, unnest(range(CASE WHEN source = 'code' THEN 3 ELSE 1 END)) AS rep FROM c)
SELECT source, {_COIN.format("CAST(conv_id AS VARCHAR) || ':' || CAST(rep AS VARCHAR)", int(0.02 * (1 << 32)))} AS split, count(*) AS n FROM r GROUP BY 1, 2""")
def source_mix_repeat(spark, sf_dir):
    """Two sources in one, the second three times over; each repeat draws its own coin."""
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    one = rows.filter("conv_id % 5 <> 0").select("conv_id", F.lit("chat").alias("source"), F.lit(0).alias("rep"))
    two = rows.filter("conv_id % 5 = 0").select("conv_id", F.lit("code").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rep"))
    coin = pack.hash_split(F.concat_ws(":", "conv_id", "rep"), 0.02)
    return one.unionByName(two).groupBy("source", coin.alias("split")).agg(F.count(F.lit(1)).alias("n"))


_PREF = """pref AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS prompt, arg_min(text, turn) FILTER (role = 'assistant') AS chosen, arg_max(text, turn) FILTER (role = 'assistant') AS rejected FROM conversations GROUP BY conv_id)"""


def _preferences(spark, sf_dir) -> DataFrame:
    user, own = F.col("role") == "user", F.col("role") == "assistant"
    said = lambda pick, who: pick(F.when(who, F.col("text")), F.when(who, F.col("turn")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said(F.min_by, user).alias("prompt"), said(F.min_by, own).alias("chosen"), said(F.max_by, own).alias("rejected"))
    return rows.filter("prompt is not null and chosen is not null")


@query(f"""WITH {_PREF} SELECT conv_id, p + c <= 512 AND p + r <= 512 AS fits, CAST(CASE WHEN p + c <= 512 AND p + r <= 512 THEN c ELSE 0 END AS BIGINT) AS chosen_learnt, CAST(CASE WHEN p + c <= 512 AND p + r <= 512 THEN r ELSE 0 END AS BIGINT) AS rejected_learnt,
  CAST(CASE WHEN p + c <= 512 AND p + r <= 512 THEN 512 ELSE 0 END AS BIGINT) AS width FROM (SELECT conv_id, strlen(prompt) + 3 AS p, strlen(chosen) + 1 AS c, strlen(rejected) + 1 AS r FROM pref WHERE prompt IS NOT NULL AND chosen IS NOT NULL)""")
def preference_pairs(spark, sf_dir):
    rows = chat.preference_pairs(_preferences(spark, sf_dir), 512)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    learnt = [none(F.when(F.col(f"{s}_mask").isNotNull(), _ones(f"{s}_mask"))).alias(f"{s}_learnt") for s in ("chosen", "rejected")]
    return rows.select("conv_id", F.col("chosen_ids").isNotNull().alias("fits"), *learnt, none(F.when(F.col("chosen_ids").isNotNull(), long(F.size("chosen_ids")))).alias("width"))


_PACKED = f"""{_PREF}, pr AS (SELECT conv_id, strlen(prompt) + 3 AS p, strlen(chosen) + 1 AS c, strlen(rejected) + 1 AS r, {_COIN.format("CAST(conv_id AS VARCHAR)", int(0.2 * (1 << 32)))} AS split FROM pref WHERE prompt IS NOT NULL AND chosen IS NOT NULL),
cp AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY conv_id) AS k FROM pr), ft AS (SELECT * FROM cp WHERE k <= CASE WHEN split = 'train' THEN 150 ELSE 15 END AND p + c <= 2048 AND p + r <= 2048),
pk AS (SELECT conv_id, split, row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1 AS row, CAST(c AS BIGINT) AS chosen_learnt, CAST(r AS BIGINT) AS rejected_learnt FROM ft)"""


def _packed(spark, sf_dir, split: str) -> DataFrame:
    path = shared_dir(spark, "preferences")
    chat.write_preferences(chat.pack_preferences(_preferences(spark, sf_dir), "conv_id", pack.hash_split(F.col("conv_id"), 0.2), 2048, 150), path)
    rows = chat.read_preferences(spark, path, split, "conv_id")
    return rows.select("conv_id", "row", _ones("chosen_mask").alias("chosen_learnt"), _ones("rejected_mask").alias("rejected_learnt"))


@query(f"WITH {_PACKED} SELECT conv_id, split, row, chosen_learnt, rejected_learnt FROM pk")
def preference_arrays(spark, sf_dir):
    """Preference pairs packed under the caps of their splits (150 and a tenth), written, and read again with their lengths checked."""
    both = [_packed(spark, sf_dir, name).withColumn("split", F.lit(name)) for name in ("train", "val")]
    return both[0].unionByName(both[1]).select("conv_id", "split", "row", "chosen_learnt", "rejected_learnt")


@query(f"WITH {_PACKED}, n AS (SELECT count(*) AS n FROM pk WHERE split = 'train'), d AS (SELECT range AS draw, {_DRAW.format(seed=5, i='range', n='n')} AS spot FROM range(64), n) SELECT draw, conv_id, chosen_learnt FROM d JOIN pk ON pk.row = spot AND split = 'train'")
def preference_sample(spark, sf_dir):
    """Rows of the packed pairs drawn with replacement."""
    rows = stored(_packed(spark, sf_dir, "train"), "train")
    return pack.drawn_rows(rows, "row", 64, rows.count(), 5).select("draw", "conv_id", "chosen_learnt")


@query(f"""WITH {_PREF} SELECT conv_id, CAST(256 AS BIGINT) AS width, CAST(greatest(least(strlen(prompt) + strlen(chosen), 256) - least(strlen(prompt), 256), 0) AS BIGINT) AS learnt FROM pref WHERE prompt IS NOT NULL AND chosen IS NOT NULL""")
def rollout_pack(spark, sf_dir):
    row = chat.rollout_row(chat.byte_ids(F.col("prompt")), chat.byte_ids(F.col("chosen")), chat.BYTES.end, 256)
    rows = _preferences(spark, sf_dir).select("conv_id", row.alias("r"))
    return rows.select("conv_id", long(F.size("r.ids")).alias("width"), _ones("r.mask").alias("learnt"))


@query(f"WITH {_ENC} SELECT conv_id, n_ids + 1 AS n_ids, 257 AS last_id FROM enc")
def serving_prompt(spark, sf_dir):
    rows = chat.serving_prompts(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", long(F.size("ids")).alias("n_ids"), F.element_at("ids", -1).alias("last_id"))


# ---------------------------------------------------------------- rewards

_COMPLETIONS = """co AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no answer here' WHEN 1 THEN 'steps\n#### ' || o_orderkey WHEN 2 THEN '#### 1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
  WHEN 3 THEN '#### 7 then #### ' || (o_orderkey + 1) ELSE '#### -' || o_orderkey || '.5' END AS completion, CASE WHEN o_orderkey % 2 = 0 THEN '#### ' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS gold FROM orders),
an AS (SELECT o_orderkey, replace(regexp_extract_all(completion, '####\\s*(-?[\\d,]+(?:\\.\\d+)?)', 1)[-1], ',', '') AS answer, coalesce(replace(regexp_extract_all(gold, '####\\s*(-?[\\d,]+(?:\\.\\d+)?)', 1)[-1], ',', ''), gold) AS g FROM co),
rw AS (SELECT o_orderkey, answer, CASE WHEN answer IS NULL THEN 0.0 ELSE 1.0 + CASE WHEN abs(CAST(answer AS DOUBLE) - CAST(g AS DOUBLE)) < 1e-4 THEN 3.0 ELSE 0.0 END END AS reward FROM an)"""


def _completions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.lit("no answer here")).when(kind == 1, F.concat(F.lit("steps\n#### "), k)).when(kind == 2, F.concat(F.lit("#### 1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")))
        .when(kind == 3, F.concat(F.lit("#### 7 then #### "), (F.col("o_orderkey") + 1).cast("string"))).otherwise(F.concat(F.lit("#### -"), k, F.lit(".5")))
    )
    gold = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("#### "), k)).otherwise(k)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("completion"), gold.alias("gold"))


@query(f"WITH {_COMPLETIONS} SELECT o_orderkey, answer FROM an")
def extract_answer(spark, sf_dir):
    return _completions(spark, sf_dir).select("o_orderkey", reward.extract_answer(F.col("completion")).alias("answer"))


@query(f"WITH {_COMPLETIONS} SELECT o_orderkey, CAST(reward AS DOUBLE) AS reward FROM rw")
def math_reward(spark, sf_dir):
    return _completions(spark, sf_dir).select("o_orderkey", reward.reward(F.col("completion"), F.col("gold")).alias("reward"))


@query(f"WITH {_COMPLETIONS} SELECT round(avg(CASE WHEN reward >= 4 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rw")
def reward_accuracy(spark, sf_dir):
    return reward.accuracy(math_reward(spark, sf_dir)).select(r6("accuracy", "accuracy"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-4), 6) + 0.0 AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def group_advantages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return reward.group_advantages(rows, "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", r6("advantage", "advantage"))


@query("SELECT event_id // 8 AS \"group\", event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-4), 4) + 0.0 AS advantage FROM events WINDOW w AS (PARTITION BY event_id // 8)")
def positional_advantages(spark, sf_dir):
    """Groups of eight consecutive rewards."""
    rows = reward.positional_groups(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 8)
    return reward.group_advantages(rows, "group", "value").select("group", "event_id", (F.round("advantage", 4) + F.lit(0.0)).alias("advantage"))


# ---------------------------------------------------------------- objectives

_STEPS = "WITH s AS (SELECT range AS step FROM range(1100))"


@query(f"""{_STEPS} SELECT step, round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 WHEN step < 800 THEN 0.001 WHEN step >= 1000 THEN 0.0001 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos({math.pi!r} * ((step - 800) / 200))) END, 9) AS cosine,
  round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 WHEN step < 800 THEN 0.001 WHEN step >= 1000 THEN 0.0001 ELSE 0.0001 + 0.0009 * (1 - (step - 800) / 200) END, 9) AS linear,
  round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 WHEN step < 800 THEN 0.001 WHEN step >= 1000 THEN 0.0001 ELSE 0.0001 + 0.0009 * (1 - sqrt(greatest(step - 800, 0) / 200)) END, 9) AS sqrt FROM s""")
def wsd_lr(spark, sf_dir):
    lr = lambda shape: F.round(objectives.wsd_lr(F.col("step"), 1e-3, 1000, 100, 0.2, 0.1, shape), 9).alias(shape)
    return spark.range(1100).select(F.col("id").alias("step")).select("step", lr("cosine"), lr("linear"), lr("sqrt"))


@query(f"""{_STEPS} SELECT step, round(CASE WHEN step < 100 THEN 0.00001 + 0.00099 * (step / 100) WHEN step < 800 THEN 0.001 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos({math.pi!r} * least((step - 800) / 200, 1.0))) END, 9) AS lr,
  round(CASE WHEN step < 100 THEN 0.00001 + 0.00099 * (step / 100) ELSE 0.001 END, 9) AS lr_flat FROM s""")
def wsd_schedule(spark, sf_dir):
    lr = lambda frac, name: F.round(objectives.wsd_schedule(F.col("step"), 1e-3, 1000, 100, frac, 0.1), 9).alias(name)
    return spark.range(1100).select(F.col("id").alias("step")).select("step", lr(0.2, "lr"), lr(0.0, "lr_flat"))


_PRESETS = "c AS (SELECT * FROM (VALUES ('135m', 32769, 576, 30, 9, 3, 1536), ('360m', 32769, 960, 32, 15, 5, 2560), ('tiny', 32769, 128, 4, 4, 2, 352)) t(name, v, d, l, h, k, f))"


@query(f"WITH {_PRESETS} SELECT name, CAST(v * d + l * (2 * d * d + 2 * d * k * (d // h) + 3 * d * f + 2 * d) + d AS BIGINT) AS n_params FROM c")
def param_count(spark, sf_dir):
    return objectives.tensor_sizes(objectives.presets(spark)).groupBy("name").agg(F.sum("size").alias("n_params"))


@query(f"""WITH {_PRESETS} SELECT name, unnest(['embedding', 'attention', 'feed_forward', 'block_norms', 'final_norm', 'lm_head']) AS part,
  unnest([CAST(v * d AS BIGINT), l * (2 * d * d + 2 * d * k * (d // h)), l * 3 * d * f, l * 2 * d, d, 0]) AS size FROM c""")
def param_groups(spark, sf_dir):
    return objectives.tensor_sizes(objectives.presets(spark))


@query(f"WITH {_PRESETS}, n AS (SELECT name, v * d + l * (2 * d * d + 2 * d * k * (d // h) + 3 * d * f + 2 * d) + d AS n FROM c) SELECT name, CAST(2 * n AS BIGINT) AS bytes_16, CAST(ceil(n * 4 / 8) + ceil(n / 64) * 4 AS BIGINT) AS bytes_4 FROM n")
def size_report(spark, sf_dir):
    n = F.col("n_params")
    return param_count(spark, sf_dir).select("name", long(2 * n).alias("bytes_16"), long(objectives.quantized_bytes(n)).alias("bytes_4"))


@query("SELECT user_id, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY event_id), lambda a, x: 0.9 * a + 0.1 * x), 6) + 0.0 AS ema FROM events GROUP BY user_id")
def ema_fold(spark, sf_dir):
    return objectives.ema(table(spark, sf_dir, "events"), "value", "event_id", "user_id", 0.9).select("user_id", r6("ema", "ema"))


_EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _neg(first: int, n: int) -> Column:
    """Log-probability stand-ins: a run of components, made negative."""
    return F.transform(F.slice("x", first, n), lambda v: -F.abs(v))


@query(f"WITH {_EMB}, t AS (SELECT unnest(list_transform(x, lambda v: abs(v))) AS nll FROM e) SELECT round(avg(nll), 6) AS loss, round(exp(avg(nll)), 6) AS perplexity FROM t")
def perplexity(spark, sf_dir):
    rows = objectives.cross_entropy(_embeddings(spark, sf_dir).select(_neg(1, 64).alias("logp")))
    return rows.select(r6("loss", "loss"), r6("perplexity", "perplexity"))


@query(f"WITH {_EMB}, t AS (SELECT unnest(x) AS v, unnest(range(64)) AS i FROM e) SELECT round(sum(abs(v)) FILTER (i % 3 = 0) / greatest(count(*) FILTER (i % 3 = 0), 1), 6) AS loss FROM t")
def masked_ce(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 3 == 0).cast("int"))
    return objectives.masked_cross_entropy(_embeddings(spark, sf_dir).select(_neg(1, 64).alias("logp"), mask.alias("mask"))).select(r6("loss", "loss"))


@query(f"WITH {_EMB} SELECT vec_id, round(list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN -abs(x[i]) ELSE 0 END)), 6) + 0.0 AS logp FROM e")
def sequence_logp(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i % 2 == 1).cast("int"))
    return _embeddings(spark, sf_dir).select("vec_id", r6(objectives.sequence_logp(_neg(1, 15), mask), "logp"))


@query(f"""WITH {_EMB}, m AS (SELECT 0.1 * (x[1] - x[3]) AS c, 0.1 * (x[2] - x[4]) AS r FROM e) SELECT round(avg(greatest(-(c - r), 0) + ln(1 + exp(-abs(c - r)))), 6) AS loss, round(avg(c - r), 6) + 0.0 AS margin, round(avg(CASE WHEN c - r > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM m""")
def dpo_metrics(spark, sf_dir):
    x = lambda i: F.get("x", F.lit(i))
    rows = _embeddings(spark, sf_dir).select(x(0).alias("policy_chosen"), x(1).alias("policy_rejected"), x(2).alias("ref_chosen"), x(3).alias("ref_rejected"))
    return objectives.means(objectives.dpo_rows(rows), "loss", "margin", "accuracy").select(r6("loss", "loss"), r6("margin", "margin"), r6("accuracy", "accuracy"))


@query(f"""WITH {_EMB}, t AS (SELECT CAST(label AS DOUBLE) AS adv, unnest(range(16)) AS i, unnest(x[1:16]) AS a, unnest(x[17:32]) AS b FROM e), k AS (SELECT adv, -abs(a) AS p, -abs(b) + abs(a) AS d FROM t WHERE i % 2 = 0)
SELECT round(sum(-adv * p + 0.04 * (exp(d) - d - 1)) / greatest(count(*), 1), 6) AS loss, round(sum(exp(d) - d - 1) / greatest(count(*), 1), 6) AS kl, (SELECT round(avg(CAST(label AS DOUBLE)), 6) FROM e) AS mean_advantage FROM k""")
def grpo_loss(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i % 2 == 0).cast("int"))
    rows = _embeddings(spark, sf_dir).select(_neg(1, 16).alias("policy_logp"), _neg(17, 16).alias("ref_logp"), mask.alias("mask"), F.col("label").cast("double").alias("advantage"))
    return objectives.grpo_loss(rows).select(r6("loss", "loss"), r6("kl", "kl"), r6("mean_advantage", "mean_advantage"))


@query(f"WITH {_EMB}, k AS (SELECT vec_id, x, list_reverse_sort(x)[8] AS kth FROM e) SELECT vec_id, CAST(len(list_filter(x, lambda v: v >= kth)) AS BIGINT) AS kept, round(list_sum(list_filter(x, lambda v: v >= kth)) / 0.7, 6) + 0.0 AS kept_sum FROM k")
def topk_mask(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", F.filter(objectives.top_k(F.col("x"), 8, 0.7), lambda v: v > float("-inf")).alias("k"))
    return rows.select("vec_id", long(F.size("k")).alias("kept"), r6(objectives.total(F.col("k")), "kept_sum"))


@query(f"WITH {_EMB}, p AS (SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN i - 1 < 8 THEN CASE WHEN v > 0 THEN v / 1.3 ELSE v * 1.3 END ELSE v END) AS x FROM e) SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS next_id, round(list_sum(x), 6) + 0.0 AS total FROM p")
def repetition_penalty(spark, sf_dir):
    seen = F.sequence(F.lit(0), F.lit(7))
    rows = _embeddings(spark, sf_dir).select("vec_id", objectives.repetition_penalty(F.col("x"), seen, 1.3).alias("x"))
    return rows.select("vec_id", objectives.greedy(F.col("x")).alias("next_id"), r6(objectives.total(F.col("x")), "total"))


@query()
def categorical_sample(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", objectives.categorical(F.col("x"), F.col("vec_id")).alias("next_id"))


@query(f"""WITH {_EMB}, q AS (SELECT vec_id, x, list_min(x) AS lo, (list_max(x) - list_min(x)) / 15 AS sc FROM e) SELECT vec_id, round(sc, 9) AS scale, round(lo, 9) + 0.0 AS bias, CAST(list_sum(list_transform(x, lambda v: floor((v - lo) / sc + 0.5))) AS BIGINT) AS code_sum FROM q""")
def affine_quantize(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", F.explode(objectives.quantize(F.col("x"))).alias("g"))
    return rows.select("vec_id", F.round("g.scale", 9).alias("scale"), (F.round("g.bias", 9) + F.lit(0.0)).alias("bias"), _ones("g.codes").alias("code_sum"))


@query("SELECT range AS step, round(range * 1000 / (range * 0.5 + 1), 6) AS tokens_per_s FROM range(200)")
def throughput(spark, sf_dir):
    log = spark.range(200).select(F.col("id").alias("step"), (F.col("id") * 1000).alias("tokens"), (F.col("id") * 0.5 + 1).alias("elapsed_s"))
    return objectives.throughput(log).select("step", r6("tokens_per_s", "tokens_per_s"))


@query("SELECT range AS run, CASE WHEN range % 3 = 0 THEN range ELSE CASE WHEN range % 2 = 0 THEN range * 10 ELSE 7 END END AS steps FROM range(30)")
def config_precedence(spark, sf_dir):
    i = F.col("id")
    return spark.range(30).select(i.alias("run"), objectives.first_set(F.when(i % 3 == 0, i), F.when(i % 2 == 0, i * 10), F.lit(7).cast("long")).alias("steps"))


# ---------------------------------------------------------------- evaluation


@query(f"WITH {_EMB} SELECT vec_id, round(list_sum(list_transform(x[1:8], lambda v: -abs(v))), 6) + 0.0 AS logp, len(list_filter(x[1:8], lambda v: v <= 0)) = 0 AS greedy FROM e")
def loglikelihood(spark, sf_dir):
    tokens = _embeddings(spark, sf_dir).select("vec_id", F.explode(F.slice("x", 1, 8)).alias("v")).select("vec_id", (-F.abs("v")).alias("logp"), (F.col("v") > 0).alias("is_argmax"))
    return evaluate.with_empty(_embeddings(spark, sf_dir), evaluate.loglikelihood(tokens, "vec_id"), "vec_id").select("vec_id", r6("logp", "logp"), "greedy")


@query(f"""WITH {_EMB}, q AS (SELECT vec_id // 4 AS q, vec_id % 4 AS c, x[1] AS s, label % 4 AS g FROM e), b AS (SELECT q, arg_max(c, s) AS c, min(g) AS g FROM q GROUP BY q) SELECT count(*) AS questions, round(avg(CASE WHEN c = g THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b""")
def choice_accuracy(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("q"), (F.col("vec_id") % 4).alias("c"), F.get("x", F.lit(0)).alias("s"), (F.col("label") % 4).alias("g"))
    gold = rows.groupBy("q").agg(F.min("g").alias("gold"))
    return evaluate.choice_accuracy(rows.join(gold, "q"), "q", "c", "s", "gold").select("questions", r6("accuracy", "accuracy"))


_LENGTHS = "w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\S+'), lambda x: CAST(length(x) AS INTEGER)) AS ids FROM documents)"


def _lengths(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.transform(T.words(F.col("text")), lambda w: F.length(w)).alias("ids"))


@query(f"""WITH {_LENGTHS}, c AS (SELECT doc_id, ids, unnest(range(CAST(ceil(len(ids) / 64) AS BIGINT))) AS chunk FROM w)
SELECT doc_id, chunk, CASE WHEN chunk = 0 THEN 0 ELSE ids[chunk * 64] END AS context, CAST(len(ids[chunk * 64 + 1:chunk * 64 + 64]) AS BIGINT) AS n, CAST(list_sum(ids[chunk * 64 + 1:chunk * 64 + 64]) AS BIGINT) AS total FROM c""")
def rolling_chunks(spark, sf_dir):
    rows = evaluate.rolling_chunks(_lengths(spark, sf_dir), "doc_id", "ids", 64, 0)
    return rows.select("doc_id", long("chunk").alias("chunk"), F.get("context", F.lit(0)).alias("context"), long(F.size("continuation")).alias("n"), _ones("continuation").alias("total"))


@query(f"""WITH {_LENGTHS}, k AS (SELECT doc_id, ids, least(len(ids), 28) AS n FROM w) SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(coalesce(list_sum(ids[len(ids) - n + 1:len(ids)]), 0) AS BIGINT) AS total FROM k""")
def left_truncate(spark, sf_dir):
    """Contexts cut from the left so that five more ids fit in 32 + 1."""
    kept = evaluate.cut_context(F.col("ids"), F.array(*map(F.lit, range(5))), 32)
    return _lengths(spark, sf_dir).select("doc_id", kept.alias("k")).select("doc_id", long(F.size("k")).alias("n"), _ones("k").alias("total"))


@query("SELECT doc_id, CASE WHEN contains(text, 'zz') THEN string_split(text, 'zz')[1] WHEN contains(text, chr(10)) THEN string_split(text, chr(10))[1] WHEN contains(text, '. ') THEN string_split(text, '. ')[1] ELSE text END AS cut FROM documents")
def stop_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", evaluate.stop_at(F.col("text"), ["zz", "", "\n", ". "]).alias("cut"))


@query("SELECT 'r' AS results, 'c' AS configs")
def eval_result_keys(spark, sf_dir):
    return evaluate.kept_results(spark.range(1).select(F.lit("r").alias("results"), F.lit("c").alias("configs"), F.lit("s").alias("samples")))


_TINY = objectives.ModelConfig(vocab_size=260, dim=32, n_layers=2, n_heads=4, n_kv_heads=2, hidden_dim=64, max_seq_len=256)


@query()
def model_loglikelihood(spark, sf_dir):
    """Every benchmark text scored by a small decoder with seeded weights."""
    request = evaluate.scoring_request(F.array().cast("array<int>"), chat.byte_ids(F.col("text")), 1 << 20, chat.BYTES_EOT)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), request.alias("r")).select("row_id", "r.ids", "r.start")
    tokens = model.score_rows(rows, model.initial_weights(_TINY), _TINY)
    return evaluate.with_empty(rows, evaluate.loglikelihood(tokens, "row_id"), "row_id").select("row_id", F.round("logp", 3).alias("logp"), "greedy")


@query()
def model_generate(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), evaluate.generation_context(chat.byte_ids(F.col("text")), 256, 128).alias("ids"))
    return model.generate_rows(rows, model.initial_weights(_TINY), _TINY, 16, chat.BYTES_EOT)


#: A decoder that says the next byte after each, so what it scores and generates can be said in SQL.
_NEXT = objectives.ModelConfig(vocab_size=256, dim=256, n_layers=1, n_heads=4, n_kv_heads=2, hidden_dim=16, tie_embeddings=False, max_seq_len=64, norm_eps=0.0)
_BYTES = "raw AS (SELECT item_id AS row_id, list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)) AS b FROM benchmark)"
_MISSES = "CAST(len(list_filter(range(1, len(b) + 1), lambda i: b[i] <> (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END + 1) % 256)) AS BIGINT)"


def _byte_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), chat.byte_ids(F.col("text")).alias("ids"))


@query(f"WITH {_BYTES} SELECT row_id, {_MISSES} AS misses, {_MISSES} = 0 AS greedy FROM raw")
def successor_loglikelihood(spark, sf_dir):
    """Whole texts after an empty context, scored by the decoder that says the next byte: a wrong byte costs 16 nats."""
    request = evaluate.scoring_request(F.array().cast("array<int>"), F.col("ids"), 1 << 20, 0)
    rows = _byte_rows(spark, sf_dir).select("row_id", request.alias("r")).select("row_id", "r.ids", "r.start")
    scored = evaluate.loglikelihood(model.score_rows(rows, model.successor_weights(_NEXT), _NEXT), "row_id")
    return evaluate.with_empty(rows, scored, "row_id").select("row_id", long(F.round(-F.col("logp") / 16)).alias("misses"), "greedy")


@query(f"WITH {_BYTES} SELECT row_id, {_MISSES} AS misses FROM raw")
def rolling_loglikelihood(spark, sf_dir):
    """Whole texts in chunks of the decoder's 64 places."""
    scored = model.rolling_loglikelihood(_byte_rows(spark, sf_dir), model.successor_weights(_NEXT), _NEXT, 0)
    return scored.select("row_id", long(F.round(-F.col("logp") / 16)).alias("misses"))


@query("""WITH c AS (SELECT item_id AS row_id, ascii(right(substr(regexp_replace(text, '[^ -z]', '', 'g'), 1, 20 + item_id % 50), 1)) AS b FROM benchmark),
g AS (SELECT row_id, list_transform(range(1, 17), lambda i: chr(CAST(b + i AS INTEGER))) AS s FROM c), h AS (SELECT row_id, s, coalesce(list_min(list_filter(range(1, 17), lambda i: s[i] = '7' OR s[i] = '{')), 0) AS hit FROM g)
SELECT row_id, CAST(CASE WHEN hit = 0 THEN 16 ELSE hit END AS BIGINT) AS n_ids, array_to_string(CASE WHEN hit = 0 THEN s ELSE s[1:hit - 1] END, '') AS text FROM h""")
def generate_until(spark, sf_dir):
    """Greedy text after each context, up to 16 bytes or a stop string."""
    context = F.substring(F.regexp_replace("text", "[^ -z]", ""), F.lit(1), (20 + F.col("item_id") % 50).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), chat.byte_ids(context).alias("ids"))
    return model.generate_until(rows, model.successor_weights(_NEXT), _NEXT, bpe.Tokenizer([]), ["{", "7"], 16, 0)


@query(f"""SELECT item_id AS row_id, s.range AS sample_idx, 'ABCDEFGH' AS text, CAST(0 AS DOUBLE) AS reward, CAST(600 AS BIGINT) AS width, CAST(greatest(least(8, 600 - ({len(reward.PROMPT)} + 3 + strlen(text))), 0) AS BIGINT) AS learnt FROM benchmark, range(2) s""")
def rollout_scores(spark, sf_dir):
    """Two completions of each prompt, scored and packed. The assistant's tag is the byte before A."""
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("question"), F.lit("7").alias("gold"))
    rows = model.rollout(prompts, model.successor_weights(_NEXT), _NEXT, bpe.Tokenizer([]), chat.ChatFormat(1, 64, 3), 2, 8, 600)
    return rows.select("row_id", long("sample_idx").alias("sample_idx"), "text", "reward", long(F.size("ids")).alias("width"), _ones("mask").alias("learnt"))


@query()
def vector_search(spark, sf_dir):
    """The ten nearest of all embeddings for each whose id is divisible by 100, by inverted lists of product-quantised residuals."""
    rows = table(spark, sf_dir, "embeddings")
    book = vectors.fit(rows, "vec_id", "embedding")
    codes = stored(vectors.index(rows, "vec_id", "embedding", book), "codes")
    got = vectors.search(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", book, codes)
    return got.select("query", long("rank").alias("rank"), F.col("id").alias("vec_id"), r6("distance", "distance"))


@query()
def page_main_text(spark, sf_dir):
    """The main text of each page."""
    got = mainpage.main_texts(table(spark, sf_dir, "pages"))
    return got.select("page_id", long(F.length("text")).alias("chars"), F.md5("text").alias("digest"), "first", "end")


# ---------------------------------------------------------------- sketches


@query(f"""WITH {_CHECKED}, r AS (SELECT d.lang, d.source, unnest(CASE WHEN len(fails) = 0 THEN ['kept'] ELSE fails END) AS rule, length(d.text) AS chars FROM checked JOIN documents d USING (doc_id))
SELECT lang, source, rule, grouping(lang, source, rule) AS level, count(*) AS n, min(chars) AS low, max(chars) AS high FROM r GROUP BY CUBE (lang, source, rule)""")
def rule_cube(spark, sf_dir):
    """Documents by language, source and failed rule, and by every subset of these, merged from sketches that are made a part of the corpus at a time and stored."""
    dims = ["lang", "source", "rule"]
    rule = F.explode(F.when(F.size("fails") == 0, F.array(F.lit("kept"))).otherwise(F.col("fails"))).alias("rule")
    rows = _checked(spark, sf_dir).select("lang", "source", rule, "text", F.length("text").alias("chars"))
    parts = [sketches.sketched(rows.filter(part), dims, F.col("text"), F.col("chars")) for part in (F.col("chars") % 2 == 0, F.col("chars") % 2 == 1)]
    got = sketches.cube(stored(parts[0].unionByName(parts[1]), "sketches"), dims)
    return got.select(*dims, long("level").alias("level"), "n", sketches.quantile("spread", 0.0).alias("low"), sketches.quantile("spread", 1.0).alias("high"))


# ---------------------------------------------------------------- timed rows

_GAP, _DELAY = 1800, 7200


@query("""SELECT c.click_id, s.sale_id FROM clicks c ASOF LEFT JOIN (SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY client_id, sold_at) s
ON c.client_id = s.client_id AND c.ts >= s.sold_at""")
def clicks_last_sale(spark, sf_dir):
    """Each click with its client's last sale at or before it."""
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    return temporal.asof_join(clicks.select("click_id", "client_id", "ts"), sales, "client_id", "ts", "sold_at", ["sale_id"], "sale_id").select("click_id", "sale_id")


_SESSIONS = f"""t AS (SELECT client_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, click_id) AS i FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL{{late}}),
f AS (SELECT client_id, t, i, CASE WHEN t - lag(t) OVER (PARTITION BY client_id ORDER BY i) <= {_GAP * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM t),
g AS (SELECT client_id, t, sum(fresh) OVER (PARTITION BY client_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT client_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM g GROUP BY client_id, run)"""
_IN_TIME = f" AND epoch_us(arrived_at) - epoch_us(ts) <= {_DELAY * 1_000_000}"


@query(f"WITH {_SESSIONS.format(late='')} SELECT client_id, first_us, last_us, n FROM s")
def click_sessions(spark, sf_dir):
    """Runs of a client's clicks with half an hour between them at most."""
    got = temporal.sessions(table(spark, sf_dir, "clicks"), "client_id", "ts", _GAP)
    return got.select("client_id", temporal.micros(F.col("first")).alias("first_us"), temporal.micros(F.col("last")).alias("last_us"), "n")


@query(f"""WITH {_SESSIONS.format(late=_IN_TIME)} SELECT client_id, first_us, last_us, n, false AS late FROM s WHERE last_us + {_GAP * 1_000_000} <= (SELECT max(t) // 1000 * 1000 FROM t) - {_DELAY * 1_000_000}
UNION ALL SELECT client_id, epoch_us(ts), epoch_us(ts), 1, true FROM clicks WHERE NOT coalesce(client_id IS NOT NULL{_IN_TIME}, false)""")
def click_session_stream(spark, sf_dir):
    """The same of a stream: the sessions that are closed once all clicks have arrived, in three starts on one checkpoint, and the late clicks."""
    clicks, base = table(spark, sf_dir, "clicks"), shared_dir(spark, "sessions")
    low, high = clicks.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    third = (high - low) / 3
    for k in range(3):
        since = F.lit(True) if k == 0 else F.col("arrived_at") >= F.lit(low + k * third)
        until = F.lit(True) if k == 2 else F.col("arrived_at") < F.lit(low + (k + 1) * third)
        part = clicks.filter(F.coalesce(since & until, F.lit(k == 2)))
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(clicks.schema).parquet(f"{base}/in")
        for q in streams.session_stream(stream, "client_id", "ts", "arrived_at", _GAP, _DELAY, f"{base}/out", f"{base}/late", f"{base}/state"):
            q.awaitTermination()
    us = temporal.micros
    closed = spark.read.parquet(f"{base}/out").select("client_id", us(F.col("first")).alias("first_us"), us(F.col("last")).alias("last_us"), "n", F.lit(False).alias("late"))
    late = spark.read.schema(clicks.schema).parquet(f"{base}/late").select("client_id", us(F.col("ts")).alias("first_us"), us(F.col("ts")).alias("last_us"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("late"))
    return closed.unionByName(late)
