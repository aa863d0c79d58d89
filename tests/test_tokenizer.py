import random
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.operators import bpe, chat

TEXT = ["the cat sat on the mat and the dog sat on the log. " * 20, "héllo wörld — 日本語 1234 it's we'll\n\n  tabs\there ", "".join(map(chr, range(256))), ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXT)), "doc_id long, text string")


@pytest.fixture(scope="module")
def tok(docs):
    return bpe.train(docs, 350)


def test_pretokens_as_the_regex_module(spark, docs):
    import regex

    got = {r.doc_id: r.c for r in docs.select("doc_id", bpe.pretokens(F.col("text")).alias("c")).collect()}
    assert got[0] == regex.findall(bpe.PATTERN, TEXT[0])
    assert got[1] == regex.findall(bpe.PATTERN, TEXT[1])


def table(spark, hist):
    return spark.createDataFrame(list(hist.items()), "chunk string, freq long")


def test_training_is_the_naive_one(spark, docs):
    hist = {r.chunk: r.freq for r in bpe.histogram(docs).collect()}
    assert bpe.train(docs, 300).merges == bpe.train_naive(hist, 300)
    for small in ({"aaaaaaa": 3, "aa": 1, "abab": 2, "ba": 5, "x": 9}, {"x": 4}, {}):
        assert [p for r in bpe.merge_rounds(table(spark, small), 400) for p in r] == bpe.train_naive(small, 400)


@pytest.mark.parametrize("seed", range(1))
def test_training_equals_the_definition_whatever_the_guesses(spark, seed):
    """Ties, runs of one letter, words that no guess sees, and words that are written anew: the merges are the same."""
    rng = random.Random(seed)
    hist = {"".join(rng.choice("aabbc é") for _ in range(rng.randrange(1, 14))): rng.choice([1, 1, 2, 3, 50]) for _ in range(300)}
    for vocab, how in ((286, {"frequent": 100, "ahead": 40, "most": 16}), (258, {"frequent": 0})):
        rounds = list(bpe.merge_rounds(table(spark, hist), vocab, **how))
        assert all(rounds) and [p for r in rounds for p in r] == bpe.train_naive(hist, vocab)


def test_training_takes_a_tenth_of_the_rounds(spark):
    """Of 120 merges over the table's documents, with guesses from half of the different words; from all of them, rounds double."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hist = bpe.histogram(docs).persist()
    words = {r.chunk: r.freq for r in hist.collect()}
    rounds = list(bpe.merge_rounds(hist, 376, frequent=len(words) // 2))
    assert [p for r in rounds for p in r] == bpe.train_naive(words, 376)
    assert len(rounds) <= 12
    assert list(map(len, bpe.merge_rounds(hist, 376, frequent=2 * len(words)))) == [64, 56]


def test_changes_are_those_of_all_words(spark):
    """The pass over the words against counting every pair anew after each merge."""
    rng = random.Random(7)
    hist = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))): rng.randrange(1, 9) for _ in range(200)}
    merges = bpe.train_naive(hist, 270)
    words = spark.createDataFrame([(n, list(c.encode())) for c, n in hist.items()], "freq long, ids array<int>").repartition(3)
    got = {(r.t, r.a, r.b): r.d for r in bpe._changes(words, merges[:4], merges[4:], memory=5).collect()}

    def totals(k):
        out, rank = Counter(), {p: 256 + i for i, p in enumerate(merges[:k])}
        for c, n in hist.items():
            ids = bpe.merge_by_rank(list(c.encode()), rank)
            for p in zip(ids, ids[1:]):
                out[p] += n
        return out

    want = {}
    for t in range(len(merges) - 4):
        before, after = totals(4 + t), totals(5 + t)
        want |= {(t, *p): after[p] - before[p] for p in before | after if after[p] != before[p]}
    assert got == want


def naive_ids(ids, merges):
    for i, p in enumerate(merges):
        ids = bpe.merged(tuple(ids), p, 256 + i)
    return list(ids)


def test_encoding_is_the_merges_in_order(docs, tok):
    rng = random.Random(1)
    for _ in range(300):
        chunk = "".join(rng.choice("theca ts odné日") for _ in range(rng.randrange(0, 60)))
        assert tok.encode_chunk(chunk) == naive_ids(chunk.encode(), tok.merges)
    runs = bpe.Tokenizer([(97, 97), (256, 256), (256, 97), (257, 98)])
    for n in range(40):
        assert runs.encode_chunk("a" * n + "b") == naive_ids(b"a" * n + b"b", runs.merges)


def test_a_megabyte_is_encoded_in_seconds(docs, tok):
    rng = random.Random(2)
    chunk = "".join(rng.choice(["the", "cat", "sat", "on", "dog", "mat", "log"]) for _ in range(350_000))[:1_000_000]
    began = time.perf_counter()
    ids = tok.encode_chunk(chunk)
    assert time.perf_counter() - began < 20
    assert tok.decode(ids) == chunk and tok.encode_chunk(chunk[:2000]) == naive_ids(chunk[:2000].encode(), tok.merges)


def test_pair_counts(spark):
    hist = spark.createDataFrame([("aaa", 2), ("ab", 5), ("é", 1)], "chunk string, freq long")
    assert {(r.a, r.b): r.cnt for r in bpe.pair_counts(hist).collect()} == {(97, 97): 4, (97, 98): 5, (0xC3, 0xA9): 1}
    best = bpe.best_pair(bpe.pair_counts(hist)).first()
    assert (best.a, best.b, best.cnt) == (97, 98, 5)


def test_round_trip_and_join_form(docs, tok):
    ids = bpe.encode_documents(docs, tok)
    assert {r.doc_id: r.text for r in bpe.decode_documents(ids, tok).collect()} == dict(enumerate(TEXT))
    joined = {r.doc_id: r.ids for r in bpe.encode_by_join(docs.filter("doc_id < 2"), tok).collect()}
    assert joined == {r.doc_id: r.ids for r in ids.filter("doc_id < 2").collect()}


def test_specials_and_saving(spark, tok):
    again = bpe.Tokenizer.loads(tok.dumps())
    assert again.merges == tok.merges
    assert bpe.Tokenizer.loads("[[97, 98, 256]]").merges == [(97, 98)]
    end = again.end_id
    assert again.end_id == end == again.vocab_size - 1
    text = spark.createDataFrame([(0, "a<|endoftext|>b")], "doc_id long, text string")
    assert bpe.encode_documents(text, again, specials=[again.END]).first().ids == [97, end, 98]
    assert end not in bpe.encode_documents(text, again).first().ids
    assert again.decode([97, end]) == "a<|endoftext|>"


def test_stream_decoding(spark):
    tok = bpe.Tokenizer([])
    text = "café résumé naïve 日本"
    d = bpe.StreamDecoder(tok)
    pieces = [d.push(i) for i in text.encode()]
    assert "".join(pieces) == text and "�" not in "".join(pieces)
    cut = bpe.StreamDecoder(tok)
    cut.push(0xC3)
    assert cut.flush() == "�"


def test_keyed_stream_decoding(spark, tmp_path):
    from textmill.streaming.streams import decode_stream

    text = "café 日本"
    raw = list(text.encode())
    schema = "seq_id long, pos long, token_id int"
    src = str(tmp_path / "in")
    half = len(raw) // 2
    for part in (range(half), range(half, len(raw))):
        spark.createDataFrame([(1, p, raw[p]) for p in part], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    out = []
    q = decode_stream(stream, bpe.Tokenizer([])).writeStream.foreachBatch(lambda df, i: out.append(df.toPandas())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert "".join(pd.concat(out).piece) == text


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "ok"), (1, 0, "user", "hi"), (2, 0, "system", ""), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.encode_conversations(turns).collect()}
    assert got[1].ids == [256, *b"hi", 258, 257, *b"ok", 258]
    assert got[1].mask == [0, 0, 0, 0, 0, 1, 1, 1]
    assert got[2].ids == [256, 258, 257, 258]
    with pytest.raises(Exception, match="unknown role"):
        chat.encode_conversations(turns.withColumn("role", F.lit("robot"))).collect()


def test_preferences_and_rollouts(spark):
    rows = spark.createDataFrame([("p", "yes", "no"), ("p" * 30, "yes", "no")], "prompt string, chosen string, rejected string")
    a, b = chat.preference_pairs(rows, 16).collect()
    assert a.chosen_ids == [256, 112, 258, 257, *b"yes", 258, *[258] * 8]
    assert a.chosen_mask == [0] * 4 + [1] * 4 + [0] * 8
    assert b.chosen_ids is None and b.rejected_mask is None
    r = rows.select(chat.rollout_row(chat.byte_ids(F.col("prompt")), chat.byte_ids(F.col("chosen")), 0, 6).alias("r")).collect()
    assert r[0].r.ids == [112, *b"yes", 0, 0] and r[0].r.mask == [0, 1, 1, 1, 0, 0]
    assert r[1].r.mask == [0] * 6


ODD = ["a,b don't've  x\t\x1c!　é é.\x85 ' 's", "<|endoftext|> a <|endoftext|>b  <|endoftext|>", "", None, "z" * 9000 + " " + "ab" * 50, "\n\n a  b_1 2c "]


def test_spans_are_encoded_as_whole_texts(spark):
    """Cuts, words that are encoded together, long ones and special strings: the ids are those of the definition, and carried columns stay."""
    import regex

    tok = bpe.Tokenizer([(97, 98), (32, 97), (122, 122), (258, 258), (100, 111), (39, 115)])
    end = tok.end_id
    rows = spark.createDataFrame([(i, t, i * 7) for i, t in enumerate(ODD)], "doc_id long, text string, n long")
    plain = lambda t: [x for c in regex.findall(bpe.PATTERN, t) for x in bpe.merge_by_rank(list(c.encode()), tok.rank)]
    got = {r.doc_id: (r.n, r.ids) for r in bpe.encode_documents(rows, tok, carry=("n",)).collect()}
    assert got == {i: (i * 7, plain(t or "")) for i, t in enumerate(ODD)}
    want = {i: [x for k, s in enumerate((t or "").split(tok.END)) for x in [end] * (k > 0) + plain(s)] for i, t in enumerate(ODD)}
    assert {r.doc_id: r.ids for r in bpe.encode_documents(rows, tok, specials=[tok.END]).collect()} == want
    back = bpe.decode_documents(bpe.encode_documents(rows, tok, specials=[tok.END], carry=("n",)), tok, carry=("n",))
    assert {r.doc_id: (r.n, r.text) for r in back.collect()} == {i: (i * 7, t or "") for i, t in enumerate(ODD)}


def test_changes_by_arrays_are_those_of_chains():
    """What a merge changes in the totals, and words that are merged together, against the step-by-step definitions."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(40):
        words = [(rng.randrange(1, 9), [rng.randrange(3) for _ in range(rng.randrange(1, 9))]) for _ in range(20)]
        x, w = bpe._laid_out(pa.record_batch([pa.array([f for f, _ in words], pa.int64()), pa.array([i for _, i in words], pa.list_(pa.int32()))], ["freq", "ids"]))
        chains = bpe.Symbols(words)
        for new, pair in enumerate([(0, 0), (1, 2), (3, 3), (4, 0)], 3):
            change = []
            x, w = bpe._merge_all(x, w, pair, new, change)
            got = Counter()
            for keys, d in change:
                for k, v in zip(keys.tolist(), d.tolist(), strict=True):
                    got[k >> 32, k & 0xFFFFFFFF] += v
            assert {k: v for k, v in got.items() if v} == chains.merge(pair, new)
    for merges in ([(97, 98), (256, 97), (97, 97), (258, 258)], [(97, 98), (256, 97), (97, 97), (258, 258)] + [(i, j) for i in range(1, 6) for j in range(200)]):
        tok = bpe.Tokenizer(merges)
        some = ["".join(rng.choice("aab") for _ in range(rng.randrange(30))).encode() for _ in range(300)]
        flat, at = bpe.merge_words(some, bpe._ranks(tok))
        assert [flat[i:j].tolist() for i, j in zip(at, at[1:])] == [bpe.merge_by_rank(list(s), tok.rank) for s in some]  # noqa: B905
    assert isinstance(at, np.ndarray)


def test_a_map_holds_a_part_of_a_batch(spark):
    """Parts have whole rows and about as many bytes as asked for, so a map's memory does not grow with its batches."""
    import pyarrow as pa

    from textmill.operators import arrow

    batch = pa.record_batch([pa.array(range(50)), pa.array(["x" * (i % 7 * 10) for i in range(49)] + [None])], ["k", "t"])
    parts = list(arrow.parts([batch.slice(3)], 1, 100))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(3, 50))
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts) <= 100 and len(parts) > 10
