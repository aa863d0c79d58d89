from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import evaluate, model, objectives, pack, reward
from textmill.sources import registry, token_bin


@pytest.fixture(scope="module")
def stream(spark):
    docs = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 9))) for i in range(20)], "doc_id long, ids array<int>")
    return pack.token_stream(docs, F.col("ids"), "doc_id", 999).cache()


def tokens(stream):
    return [x for r in stream.orderBy("doc_id").collect() for x in r.ids]


def test_prefix_sum_over_many_ranges(spark):
    got = pack.prefix_sum(spark.range(5000), F.col("id"), "id", "before", width=16).orderBy("id").collect()
    want = np.concatenate([[0], np.cumsum(np.arange(5000))])[:-1]
    assert [r.before for r in got] == want.tolist()


def test_budget_takes_the_crossing_row(spark):
    assert pack.budget_cut(spark.range(10), F.lit(10), "id", 25).count() == 3
    assert pack.budget_cut(spark.range(0), F.lit(10), "id", 25).count() == 0


def test_generator_split_is_the_sequential_one(spark):
    got = [r.split for r in pack.generator_split(spark.range(300).repartition(3), "id", 0.3).orderBy("id").collect()]
    g = np.random.default_rng(0)
    assert got == ["val" if g.random() < 0.3 else "train" for _ in range(300)]


def test_windows_are_shifted(spark, stream):
    flat = tokens(stream)
    offsets = spark.createDataFrame([(0, 0), (1, 37), (2, 150)], "window long, offset long")
    for r in pack.windows_at(stream, offsets, 16).collect():
        at = {0: 0, 1: 37, 2: 150}[r.window]
        assert r.x == flat[at : at + 16] and r.y == flat[at + 1 : at + 17]
    with pytest.raises(ValueError):
        pack.drawn_offsets(spark, 3, 10, 16)


def test_sweep_covers_whole_batches(spark, stream):
    flat = tokens(stream)
    rows = pack.sweep(stream, len(flat), 2, 16).orderBy("step", "row").collect()
    assert len(rows) == 2 * ((len(flat) - 1) // 32)
    assert [x for r in rows for x in r.x] == flat[: 16 * len(rows)]


def test_token_files(spark, stream, tmp_path):
    token_bin.install(spark)
    out = str(tmp_path / "bin")
    rows = stream.select("start_pos", "ids").repartitionByRange(3, "start_pos").sortWithinPartitions("start_pos")
    rows.write.format("token_bin").mode("overwrite").option("path", out).option("eot_id", 999).save()
    back = spark.read.format("token_bin").option("path", out).option("block", 7).load().orderBy("start_pos").collect()
    assert [x for r in back for x in r.ids] == tokens(stream)
    with pytest.raises(Exception, match="fewer"):
        spark.read.format("token_bin").option("path", out).option("seq_len", 10_000).load().count()


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([("  " + "a" * 300 + "\n", "u1", 1), ("short", "u2", 2)], "body string, url string, extra int")
    docs.write.parquet(str(tmp_path / "raw"))
    registry.register("t", registry.Source(str(tmp_path / "raw"), text="body", meta=("url", "score")))
    got = registry.ingest(spark, "t")
    assert got.columns == ["text", "url"] and got.first().text == "a" * 300
    registry.write_shards(got, str(tmp_path / "shards"))
    assert registry.read_shards(spark, str(tmp_path / "shards")).select("text", "score").first().score is None
    registry.write_text(got, str(tmp_path / "txt"))
    assert registry.read_text(spark, str(tmp_path / "txt")).first().text == "a" * 300
    (tmp_path / "utf8.txt").write_bytes("aé".encode())
    assert registry.read_bytes(spark, str(tmp_path / "utf8.txt"), 2).first().text == "a"
    order = registry.indexed(spark.range(1000).withColumn("k", -F.col("id")), ["k"]).orderBy("k").collect()
    assert [r.doc_idx for r in order] == list(range(1000))


def test_checkpoints_grow(spark, tmp_path):
    rows = lambda n, v: spark.createDataFrame([("emb", i, [v, v]) for i in range(n)], "name string, row int, values array<float>")
    registry.write_checkpoint(rows(3, 1.0), {"step": 7}, str(tmp_path / "c"))
    saved, state = registry.read_checkpoint(spark, str(tmp_path / "c"))
    assert state == {"step": 7}
    assert [r["values"][0] for r in registry.resized(rows(5, 0.0), saved).orderBy("row").collect()] == [1, 1, 1, 0, 0]
    with pytest.raises(Exception, match="doesn't fit"):
        registry.resized(rows(2, 0.0), saved).collect()


def test_rewards(spark):
    rows = spark.createDataFrame([("x #### 42", "42"), ("#### 1,234", "#### 1234"), ("#### 3 and #### -3.5", "-3.5"), ("none", "1"), ("#### ,", "1"), ("#### 5", "6")], "c string, g string")
    got = rows.select(reward.extract_answer(F.col("c")).alias("a"), reward.reward(F.col("c"), F.col("g")).alias("r")).collect()
    assert [r.a for r in got] == ["42", "1234", "-3.5", None, "", "5"]
    assert [r.r for r in got] == [4, 4, 4, 0, 1, 1]
    groups = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 5.0), (1, 5.0)], "g long, reward double")
    assert sorted(round(r.advantage, 3) for r in reward.group_advantages(groups, "g", eps=0.0001).collect()) == [-1, 0, 0, 1]
    with pytest.raises(Exception, match="another size"):
        reward.group_advantages(groups, "g", group_size=3).collect()
    with pytest.raises(ValueError):
        reward.positional_groups(spark.range(5), "id", 2)


def test_objectives_in_closed_form(spark):
    same = spark.createDataFrame([(-1.0, -2.0, -1.0, -2.0)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    r = objectives.dpo_rows(same).first()
    assert abs(r.loss - np.log(2)) < 1e-12 and r.margin == 0 and r.accuracy == 0
    g = spark.createDataFrame([([-1.0, -2.0], [-1.0, -2.0], [1, 1], 0.5)], "policy_logp array<double>, ref_logp array<double>, mask array<int>, advantage double")
    out = objectives.grpo_loss(g).first()
    assert out.kl == 0 and abs(out.loss - 0.75) < 1e-12
    lr = [r[0] for r in spark.range(1001).select(objectives.wsd_lr(F.col("id"), 1.0, 1000, 100, 0.2, 0.1)).collect()]
    assert (lr[0], lr[49], lr[99], lr[500], lr[1000]) == (0.01, 0.5, 1.0, 1.0, 0.1)
    with pytest.raises(ValueError):
        objectives.wsd_lr(F.col("id"), 1.0, 10, shape="odd")
    assert np.isnan(objectives.means(same.filter("false").withColumn("m", F.lit(1.0)), "m").first().m)
    row = spark.createDataFrame([([5.0, 4.0],)], "x array<double>").select(objectives.greedy(objectives.repetition_penalty(F.col("x"), F.array(F.lit(0)), 2.0))).first()
    assert row[0] == 1
    x = [float(i) for i in range(100)]
    q = spark.createDataFrame([(x,)], "x array<double>").select(objectives.quantize(F.col("x"), 8, 64).alias("q")).select(objectives.dequantize(F.col("q")).alias("y")).first()
    assert max(abs(a - b) for a, b in zip(x, q.y, strict=True)) < 0.2


def test_decoder_cache_and_scoring(spark):
    c = objectives.ModelConfig(vocab_size=50, dim=16, n_layers=2, n_heads=4, n_kv_heads=2, hidden_dim=24)
    w = model.initial_weights(c, 1)
    assert sum(x.size for x in w.values()) == sum(r.size for r in objectives.tensor_sizes(spark.createDataFrame([("x", 50, 16, 2, 4, 2, 24, True)], "name string, vocab_size long, dim long, n_layers long, n_heads long, n_kv_heads long, hidden_dim long, tied boolean")).collect())
    ids = [3, 7, 11, 2, 9]
    whole = model.forward(w, c, ids)
    cache = model.Cache(c.n_layers)
    steps = np.concatenate([model.forward(w, c, [i], cache) for i in ids])
    assert np.allclose(whole, steps, atol=1e-4)
    rows = spark.createDataFrame([(1, ids, 0)], "row_id long, ids array<int>, start int")
    got = evaluate.loglikelihood(model.score_rows(rows, w, c), "row_id").first()
    want = sum(model.log_softmax(whole)[i, ids[i + 1]] for i in range(4))
    assert abs(got.logp - want) < 1e-4


def test_rolling_and_cuts(spark):
    rows = spark.createDataFrame([(1, list(range(10))), (2, [])], "k long, ids array<int>")
    got = evaluate.rolling_chunks(rows, "k", "ids", 4, 99).orderBy("chunk").collect()
    assert [(r.context, r.continuation) for r in got] == [([99], [0, 1, 2, 3]), ([3], [4, 5, 6, 7]), ([7], [8, 9])]
    one = spark.createDataFrame([("a stop b END", [1, 2, 3], [4, 5])], "t string, c array<int>, d array<int>")
    r = one.select(evaluate.stop_at(F.col("t"), ["END", "stop"]).alias("s"), evaluate.cut_context(F.col("c"), F.col("d"), 3).alias("k"), evaluate.scoring_request(F.array().cast("array<int>"), F.col("d"), 9, 0).alias("q")).first()
    assert r.s == "a stop b " and r.k == [2, 3] and r.q.ids == [0, 4, 5] and r.q.start == 0


def test_streams(spark, tmp_path):
    from textmill.streaming import streams

    src = str(tmp_path / "src")
    docs = spark.createDataFrame([(0, "good words and more words to read here " * 10), (1, "bad"), (2, "bad")], "doc_id long, text string")
    docs.write.parquet(src)
    read = lambda: spark.readStream.schema(docs.schema).parquet(src)
    streams.filter_stream(read(), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 1
    streams.dedup_stream(read(), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2


def test_windows_have_no_row_for_each_token(spark, stream):
    """A sweep neither joins nor makes more rows than documents and windows; windows of many blocks come out whole."""
    flat = tokens(stream)
    plain = spark.createDataFrame([(0, [1, 2, 3])], "start_pos long, ids array<int>")
    plan = pack.sweep(plain, len(flat), 2, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "posexplode" not in plan
    offsets = spark.createDataFrame([(i, o) for i, o in enumerate((0, 5, 63, 64, 100, 150))], "window long, offset long")
    got = {r.window: r for r in pack.windows_at(stream, offsets, 40, step=8).collect()}
    assert len(got) == 6 and all(got[i].x == flat[o : o + 40] and got[i].y == flat[o + 1 : o + 41] for i, o in enumerate((0, 5, 63, 64, 100, 150)))
    assert not pack.windows_at(stream, spark.createDataFrame([(0, len(flat) - 40)], "window long, offset long"), 40).count()
    big = pack.token_stream(spark.createDataFrame([(0, list(range(1000))), (1, [])], "doc_id long, ids array<int>"), F.col("ids"), "doc_id", 999)
    rows = pack.sweep(big, 1002, 3, 10).orderBy("step", "row").collect()
    assert [r.x[0] for r in rows] == list(range(0, 990, 10)) and all(r.y == [x + 1 for x in r.x] for r in rows)


def test_drawn_rows_come_with_replacement(spark):
    rows = pack.drawn_rows(spark.range(10), "id", 500, 10, 7).collect()
    assert sorted(r.draw for r in rows) == list(range(500)) and {r.id for r in rows} == set(range(10))


def test_masked_token_files(spark, tmp_path):
    token_bin.install(spark)
    out = str(tmp_path / "sft")
    rows = spark.createDataFrame([(0, [5, 6, 7], [0, 1, 1]), (3, [], []), (3, [70000], [1])], "start_pos long, ids array<int>, mask array<int>").coalesce(1).sortWithinPartitions("start_pos")
    how = {"path": out, "masked": "true"}
    with pytest.raises(Exception, match="fit"):
        rows.write.format("token_bin").mode("overwrite").options(**how).save()
    rows.write.format("token_bin").mode("overwrite").options(**how, dtype="uint32").save()
    r = spark.read.format("token_bin").options(**how).load().first()
    assert r.ids == [5, 6, 7, 70000] and r["mask"] == [0, 1, 1, 1]
    mask = next(tmp_path.glob("sft/*.mask"))
    mask.write_bytes(b"\x00")
    with pytest.raises(Exception, match="a mask of 1"):
        spark.read.format("token_bin").options(**how).load().count()
    short = spark.createDataFrame([(0, [5, 6], [1])], "start_pos long, ids array<int>, mask array<int>")
    with pytest.raises(Exception, match="a mask of 1 for 2"):
        short.write.format("token_bin").mode("overwrite").options(**how).save()


def test_byte_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 30) for i in range(100)], "doc_id long, text string")
    registry.write_byte_shards(docs, str(tmp_path / "s"), "doc_id", 430, "text")
    sizes = [sum(f.stat().st_size for f in d.glob("*.json")) for d in sorted((tmp_path / "s").glob("shard=*"))]
    assert sum(sizes) == 4200 and max(sizes) < 430 + 42


def test_ema_is_the_fold(spark):
    r = np.random.default_rng(0)
    rows = [(int(g), i, float(v)) for i, (g, v) in enumerate(zip(r.integers(0, 5, 300), r.normal(size=300), strict=True))]
    want = {}
    for g, _, v in rows:
        want[g] = 0.9 * want[g] + 0.1 * v if g in want else v
    got = {r.g: r.ema for r in objectives.ema(spark.createDataFrame(rows, "g int, i int, v double").repartition(3), "v", "i", "g", 0.9).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)


@pytest.fixture
def token_files(spark, tmp_path):
    """12,000 ids in four files of unequal sizes, with masks."""
    token_bin.install(spark)
    path = str(tmp_path / "bins")
    rows = spark.range(400).selectExpr("id * 30 AS start_pos", "transform(sequence(0, 29), i -> cast(id * 30 + i AS int)) AS ids", "transform(sequence(0, 29), i -> cast((id * 30 + i) % 3 = 0 AS int)) AS mask")
    rows.repartitionByRange(4, "start_pos").sortWithinPartitions("start_pos").write.format("token_bin").mode("overwrite").options(path=path, masked="true").save()
    assert len(token_bin.metadata(path)["files"]) == 4
    return path


def asked_ids(path, filters, **options):
    """The filters that are left to Spark, and the ids that the planned partitions read."""
    reader = token_bin.TokenBin({"path": path, **options}).reader(None)
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    got = [i for p in parts for b in reader.read(p) for row in b.column(1).to_pylist() for i in row]
    assert len(got) == sum(e - s for p in parts for s, e in p.ranges)
    return left, got


def test_pushed_filters_read_only_their_ranges(spark, token_files):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains

    pos, how = ("start_pos",), {"block": 16}
    starts = sorted(r.start_pos for r in spark.read.format("token_bin").options(path=token_files, **how).load().collect())
    assert len(starts) > 700 and asked_ids(token_files, [], **how)[1] == list(range(12_000))
    rows = lambda keep: [i for s, e in zip(starts, [*starts[1:], 12_000], strict=True) if keep(s) for i in range(s, e)]
    cases = [
        ([GreaterThan(pos, 5000), LessThan(pos, 5100)], lambda s: 5000 < s < 5100), ([GreaterThanOrEqual(pos, starts[9]), LessThanOrEqual(pos, starts[300])], lambda s: starts[9] <= s <= starts[300]),
        ([In(pos, (starts[3], starts[4], starts[500], 7, None))], lambda s: s in (starts[3], starts[4], starts[500])), ([EqualTo(pos, starts[8]), IsNotNull(pos)], lambda s: s == starts[8]),
        ([In(pos, (starts[3], starts[400])), GreaterThan(pos, 4000)], lambda s: s == starts[400] > 4000), ([GreaterThan(pos, 20_000)], lambda s: False), ([EqualTo(pos, 1)], lambda s: False),
    ]
    for filters, keep in cases:
        left, got = asked_ids(token_files, filters, **how)
        assert not left and got == rows(keep)
    other = StringContains(("ids",), "x")
    assert asked_ids(token_files, [other], **how)[0] == [other]
    empty = spark.read.format("token_bin").options(path=token_files, **how).load().filter("start_pos > 20000")
    assert empty.count() == 0


def test_partitions_are_ranges_of_bytes(token_files):
    reader = token_bin.TokenBin({"path": token_files, "block": 100, "split": 1000}).reader(None)
    parts = reader.partitions()
    assert len(parts) >= 12 and all(sum(e - s for s, e in p.ranges) <= 1000 for p in parts)
    files = {f: (s, s + n) for f, s, n in reader.meta["files"]}
    assert all(files[p.file][0] <= s < e <= files[p.file][1] for p in parts for s, e in p.ranges)


def test_windows_read_the_rows_that_they_touch(spark, token_files):
    offsets, length, block = [0, 17, 2990, 2999, 3000, 7771, 11_959], 40, 16
    starts = token_bin.row_starts(token_files, offsets, length, block)
    rows = spark.read.format("token_bin").options(path=token_files, block=block).load().filter(F.col("start_pos").isin(starts))
    assert sum(len(r.ids) for r in rows.collect()) <= len(offsets) * (length + 1 + 2 * block)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan  # Spark has nothing left to sift
    at = spark.createDataFrame(list(enumerate(offsets)), "window long, offset long")
    for got in (pack.windows_at(rows, at, length), token_bin.windows(at, token_files, length)):
        found = {r.window: (r.x, r.y) for r in got.collect()}
        assert found == {w: (list(range(o, o + length)), list(range(o + 1, o + length + 1))) for w, o in enumerate(offsets)}


def test_windows_by_byte_ranges_handle_ends_nulls_and_masks(spark, token_files):
    offsets = spark.createDataFrame([(0, 11_989), (1, 11_990), (2, -1), (3, None), (None, 5), (4, 5)], "window long, offset long")
    got = sorted((tuple(r) for r in token_bin.windows(offsets, token_files, 10, masked=True).collect()), key=repr)
    want = [(w, list(range(o, o + 10)), list(range(o + 1, o + 11)), [int(i % 3 == 0) for i in range(o + 1, o + 11)]) for w, o in ((0, 11_989), (4, 5), (None, 5))]
    assert got == sorted(want, key=repr)
    assert token_bin.windows(offsets.limit(0), token_files, 10).count() == 0


def test_a_cut_file_is_an_error(spark, token_files):
    file = next(Path(token_files).glob("*.bin"))
    file.write_bytes(file.read_bytes()[:-2])
    with pytest.raises(Exception, match="too early|a mask of"):
        spark.read.format("token_bin").options(path=token_files).load().count()


def test_prefix_sums_leave_null_orders_out(spark):
    rows = spark.createDataFrame([(None, 100), (0, 5), (1, None), (2, 7), (None, 9), (5000, 1)], "i long, v long")
    got = sorted((r.i, r.before) for r in pack.prefix_sum(rows, F.col("v"), "i", "before").collect())
    assert got == [(0, 0), (1, 5), (2, 5), (5000, 12)]
    assert [r.i for r in pack.budget_cut(rows, F.col("v"), "i", 6).orderBy("i").collect()] == [0, 1, 2]


def test_spans_have_any_length(spark, token_files):
    asked = spark.createDataFrame([(0, 5, 0), (1, 5, 3), (2, 2990, 4000), (3, 11_999, 1), (4, 11_999, 2), (5, None, 3), (6, 3, None)], "key long, offset long, n long")
    assert {r.key: r.ids for r in token_bin.spans(asked, token_files).collect()} == {0: [], 1: [5, 6, 7], 2: list(range(2990, 6990)), 3: [11_999]}


def test_penalty_counts_the_prompt_but_never_the_end():
    c = objectives.ModelConfig(vocab_size=50, dim=16, n_layers=1, n_heads=4, n_kv_heads=2, hidden_dim=24)
    w, prompt, eot = model.initial_weights(c, 3), [3, 7, 11, 2], 2
    ids, want = list(prompt), []
    for _ in range(8):
        x = model.forward(w, c, ids)[-1].astype(float)
        for i in set(ids) - {eot}:
            x[i] = x[i] / 1.5 if x[i] > 0 else x[i] * 1.5
        if int(x.argmax()) == eot:
            break
        want.append(int(x.argmax()))
        ids.append(want[-1])
    assert model.generate(w, c, prompt, 8, eot, penalty=1.5) == want
