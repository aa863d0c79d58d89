import json
import random

import pytest

from textmill.sources import shard_stream
from textmill.streaming import streams

SCHEMA = "doc_id long, text string"


def line(i, text):
    return json.dumps({"doc_id": i, "text": text}, ensure_ascii=False) + "\n"


def batch(spark, path, **options):
    shard_stream.install(spark)
    return [(r.shard, r.byte, r.line) for r in spark.read.format("shard_lines").options(path=str(path), **options).load().collect()]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_each_line_is_read_once_whatever_the_ranges(tmp_path, split):
    rng = random.Random(split)
    want = []
    for name in ("a.json", "b/c.jsonl", "d.json", "empty.json"):
        raw, file = b"", tmp_path / name
        for i in range(0 if name == "empty.json" else 40):
            text = "é日x" * rng.randrange(0, 9)
            want.append((name, len(raw), text))
            raw += text.encode() + rng.choice([b"\n", b"\r\n"])
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(raw.removesuffix(b"\n") if name == "d.json" else raw)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "notes.txt").write_text("no shard\n")
    shards = shard_stream.Shards({"path": str(tmp_path), "split": split})
    parts = shards.between({"shard": "", "byte": 0}, shards.end(growing=False))
    assert all(p.end - p.first <= split for p in parts)
    assert [(p.shard, at, x) for p in parts for b in shards.read(p) for at, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())] == want
    # the last line of a growing shard waits for its line feed; here the last shard is empty
    assert shards.end(growing=True)["byte"] == 0


def test_offsets_anywhere_lose_and_repeat_no_line(tmp_path):
    (tmp_path / "a.json").write_text("".join(f"line {i}\n" for i in range(50)))
    (tmp_path / "b.json").write_text("".join(f"more {i}\n" for i in range(50)))
    shards = shard_stream.Shards({"path": str(tmp_path), "split": 100})
    rng, end = random.Random(4), {"shard": "b.json", "byte": (tmp_path / "b.json").stat().st_size}
    for _ in range(50):
        cut = {"shard": rng.choice(["a.json", "b.json"]), "byte": rng.randrange(0, 300)}
        got = [x for a, b in (({"shard": "", "byte": 0}, cut), (cut, end)) for p in shards.between(a, b) for r in shards.read(p) for x in r.column(2).to_pylist()]
        assert got == [f"line {i}" for i in range(50)] + [f"more {i}" for i in range(50)]


@pytest.mark.parametrize("budget", [0, 1, 31, 1000, 1800, 10**9])
def test_budget_ends_with_the_line_that_reaches_it(spark, tmp_path, budget):
    lines, total, want = [line(i, "x" * (i % 23)) for i in range(60)], 0, []
    for i, x in enumerate(lines):
        if total < budget:
            want.append(i)
        total += len(x)
    (tmp_path / "a.json").write_text("".join(lines[:33]))
    (tmp_path / "b.json").write_text("".join(lines[33:]))
    assert [json.loads(x)["doc_id"] for _, _, x in batch(spark, tmp_path, budget=budget, split=50)] == want


def test_stream_goes_on_where_it_was_stopped(spark, tmp_path):
    """Shards come and the last one grows, also in the middle of a line, while the query is stopped and started."""
    src, how = tmp_path / "in", (SCHEMA, str(tmp_path / "out"), str(tmp_path / "state"), 3)
    src.mkdir()

    def run(budget=None):
        streams.ingest_stream(spark, str(src), *how, budget=budget).awaitTermination(120)
        return sorted(r.doc_id for r in spark.read.schema(SCHEMA).parquet(how[1]).collect())

    first = "".join(line(i, " four ") for i in range(5)) + line(5, " x ") + "no json\n"
    (src / "0.json").write_text(first)
    assert run() == [0, 1, 2, 3, 4] == run()
    with open(src / "0.json", "a") as f:
        f.write(line(6, "word") + line(7, "word")[:9])
    assert run() == [0, 1, 2, 3, 4, 6]
    with open(src / "0.json", "a") as f:
        f.write(line(7, "word")[9:])
    (src / "1.json").write_text("".join(line(i, "éé é") for i in range(10, 13)))
    assert run() == [0, 1, 2, 3, 4, 6, 7, 10, 11, 12] == run()
    (src / "2.json").write_text(line(20, "word") * 3 + line(21, "word"))
    size = sum(f.stat().st_size for f in src.iterdir())
    assert run(size - len(line(21, "word"))) == [0, 1, 2, 3, 4, 6, 7, 10, 11, 12, 20, 20, 20]
    assert run() == [0, 1, 2, 3, 4, 6, 7, 10, 11, 12, 20, 20, 20, 21]
    texts = {r.text for r in spark.read.schema(SCHEMA).parquet(how[1]).collect()}
    assert texts == {"four", "word", "éé é"}
