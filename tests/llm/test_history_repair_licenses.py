"""op11 to op13 against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill.llm import conversations, history, licenses, queries

SF = "/root/testdata/sf0.001"
CLASH = ["entry", "last", "start", "h", "j", "value", "key", "again", "gone_", "row", "words", "label", "rank", "has", "b"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op11_dimension_history", "op12_conversation_repair", "op13_license_scan"])
def test_query_equals_its_sql(spark, db, name):
    df, sql = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert sorted(sql.columns) == order
    plain = lambda rows, cols: sorted(repr([r[cols.index(c)] for c in order]) for r in rows)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(sql.fetchall(), list(sql.columns))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- dimension history


def brute_history(changes, days):
    """changes: (key, start, kind, arrival, value). Day by day."""
    out = []
    for key in sorted({c[0] for c in changes if c[0] is not None and c[1] is not None}):
        own = [c for c in changes if c[0] == key and c[1] is not None]
        runs = []
        for day in days:
            order = lambda c: (c[3], c[4] is not None, c[4] or "", c[2] != "delete")
            holds = [c for c in own if c[2] == "correction" and c[1] <= day < c[1] + 3]
            base = [c for c in own if c[2] != "correction" and c[1] <= day]
            won = max(holds, key=order) if holds else max(base, key=lambda c: (c[1], *order(c))) if base else None
            if won is None or won[2] == "delete":
                continue
            if runs and runs[-1][1] == day and runs[-1][2] == won[4]:
                runs[-1][1] = day + 1
            else:
                runs.append([day, day + 1, won[4]])
        out += [(key, i, a, None if b == days[-1] + 1 else b, v) for i, (a, b, v) in enumerate(runs, 1)]
    return out


def test_history_equals_days(spark):
    rng = random.Random(5)
    changes = [(rng.randrange(6), rng.randrange(40), rng.choice(["update", "update", "delete", "correction"]), rng.randrange(30), rng.choice(["a", "b", None])) for _ in range(300)]
    changes += [(7, rng.randrange(40), "update", i, "hot") for i in range(3000)] + [(7, 11, "correction", 9999, None), (None, 3, "update", 1, "x"), (8, None, "update", 1, "x"), (9, 5, "delete", 1, "x")]
    changes += changes[:50]
    df = spark.createDataFrame(changes, "key long, start long, kind string, at long, value string").withColumns({c: F.lit("mine") for c in ("entry", "last", "end", "fixed")})
    got = [tuple(r) for r in history.history(df, ["at"]).orderBy("key", "version").collect()]
    assert got == brute_history(changes, range(0, 60))


def test_history_array_is_bounded_by_starts(spark):
    """However many changes a key has, its array has two entries for each day at most."""
    df = spark.range(50_000).selectExpr("1L AS key", "id % 20 AS start", "if(id % 3 = 0, 'correction', 'update') AS kind", "id AS at", "cast(id % 7 AS string) AS value")
    kept = history.last_of_each_start(df, ["at"], 3)
    assert kept.count() <= 40
    assert history.history(df, ["at"]).count() > 0


def test_history_of_odd_documents(spark):
    rows = [(0, "en"), (1, None), (2, ""), (3, "en"), (3, "en"), (3, "fr"), (None, "de"), (24, None), (20, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string").withColumns({c: F.lit("mine") for c in CLASH})
    changes = []
    for (i, lang), j in itertools.product(set(rows), (0, 1)):
        if i is not None:
            h = int(hashlib.sha256(f"{i}:{j}".encode()).hexdigest()[:12], 16)
            kind = ("delete", "delete", "correction", "correction", "correction")[h // 1000 % 10] if h // 1000 % 10 < 5 else "update"
            changes.append((i - i % 5, h % 365, kind, (h, i, j), lang))
    df = history.document_history(docs)
    assert [tuple(r) for r in df.orderBy("doc_id", "version").collect()] == brute_history(changes, range(0, 370))
    assert not re.search("Python|Pandas|Arrow|Broadcast", executed(df))
    assert history.document_history(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- conversation repair


def ways(rows):
    """Every (audit, cost, lines) that makes the rows right, with two inserts at most in each place."""
    grammar = re.compile("(s?(ua)+)?")

    def edits(i):
        if i == len(rows):
            yield "", 0, []
            return
        role, text, must_go, cut = rows[i]
        for audit, cost, lines in edits(i + 1):
            yield "D" + audit, cost + 4, lines
            if not must_go:
                yield "K" + audit, cost + 3 * cut, [(role, text), *lines]
                for r in ("user", "assistant"):
                    yield "R" + audit, cost + 3 + 3 * cut, [(r, text), *lines]

    def filled(audit, cost, lines):
        # inserts go before any edit or at the end
        places = len(audit) + 1
        for counts in itertools.product(range(3), repeat=places):
            for roles in itertools.product(("user", "assistant"), repeat=sum(counts)):
                new, out, at, k = "", [], 0, 0
                for p in range(places):
                    out += [(r, "") for r in roles[k : k + counts[p]]]
                    k += counts[p]
                    new += "I" * counts[p]
                    if p < len(audit):
                        new += audit[p]
                        if audit[p] != "D":
                            out.append(lines[at])
                            at += 1
                yield new, cost + 3 * sum(counts), out

    for way in edits(0):
        for audit, cost, lines in filled(*way):
            if grammar.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                yield cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def brute_repair(rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        solid = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, text = min(ways([(r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(rows, faults, strict=True)]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair_equals_all_ways(spark):
    rng, rows = random.Random(3), []
    for conv in range(120):
        for _ in range(rng.randrange(0, 4)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 5]), rng.choice(["user", "assistant", "system", "tool", "", None, "useless"]), rng.choice(["Yes.", "no", " ", "", None, "Why?", "one. \n", "é!"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in CLASH})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == brute_repair([r[1:] for r in rows if r[0] == conv]), conv


def plain_repair(rows):
    """(cost, audit) by whole strings: for conversations that are too long for all ways."""
    layer = {0: (0, "")}
    close = lambda layer: {q: min(w for p, (c, a) in layer.items() for q2, roles in conversations.inserts(p) for w in [(c + 3 * len(roles), a + "I" * len(roles))] if q2 == q) for q in {q for p in layer for q, _ in conversations.inserts(p)}}
    for role, text in rows:
        now = {}
        for p, (c, a) in close(layer).items():
            more = 0 if text[-1] in ".!?" else 3
            out = [(p, c + 4, "D"), (conversations.rerole(p), c + 3 + more, "R")]
            if (q := conversations.after(p, role[:1])) is not None:
                out.append((q, c + more, "K"))
            for q, cost, edit in out:
                now[q] = min(now.get(q, (1 << 60, "")), (cost, a + edit))
        layer = now
    return min(w for q, w in close(layer).items() if q in (0, 3))


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["user", "assistant", "system"]), f"{i}{rng.choice('.x')}") for i in range(3000)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    got = conversations.repair(df).first()
    assert (got.cost, got.audit) == plain_repair(rows)
    assert len(got.audit.replace("I", "")) == 3000


def test_damage_and_odd_conversations(spark):
    long_ = "many words of a long turn. " * 40_000
    rows = [(0, 0, "user", "Hi."), (0, 0, "user", "Hi."), (0, 1, "assistant", long_), (None, None, None, None), (None, 2, "user", "A?"), (3, None, "system", "S."), (3, 4, "user", "")]
    rows += [(conv, turn, role, "Well!") for conv in range(10, 60) for turn, role in ((0, "user"), (1, "assistant"))] + [(conv, 0, "user", "Alone.") for conv in range(100, 140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("mine"))
    want = {}
    for conv, turn, role, text in rows:
        own = want.setdefault(conv, [])
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        own += [(turn, "user" if x == 4 else role, text)] * {0: 0, 3: 2}.get(x, 1)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df)).collect()}
    assert got == {conv: brute_repair(own) for conv, own in want.items()}
    assert any(not own for own in want.values())  # a conversation that loses all rows stays
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0


# ---------------------------------------------------------------- license scans


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_scan(text):
    w = words_of(text)
    places = [(i, label) for i in range(len(w)) for p, label in licenses.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    best, labels, at = 0.0, {label for _, label in places}, 0
    while True:
        block = set(w[at : at + licenses.WIDTH])
        for t in licenses.TEMPLATES:
            own = set(words_of(t.text))
            if len(own & block) >= licenses.needed(len(own), licenses.THRESHOLD):
                labels.add(t.label)
                best = max(best, len(own & block) / len(own))
        at += licenses.STEP
        if at + licenses.WIDTH - licenses.STEP >= len(w):
            break
    base = {label for _, label in places}
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best)


def license_rows():
    rng = random.Random(2)
    vocab = sorted({w for t in licenses.TEMPLATES for w in words_of(t.text)}) + ["cc", "by", "all", "rights", "reserved", "été", "naïve", "x9"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", " ", ", ", "\n", "-", " "]) for _ in range(rng.randrange(0, 200)))) for i in range(150)]
    for i, t in enumerate(licenses.TEMPLATES):
        w = t.text.split()
        w[rng.randrange(len(w))] = "other"
        wrapped = re.sub(r"((?:\S+ ){4})", r"\1\n  * ", t.text)
        rows += [(1000 + i, "foo bar " * 30 + wrapped + " baz" * 70), (2000 + i, "foo bar " * 20 + " ".join(w))]
    rows += [
        (1, None), (2, ""), (3, " \n\t"), (4, "CC BY"), (5, "cc\n\n-by cc by"), (6, "xcc by cc byx écc by"), (7, "GENERAL PUBLIC, LICENSE all rights RESERVED All Rights Reserved."), (8, "cc K by"),
        (None, "all rights reserved"), (4, "CC BY"), (4, "another text of this id: Released under the MIT License"), (9, "cc " * 50_000 + "by" + " all rights" * 50_000), (10, "\U0001f600cc by \U0001f600 cc by\U0001f600"),
    ]
    return rows


def test_scan_equals_all_blocks_and_templates(spark):
    rows = license_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASH})
    out = licenses.scan(df)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_scan(t)) for i, t in rows), key=repr)
    assert not re.search("Python|Pandas|ArrowEval", executed(out))
    assert licenses.scan(df.limit(0)).count() == 0
    none = licenses.scan(df, templates=())
    assert none.filter("labels <> base_labels").count() == 0 and none.count() == len(rows)


def test_every_template_is_found_however_it_is_wrapped(spark):
    rows = [(i, "foo bar " * 30 + re.sub(r"((?:\S+ ){3})", r"\1\n// ", t.text) + " baz" * 70) for i, t in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t.label in got[i] for i, t in enumerate(licenses.TEMPLATES))


def test_only_license_lines_get_labels_in_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = licenses.scan(docs).filter("labels <> ''").join(docs, "doc_id").filter("not lower(text) rlike 'licen[sc]e|rights reserved|cc by'")
    assert odd.count() == 0
