"""Repair of the structure of conversations by a forward Viterbi pass over four grammar states.

A conversation is right if its roles' initials are ``(s?(ua)+)?``. Rows are kept (0), get the role that the grammar asks for (3) or are deleted (4, which
blank and repeated rows must be); empty rows of users and assistants are inserted anywhere (3); a truncated row that stays adds 3. Of the cheapest
repairs the one with the least audit string (the edits' initials in order) is taken.

States: nothing yet, after s, after u, after a. A layer holds the best (cost, audit) of each state after a row; from there at most two inserts lead to
each other state, as a third would come back to where the first began. Two repairs of equally many rows end with an edit of the same row, so neither's
audit is the beginning of the other's, and a rank within the layer stands for the string: the pass compares (cost, rank, what is new). Each
state also carries the SHA-256 of its repaired rows, so no row is held.

Spark shuffles the rows once, by conversation, and sorts them; a map goes through each partition row by row and gives one row for each conversation. A
conversation's digest can only be made in the order of its rows, so its rows go through one task, but they are never gathered there:
the sorts spill, and the map keeps four states and their audits, a byte for each row, however long a conversation is.

Defined results: a null role or text is one space, and so is a null id or turn where it is written; null ids are one conversation; null turns come first
and ties go by role, then text, so repeated rows follow each other and all but the first are duplicates; a conversation without rows has zeros, an empty
audit and the digest of nothing; empty tables give an empty result; very long texts are only hashed; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: White space, as the faults take it, and what ends a whole text.
SPACE, END = " \t\n\x0b\x0c\r", ".!?"
#: Rows after which an audit's parts are joined.
JOIN_EVERY = 512

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def after(state: int, initial: str) -> int | None:
    """The state after a row with this initial, or None where the grammar has no such row."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return None


def rerole(state: int) -> int:
    return ASSISTANT if state == USER else USER


def inserts(state: int) -> Iterator[tuple[int, list[str]]]:
    """Each state within two inserts, and the inserted roles."""
    roles: list[str] = []
    for _ in range(3):
        yield state, list(roles)
        state = rerole(state)
        roles.append(ROLES[state])


Move = tuple[int, int, str, int, list[str], str | None]


def moves(initial: str, must_go: bool, truncated: bool) -> list[Move]:
    """(from, to, suffix of the audit, cost, inserted roles, role of the row): the best way between each two states across one row. An empty
    role is the row's own, None a deleted row."""
    best: dict[tuple[int, int], tuple] = {}
    for first in range(4):
        for state, roles in inserts(first):
            ways = [("D", DELETE, state, None)]
            if not must_go:
                more = TRUNCATED * truncated
                ways.append(("R", REROLE + more, rerole(state), ROLES[rerole(state)]))
                if (to := after(state, initial)) is not None:
                    ways.append(("K", KEEP + more, to, ""))
            for edit, cost, to, role in ways:
                way = (cost + INSERT * len(roles), "I" * len(roles) + edit, roles, role)
                if (first, to) not in best or way[:2] < best[first, to][:2]:
                    best[first, to] = way
    return [(first, to, suffix, cost, roles, role) for (first, to), (cost, suffix, roles, role) in best.items()]


_MOVES = {(i, *flags): moves(i, *flags) for i in ("s", "u", "a", "") for flags in ((True, False), (False, False), (False, True))}


def _joined(node: tuple | None, whole: bool) -> tuple[tuple | None, str]:
    """The audit back to the last joined part, or to its beginning, and what stands before it."""
    parts = []
    while node and (whole or len(node) == 2):
        parts.append(node[1])
        node = node[0]
    return node, "".join(reversed(parts))


class Conversation:
    """One conversation's figures and the four states of its repair, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.low = self.high = None
        self.turns = self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        #: state: (cost, rank, audit as (part before, text), digest so far or None where no row stays)
        self.layer: dict[int, tuple[int, int, tuple | None, hashlib._Hash | None]] = {START: (0, 0, None, None)}

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        solid, initial = text.rstrip(SPACE), role[:1]
        blank, again = not solid, again and bool(solid)
        truncated = bool(solid) and not again and solid[-1] not in END
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + truncated
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial

        best: dict[int, tuple] = {}
        for first, to, suffix, cost, roles, own in _MOVES[initial if initial in ("s", "u", "a") else "", blank or again, truncated]:
            if held := self.layer.get(first):
                way = (held[0] + cost, held[1], suffix, first, roles, own)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        ranks = {to: i for i, (_, to) in enumerate(sorted(((w[1], w[2]), to) for to, w in best.items()))}
        layer = {}
        for to, (cost, _, suffix, first, roles, own) in best.items():
            _, _, node, digest = self.layer[first]
            lines = [f"{r}:" for r in roles] + ([] if own is None else [f"{own or role}:{text}"])
            layer[to] = (cost, ranks[to], (node, suffix), _hashed(digest, lines))
        self.rows += 1
        if self.rows % JOIN_EVERY == 0:
            layer = {to: (cost, rank, (*_joined(node, False), True), digest) for to, (cost, rank, node, digest) in layer.items()}
        self.layer = layer

    def result(self) -> tuple:
        ways = []
        for first, (cost, rank, node, digest) in self.layer.items():
            ways += [(cost + INSERT * len(roles), rank, "I" * len(roles), node, digest, roles) for state, roles in inserts(first) if state in FINAL]
        cost, _, suffix, node, digest, roles = min(ways, key=lambda w: w[:3])
        digest = _hashed(digest, [f"{r}:" for r in roles]) or hashlib.sha256()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, _joined(node, True)[1] + suffix, digest.hexdigest()


def _hashed(digest: hashlib._Hash | None, lines: list[str]) -> hashlib._Hash | None:
    """The digest of what it has and the lines after it, newline-joined; the one given stays as it is."""
    if not lines:
        return digest
    if digest is None:
        return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass"))
    digest = digest.copy()
    digest.update(("\n" + "\n".join(lines)).encode("utf-8", "surrogatepass"))
    return digest


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv_id, turn, role, text, gone, again), sorted: one row for each conversation."""
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
    now: Conversation | None = None
    made = []
    for batch in batches:
        for conv, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv_id:
                if now:
                    made.append(now.result())
                now = Conversation(conv)
            if not gone:
                now.add(turn, role, text, again)
        if len(made) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)
            made = []
    if now:
        made.append(now.result())
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, and perhaps gone): its faults, the cost and audit of its repair, and the digest of
    what it leads to. Rows that are gone only name their conversation."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    # the shuffle by conversation serves the window and the map alike
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    numbered = clean.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)
    ordered = numbered.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    return ordered.mapInArrow(_run, SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows with the faults that crc32(conv_id:turn) % 20 gives them: 0 takes the row, 1 empties its text, 2 takes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", END, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies).drop("copy")


def _sql() -> str:
    """The same layers as a recursive query over all ways of inserts and edits, none pruned; it carries the repaired text."""
    ways = []
    for first in range(4):
        for k in range(3):
            state, roles = next(itertools.islice(inserts(first), k, None))
            lines = "".join(f"\n{r}:" for r in roles)
            ways.append((first, state, "I" * k + "D", 3 * k + 4, 0, lines, "-", ""))
            ways.append((first, rerole(state), "I" * k + "R", 3 * k + 3, 1, lines, ROLES[rerole(state)], ""))
            ways += [(first, after(state, i), "I" * k + "K", 3 * k, 1, lines, "", i) for i in "sua" if after(state, i) is not None]
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\n", "' || chr(10) || '") + "'"
    ends = [(first, "I" * len(r), 3 * len(r), "".join(f"\n{x}:" for x in r)) for first in range(4) for s, r in inserts(first) if s in FINAL]
    values = lambda rows: ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"
    return f"""WITH RECURSIVE w(q, q2, edits, price, stays, ins, becomes, initial) AS (VALUES {values(ways)}), z(q, edits, price, ins) AS (VALUES {values(ends)}),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor({crc}, 4294967295::BIGINT) % 20 AS x FROM o),
d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM f),
e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM d),
g AS (SELECT *, solid = '' AS blank, solid <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup FROM e),
h AS (SELECT *, solid <> '' AND NOT dup AND right(solid, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS b FROM g),
ids AS (SELECT conv_id, count(n) AS total FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN e USING (conv_id) GROUP BY conv_id),
layer AS (SELECT conv_id, 0::BIGINT AS n, 0 AS q, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS m FROM ids
  UNION ALL
  SELECT conv_id, n, q, m FROM (SELECT l.conv_id, h.n, w.q2 AS q, min({{'c': l.m.c + w.price + CASE WHEN h.cut THEN 3 * w.stays ELSE 0 END, 'a': l.m.a || w.edits,
      't': l.m.t || w.ins || CASE w.becomes WHEN '-' THEN '' WHEN '' THEN chr(10) || h.role || ':' || h.text ELSE chr(10) || w.becomes || ':' || h.text END}}) AS m
    FROM layer l JOIN h ON h.conv_id = l.conv_id AND h.n = l.n + 1 JOIN w ON w.q = l.q AND (w.initial = '' OR w.initial = h.initial) AND NOT (w.stays = 1 AND (h.blank OR h.dup)) GROUP BY l.conv_id, h.n, w.q2)),
r AS (SELECT l.conv_id, min({{'c': l.m.c + z.price, 'a': l.m.a || z.edits, 't': l.m.t || z.ins}}) AS m FROM layer l JOIN ids ON l.conv_id = ids.conv_id AND l.n = ids.total JOIN z ON z.q = l.q GROUP BY l.conv_id),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (b IS NOT NULL AND b || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY conv_id)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, m.c AS cost, m.a AS audit, sha256(substr(m.t, 2)) AS repaired_sha256
FROM r LEFT JOIN k ON k.conv_id = r.conv_id"""


ORACLE_SQL = _sql()
