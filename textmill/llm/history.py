"""Versioned history of a dimension from changes that arrive in any order, in native SQL arrays.

A change concerns a key, starts on a day, and is an update or delete (in force until the next one starts) or a correction (in force for a fixed
number of days, before all updates and deletes). Of those in force on a day, the last-arrived correction wins, else the update or delete with
the latest start, ties to the last-arrived. A delete, or no change at all, is absence; a null value is a value. Maximal runs of days with equal
values (null equals null) are versions.

1. Of the changes of one key, start and class, only the last-arrived can ever win: an aggregation with map-side combine keeps it. So a key's
   array has at most two entries for each day on which one of its changes starts, however many changes it has.
2. The starts and ends of a key's entries are its sorted array of boundaries. Between two of them the winner is one entry: array_max of those that
   filter finds in force, by (class, start, arrival).
3. aggregate folds the segments, and coalesces neighbours of equal values.

No Python runs on the executors, nothing is broadcast, and nothing goes to the driver.

Defined results: changes without a key or start concern nothing and are left out; changes that arrive in the same place take the greatest value as the
last-arrived, null before all others and a delete before what is present, so repeated rows count once; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

#: The end of what never ends, inside; null in the result.
NEVER = (1 << 63) - 1
#: Days that a correction holds, and what kinds of change there are.
SPAN = 3
UPDATE, DELETE, CORRECTION = "update", "delete", "correction"


def document_changes(docs: DataFrame) -> DataFrame:
    """(key, start, kind, h, doc_id, j, value): the two changes that each row of documents stands for; they arrive by (h, doc_id, j).

    Rows without an id make none.
    """
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("value"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    digest = F.sha2(F.concat_ws(":", F.col("doc_id"), F.col("j")).cast("binary"), 256)
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))
    what = F.floor(F.col("h") / 1000) % 10
    kind = F.when(what <= 1, F.lit(DELETE)).when(what <= 4, F.lit(CORRECTION)).otherwise(F.lit(UPDATE))
    return rows.select((F.col("doc_id") - F.pmod("doc_id", F.lit(5))).alias("key"), (F.col("h") % 365).alias("start"), kind.alias("kind"), "h", "doc_id", "j", "value")


def last_of_each_start(changes: DataFrame, arrival: list[str], span: int) -> DataFrame:
    """(key, entry): the last-arrived change of each key, start and class. entry's first fields are the order of precedence."""
    fixed = F.col("kind") == CORRECTION
    rows = changes.filter("key is not null and start is not null").select("key", fixed.alias("fixed"), F.col("start").cast("long").alias("start"), F.struct(*arrival, "value", (F.col("kind") != DELETE).alias("present")).alias("last"))
    kept = rows.groupBy("key", "start", "fixed").agg(F.max("last").alias("last"))
    entry = F.struct(
        F.col("fixed"), F.when(F.col("fixed"), F.lit(0).cast("long")).otherwise(F.col("start")).alias("at"), F.col("last"), F.col("start").alias("first"),
        F.when(F.col("fixed"), F.col("start") + span).otherwise(F.lit(NEVER)).alias("end"),
    )
    return kept.select("key", entry.alias("entry"))


def segments(entries: Column) -> Column:
    """The winner between each two neighbouring boundaries of the entries, ascending: (first, end, entry), entry null where none is in force."""
    ends = F.transform(F.filter(entries, lambda e: e["fixed"]), lambda e: e["end"])
    boundaries = F.array_sort(F.array_distinct(F.concat(F.transform(entries, lambda e: e["first"]), ends)))
    winner = lambda day: F.array_max(F.filter(entries, lambda e: (e["first"] <= day) & (day < e["end"])))
    cut = lambda b: F.transform(b, lambda day, i: F.struct(day.alias("first"), F.coalesce(F.get(b, i + 1), F.lit(NEVER)).alias("end"), winner(day).alias("entry")))
    return bound(boundaries, cut)


def coalesced(cut: Column) -> Column:
    """The segments with a present value, (first, end, value), neighbours of equal values as one."""
    live = F.transform(F.filter(cut, lambda s: s["entry"]["last"]["present"]), lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), s["entry"]["last"]["value"].alias("value")))

    def fold(done: Column, s: Column) -> Column:
        def step(last: Column) -> Column:
            longer = F.struct(last["first"].alias("first"), s["end"].alias("end"), last["value"].alias("value"))
            goes_on = (last["end"] == s["first"]) & last["value"].eqNullSafe(s["value"])
            return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

        return bound(F.get(done, F.size(done) - 1), step)

    return F.aggregate(live, F.array().cast("array<struct<first:bigint,end:bigint,value:string>>"), fold)


def history(changes: DataFrame, arrival: list[str], span: int = SPAN) -> DataFrame:
    """(key, version, valid_from, valid_to, value) of changes (key, start, kind, value, and the columns by which they arrive).

    valid_to is exclusive, and null where the version doesn't end. Keys that are never present have no row.
    """
    entries = last_of_each_start(changes, arrival, span).groupBy("key").agg(F.collect_list("entry").alias("entries"))
    rows = entries.select("key", F.posexplode(coalesced(segments(F.col("entries")))).alias("at", "v"))
    end = F.when(F.col("v.end") < NEVER, F.col("v.end"))
    return rows.select("key", (F.col("at") + 1).cast("int").alias("version"), F.col("v.first").alias("valid_from"), end.alias("valid_to"), F.col("v.value").alias("value"))


def document_history(docs: DataFrame) -> DataFrame:
    """The versions of the documents that the rows' changes concern: doc_id (concerned), version, valid_from, valid_to, value."""
    return history(document_changes(docs), ["h", "doc_id", "j"]).withColumnRenamed("key", "doc_id")


#: By days instead of boundaries: nothing starts or ends after day 367.
ORACLE_SQL = """WITH c AS (SELECT DISTINCT doc_id - ((doc_id % 5) + 5) % 5 AS k, doc_id, j, lang, CAST('0x' || substr(sha256(doc_id || ':' || j), 1, 12) AS BIGINT) AS h
  FROM documents, (SELECT unnest([0, 1]) AS j) WHERE doc_id IS NOT NULL),
e AS (SELECT *, h % 365 AS s, (h // 1000) % 10 AS m FROM c),
w AS (SELECT k, day, m, lang, row_number() OVER (PARTITION BY k, day ORDER BY CASE WHEN m BETWEEN 2 AND 4 THEN 1 ELSE 0 END DESC, CASE WHEN m BETWEEN 2 AND 4 THEN 0 ELSE s END DESC, h DESC, doc_id DESC, j DESC, lang DESC NULLS LAST) AS r
  FROM e JOIN (SELECT unnest(range(0, 368)) AS day) ON s <= day AND (m NOT BETWEEN 2 AND 4 OR day < s + 3)),
p AS (SELECT k, day, lang, lag(day) OVER x IS DISTINCT FROM day - 1 OR lag(lang) OVER x IS DISTINCT FROM lang AS fresh FROM w WHERE r = 1 AND m > 1 WINDOW x AS (PARTITION BY k ORDER BY day)),
v AS (SELECT k, day, lang, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY day) AS n FROM p)
SELECT k AS doc_id, CAST(n AS INTEGER) AS version, min(day) AS valid_from, CASE WHEN max(day) < 367 THEN max(day) + 1 END AS valid_to, any_value(lang) AS value FROM v GROUP BY k, n"""
