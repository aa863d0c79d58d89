"""Sources and sinks: named corpora, JSON-lines shards, plain text, tables of tensors, run metadata and logs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.pack import byte_shards, json_line_bytes, prefix_sum

DOCUMENT = "text string, id string, url string, score double, language_score double, token_count long, dump string"


@dataclass(frozen=True)
class Source:
    """A corpus: where it is, its format, its text column, and the columns that are kept if they exist."""

    path: str
    format: str = "parquet"
    text: str = "text"
    meta: tuple[str, ...] = ()


_WEB = ("id", "url", "score", "language_score", "token_count", "dump")
#: Public corpora by name, with the columns that are kept if they exist; paths are below the root that ingest() gets.
SOURCES: dict[str, Source] = {
    "fineweb-edu": Source("fineweb-edu/sample-10BT", meta=_WEB),
    "tinystories": Source("tinystories"),
    "documents": Source("documents.parquet", meta=("doc_id", "lang", "source")),
}


def register(name: str, source: Source) -> None:
    SOURCES[name] = source


def present(df: DataFrame, *columns: str) -> list[str]:
    """Of the named columns, those that df has."""
    return [c for c in columns if c in df.columns]


def ingest(spark: SparkSession, source: Source | str, min_chars: int = 200, root: str | None = None) -> DataFrame:
    """The source's texts, stripped and not shorter than min_chars, with the meta columns that exist."""
    s = SOURCES[source] if isinstance(source, str) else source
    raw = spark.read.format(s.format).load(s.path if root is None else f"{root.rstrip('/')}/{s.path}")
    out = raw.select(strip(F.col(s.text)).alias("text"), *present(raw, *s.meta))
    return out.filter(F.length("text") >= min_chars)


def resumed(new: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What has not been written before, by a stable id, whatever the order of the source."""
    return new.join(done.select(key), key, "left_anti")


def indexed(df: DataFrame, order: list[Column | str], name: str = "doc_idx") -> DataFrame:
    """df with a dense index in the given order: ranges are sorted in parallel and counted on from their totals.

    df must give the same rows each time it is read, since it is read once for the counts and once for the rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    place = {"_p": F.shiftrightunsigned("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}
    rows = ranged.withColumns(place)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = prefix_sum(sizes, F.col("_n"), "_p", "_before").select("_p", "_before")
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_m", "_p", "_i", "_before")


def read_shards(spark: SparkSession, path: str, schema: str | T.StructType = DOCUMENT) -> DataFrame:
    """JSON-lines shards with _file and _at, which order the documents as the shards' names and lines do."""
    df = spark.read.schema(schema).json(path)
    return df.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """JSON lines without null fields; rows_per_file bounds a shard."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def write_byte_shards(df: DataFrame, path: str, order: str, limit: int, *columns: str) -> None:
    """JSON lines in a folder for each limit bytes, in order; each folder is one task's, sorted."""
    sized = byte_shards(df, json_line_bytes(*columns), order, limit)
    sized.select(*dict.fromkeys([*columns, order, "shard"])).repartition("shard").sortWithinPartitions("shard", order).drop(*({order} - {*columns})).write.mode("overwrite").partitionBy("shard").json(path)


def read_sample_text(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows, stripped; empty ones go but count."""
    return df.filter(F.col(order) < n).withColumn("text", strip(F.col("text"))).filter("text <> ''")


def write_text(df: DataFrame, path: str) -> None:
    """Texts with a blank line after each."""
    df.select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(text) of files with a blank line between texts."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text")).filter("text <> ''")


def read_bytes(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(path, text): the first bytes of each file; a character cut in two at the end is left out."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, limit).alias("raw"))
    # whole characters end at most three bytes before the cut
    tail = F.expr("aggregate(sequence(0, 3), cast(null as string), (a, i) -> coalesce(a, try_validate_utf8(cast(substring(raw, 1, length(raw) - i) as string))))")
    return raw.select("path", tail.alias("text"))


def first_stage(found: dict[str, DataFrame], order: tuple[str, ...] = ("dedup", "clean", "raw")) -> DataFrame:
    """The first stage's table that has a row."""
    for name in order:
        if name in found and found[name].limit(1).count():
            return found[name]
    raise FileNotFoundError("no stage has any document")


def write_metadata(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def append_log(events: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines."""
    events.write.mode("append").json(path)


LOG = "step long, loss double, lr double, tokens_per_s double, val_loss double, val_ppl double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of training and validation alike; what a row lacks is null."""
    return spark.read.schema(LOG).json(path)


# Checkpoints: a table of tensor rows (name, row, values) and a JSON state.
def write_checkpoint(rows: DataFrame, state: dict, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/tensors")
    rows.sparkSession.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/tensors"), json.loads(spark.read.text(f"{path}/state").first()[0])


def resized(fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """fresh with the saved values where there are any: more rows keep their start values.

    An error if a row's length differs, or if saved has a row that fresh lacks.
    """
    both = fresh.alias("f").join(saved.alias("s"), ["name", "row"], "full")
    bad = F.col("f.values").isNull() | (F.col("s.values").isNotNull() & (F.size("f.values") != F.size("s.values")))
    value = F.when(bad, F.raise_error(F.lit("the checkpoint doesn't fit")).cast("array<float>")).otherwise(F.coalesce("s.values", "f.values"))
    return both.select("name", "row", value.alias("values"))
