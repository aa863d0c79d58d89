"""Structured Streaming forms: filtering new documents, and decoding tokens as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import strip
from ..operators.bpe import StreamDecoder, Tokenizer
from ..operators.quality import QualityConfig, check_documents
from ..operators.temporal import micros
from ..sources import shard_stream


def filter_stream(docs: DataFrame, out: str, checkpoint: str, cfg: QualityConfig = QualityConfig()) -> StreamingQuery:
    """Writes the documents that fail no rule to a folder of Parquet files; the checkpoint makes restarts exact."""
    kept = check_documents(docs, cfg).filter(F.size("fails") == 0).drop("fails")
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, min_chars: int = 200, budget: int | None = None) -> StreamingQuery:
    """Writes what is new in a folder of JSON-line shards to Parquet files: text stripped, rows of fewer than min_chars characters left out.

    schema: the columns, text among them; lines that are no JSON have a null text and go. Offsets are (shard, byte), so a query that is stopped and started
    again on its checkpoint loses and repeats no row; the budget ends it at the line that reaches it.
    """
    shard_stream.install(spark)
    lines = spark.readStream.format("shard_lines").option("path", path)
    lines = (lines if budget is None else lines.option("budget", budget)).load()
    rows = lines.select("shard", "byte", F.from_json("line", schema).alias("row")).select("shard", "byte", "row.*").withColumn("text", strip(F.col("text")))
    long_ = rows.filter(F.length("text") >= min_chars)
    return long_.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, key: str, time: str, arrived: str, gap: int, delay: int, out: str, late: str, checkpoint: str) -> list[StreamingQuery]:
    """Sessions of a stream of events as they close, and the rows that came too late for them, each in a folder of Parquet files.

    A row is late if it arrived more than delay seconds after its time, which depends on the row alone, whatever comes with it. All others are at or
    after the watermark of every row that arrived before them, so none is dropped, and the sessions that are written are those of a batch over the rows that
    are not late, in any order of arrival. Rows with a null key, time or arrival are late.
    """
    at = F.col(time).cast("timestamp")
    known = F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(arrived).isNotNull()
    in_time = F.coalesce(known & (micros(F.col(arrived)) - micros(F.col(time)) <= delay * 1_000_000), F.lit(False))
    rows = events.filter(in_time).select(F.col(key).alias(key), at.alias("_at")).withWatermark("_at", f"{delay} seconds")
    closed = rows.groupBy(key, F.session_window("_at", f"{gap} seconds").alias("_s")).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n")).drop("_s")
    write = lambda df, to, name: df.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(availableNow=True).start()
    return [write(closed, out, "sessions"), write(events.filter(~in_time), late, "late")]


def dedup_stream(docs: DataFrame, out: str, checkpoint: str, key: str = "text") -> StreamingQuery:
    """Writes documents whose text an earlier micro-batch or row has not had: an anti join with what is written, by digest."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("digest", F.md5(key)).dropDuplicates(["digest"])
        try:
            done = spark.read.parquet(out).select("digest")
        except Exception as e:  # noqa: BLE001  nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(done, "digest", "left_anti")
        new.write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decode_stream(tokens: DataFrame, tok: Tokenizer) -> DataFrame:
    """(seq_id, piece) of a stream of (seq_id, pos, token_id): what each batch adds to a sequence's text, whole characters only."""
    shared = tokens.sparkSession.sparkContext.broadcast(tok)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (b"", 0)
        d = StreamDecoder(shared.value, (bytes(held[0]), int(held[1])))
        rows = pd.concat(list(parts)).sort_values("pos")
        piece = "".join(d.push(int(i)) for i in rows.token_id)
        state.update(d.state())
        yield pd.DataFrame({"seq_id": [key[0]], "piece": [piece]})

    return tokens.groupBy("seq_id").applyInPandasWithState(step, "seq_id long, piece string", "held binary, flag long", "append", GroupStateTimeout.NoTimeout)
