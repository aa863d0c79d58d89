"""The registered queries of this subpackage: each applies one operator, with production parameters, to its
whole table, and derives the digest columns of the result from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, history, jaccard_join, licenses, line_dedup, packing, pii, quality_llr, resharding, token_store, toxicity, warc_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op2_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old shards by source, as a crawl would leave them; eight new ones of equal capacity."""
    docs = table(spark, sf_dir, "documents")
    out, _ = resharding.reshard(docs, F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(8)), [1] * 8)
    cols = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"]
    return out.select("doc_id", "size", "text_crc32", *cols)


@query
def op3_edit_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, links (other lines of the table that equal or nearly equal one of its own), the earliest document
    of its class, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_classes(docs)


@query
def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(table(spark, sf_dir, "documents")))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.read_bundles(warc_bundles.write_bundles(table(spark, sf_dir, "pages")))


ORACLE["op9_warc_bundles"] = warc_bundles.ORACLE_SQL


@query
def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_dimension_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.document_history(table(spark, sf_dir, "documents"))


ORACLE["op11_dimension_history"] = history.ORACLE_SQL


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


ORACLE["op12_conversation_repair"] = conversations.ORACLE_SQL


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE["op13_license_scan"] = licenses.ORACLE_SQL
