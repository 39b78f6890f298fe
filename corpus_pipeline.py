"""A corpus pipeline: quality rules, line dedup, near-duplicate join, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import jaccard, lines, packing, quality_rules, secrets
from telemill.llm.common import SPACES, table
from telemill.plans.lineage import sized_join, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; those of which no word is left go, as all of it stays elsewhere."""
    out = lines.line_dedup(docs)
    left = F.length(F.translate("text", SPACES, "")) > 0
    out = out.where((F.col("n_dropped") == 0) | left)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Rows that share a doc_id are one document: all their different texts stay, of equal texts one row, the least by all
    columns. Rows without doc_id are linked with nothing and stay.
    """
    others = jaccard.components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = sized_join(docs, written(others, "others"), "doc_id", "left_anti")
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = sized_join(kept, repeated, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256)).agg(F.min(whole).alias("row")).select("row.*")
    return sized_join(kept, repeated, "doc_id", "left_anti").unionByName(once)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.contains("text", F.lit(secrets.MARK)), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("best-fit packing", pack)]

#: SQL expresses neither cutoffs, forest nor packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
