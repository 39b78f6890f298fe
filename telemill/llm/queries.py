"""The queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from telemill.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.jaccard import components

    return components(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.warc import archive, read

    folder = archive(table(spark, sf_dir, "pages"))
    # revisits are read by their headers alone, payloads are decoded of responses only
    whole = read(spark, folder, "page_id long, record_type string, payload_bytes long, actual_digest string").where("record_type = 'response'")
    heads = read(spark, folder, "page_id long, record_type string, declared_bytes long, payload_digest string, refers_to long").where("record_type = 'revisit'")
    one = whole.select("page_id", "payload_bytes", F.col("actual_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return one.union(heads.select("page_id", F.col("declared_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.media import store, with_features, with_metadata

    rows = store(table(spark, sf_dir, "documents"))
    return with_metadata(with_features(rows), rows).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth"
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from telemill.llm.bpe import coded

    return coded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.language import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    # the share that is held out is known from doc_id alone, after the prediction
    return predict(docs, train(docs, F.coalesce(~held_out, F.lit(True)))).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.secrets import found

    rows = found(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "nth", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "occurrences", "probability", "secret")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.fim import fill_in_middle, restored

    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("notices")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from telemill.llm import divergence, fim, jaccard, lines, warc

    return {
        "op2_jaccard_join": jaccard.ORACLE, "op3_warc": warc.ORACLE, "op4_line_dedup": lines.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_fill_in_middle": fim.ORACLE,
    }
