"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import chat, hardneg, lines
from attestry.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.secrets import find_secrets, secret_report

    return secret_report(find_secrets(read_table(spark, sf_dir, "documents")))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.decontam import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.lines import dedup_lines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_deleted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.licenses import find_licenses, license_report

    return license_report(find_licenses(read_table(spark, sf_dir, "documents")))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from attestry.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.spotsigs import edited_report

    return edited_report(read_table(spark, sf_dir, "documents"))


def op7_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.warc import archive_pages

    return archive_pages(read_table(spark, sf_dir, "pages"))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.simhash import near_duplicate_classes

    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.quality import select_quality

    return select_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.chunks import repeated_spans

    return repeated_spans(read_table(spark, sf_dir, "documents"))


def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from attestry.llm.alignment import alignment_report

    a, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_report(read_table(spark, sf_dir, "documents"), a, b)


def op12_vertical_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.hardneg import hard_negatives

    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.chat import chat_report

    return chat_report(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_spaced_seeds, op3_line_winnowing, op4_license_scan, op5_harmonic_packing, op6_spot_signatures, op7_legacy_archives,
        op8_simhash_variants, op9_quality_resampling, op10_gear_chunks, op11_token_spans, op12_vertical_negatives,
        op13_schema_fingerprints,
    )
}

ORACLE_SQL = {
    "op3_line_winnowing": lines.ORACLE_SQL, "op12_vertical_negatives": hardneg.ORACLE_SQL, "op13_schema_fingerprints": chat.ORACLE_SQL,
}
