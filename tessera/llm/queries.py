"""The queries op1_ to op10_: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, ctw, images, langid, line_dedup, packing, pii, revisits, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers' file is on this machine; the executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "time", "source_id", "outcome", "status", headers.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


def image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images, so one is drawn for every row of embeddings; each four ids in a row are copies."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"))
    found = images.copies(ids, "vec_id", "vec_id", images.rendered)
    return found.withColumnRenamed("id", "vec_id")


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), counts=("n_lines", "n_removed"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_lm_scoring": lm_scoring,
    "op3_nearest_neighbours": nearest_neighbours,
    "op4_pii": pii_spans,
    "op5_image_copies": image_copies,
    "op6_language_id": language_id,
    "op7_simhash_near_dedup": simhash_near_dedup,
    "op8_byte_bpe": byte_bpe,
    "op9_warc_revisits": warc_revisits,
    "op10_line_dedup": line_dedup_query,
}

#: DuckDB SQL where SQL can express the query; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op9_warc_revisits": revisits.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE.format(documents="documents")
    + "SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM cleaned",
}
