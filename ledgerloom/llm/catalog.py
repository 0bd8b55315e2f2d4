"""Registered queries of this subpackage: one for each operator, and the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontaminate, exact, languages, licences, merkle, near, packing, quality, repeats, secrets, sitetree, spelling, sql, tokenfile
from ledgerloom.llm.common import held_out, table


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0, 1024)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.verdicts(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.scores(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.predictions(docs, languages.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.findings(docs, secrets.learn(docs))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "equal_words", "item_words")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.new_path(spark, "token-ids")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1, path)
    return tokenfile.checksums(tokenfile.read_ids(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.paragraphs(docs, licences.learn(docs)).select("doc_id", "paragraph", "family", "similarity", "confirmed")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verified(table(spark, sf_dir, "documents"), claimed={"text": F.when(tampered, lowered).otherwise(F.col("text"))})


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), least=7, times=2, every=31), factor=10)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_language_id, op3_secret_scan, op4_decontamination, op5_substring_dedup,
        op6_token_files, op7_minhash_near_dedup, op8_packing, op9_exact_dedup, op10_licence_scan,
        op11_merkle_manifest, op12_spelling_variants, op13_html_extraction)
}

ORACLE: dict[str, str] = {
    "op4_decontamination": sql.CONTAINED_ITEMS,
    "op10_licence_scan": sql.LICENCE_LINES,
    "op5_substring_dedup": sql.REPEATS,
    "op7_minhash_near_dedup": sql.NEAR_DEDUP,
    "op9_exact_dedup": sql.EXACT_DEDUP,
    "op11_merkle_manifest": sql.MERKLE,
    "op12_spelling_variants": sql.VARIANTS,
    "op13_html_extraction": sql.ARTICLES,
}
