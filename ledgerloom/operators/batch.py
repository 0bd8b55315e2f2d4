"""Figures about one run over a batch of documents.

Input: one row per document with success, processing_time, supplier_name, document_type,
total_amount, total_tax, validation_passed, is_duplicate, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn


def batch_summary(results: DataFrame) -> DataFrame:
    """One row. Counts by type are folded first, so the map is built from a few rows."""
    done = F.col("success")
    figures = results.agg(
        F.count("*").alias("total_documents"), F.count_if(done).alias("successful"),
        F.count_if(~done).alias("failed"), F.sum("processing_time").cast("double").alias("total_time"),
        F.try_divide(F.sum("processing_time").cast("double"), F.count("*")).alias("average_time"),
        F.coalesce(F.sum(F.when(done, F.col("total_amount"))), F.lit(0)).cast("double").alias("total_amount"),
        F.coalesce(F.sum(F.when(done, F.col("total_tax"))), F.lit(0)).cast("double").alias("total_tax"),
        F.countDistinct(F.when(done, F.col("supplier_name"))).alias("unique_suppliers"),
        F.count_if("validation_passed").alias("validation_passed"),
        F.count_if(~F.col("validation_passed")).alias("validation_failed"),
        F.count_if("is_duplicate").alias("duplicates"), F.count_if(~F.col("is_duplicate")).alias("unique_documents"))
    by_type = (results.where(done).groupBy("document_type").agg(F.count("*").alias("n"))
               .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("document_type", "n")))).alias("m")).scalar())
    return figures.withColumn("document_types", by_type)


def top_suppliers(results: DataFrame, n: int = 10) -> DataFrame:
    return (results.where("success AND supplier_name IS NOT NULL").groupBy("supplier_name")
            .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("amount"),
                 F.count("*").alias("invoice_count"))
            .orderBy(F.desc("amount"), "supplier_name").limit(n))


def batch_insights(summary: DataFrame) -> DataFrame:
    ran = F.col("successful") > 0
    validated = F.col("validation_passed") + F.col("validation_failed")
    lines = F.array_compact(F.array(
        F.when(ran, F.format_string("Processed %d of %d documents (%.1f%%)", "successful", "total_documents",
                                    F.col("successful") * 100.0 / F.col("total_documents"))),
        F.when(ran, F.concat(F.lit("Total invoice value: ₹"), F.format_number("total_amount", 2))),
        F.when(ran, F.format_string("Average processing time: %.2fs per document", "average_time")),
        F.when(ran & (F.col("validation_passed") > 0), F.format_string(
            "Validation success rate: %.1f%%", F.try_divide(F.col("validation_passed") * 100.0, validated))),
        F.when(ran & (F.col("duplicates") > 0), F.format_string("%d potential duplicates detected", "duplicates")),
        F.when(ran & (F.col("unique_suppliers") > 0), F.format_string("Invoices from %d suppliers", "unique_suppliers"))))
    return summary.select(F.posexplode(lines).alias("position", "insight"))


def failed_documents(results: DataFrame) -> DataFrame:
    return results.where("NOT success").select("doc_id", F.coalesce("error", F.lit("Unknown error")).alias("error"))


def batch_rates(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.try_divide(F.lit(60.0), F.col("average_time")).alias("documents_per_minute"),
        F.try_divide(F.col("total_amount"), F.col("successful").cast("double")).alias("mean_invoice_value"),
        fn.percent(F.col("validation_passed"), F.col("validation_passed") + F.col("validation_failed")).alias("validation_rate"),
        fn.percent(F.col("duplicates"), F.col("duplicates") + F.col("unique_documents")).alias("duplicate_rate"))
