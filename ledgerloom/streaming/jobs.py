"""Incremental jobs: new documents, exact repeats, windowed totals and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerloom import model
from ledgerloom.lake import Lake
from ledgerloom.operators import classify, duplicates, extract, store, validation


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of analysis files that carry their OCR text."""
    return (spark.readStream.schema(f"{model.ANALYSIS_DDL}, ocr_text string").option("multiLine", True).json(path))


def ingest(documents: DataFrame, root: str, checkpoint: str,
           after: Callable[[DataFrame, DataFrame], None] | None = None) -> DataStreamWriter:
    """Classify, extract, store and validate each batch of new documents.

    Ids are hashes of business keys, and rows already stored are left out, so a batch that
    is run again after a failure adds nothing. ``after`` receives the verdicts and the exact
    duplicates of the batch among all stored invoices.
    """
    def run(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        lake = Lake.at(spark, root)
        told = batch.select(extract.document_key(batch).alias("document_key"), classify.analysis_text(batch).alias("told")).dropDuplicates(["document_key"])
        types = classify.classify(told, "told", "document_key").select("document_key", "document_type")
        # Read by each of the written tables.
        extracted = extract.extract_invoices(batch, types).persist()
        rows = store.normalize_extracted(extracted, lake.companies, lake.products)
        keys = {"documents": "doc_id", "companies": "company_id", "products": "product_id", "invoices": "invoice_id",
                "invoice_item": "item_id"}
        fresh = {}
        for name, key in keys.items():
            schema = model.TABLES[name]
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows[name].columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            fresh[name] = rows[name].select(*columns).join(lake.table(name).select(key), key, "left_anti").select(
                *[f.name for f in schema.fields])
        stored_ids = rows["invoices"].select("invoice_id")
        store.append(fresh, root)
        if after is not None:
            now = Lake.at(spark, root)
            mine = now.invoices.join(stored_ids, "invoice_id", "left_semi")
            lines = now.items.join(stored_ids, "invoice_id", "left_semi")
            # Only stored invoices with a number of this batch can be repeats of it.
            number = F.upper(F.trim("invoice_num"))
            asked = now.invoices.withColumn("_number", number).join(
                mine.select(number.alias("_number")).distinct(), "_number", "left_semi").drop("_number")
            exact = duplicates.exact_matches(asked).join(stored_ids, "invoice_id", "left_semi")
            after(validation.verdicts(mine, lines), exact)
        extracted.unpersist()
    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def repeats_of_stored(stream: DataFrame, invoices: DataFrame) -> DataFrame:
    """Arriving invoices whose number, supplier and total are already stored."""
    return stream.join(invoices.select("invoice_num", "supplier_company_id", "total_value"),
                       ["invoice_num", "supplier_company_id", "total_value"], "left_semi")


def first_arrivals(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Arriving invoices without repeats of number, supplier and total inside the delay; state is dropped after it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
        ["invoice_num", "supplier_company_id", "total_value"])


def windowed_revenue(events: DataFrame, time: str, amount: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Totals per window of event time; works on streams and on tables."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w")).agg(
        F.count("*").alias("events"), F.sum(amount).alias("revenue")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "revenue")


def session_activity(events: DataFrame, time: str, user: str, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per user and session, a session ending after a gap; works on streams and on tables."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("events")).select(
        user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
