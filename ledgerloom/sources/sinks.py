"""Writers of reports and registry records as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.returns import returns_summary


def write_batch_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """The summary in ``path/summary`` and one row per document in ``path/results``."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def registry_records(registry: DataFrame, filings: DataFrame) -> DataFrame:
    """Taxpayers with their summary of filings nested."""
    summary = returns_summary(filings).select("gstin", F.struct(
        F.col("total_filings").alias("total_returns_filed"),
        F.struct("total_filings", "return_types", "filing_frequency", "latest_filing", "oldest_filing")
        .alias("returns_summary")).alias("gst_returns"))
    return registry.join(summary, "gstin", "left")


def write_registry_json(registry: DataFrame, filings: DataFrame, path: str) -> None:
    registry_records(registry, filings).write.mode("overwrite").json(path)


def write_hsn_json(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").json(path)
