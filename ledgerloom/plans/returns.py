"""Summary of tax return filings per taxpayer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTH_NAMES = "dd-MMM-yyyy"


def _counts(filings: DataFrame, name: str, out: str) -> DataFrame:
    """Map of counts per taxpayer; counted first, so each map is built from a few rows."""
    counted = filings.where(F.col(name).isNotNull()).groupBy("gstin", name).agg(F.count("*").alias("n"))
    return counted.groupBy("gstin").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(out))


def returns_summary(filings: DataFrame, by_date: bool = False) -> DataFrame:
    """Per taxpayer: total, counts by type and by year, latest and oldest filing.

    Latest and oldest follow the text of the date, as recorded reports have it; ``by_date``
    compares real dates. Filings: gstin, return_type, period, filed_date (text).
    """
    rows = filings.withColumns({
        "year": F.nullif(F.regexp_extract("filed_date", r"20\d{2}", 0), F.lit("")),
        "mark": F.when(F.col("filed_date") != "", F.struct(
            *([F.try_to_timestamp("filed_date", F.lit(MONTH_NAMES)).cast("date").alias("day")] if by_date else []),
            F.col("filed_date").alias("date_str"), "return_type", "period"))})
    totals = rows.groupBy("gstin").agg(
        F.count("*").alias("total_filings"), F.max("mark").alias("latest_filing"), F.min("mark").alias("oldest_filing"))
    return (totals.join(_counts(rows, "return_type", "return_types"), "gstin", "left")
            .join(_counts(rows, "year", "filing_frequency"), "gstin", "left"))
