"""Trends, rankings, growth, overviews and anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.functions.aggregates import mean, tax_rate_percent, total
from ledgerloom.lake import Lake
from ledgerloom.operators.ranking import global_rank


def _since(lake: Lake, months: int) -> DataFrame:
    return lake.invoices.where(F.col("invoice_date") >= fn.months_back(lake.as_of, months))


def _named(lake: Lake) -> DataFrame:
    return lake.companies.select(F.col("company_id").alias("supplier_company_id"),
                                 F.col("legal_name").alias("supplier_name"))


def period_statistics(lake: Lake, months: int = 24) -> DataFrame:
    value = F.col("total_value")
    return _since(lake, months).groupBy(fn.month_of(F.col("invoice_date")).alias("period")).agg(
        F.count("*").alias("invoice_count"), total(value).alias("period_total"), mean(value).alias("avg_value"),
        F.min(value).cast("double").alias("min_value"), F.max(value).cast("double").alias("max_value"),
    ).orderBy(F.desc("period"))


def value_statistics(lake: Lake) -> DataFrame:
    """Overall figures and the number of invoices above the mean, which is a scalar subquery."""
    value = F.col("total_value")
    average = lake.invoices.agg(mean(value)).scalar()
    return lake.invoices.agg(
        F.count("*").alias("total_invoices"), mean(value).alias("mean_value"),
        F.min(value).cast("double").alias("min_value"), F.max(value).cast("double").alias("max_value"),
        total(value).alias("total_amount"), F.count_if(value.cast("double") > average).alias("above_average"))


def _supplier_facts(lake: Lake) -> DataFrame:
    value = F.col("total_value")
    return lake.invoices.groupBy("supplier_company_id").agg(
        F.count("*").alias("invoice_count"), total(value).alias("total_amount"), mean(value).alias("avg_amount"),
        F.min("invoice_date").alias("first_invoice"), F.max("invoice_date").alias("latest_invoice"),
        F.countDistinct(fn.month_of(F.col("invoice_date"))).alias("active_months"))


def supplier_comparison(lake: Lake, n: int = 20) -> DataFrame:
    facts = _supplier_facts(lake).where("invoice_count > 1").drop("active_months")
    best = facts.orderBy(F.desc("total_amount"), "supplier_company_id").limit(n)
    return best.join(_named(lake), "supplier_company_id", "left")


def quarterly_breakdown(lake: Lake, months: int = 36) -> DataFrame:
    rate = tax_rate_percent(F.col("total_tax"), F.col("taxable_value"))
    return _since(lake, months).groupBy(
        F.year("invoice_date").cast("bigint").alias("year"), F.quarter("invoice_date").cast("bigint").alias("quarter")
    ).agg(F.count("*").alias("transaction_count"), total(F.col("taxable_value")).alias("total_taxable"),
          total(F.col("total_tax")).alias("total_tax_paid"), total(F.col("total_value")).alias("total_revenue"),
          mean(rate).alias("avg_tax_rate")).orderBy(F.desc("year"), F.desc("quarter"))


def cross_table_analysis(lake: Lake) -> DataFrame:
    """Per supplier and tax id: counts, sums, mean effective tax rate, first and last date.

    Invoices are folded per supplier id first; names and tax ids are joined afterwards
    on the normalized name.
    """
    rate = tax_rate_percent(F.col("total_tax"), F.col("taxable_value"))
    facts = lake.invoices.groupBy("supplier_company_id").agg(
        F.count("*").alias("invoice_count"), total(F.col("total_value")).alias("total_amount"),
        mean(rate).alias("avg_tax_rate"), F.min("invoice_date").alias("first_invoice"),
        F.max("invoice_date").alias("latest_invoice"))
    named = facts.join(_named(lake), "supplier_company_id").drop("supplier_company_id")
    key = lambda c: F.upper(F.trim(c))
    others = lake.companies.select(F.col("legal_name").alias("company_name"), "gstin")
    return named.join(others, key("supplier_name") == key("company_name"), "left")


def database_overview(lake: Lake) -> DataFrame:
    """One row per table with typed NULLs where a figure does not exist."""
    invoices = lake.invoices.agg(
        F.lit("invoices").alias("table_name"), F.count("*").alias("record_count"),
        F.min("invoice_date").alias("earliest_date"), F.max("invoice_date").alias("latest_date"),
        total(F.col("total_value")).alias("total_value"),
        F.countDistinct("supplier_company_id").alias("unique_parties"))
    companies = lake.companies.agg(
        F.lit("companies").alias("table_name"), F.count("*").alias("record_count"),
        F.min("created_at").cast("date").alias("earliest_date"), F.max("created_at").cast("date").alias("latest_date"),
        F.lit(None).cast("double").alias("total_value"), F.countDistinct("gstin").alias("unique_parties"))
    return invoices.unionByName(companies)


def growth(lake: Lake, months: int = 24) -> DataFrame:
    """Month totals with the change against the month before.

    The window has no partition, but it runs over one row per month, after grouping.
    """
    monthly = _since(lake, months).groupBy(fn.month_of(F.col("invoice_date")).alias("month")).agg(
        F.count("*").alias("invoice_count"), total(F.col("total_value")).alias("monthly_total"),
        mean(F.col("total_value")).alias("monthly_avg"))
    before = F.lag("monthly_total").over(W.orderBy("month"))
    return (monthly.withColumn("prev_month_total", before)
            .withColumn("growth_rate", F.try_divide(
                (F.col("monthly_total") - F.col("prev_month_total")) * 100, F.col("prev_month_total")))
            .orderBy(F.desc("month")))


def supplier_performance(lake: Lake) -> DataFrame:
    """Suppliers with two or more invoices, ranked by business and by frequency."""
    facts = _supplier_facts(lake).where("invoice_count >= 2")
    ranked = global_rank(global_rank(facts, "total_amount", "business_rank"), "invoice_count", "frequency_rank")
    return (ranked.join(_named(lake), "supplier_company_id", "left")
            .withColumn("days_since_last", F.date_diff(lake.as_of, "latest_invoice").cast("bigint")))


def anomaly_flags(lake: Lake, months: int = 12, n: int = 50, by_variance: bool = False) -> DataFrame:
    """The largest recent invoices, each with a flag; the limit is 2 sigma above the mean.

    ``by_variance`` uses the variance in place of sigma, as older reports did.
    """
    value = F.col("total_value").cast("double")
    # Moments from exact decimal sums, so the limit is the same on every run.
    exact = F.col("total_value").cast("decimal(18,2)")
    moments = lake.invoices.agg(
        (F.sum(exact).cast("double") / F.count(exact)).alias("m"),
        (F.sum((exact * exact).cast("decimal(38,4)")).cast("double") / F.count(exact)).alias("m2"))
    spread = "m2 - m * m" if by_variance else "sqrt(m2 - m * m)"
    limit = moments.select(F.expr(f"m + 2 * ({spread})")).scalar()
    rate = F.try_divide(F.col("total_tax").cast("double"), F.col("taxable_value").cast("double"))
    flag = (F.when(value > limit, "HIGH_VALUE_ANOMALY").when(rate > 0.3, "HIGH_TAX_RATE")
            .when(value < 100, "LOW_VALUE_TRANSACTION").otherwise("NORMAL"))
    return (_since(lake, months).select("invoice_id", "invoice_num", value.alias("total_value"), flag.alias("anomaly_type"))
            .orderBy(F.desc("total_value"), "invoice_id").limit(n))
