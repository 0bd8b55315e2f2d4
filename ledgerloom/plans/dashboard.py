"""Dashboard and reporting queries over the core tables.

Each function returns a DataFrame and leaves collecting to the caller. Facts are
aggregated on ids before dimensions are joined, so names never travel through the big
shuffle, and every table is read once per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.functions.aggregates import mean, tax_rate_percent, total
from ledgerloom.lake import Lake


def one_row(spark, **structs: DataFrame) -> DataFrame:
    """Put several one-row frames side by side through scalar subqueries."""
    row = spark.range(1).select(*[
        frame.select(F.struct("*").alias("s")).scalar().alias(name) for name, frame in structs.items()])
    return row.select(*[f"{name}.*" for name in structs])


def _supplier_names(lake: Lake) -> DataFrame:
    return lake.companies.select(F.col("company_id").alias("supplier_company_id"),
                                 F.col("legal_name").alias("supplier_name"))


def key_metrics(lake: Lake) -> DataFrame:
    month_ago = F.date_sub(lake.as_of, 30)
    return one_row(
        lake.spark,
        documents=lake.documents.agg(F.count("*").alias("total_documents")),
        companies=lake.companies.agg(F.count("gstin").alias("registered_companies")),
        invoices=lake.invoices.agg(
            F.coalesce(F.sum(F.when(F.col("status") == "PAID", F.col("total_value"))), F.lit(0))
            .cast("double").alias("paid_revenue"),
            F.count_if(F.col("created_at").cast("date") >= month_ago).alias("recent_invoices"),
            fn.percent(F.count_if("validation"), F.count("*")).alias("validated_percent")))


def recent_invoices(lake: Lake, n: int = 10) -> DataFrame:
    """Latest invoices by load time, with display defaults for missing values."""
    latest = lake.invoices.orderBy(F.desc("created_at"), "invoice_id").limit(n)
    return latest.join(_supplier_names(lake), "supplier_company_id", "left").select(
        "invoice_id", "invoice_num", fn.or_default(F.col("supplier_name"), "Unknown Supplier").alias("supplier"),
        F.coalesce("invoice_date", lake.as_of).alias("invoice_date"),
        F.coalesce(F.col("total_value").cast("double"), F.lit(0.0)).alias("amount"), "status")


def invoices_with_defaults(lake: Lake) -> DataFrame:
    places = lake.companies.select(F.col("company_id").alias("supplier_company_id"), "legal_name", "city")
    return lake.invoices.join(places, "supplier_company_id", "left").select(
        "invoice_id", fn.or_default(F.col("legal_name"), "Unknown Supplier").alias("supplier"),
        F.coalesce("invoice_date", lake.as_of).alias("invoice_date"),
        F.coalesce(F.col("total_value").cast("double"), F.lit(0.0)).alias("amount"),
        fn.or_default(F.col("city"), "Unknown").alias("city"))


def _by_supplier(lake: Lake) -> DataFrame:
    return lake.invoices.groupBy("supplier_company_id").agg(
        F.count("*").alias("invoice_count"), F.sum("total_value").alias("revenue"))


def top_companies(lake: Lake, n: int = 10) -> DataFrame:
    named = lake.companies.join(_by_supplier(lake), F.col("company_id") == F.col("supplier_company_id"))
    return named.where("invoice_count > 0").select(
        "company_id", "legal_name", fn.or_default(F.col("city"), "Unknown").alias("city"),
        "invoice_count", F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"),
    ).orderBy(F.desc("invoice_count"), F.desc("revenue"), "company_id").limit(n)


def revenue_trends(lake: Lake, months: int = 12) -> DataFrame:
    recent = lake.invoices.where(F.col("invoice_date") >= fn.months_back(lake.as_of, months))
    return recent.groupBy(fn.month_of(F.col("invoice_date")).alias("month")).agg(
        total(F.col("total_value")).alias("revenue"), total(F.col("total_tax")).alias("tax"),
        F.count("*").alias("invoice_count")).orderBy(F.desc("month")).limit(months)


def compliance(lake: Lake) -> DataFrame:
    return one_row(
        lake.spark,
        companies=lake.companies.agg(
            F.count("*").alias("total_companies"),
            F.count_if(F.coalesce(F.trim("gstin"), F.lit("")) != "").alias("with_gstin")),
        invoices=lake.invoices.agg(
            fn.percent(F.count_if("validation"), F.count("*")).alias("validation_rate"),
            fn.percent(F.count_if("duplication"), F.count("*")).alias("duplication_rate")))


def product_analytics(lake: Lake, n: int = 10) -> DataFrame:
    used = lake.items.groupBy("product_id").agg(
        F.count("*").alias("usage_count"), F.sum("total_amount").alias("value"))
    return (lake.products.select("product_id", "canonical_name", "hsn_code").join(used, "product_id")
            .select("product_id", "canonical_name", "hsn_code", "usage_count",
                    F.col("value").cast("double").alias("total_value"))
            .orderBy(F.desc("usage_count"), F.desc("total_value"), "product_id").limit(n))


def geographic_distribution(lake: Lake) -> DataFrame:
    placed = lake.companies.where(F.coalesce(F.trim("state"), F.lit("")) != "").select("company_id", "state")
    joined = placed.join(_by_supplier(lake), F.col("company_id") == F.col("supplier_company_id"), "left")
    return joined.groupBy("state").agg(
        F.coalesce(F.sum("invoice_count"), F.lit(0)).alias("invoice_count"),
        total(F.col("revenue")).alias("revenue"), F.countDistinct("company_id").alias("company_count"))


def invoice_summary(lake: Lake) -> DataFrame:
    counts = lake.items.groupBy("invoice_id").agg(F.count("*").alias("item_count"))
    buyers = lake.companies.select(F.col("company_id").alias("buyer_company_id"),
                                   F.col("legal_name").alias("buyer_name"))
    return (lake.invoices.join(counts, "invoice_id", "left").join(_supplier_names(lake), "supplier_company_id", "left")
            .join(buyers, "buyer_company_id", "left")
            .select("invoice_id", "invoice_num", "invoice_date", "supplier_name", "buyer_name",
                    F.col("total_value").cast("double").alias("total_value"), "status",
                    F.coalesce("item_count", F.lit(0)).alias("item_count"))
            .orderBy(F.desc("invoice_date"), "invoice_id"))


def flag_counts(lake: Lake) -> DataFrame:
    return lake.invoices.agg(
        F.count("*").alias("total"), F.count_if("validation").alias("validated"),
        F.count_if("duplication").alias("duplicates"), F.count_if(~F.col("validation")).alias("pending"))


def validation_statistics(lake: Lake) -> DataFrame:
    return lake.invoices.agg(
        F.count("*").alias("total_invoices"), F.count_if("validation").alias("validated"),
        F.count_if(~F.col("validation")).alias("not_validated"),
        fn.percent(F.count_if("validation"), F.count("*"), 2).alias("validation_rate"))


def duplicate_rate_by_supplier(lake: Lake) -> DataFrame:
    rates = lake.invoices.groupBy("supplier_company_id").agg(
        F.count("*").alias("total_invoices"), F.count_if("duplication").alias("duplicates"),
        fn.percent(F.count_if("duplication"), F.count("*"), 2).alias("duplicate_rate"))
    return rates.join(_supplier_names(lake), "supplier_company_id")


def document_type_stats(lake: Lake) -> DataFrame:
    return lake.documents.groupBy("doc_type").agg(
        F.count("*").alias("documents"), mean(F.col("analysis_confidence")).alias("avg_confidence"),
        F.min("created_at").cast("date").alias("first_seen"), F.max("created_at").cast("date").alias("last_seen"),
    ).orderBy(F.desc("documents"), "doc_type")


def financial_totals(lake: Lake) -> DataFrame:
    return lake.invoices.agg(
        F.count("*").alias("invoice_count"), total(F.col("taxable_value")).alias("total_taxable"),
        total(F.col("total_tax")).alias("total_tax"), total(F.col("total_value")).alias("total_value"))


def monthly_totals(lake: Lake, months: int = 12) -> DataFrame:
    recent = lake.invoices.where(F.col("invoice_date") >= fn.months_back(lake.as_of, months))
    return recent.groupBy(fn.month_of(F.col("invoice_date")).alias("month")).agg(
        F.count("*").alias("invoice_count"), total(F.col("total_value")).alias("total_value")).orderBy(F.desc("month"))


def top_suppliers(lake: Lake, n: int = 10) -> DataFrame:
    return (_by_supplier(lake).join(_supplier_names(lake), "supplier_company_id")
            .select("supplier_company_id", "supplier_name", "invoice_count",
                    F.col("revenue").cast("double").alias("total_value"))
            .orderBy(F.desc("total_value"), "supplier_company_id").limit(n))


def processing_stats(lake: Lake) -> DataFrame:
    scored = F.when(F.col("analysis_confidence") > 0, F.col("analysis_confidence"))
    average = F.try_divide(F.sum(scored), F.count(scored)).cast("decimal(20,10)")
    return one_row(
        lake.spark,
        documents=lake.documents.agg(F.count("*").alias("documents"),
                                     F.round(average, 2).cast("double").alias("avg_confidence")),
        invoices=lake.invoices.agg(F.count("*").alias("invoices")),
        companies=lake.companies.agg(F.count("*").alias("companies")),
        products=lake.products.agg(F.count("*").alias("products")))


def general_counts(lake: Lake) -> DataFrame:
    names = {"documents": lake.documents, "companies": lake.companies, "products": lake.products,
             "invoices": lake.invoices, "invoice_item": lake.items, "payment": lake.payments,
             "gst_companies": lake.registry}
    return one_row(lake.spark, **{n: f.agg(F.count("*").alias(n)) for n, f in names.items()})


def business_impact(lake: Lake) -> DataFrame:
    tax_ids = lake.companies.select(F.col("company_id").alias("supplier_company_id"), "gstin")
    return lake.invoices.join(tax_ids, "supplier_company_id", "left").select(
        "invoice_id", F.when(F.col("validation"), "PASSED").otherwise("FAILED").alias("validation_result"),
        F.when(F.col("duplication"), "DUPLICATE DETECTED").otherwise("UNIQUE").alias("duplication_result"),
        F.when(F.coalesce(F.trim("gstin"), F.lit("")) != "", "COMPLIANT").otherwise("NON-COMPLIANT")
        .alias("compliance_result"))


def relationships(lake: Lake, invoice_ids: DataFrame | None = None) -> DataFrame:
    """Item and product counts per invoice, with the cardinality each relation shows."""
    items = lake.items if invoice_ids is None else lake.items.join(invoice_ids, "invoice_id", "left_semi")
    label = lambda c: F.when(F.col(c) == 1, "one-to-one").otherwise("one-to-many")
    counted = items.groupBy("invoice_id").agg(
        F.count("*").alias("item_count"), F.countDistinct("product_id").alias("product_count"))
    return counted.select("*", label("item_count").alias("item_relation"), label("product_count").alias("product_relation"))


def bar_scaling(lake: Lake, shown: int = 6) -> DataFrame:
    """Monthly revenue scaled to bar heights of 20 to 100, with a band by share of the best month."""
    months = lake.invoices.groupBy(fn.month_of(F.col("invoice_date")).alias("month")).agg(
        total(F.col("total_value")).alias("revenue"))
    limits = months.agg(F.struct(F.min("revenue").alias("low"), F.max("revenue").alias("high")).alias("r")).scalar()
    spread = F.col("limits.high") - F.col("limits.low")
    height = F.when(spread == 0, 50.0).otherwise(
        F.greatest(F.lit(20.0), (F.col("revenue") - F.col("limits.low")) / spread * 80 + 20))
    share = F.try_divide(F.col("revenue"), F.col("limits.high"))
    band = (F.when(share >= 0.8, "high").when(share >= 0.6, "good").when(share >= 0.4, "medium").otherwise("low"))
    return (months.withColumn("limits", limits).select("month", "revenue", height.alias("height"), band.alias("band"))
            .orderBy(F.desc("month")).limit(shown))


def share_percentages(lake: Lake) -> DataFrame:
    return one_row(
        lake.spark,
        companies=lake.companies.agg(fn.percent(F.count("gstin"), F.count("*"), 0).alias("gstin_percent")),
        invoices=lake.invoices.agg(
            fn.percent(F.count_if(F.col("status") != "PENDING"), F.count("*"), 0).alias("completed_percent")))


def analysis(lake: Lake, kind: str = "tax_summary", group_by: str = "month") -> DataFrame:
    """One grouped report: kind is tax_summary, supplier_analysis, monthly_trends or
    compliance_check; group_by is supplier, month, product or tax_rate."""
    item_level = group_by in ("product", "tax_rate")
    if item_level:
        flags = lake.invoices.select("invoice_id", "validation", "duplication")
        rows = lake.items.join(flags, "invoice_id")
        key = F.col("product_id") if group_by == "product" else F.col("gst_rate")
        taxable, tax, value = "taxable_value", "gst_amount", "total_amount"
    else:
        rows = lake.invoices
        key = F.col("supplier_company_id") if group_by == "supplier" else fn.month_of(F.col("invoice_date"))
        taxable, tax, value = "taxable_value", "total_tax", "total_value"
    measures = {
        "tax_summary": [total(F.col(taxable)).alias("taxable"), total(F.col(tax)).alias("tax"),
                        mean(tax_rate_percent(F.col(tax), F.col(taxable))).alias("avg_tax_rate")],
        "supplier_analysis": [F.count("*").alias("rows"), total(F.col(value)).alias("value"),
                              mean(F.col(value)).alias("avg_value")],
        "monthly_trends": [F.count("*").alias("rows"), total(F.col(value)).alias("value"),
                           total(F.col(tax)).alias("tax")],
        "compliance_check": [fn.percent(F.count_if("validation"), F.count("*"), 2).alias("validated_percent"),
                             fn.percent(F.count_if("duplication"), F.count("*"), 2).alias("duplicate_percent")],
    }[kind]
    return rows.groupBy(key.cast("string").alias("group_key")).agg(*measures)
