"""Invoices with known faults, to measure what the checks find.

Everything is a function of the row number and a seed, so the same call gives the same rows
on any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAULTS = ("arithmetic_error", "summation_error", "quantity_duplication", "wrong_tax_rate", "same_invoice_diff_date",
          "logical_adjustment")


def _pick(seed: int, n: int, *keys) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(n))


def headers_of(heads: DataFrame, items: DataFrame) -> DataFrame:
    """Header rows with the sums of their items."""
    money = "decimal(15,2)"
    sums = items.groupBy("invoice_id").agg(F.sum("taxable_value").cast(money).alias("taxable_value"),
                                           F.sum("gst_amount").cast(money).alias("total_tax"))
    return heads.join(sums, "invoice_id").withColumn("total_value", (F.col("taxable_value") + F.col("total_tax")).cast(money))


def clean_invoices(spark: SparkSession, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(invoices, items): 4 to 7 lines each at 18 %, split between two halves, all sums consistent."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "invoice_id")
    lines = ids.select("invoice_id", F.explode(F.sequence(F.lit(1).cast("bigint"), 4 + _pick(seed, 4, "invoice_id"))).alias("line"))
    money, price = "decimal(15,2)", "decimal(10,2)"
    priced = lines.select(
        (F.col("invoice_id") * 100 + F.col("line")).alias("item_id"), "invoice_id",
        (_pick(seed + 1, 50, "invoice_id", "line") + 1).alias("product_id"),
        (_pick(seed + 2, 20, "invoice_id", "line") + 1).cast(price).alias("quantity"),
        ((_pick(seed + 3, 500000, "invoice_id", "line") + 1000) * F.expr("0.01")).cast(price).alias("unit_price"))
    items = priced.withColumns({
        "hsn_code": (84000000 + F.col("product_id")).cast("string"),
        "item_description": F.concat(F.lit("Product "), F.col("product_id").cast("string")),
        "taxable_value": (F.col("quantity") * F.col("unit_price")).cast(money)})
    items = taxed(items, F.lit(18))
    heads = ids.select(
        "invoice_id", F.col("invoice_id").alias("doc_id"), F.concat(F.lit("GEN-"), F.col("invoice_id").cast("string")).alias("invoice_num"),
        F.date_add(F.lit("2025-01-01").cast("date"), _pick(seed + 4, 180, "invoice_id").cast("int")).alias("invoice_date"),
        (_pick(seed + 5, 5, "invoice_id") + 1).alias("supplier_company_id"), F.lit("INR").alias("currency"),
        F.lit("PENDING").alias("status"), F.lit(False).alias("validation"), F.lit(False).alias("duplication"))
    return headers_of(heads, items), items


def taxed(items: DataFrame, rate: Column) -> DataFrame:
    """Items with tax columns that follow from taxable value and rate; no interstate tax."""
    money, kind = "decimal(15,2)", "decimal(5,2)"
    half = F.round(F.col("taxable_value") * F.col("_rate") * F.expr("0.005"), 2)
    found = items.withColumn("_rate", rate.cast(kind)).withColumns({
        "sgst_rate": (F.col("_rate") * F.expr("0.5")).cast(kind), "cgst_rate": (F.col("_rate") * F.expr("0.5")).cast(kind),
        "igst_rate": F.lit(0).cast(kind), "gst_rate": F.col("_rate"), "sgst_amount": half.cast(money), "cgst_amount": half.cast(money),
        "igst_amount": F.lit(0).cast(money)})
    found = found.withColumn("gst_amount", (F.col("sgst_amount") + F.col("cgst_amount")).cast(money))
    return found.withColumn("total_amount", (F.col("taxable_value") + F.col("gst_amount")).cast(money)).drop("_rate")


def inject(invoices: DataFrame, items: DataFrame, fault: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(invoices, items) with one fault in every invoice, named in a ``fault`` column of the headers."""
    money, price = "decimal(15,2)", "decimal(10,2)"
    columns = items.columns
    first = items.groupBy("invoice_id").agg(F.min("item_id").alias("_first"))
    marked = items.join(first, "invoice_id").withColumn("_hit", F.col("item_id") == F.col("_first"))
    steps = F.array(*[F.lit(x).cast(money) for x in (1, 10, 100, 1000)])
    heads, changed = invoices, items
    if fault == "arithmetic_error":
        step = F.element_at(steps, (_pick(seed, 4, "invoice_id") + 1).cast("int"))
        changed = marked.withColumn("taxable_value", F.when(F.col("_hit"), F.col("taxable_value") + step).otherwise(
            F.col("taxable_value")).cast(money))
        heads = headers_of(invoices.drop("taxable_value", "total_tax", "total_value"), changed)
    elif fault == "summation_error":
        step = ((_pick(seed, 99, "invoice_id") + 2) * F.expr("0.01")).cast(money)
        heads = invoices.withColumn("total_tax", (F.col("total_tax") + step).cast(money))
    elif fault == "quantity_duplication":
        again = marked.where("_hit").withColumns({
            "item_id": F.col("item_id") + 50, "quantity": (F.col("quantity") + 1).cast(price),
            "taxable_value": ((F.col("quantity") + 1) * F.col("unit_price")).cast(money)})
        changed = items.unionByName(again.select(*columns))
        tax = items.groupBy("invoice_id").agg(F.sum("gst_amount").alias("_tax"))
        heads = headers_of(invoices.drop("taxable_value", "total_tax", "total_value"), changed).join(tax, "invoice_id").withColumn(
            "total_tax", F.col("_tax").cast(money)).drop("_tax").withColumn(
            "total_value", (F.col("taxable_value") + F.col("total_tax")).cast(money))
    elif fault == "wrong_tax_rate":
        rates = F.array(*[F.lit(r) for r in (5, 12, 28)])
        wrong = taxed(marked, F.when(F.col("_hit"), F.element_at(rates, (_pick(seed, 3, "invoice_id") + 1).cast("int"))).otherwise(18))
        changed = wrong
        heads = headers_of(invoices.drop("taxable_value", "total_tax", "total_value"), changed)
    elif fault == "same_invoice_diff_date":
        top = invoices.agg(F.max("invoice_id")).scalar()
        again = invoices.withColumns({"invoice_id": F.col("invoice_id") + top, "invoice_date": F.date_add("invoice_date", 9)})
        heads = invoices.unionByName(again)
        changed = items.unionByName(items.withColumn("_top", invoices.agg(F.max("invoice_id")).scalar()).withColumns({
            "invoice_id": F.col("invoice_id") + F.col("_top"), "item_id": F.col("item_id") + F.col("_top") * 100}).drop("_top"))
    elif fault == "logical_adjustment":
        step = (F.when(_pick(seed, 2, "item_id") == 0, F.expr("0.01")).otherwise(F.expr("-0.02"))).cast(money)
        changed = items.withColumn("taxable_value", (F.col("taxable_value") + step).cast(money))
        heads = headers_of(invoices.drop("taxable_value", "total_tax", "total_value"), changed)
    else:
        raise ValueError(f"unknown fault {fault}")
    return heads.withColumn("fault", F.lit(fault)), changed.select(*columns)


def sample_star(spark: SparkSession, months: int = 6, per_month: int = 10, seed: int = 0) -> dict[str, DataFrame]:
    """Five companies, eight products, invoices of some months with items and payments."""
    invoices, items = clean_invoices(spark, months * per_month, seed)
    companies = spark.range(1, 6).select(
        F.col("id").alias("company_id"), F.concat(F.lit("Company "), F.col("id").cast("string")).alias("legal_name"),
        F.concat(F.lit("24AAAAA000"), F.col("id").cast("string"), F.lit("A1Z5")).alias("gstin"), F.lit("Gujarat").alias("state"))
    products = spark.range(1, 9).select(
        F.col("id").alias("product_id"), F.concat(F.lit("Product "), F.col("id").cast("string")).alias("canonical_name"),
        (84000000 + F.col("id")).cast("string").alias("hsn_code"), F.lit(18).cast("decimal(5,2)").alias("default_tax_rate"))
    payments = invoices.where("invoice_id % 2 = 0").select(
        F.col("invoice_id").alias("payment_id"), "doc_id", "invoice_id", F.date_add("invoice_date", 30).alias("payment_date"),
        F.lit("NEFT").alias("payment_method"), F.col("total_value").alias("amount"))
    return {"companies": companies, "products": products, "invoices": invoices, "invoice_item": items, "payment": payments}
