"""Lookups, filters and listings over the core tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import model
from ledgerloom.functions import scalars as fn
from ledgerloom.lake import Lake


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def sample_rows(lake: Lake, table: str, n: int = 5) -> DataFrame:
    return lake.table(table).orderBy(model.primary_key(table)).limit(n)


def table_info(lake: Lake) -> DataFrame:
    """One row per column of every core table, with the row count of its table."""
    columns = [(t, f.name, f.dataType.simpleString(), not f.nullable, bool(f.metadata["primary_key"]))
               for t, schema in model.TABLES.items() for f in schema.fields]
    described = lake.spark.createDataFrame(
        columns, "table_name string, column_name string, type string, required boolean, primary_key boolean")
    counts = reduce(DataFrame.unionByName, [
        lake.table(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in model.TABLES])
    return described.join(counts, "table_name")


def table_groups(spark: SparkSession) -> DataFrame:
    """Every reference between tables, with the group each side belongs to."""
    def group(table):
        return "financial" if table in model.FINANCIAL_TABLES else (
            "reference" if table in model.REFERENCE_TABLES else "core")
    rows = [(child, column, group(child), parent, key, group(parent))
            for child, column, parent, key in model.references()]
    return spark.createDataFrame(rows, "child_table string, child_column string, child_group string, "
                                       "parent_table string, parent_column string, parent_group string")


def invoices_by_flag(lake: Lake, validation: bool | None = None, duplication: bool | None = None) -> DataFrame:
    tests = [F.col(c) == F.lit(wanted) for c, wanted in
             (("validation", validation), ("duplication", duplication)) if wanted is not None]
    return lake.invoices.where(_all(tests)).select("invoice_id", "invoice_num", "total_value")


def invoice_status(lake: Lake, invoice_id: int) -> DataFrame:
    return lake.invoices.where(F.col("invoice_id") == invoice_id).select(
        "invoice_id", "invoice_num", "validation", "duplication", "status", "total_value", "created_at")


def status_labels(lake: Lake) -> DataFrame:
    names = lake.companies.select(F.col("company_id").alias("supplier_company_id"), F.col("legal_name").alias("supplier"))
    return lake.invoices.join(names, "supplier_company_id", "left").select(
        "invoice_id", "invoice_num", "invoice_date", "supplier",
        F.when(F.col("validation"), "Validated").otherwise("Not Validated").alias("validation_status"),
        F.when(F.col("duplication"), "Duplicate").otherwise("Unique").alias("duplication_status"),
    ).orderBy(F.desc("invoice_date"), "invoice_id")


def exact_duplicates_of(batch: DataFrame, invoices: DataFrame) -> DataFrame:
    """Rows of a batch whose number, supplier and total are already stored."""
    return batch.join(invoices, ["invoice_num", "supplier_company_id", "total_value"], "left_semi")


def company_by_gstin(lake: Lake, gstin: str) -> DataFrame:
    return lake.companies.where(F.col("gstin") == gstin)


def document_preview(lake: Lake, length: int = 100) -> DataFrame:
    text = F.col("raw_data")
    return lake.documents.select(
        "doc_id", "doc_type", "filename",
        F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
        .alias("preview"), "created_at").orderBy(F.desc("created_at"), "doc_id")


def documents_where(lake: Lake, doc_type: str | None = None, since: Column | None = None,
                    min_confidence: float | None = None, json_path: str | None = None,
                    above: float | None = None) -> DataFrame:
    tests = []
    if doc_type is not None:
        tests.append(F.col("doc_type") == doc_type)
    if since is not None:
        tests.append(F.col("created_at").cast("date") >= since)
    if min_confidence is not None:
        tests.append(F.col("analysis_confidence") > min_confidence)
    if json_path is not None:
        tests.append(F.get_json_object("raw_data", json_path).try_cast("double") > above)
    return lake.documents.where(_all(tests))


def _like(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def search_invoices(lake: Lake, supplier: str | None = None, buyer: str | None = None, gstin: str | None = None,
                    number: str | None = None, date_from: str | None = None, date_to: str | None = None,
                    amount_min: float | None = None, amount_max: float | None = None, status: str | None = None,
                    validation: bool | None = None, duplication: bool | None = None) -> DataFrame:
    """Any combination of optional conditions; names and numbers match in part.

    Conditions on the invoice reach the scan. Parties are joined only as far as named.
    """
    tests = []
    for value, make in ((number, lambda v: _like("invoice_num", v)),
                        (date_from, lambda v: F.col("invoice_date") >= F.lit(v).cast("date")),
                        (date_to, lambda v: F.col("invoice_date") <= F.lit(v).cast("date")),
                        (amount_min, lambda v: F.col("total_value") >= v),
                        (amount_max, lambda v: F.col("total_value") <= v),
                        (status, lambda v: F.col("status") == v),
                        (validation, lambda v: F.col("validation") == F.lit(v)),
                        (duplication, lambda v: F.col("duplication") == F.lit(v))):
        if value is not None:
            tests.append(make(value))
    found = lake.invoices.where(_all(tests))
    suppliers = []
    if supplier is not None:
        suppliers.append(_like("legal_name", supplier))
    if gstin is not None:
        suppliers.append(F.col("gstin") == gstin)
    for role, conditions in (("supplier_company_id", suppliers),
                             ("buyer_company_id", [] if buyer is None else [_like("legal_name", buyer)])):
        if conditions:
            parties = lake.companies.where(_all(conditions)).select(F.col("company_id").alias(role))
            found = found.join(parties, role, "left_semi")
    return found


def search_companies(lake: Lake, name: str | None = None, gstin: str | None = None, state: str | None = None,
                     status: str | None = None, include_gst: bool = False) -> DataFrame:
    tests = []
    if name is not None:
        tests.append(_like("legal_name", name))
    if gstin is not None:
        tests.append(F.col("gstin") == gstin)
    if state is not None:
        tests.append(F.col("state") == state)
    found = lake.companies.where(_all(tests))
    if status is not None or include_gst:
        facts = lake.registry.select("gstin", F.col("status").alias("registry_status"), "trade_name", "pan")
        found = found.join(facts, "gstin", "left")
        if status is not None:
            found = found.where(F.col("registry_status") == status)
    return found


def search_products(lake: Lake, name: str | None = None, hsn: str | None = None, rate: float | None = None,
                    uom: str | None = None) -> DataFrame:
    tests = []
    if name is not None:
        tests.append(_like("canonical_name", name))
    if hsn is not None:
        tests.append(F.startswith(F.col("hsn_code"), F.lit(hsn)))
    if rate is not None:
        tests.append(F.col("default_tax_rate") == rate)
    if uom is not None:
        tests.append(F.col("unit_of_measure") == uom)
    return lake.products.where(_all(tests))


def track_payments(lake: Lake, invoice_id: int | None = None, status: str | None = None,
                   date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    tests = []
    if invoice_id is not None:
        tests.append(F.col("invoice_id") == invoice_id)
    if status is not None:
        tests.append(F.col("status") == status)
    if date_from is not None:
        tests.append(F.col("payment_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        tests.append(F.col("payment_date") <= F.lit(date_to).cast("date"))
    return lake.payments.where(_all(tests))


def query(lake: Lake, table: str, filters: dict | None = None, join_tables: list[str] | None = None,
          fields: list[str] | None = None, limit: int | None = None, sort_by: str | None = None) -> DataFrame:
    """A request given as data: equality filters, joins along declared references, fields, order, limit.

    Columns of joined tables are named ``table.column`` in requests and ``table_column`` in the result.
    """
    found = lake.table(table)
    for name, wanted in (filters or {}).items():
        found = found.where(F.col(name) == F.lit(wanted))
    for other in join_tables or []:
        link = next((r for r in model.references() if r[0] == table and r[2] == other), None)
        if link is None:
            raise ValueError(f"{table} does not refer to {other}")
        side = lake.table(other)
        side = side.select([F.col(c).alias(f"{other}_{c}") for c in side.columns])
        found = found.join(side, F.col(link[1]) == F.col(f"{other}_{link[3]}"), "left")
    if fields:
        found = found.select(*[f.replace(".", "_") for f in fields])
    if sort_by:
        found = found.orderBy(F.desc(sort_by[1:]) if sort_by.startswith("-") else F.asc(sort_by))
    return found if limit is None else found.limit(limit)


def inserted_records(lake: Lake, table: str, ids: DataFrame) -> DataFrame:
    """Long form of given rows: one row per record and field, with type, description and shown text.

    ``ids`` has one column, the key of the table.
    """
    key = model.primary_key(table)
    rows = lake.table(table).join(ids, key, "left_semi")
    fields = [f for f in model.TABLES[table].fields if f.name in rows.columns]
    entries = F.array(*[
        F.struct(F.lit(f.name).alias("field"), F.col(f.name).cast("string").alias("value"),
                 F.lit(f.dataType.simpleString()).alias("type"),
                 F.lit(f.metadata["description"]).alias("description"),
                 fn.formatted_value(f.name, F.col(f.name)).alias("formatted_value")) for f in fields])
    return rows.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"),
                       F.explode(entries).alias("e")).select("table_name", "record_id", "e.*")


def latest_invoices(lake: Lake, n: int = 10) -> DataFrame:
    """Latest invoices by date, with supplier, buyer and amounts as nested structs."""
    latest = lake.invoices.orderBy(F.desc("invoice_date"), "invoice_id").limit(n)

    def party(role):
        return lake.companies.select(F.col("company_id").alias(f"{role}_company_id"),
                                     F.struct(F.col("legal_name").alias("name"), "gstin").alias(role))
    return (latest.join(party("supplier"), "supplier_company_id", "left").join(party("buyer"), "buyer_company_id", "left")
            .select("invoice_id", "invoice_num", "invoice_date", "supplier", "buyer",
                    F.struct(F.col("taxable_value").alias("taxable"), F.col("total_tax").alias("tax"),
                             F.col("total_value").alias("total")).alias("amounts"), "status")
            .orderBy(F.desc("invoice_date"), "invoice_id"))


def companies_by_name(lake: Lake, n: int = 15) -> DataFrame:
    facts = lake.registry.select("gstin", "trade_name", F.col("status").alias("registry_status"))
    first = lake.companies.orderBy("legal_name", "company_id").limit(n)
    return first.join(facts, "gstin", "left").select(
        "company_id", "legal_name", "gstin", "state", "trade_name", "registry_status").orderBy("legal_name", "company_id")


def products_by_name(lake: Lake, n: int = 15) -> DataFrame:
    return lake.products.orderBy("canonical_name", "product_id").limit(n)


def latest_payments(lake: Lake, n: int = 10) -> DataFrame:
    numbers = lake.invoices.select("invoice_id", "invoice_num", "total_value")
    return lake.payments.join(numbers, "invoice_id").orderBy(F.desc("payment_date"), "payment_id").limit(n)
