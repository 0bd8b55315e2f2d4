"""Maintenance of the core tables: append, upsert, get-or-insert, flags.

Tables are plain Parquet, so a change is a new version of the table computed by a join;
``publish`` writes it next to the old one and then points the name at it. Catalogs that
support MERGE can take the same frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn


def new_id(*key: Column) -> Column:
    """An id from a business key: the same on every run and without numbering rows in one place."""
    return F.xxhash64(*[F.coalesce(k.cast("string"), F.lit("")) for k in key]).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def upsert(current: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key of both; an update wins over a stored row of the same version."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (key, "_new")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("r"))
    return newest.select(key, "r.*").select(*current.columns)


def upsert_registry(current: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(current, updates, "gstin", "last_verified")


def merge_snapshots(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fill registry gaps: tax ids that only the snapshot files know."""
    return registry.unionByName(snapshots.join(registry, "gstin", "left_anti"), allowMissingColumns=True)


def get_or_insert_companies(batch: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch with company_id, companies to add). Known tax ids keep their id; rows without one
    are always new. ``batch``: row_id, legal_name, gstin, state, city, and own_id where ids were assigned (see identity.py)."""
    known = companies.where("gstin IS NOT NULL").select("gstin", F.col("company_id").alias("known_id"))
    own = F.col("own_id") if "own_id" in batch.columns else F.when(F.coalesce(F.col("gstin"), F.lit("")) != "", new_id(F.lit("gstin"), F.col("gstin"))).otherwise(
        new_id(F.lit("row"), F.col("row_id")))
    linked = batch.join(known, "gstin", "left").withColumn("company_id", F.coalesce("known_id", own))
    fresh = linked.where("known_id IS NULL")
    added = fresh.groupBy("company_id").agg(F.min_by(F.struct("legal_name", "gstin", "state", "city"), "row_id").alias("r"))
    return linked.drop("known_id"), added.select("company_id", "r.*")


def get_or_insert_products(batch: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch with product_id, products to add), by tariff code and exact name; no id if either is empty."""
    keys = ["hsn_code", "canonical_name"]
    filled = F.coalesce(F.col("hsn_code") != "", F.lit(False)) & F.coalesce(F.col("canonical_name") != "", F.lit(False))
    known = products.groupBy(*keys).agg(F.min("product_id").alias("known_id"))
    linked = batch.join(known, keys, "left").withColumn(
        "product_id", F.when(filled, F.coalesce("known_id", new_id(*[F.col(k) for k in keys]))))
    added = linked.where(F.col("known_id").isNull() & F.col("product_id").isNotNull()).select("product_id", *keys).distinct()
    return linked.drop("known_id"), added


def enrich_companies(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered companies take name and state from the registry, and state and postal code as address."""
    facts = registry.select("gstin", F.col("legal_name").alias("r_name"), F.col("state").alias("r_state"), "pin_code")
    joined = companies.join(facts, "gstin", "left")
    place = F.concat_ws(" - ", F.nullif(F.col("r_state"), F.lit("")), F.nullif(F.col("pin_code"), F.lit("")))
    return joined.withColumns({
        "legal_name": F.coalesce(F.nullif(F.col("r_name"), F.lit("")), "legal_name"),
        "state": F.coalesce(F.nullif(F.col("r_state"), F.lit("")), "state"),
        "address": F.coalesce(F.nullif(place, F.lit("")), "address")}).select(*companies.columns)


def set_flags(invoices: DataFrame, flags: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Invoices with the given flags; ``flags`` holds the key and any of validation, duplication."""
    named = [c for c in ("validation", "duplication") if c in flags.columns]
    new = flags.select(key, *[F.col(c).alias(f"_{c}") for c in named])
    return (invoices.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in named})
            .select(*invoices.columns))


def reset_flags(invoices: DataFrame) -> DataFrame:
    return invoices.withColumns({"validation": F.lit(False), "duplication": F.lit(False)})


def set_document_types(documents: DataFrame, types: DataFrame) -> DataFrame:
    """Documents with the type given per file name."""
    new = types.select("filename", F.col("doc_type").alias("_type"))
    return documents.join(new, "filename", "left").withColumn("doc_type", F.coalesce("_type", "doc_type")).select(
        *documents.columns)


def normalize_extracted(extracted: DataFrame, companies: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Rows to append to documents, companies, products, invoices and invoice_item, in that order.

    ``extracted``: document_key, filename, file_size_bytes, raw_data, document_type, confidence, supplier_name, supplier_gstin, supplier_state,
    invoice_num, invoice_date, taxable_value, total_tax, total_value, line_items. Ids are hashes of
    business keys, so all five frames agree without a lookup and a retried write repeats itself. Columns doc_id and
    supplier_own_id, if there are any, are ids that were assigned with a check for clashes.
    """
    doc_id = F.col("doc_id") if "doc_id" in extracted.columns else new_id(F.lit("doc"), F.col("document_key"))
    money = "decimal(15,2)"

    def amount(name):
        return F.coalesce(F.col(name).try_cast(money), F.lit(0).cast(money))
    docs = extracted.withColumn("doc_id", doc_id)
    parties, new_companies = get_or_insert_companies(docs.select(
        F.col("doc_id").alias("row_id"), F.col("supplier_name").alias("legal_name"), F.col("supplier_gstin").alias("gstin"),
        F.col("supplier_state").alias("state"), F.lit(None).cast("string").alias("city"),
        *[F.col("supplier_own_id").alias("own_id") for _ in [1] if "supplier_own_id" in docs.columns]), companies)
    heads = docs.join(parties.select(F.col("row_id").alias("doc_id"), F.col("company_id").alias("supplier_company_id")), "doc_id")
    invoices = heads.select(
        F.col("doc_id").alias("invoice_id"), "doc_id",
        F.coalesce(F.nullif(F.trim("invoice_num"), F.lit("")), F.concat(F.lit("AUTO-"), F.col("doc_id").cast("string")))
        .alias("invoice_num"), "invoice_date", "supplier_company_id", amount("taxable_value").alias("taxable_value"),
        amount("total_tax").alias("total_tax"), amount("total_value").alias("total_value"), F.lit("INR").alias("currency"),
        F.lit("PROCESSED").alias("status"), F.lit(False).alias("validation"), F.lit(False).alias("duplication"))
    exploded = docs.select("doc_id", F.posexplode("line_items").alias("position", "line")).select(
        "doc_id", "position", F.col("line.description").alias("canonical_name"), F.col("line.hsn_code").alias("hsn_code"),
        F.col("line.quantity").alias("quantity"), F.col("line.unit_price").alias("unit_price"),
        F.col("line.taxable_value").alias("taxable"))
    linked, new_products = get_or_insert_products(exploded, products)
    taxable = F.coalesce(F.col("taxable").try_cast(money), F.lit(0).cast(money))
    gst = F.round(taxable * F.lit("0.18").cast("decimal(4,2)"), 2).cast(money)
    items = linked.select(
        new_id(F.lit("item"), F.col("doc_id"), F.col("position")).alias("item_id"), F.col("doc_id").alias("invoice_id"),
        "product_id", "hsn_code", F.col("canonical_name").alias("item_description"),
        F.coalesce(F.col("quantity").try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")).alias("quantity"),
        F.coalesce(F.col("unit_price").try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")).alias("unit_price"),
        taxable.alias("taxable_value"), F.lit(18).cast("decimal(5,2)").alias("gst_rate"), gst.alias("gst_amount"),
        (taxable + gst).cast(money).alias("total_amount"))
    documents = docs.select("doc_id", F.col("document_type").alias("doc_type"), "filename", "file_size_bytes", "raw_data",
                            F.col("confidence").try_cast("decimal(5,2)").alias("analysis_confidence"))
    return {"documents": documents, "companies": new_companies, "products": new_products, "invoices": invoices,
            "invoice_item": items}


def append(tables: dict[str, DataFrame], root: str) -> None:
    """Append to ``root/<table>``, parents before children, so that a reader never sees an orphan."""
    for name in ("documents", "companies", "products", "invoices", "invoice_item", "payment", "gst_companies"):
        if name in tables:
            tables[name].write.mode("append").parquet(f"{root}/{name}")
