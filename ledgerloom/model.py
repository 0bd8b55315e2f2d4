"""The seven core tables and the nested document types, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, TEXT, DATE, TIME, BOOL = (T.LongType(), T.StringType(), T.DateType(),
                                T.TimestampType(), T.BooleanType())
MONEY, PRICE, RATE = T.DecimalType(15, 2), T.DecimalType(10, 2), T.DecimalType(5, 2)


def _table(kind: str, key: str, *columns) -> T.StructType:
    """columns: (name, type, description[, 'table.column' it refers to])."""
    schema = T.StructType()
    for name, dtype, about, *ref in columns:
        required = about.startswith("!")
        schema.add(T.StructField(name, dtype, not (required or name == key), {
            "description": about.lstrip("!"), "table_type": kind,
            "primary_key": name == key, "references": ref[0] if ref else "",
        }))
    return schema


TABLES: dict[str, T.StructType] = {
    "documents": _table(
        "core", "doc_id",
        ("doc_id", LONG, "document id"), ("doc_type", TEXT, "!document type"),
        ("created_at", TIME, "load time"), ("filename", TEXT, "source file"),
        ("file_size_bytes", LONG, "file size"),
        ("analysis_confidence", RATE, "confidence, 0 to 100"),
        ("raw_data", TEXT, "analysis as JSON text")),
    "companies": _table(
        "reference", "company_id",
        ("company_id", LONG, "company id"), ("legal_name", TEXT, "!registered name"),
        ("gstin", TEXT, "tax id", "gst_companies.gstin"), ("city", TEXT, "city"),
        ("state", TEXT, "state"), ("address", TEXT, "address"), ("phone", TEXT, "phone"),
        ("email", TEXT, "e-mail"), ("created_at", TIME, "load time")),
    "products": _table(
        "reference", "product_id",
        ("product_id", LONG, "product id"), ("canonical_name", TEXT, "!product name"),
        ("hsn_code", TEXT, "!tariff code"), ("default_tax_rate", RATE, "tax rate in percent"),
        ("description", TEXT, "description"), ("unit_of_measure", TEXT, "unit"),
        ("created_at", TIME, "load time")),
    "invoices": _table(
        "transaction", "invoice_id",
        ("invoice_id", LONG, "invoice id"), ("doc_id", LONG, "!source document", "documents.doc_id"),
        ("invoice_num", TEXT, "!number on the invoice"), ("invoice_date", DATE, "invoice date"),
        ("supplier_company_id", LONG, "supplier", "companies.company_id"),
        ("buyer_company_id", LONG, "buyer", "companies.company_id"),
        ("taxable_value", MONEY, "value before tax"), ("total_tax", MONEY, "tax"),
        ("total_value", MONEY, "value with tax"), ("currency", TEXT, "currency"),
        ("status", TEXT, "status"), ("validation", BOOL, "passed validation"),
        ("duplication", BOOL, "marked as duplicate"), ("created_at", TIME, "load time")),
    "invoice_item": _table(
        "transaction", "item_id",
        ("item_id", LONG, "item id"), ("invoice_id", LONG, "!invoice", "invoices.invoice_id"),
        ("product_id", LONG, "product", "products.product_id"), ("hsn_code", TEXT, "tariff code"),
        ("item_description", TEXT, "description"), ("quantity", PRICE, "quantity"),
        ("unit_price", PRICE, "unit price"), ("taxable_value", MONEY, "value before tax"),
        ("gst_rate", RATE, "combined rate"), ("gst_amount", MONEY, "combined tax"),
        ("sgst_rate", RATE, "state rate"), ("sgst_amount", MONEY, "state tax"),
        ("cgst_rate", RATE, "central rate"), ("cgst_amount", MONEY, "central tax"),
        ("igst_rate", RATE, "interstate rate"), ("igst_amount", MONEY, "interstate tax"),
        ("total_amount", MONEY, "value with tax"), ("created_at", TIME, "load time")),
    "payment": _table(
        "transaction", "payment_id",
        ("payment_id", LONG, "payment id"), ("doc_id", LONG, "source document", "documents.doc_id"),
        ("invoice_id", LONG, "invoice", "invoices.invoice_id"), ("payment_date", DATE, "date"),
        ("payment_method", TEXT, "method"), ("amount", MONEY, "amount"),
        ("transaction_ref", TEXT, "reference"), ("bank_details", TEXT, "bank"),
        ("status", TEXT, "status"), ("created_at", TIME, "load time")),
    "gst_companies": _table(
        "audit", "gst_id",
        ("gst_id", LONG, "registry row id"), ("gstin", TEXT, "!tax id"),
        ("legal_name", TEXT, "registered name"), ("trade_name", TEXT, "trade name"),
        ("pan", TEXT, "income tax id"), ("registration_date", TEXT, "registration date as text"),
        ("constitution", TEXT, "legal form"), ("taxpayer_type", TEXT, "taxpayer type"),
        ("status", TEXT, "registration status"), ("state", TEXT, "state"),
        ("pin_code", TEXT, "postal code"), ("cancellation_date", TEXT, "'-' when none"),
        ("state_jurisdiction", TEXT, "state office"), ("centre_jurisdiction", TEXT, "central office"),
        ("nature_of_business", TEXT, "activities"), ("api_source", TEXT, "origin"),
        ("last_verified", TIME, "last check"), ("created_at", TIME, "load time")),
}

# Groups of tables by use.
FINANCIAL_TABLES = ("invoices", "invoice_item", "payment")
REFERENCE_TABLES = ("companies", "products", "gst_companies")


def references() -> list[tuple[str, str, str, str]]:
    """(child table, child column, parent table, parent column) of every reference."""
    found = []
    for table, schema in TABLES.items():
        for field in schema.fields:
            target = field.metadata["references"]
            if target:
                found.append((table, field.name, *target.split(".")))
    return found


def primary_key(table: str) -> str:
    return next(f.name for f in TABLES[table].fields if f.metadata["primary_key"])


_FILING = "struct<return_type:string,period:string,filed_date:string,status:string,amount:string,liability:string>"
_FILING_MARK = "struct<date_str:string,return_type:string,period:string>"

ANALYSIS_DDL = (
    "file_info struct<filename:string,file_size_bytes:bigint,analyzed_at:string>, "
    "form_analysis struct<form_fields:array<struct<key:string,value:string,confidence:double>>,"
    "total_fields:int,fields_with_values:int,error:string>, "
    "table_analysis struct<tables:array<struct<rows:array<array<string>>,row_count:int,"
    "column_count:int,confidence:double>>,total_tables:int,total_cells:int,error:string>, "
    "layout_analysis struct<layout_elements:array<struct<type:string,layout_type:string,"
    "confidence:double,text:string>>,total_elements:int,element_types:array<string>,message:string>, "
    "summary struct<document_type:string,confidence_score:double,key_findings:array<string>,"
    "recommended_actions:array<string>>")

BLOCKS_DDL = (
    "doc_id string, Blocks array<struct<Id:string,BlockType:string,Text:string,Confidence:double,"
    "EntityTypes:array<string>,RowIndex:int,ColumnIndex:int,LayoutType:string,"
    "Relationships:array<struct<Type:string,Ids:array<string>>>>>")

OCR_DDL = "filename string, ocr_text string, generated_at string"

REGISTRY_DDL = (
    "gstin string, legal_name string, trade_name string, pan string, registration_date string, "
    "constitution string, taxpayer_type string, status string, state string, pin_code string, "
    "cancellation_date string, state_jurisdiction string, centre_jurisdiction string, "
    "nature_of_business string, api_source string, extracted_on string, "
    "gst_returns struct<total_returns_filed:int,returns_summary:struct<total_filings:int,"
    "return_types:map<string,int>,filing_frequency:map<string,int>,"
    f"latest_filing:{_FILING_MARK},oldest_filing:{_FILING_MARK}>,detailed_filings:array<{_FILING}>>")

HSN_DDL = (
    "hsn_code string, description string, gst_rate string, cgst_rate string, sgst_rate string, "
    "igst_rate string, cess_rate string, category string, chapter string, heading string, "
    "sub_heading string, tariff_item string, api_source string, extracted_on string, valid boolean")

STRUCTURED_DDL = (
    "invoice_number string, invoice_date string, due_date string, "
    "vendor struct<name:string,address:string,gstin:string,phone:string,email:string>, "
    "customer struct<name:string,address:string,gstin:string>, "
    "items array<struct<description:string,quantity:double,unit_price:double,total_amount:double>>, "
    "totals struct<subtotal:double,cgst:double,sgst:double,igst:double,grand_total:double>, "
    "currency string, terms_conditions string")
