"""Invoice headers and line items from analysis documents, by rules.

Input: documents in the analysis schema with an ``ocr_text`` column. Everything happens on
the arrays of one document; the only row growth is one row per line item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators.nested import field_map

# Names of a header field, in order of preference.
ALIASES = {
    "invoice_num": ("invoice no.", "invoice num", "invoice number"),
    "invoice_date_text": ("dated", "invoice date", "date"),
    "taxable_text": ("taxable value", "amount"),
    "tax_text": ("total tax amount", "tax amount"),
    "payment_terms": ("mode/terms of payment", "payment terms"),
}
TABLE_WORDS = ("hsn", "sac", "quantity", "rate", "amount", "description", "service")
SIMPLE_TABLE_WORDS = ("hsn", "quantity", "rate", "amount")
SUMMARY_WORDS = ("total", "taxable", "igst", "cgst", "sgst")
DEFAULT_RATE = 18.0


def _contains_any(text: Column, words) -> Column:
    test = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(text, F.lit(word))
    return test


def document_key(docs: DataFrame) -> Column:
    """What tells documents apart: a digest of file name and content. Files of one name stay apart, a file read again does not."""
    return F.md5(raw_json(docs).cast("binary"))


def raw_json(docs: DataFrame) -> Column:
    return F.to_json(F.struct(*docs.columns))


def extract_headers(docs: DataFrame) -> DataFrame:
    """Header attributes per document, from form fields first and from OCR text where those are silent."""
    return _read(docs).drop("line_items")


def _read(docs: DataFrame) -> DataFrame:
    """Headers and line items of each document in its own row: its text for key and raw data is made once."""
    known = docs.withColumns({"_key": document_key(docs), "_raw": raw_json(docs)}).withColumn("_fields", field_map(F.col("form_analysis.form_fields")))
    for name, aliases in ALIASES.items():
        known = known.withColumn(name, F.coalesce(*[F.try_element_at("_fields", F.lit(a)) for a in aliases]))
    keys = F.filter(F.map_keys("_fields"), lambda k: F.contains(k, F.lit("gstin")))
    ocr = F.upper(F.coalesce("ocr_text", F.lit("")))
    in_text = F.nullif(F.regexp_extract(ocr, rf"\b({fn.GSTIN})\b", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(ocr, r"INVOICE\s*(?:NUMBER|NUM|NO)\b\.?\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]*)", 1), F.lit(""))
    terms = F.nullif(F.regexp_extract(ocr, r"\b(\d+ DAYS)\b", 1), F.lit(""))
    taxable, tax = fn.clean_currency(F.col("taxable_text")), fn.clean_currency(F.col("tax_text"))
    return known.select(
        "*", F.coalesce(F.try_element_at("_fields", F.get(keys, F.lit(0))), in_text).alias("supplier_gstin"),
        F.coalesce("invoice_num", number).alias("number"), F.coalesce("payment_terms", terms).alias("terms"),
        F.when(F.col("taxable_text").isNotNull(), taxable).alias("taxable_value"),
        F.when(F.col("tax_text").isNotNull(), tax).alias("total_tax"),
    ).select(
        F.col("_key").alias("document_key"), F.col("file_info.filename").alias("filename"), F.col("file_info.file_size_bytes").alias("file_size_bytes"),
        F.col("_raw").alias("raw_data"),
        F.col("summary.confidence_score").alias("confidence"), "supplier_gstin",
        F.col("number").alias("invoice_num"), fn.parse_invoice_date(F.col("invoice_date_text")).alias("invoice_date"),
        "taxable_value", "total_tax", F.col("terms").alias("payment_terms"),
        derived_total(F.lit(None).cast("double"), F.col("taxable_value"), F.col("total_tax")).alias("total_value"),
        _line_items(F.col("table_analysis.tables")).alias("line_items"))


def derived_total(total: Column, taxable: Column, tax: Column) -> Column:
    """The total, or taxable value plus tax where it is missing and both are there."""
    missing = total.isNull() | (total == 0)
    return F.when(missing & (taxable != 0) & (tax != 0), taxable + tax).otherwise(total)


def _column_kind(title: Column) -> Column:
    has = lambda *w: _contains_any(title, w)
    return (F.when(has("description", "service"), "description").when(has("hsn", "sac"), "hsn")
            .when(has("quantity"), "quantity").when(has("rate") & ~has("amount"), "rate")
            .when(has("taxable") & has("amount"), "taxable_amount").when(has("amount") & ~has("total"), "amount"))


def _header(rows: Column) -> Column:
    return F.transform(F.get(rows, F.lit(0)), lambda c: F.lower(F.coalesce(c, F.lit("none"))))


def _useful(rows: Column, header: Column, words) -> Column:
    """Whether a table has more than a header, and that names one of the words."""
    return (F.size(rows) >= 2) & _contains_any(F.array_join(header, " "), words)


def _tables(docs: DataFrame, words) -> DataFrame:
    """(document_key, filename, table_index, header, rows) of tables whose header names one of the words."""
    tables = docs.select(document_key(docs).alias("document_key"), F.col("file_info.filename").alias("filename"),
                         F.posexplode("table_analysis.tables").alias("table_index", "t"))
    return tables.select("document_key", "filename", "table_index", _header(F.col("t.rows")).alias("header"), F.col("t.rows").alias("rows")).where(
        _useful(F.col("rows"), F.col("header"), words))


def _cell(row: Column, index: Column) -> Column:
    return F.get(row, index)


_KINDS = ("description", "hsn", "quantity", "rate", "taxable_amount", "amount")


def _places(kinds: Column) -> Column:
    """Of each kind the last column that has it."""
    def last(kind):
        return F.array_max(F.transform(kinds, lambda found, i: F.when(found == kind, i)))
    return F.struct(*[last(kind).alias(kind) for kind in _KINDS])


def _is_item(row: Column) -> Column:
    first = F.trim(F.coalesce(_cell(row, F.lit(0)), F.lit("")))
    low = F.lower(first)
    summary = F.startswith(low, F.lit(SUMMARY_WORDS[0]))
    for word in SUMMARY_WORDS[1:]:
        summary = summary | F.startswith(low, F.lit(word))
    return (F.size(row) >= 4) & (first != "") & (first.rlike(r"^\d+$") | ~summary)


def _values(row: Column, places: Column) -> list[Column]:
    def text(kind, fallback):
        return F.coalesce(_cell(row, F.coalesce(places[kind], F.lit(fallback))), F.lit(""))
    worth = F.coalesce(places["taxable_amount"], places["amount"], F.lit(6))
    return [text("description", 1).alias("description"),
            F.when(F.trim(text("hsn", 3)) != "", text("hsn", 3)).otherwise("").alias("hsn_code"),
            fn.extract_number(text("quantity", 4)).alias("quantity"), fn.clean_currency(text("rate", 5)).alias("unit_price"),
            fn.clean_currency(_cell(row, worth)).alias("taxable_value")]


def _is_filled(description: Column, quantity: Column, taxable: Column) -> Column:
    return (F.trim(description) != "") & (description != "Total") & ((taxable > 0) | (quantity > 0))


_LINES = ("array<struct<table_index:int,row_index:int,description:string,hsn_code:string,quantity:double,unit_price:double,"
          "taxable_value:double>>")


def _line_items(tables: Column) -> Column:
    """What ``extract_line_items`` gives, as an array in the document's row, in order of tables and rows."""
    headed = F.transform(tables, lambda t, i: F.struct(i.alias("table_index"), _header(t["rows"]).alias("header"), t["rows"].alias("rows")))
    useful = F.filter(headed, lambda t: _useful(t["rows"], t["header"], TABLE_WORDS))
    kinds = F.transform(useful, lambda t: F.struct(
        t["table_index"].alias("table_index"), F.transform(t["header"], _column_kind).alias("kinds"), t["rows"].alias("rows")))
    placed = F.transform(kinds, lambda t: F.struct(
        t["table_index"].alias("table_index"), _places(t["kinds"]).alias("places"), t["rows"].alias("rows")))

    def of_table(t):
        rows = F.filter(F.transform(t["rows"], lambda r, i: F.struct(i.alias("row_index"), r.alias("row"))),
                        lambda r: (r["row_index"] > 0) & _is_item(r["row"]))
        return F.transform(rows, lambda r: F.struct(
            t["table_index"].alias("table_index"), r["row_index"].alias("row_index"), *_values(r["row"], t["places"])))
    lines = F.filter(F.flatten(F.transform(placed, of_table)), lambda x: _is_filled(x["description"], x["quantity"], x["taxable_value"]))
    return F.coalesce(lines, F.array().cast(_LINES))


def extract_line_items(docs: DataFrame) -> DataFrame:
    """One row per line item of every table that looks like an item table."""
    kinds = _tables(docs, TABLE_WORDS).withColumn("kinds", F.transform("header", _column_kind))
    # Places of the columns once a table, before its rows are spread.
    placed = kinds.select("document_key", "filename", "table_index", _places(F.col("kinds")).alias("places"), "rows")
    rows = placed.select("document_key", "filename", "table_index", "places", F.posexplode("rows").alias("row_index", "row")).where(
        (F.col("row_index") > 0) & _is_item(F.col("row")))
    items = rows.select("filename", "table_index", "row_index", *_values(F.col("row"), F.col("places")), "document_key")
    return items.where(_is_filled(F.col("description"), F.col("quantity"), F.col("taxable_value"))).select(
        "*", F.when(F.col("taxable_value") > 0, DEFAULT_RATE).alias("gst_rate"),
        F.when(F.col("taxable_value") > 0, F.col("taxable_value") * 0.18).alias("gst_amount"))


def extract_line_items_by_position(docs: DataFrame) -> DataFrame:
    """The simple variant: columns 0, 2, 3, 4 and 6, whatever the header says."""
    rows = _tables(docs, SIMPLE_TABLE_WORDS).select(
        "document_key", "filename", "table_index", F.posexplode("rows").alias("row_index", "row")).where(
        (F.col("row_index") > 0) & (F.size("row") >= 4))

    def cell(index):
        return _cell(F.col("row"), F.lit(index))
    return rows.select(
        "filename", "table_index", "row_index", F.coalesce(cell(0), F.lit("")).alias("description"),
        F.when(fn.valid_hsn(cell(2)), F.trim(cell(2))).otherwise("").alias("hsn_code"),
        fn.extract_number(cell(3)).alias("quantity"), fn.clean_currency(cell(4)).alias("unit_price"),
        fn.clean_currency(cell(6)).alias("taxable_value"), "document_key").where(
        (F.col("description") != "") & (F.col("description") != "Total"))


def extract_invoices(docs: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Headers with their line items as an array: the input of ``store.normalize_extracted``.

    ``types``: document_key, document_type.
    """
    heads = _read(docs).dropDuplicates(["document_key"])
    heads = heads.withColumn("document_type", F.lit("B2B_INVOICE")) if types is None else heads.join(types, "document_key", "left")
    return heads.withColumns({"supplier_name": F.lit(None).cast("string"), "supplier_state": F.lit(None).cast("string")})


def extraction_log(docs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per document: outcome, confidence, counts and the keys read with more than 90 % confidence."""
    sure = F.transform(F.filter("form_analysis.form_fields", lambda f: f["confidence"] > 90), lambda f: f["key"])
    seen = docs.select(document_key(docs).alias("document_key"), F.col("file_info.filename").alias("filename"), F.size("form_analysis.form_fields").alias("fields"),
                       F.size("table_analysis.tables").alias("tables"), sure.alias("confident_keys"))
    done = invoices.select("document_key", "document_type", "confidence", F.size("line_items").alias("line_items"),
                           (F.col("invoice_num").isNotNull() & (F.col("taxable_value") > 0)).alias("success"))
    return seen.join(done, "document_key", "left").drop("document_key")
