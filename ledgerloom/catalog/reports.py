"""Queries of dashboards, analysis, rankings, listings and lookups."""

from pyspark.sql import functions as F

from ledgerloom import bridge
from ledgerloom.bridge import AS_OF, oracle
from ledgerloom.catalog.registry import add
from ledgerloom.functions import scalars as fn
from ledgerloom.functions.aggregates import mean
from ledgerloom.operators import neighbours
from ledgerloom.plans import analysis as an
from ledgerloom.plans import dashboard as db
from ledgerloom.plans import search as se

TODAY = f"DATE '{AS_OF}'"
_PCT = "coalesce(CAST(round(CAST({part} AS DECIMAL(18,0)) * 100.0 / nullif({whole}, 0), {digits}) AS DOUBLE), 0)"


def pct(condition, digits=1, whole="count(*)"):
    """Percent of rows that meet a condition, rounded from an exact decimal quotient."""
    part = f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"
    return (f"CAST(round(CAST(100.0 * {part} / {whole} AS DECIMAL(20,8)), {digits}) AS DOUBLE)")


def dbl(expr):
    return f"CAST({expr} AS DOUBLE)"


def cnt(condition):
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def avg(expr):
    return f"CAST(sum({expr}) AS DOUBLE) / count({expr})"


RATE = "CAST(CAST(total_tax AS DOUBLE) * 100 / CAST(taxable_value AS DOUBLE) AS DECIMAL(18,6))"
MONTH = "strftime(invoice_date, '%Y-%m')"


def since(months):
    return f"invoice_date >= {TODAY} - INTERVAL {months} MONTH"


def q(name, run, sql, *ctes, describe=False):
    add(name, lambda s, d: run(bridge.lake(s, d, describe)), oracle(sql, *ctes))


# Dashboards
q("agg01_key_metrics", db.key_metrics, f"""SELECT (SELECT count(*) FROM docs) AS total_documents,
  (SELECT count(gstin) FROM companies) AS registered_companies,
  {dbl("coalesce(sum(CASE WHEN status = 'PAID' THEN total_value END), 0)")} AS paid_revenue,
  {cnt(f"CAST(created_at AS DATE) >= {TODAY} - 30")} AS recent_invoices,
  {pct("validation")} AS validated_percent FROM invoices""")
q("agg02_top_companies", db.top_companies, f"""SELECT company_id, legal_name, city, count(*) AS invoice_count,
  {dbl("sum(total_value)")} AS revenue FROM companies JOIN invoices ON company_id = supplier_company_id
  GROUP BY 1, 2, 3 ORDER BY invoice_count DESC, revenue DESC, company_id LIMIT 10""")
q("agg03_revenue_trends", db.revenue_trends, f"""SELECT {MONTH} AS month, {dbl("sum(total_value)")} AS revenue,
  {dbl("sum(total_tax)")} AS tax, count(*) AS invoice_count FROM invoices WHERE {since(12)}
  GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
q("agg04_compliance", db.compliance, f"""SELECT (SELECT count(*) FROM companies) AS total_companies,
  (SELECT count(*) FROM companies WHERE gstin <> '') AS with_gstin, {pct("validation")} AS validation_rate,
  {pct("duplication")} AS duplication_rate FROM invoices""")
q("agg05_product_analytics", db.product_analytics, f"""SELECT p.product_id, canonical_name, p.hsn_code,
  count(*) AS usage_count, {dbl("sum(total_amount)")} AS total_value FROM products p JOIN items i
  ON p.product_id = i.product_id GROUP BY 1, 2, 3 ORDER BY usage_count DESC, total_value DESC, 1 LIMIT 10""")
q("agg06_geographic_distribution", db.geographic_distribution, f"""SELECT state, count(invoice_id) AS invoice_count,
  {dbl("coalesce(sum(total_value), 0)")} AS revenue, count(DISTINCT company_id) AS company_count
  FROM companies LEFT JOIN invoices ON company_id = supplier_company_id WHERE state <> '' GROUP BY 1""")
q("agg07_invoice_summary", db.invoice_summary, f"""SELECT h.invoice_id, invoice_num, invoice_date,
  s.legal_name AS supplier_name, b.legal_name AS buyer_name, {dbl("total_value")} AS total_value, status,
  count(item_id) AS item_count FROM invoices h LEFT JOIN companies s ON supplier_company_id = s.company_id
  LEFT JOIN companies b ON buyer_company_id = b.company_id LEFT JOIN items i ON h.invoice_id = i.invoice_id
  GROUP BY 1, 2, 3, 4, 5, 6, 7""")
q("agg08_flag_counts", db.flag_counts, f"""SELECT count(*) AS total, {cnt("validation")} AS validated,
  {cnt("duplication")} AS duplicates, {cnt("NOT validation")} AS pending FROM invoices""")
q("agg09_validation_statistics", db.validation_statistics, f"""SELECT count(*) AS total_invoices,
  {cnt("validation")} AS validated, {cnt("NOT validation")} AS not_validated,
  {pct("validation", 2)} AS validation_rate FROM invoices""")
q("agg10_duplicate_rate_by_supplier", db.duplicate_rate_by_supplier, f"""SELECT supplier_company_id,
  legal_name AS supplier_name, count(*) AS total_invoices, {cnt("duplication")} AS duplicates,
  {pct("duplication", 2)} AS duplicate_rate FROM invoices JOIN companies ON supplier_company_id = company_id
  GROUP BY 1, 2""")
q("agg12_document_type_stats", db.document_type_stats, f"""SELECT doc_type, count(*) AS documents,
  {avg("analysis_confidence")} AS avg_confidence, CAST(min(created_at) AS DATE) AS first_seen,
  CAST(max(created_at) AS DATE) AS last_seen FROM docs GROUP BY 1""")
q("agg13_financial_totals", db.financial_totals, f"""SELECT count(*) AS invoice_count,
  {dbl("sum(taxable_value)")} AS total_taxable, {dbl("sum(total_tax)")} AS total_tax,
  {dbl("sum(total_value)")} AS total_value FROM invoices""")
q("agg14_monthly_totals", db.monthly_totals, f"""SELECT {MONTH} AS month, count(*) AS invoice_count,
  {dbl("sum(total_value)")} AS total_value FROM invoices WHERE {since(12)} GROUP BY 1""")
q("agg15_top_suppliers", db.top_suppliers, f"""SELECT supplier_company_id, legal_name AS supplier_name,
  count(*) AS invoice_count, {dbl("sum(total_value)")} AS total_value FROM invoices
  JOIN companies ON supplier_company_id = company_id GROUP BY 1, 2 ORDER BY total_value DESC, 1 LIMIT 10""")
q("agg16_period_statistics", an.period_statistics, f"""SELECT {MONTH} AS period, count(*) AS invoice_count,
  {dbl("sum(total_value)")} AS period_total, {avg("total_value")} AS avg_value, {dbl("min(total_value)")} AS min_value,
  {dbl("max(total_value)")} AS max_value FROM invoices WHERE {since(24)} GROUP BY 1""")
q("agg17_value_statistics", an.value_statistics, f"""SELECT count(*) AS total_invoices, {avg("total_value")} AS mean_value,
  {dbl("min(total_value)")} AS min_value, {dbl("max(total_value)")} AS max_value, {dbl("sum(total_value)")} AS total_amount,
  {cnt(f"CAST(total_value AS DOUBLE) > (SELECT {avg('total_value')} FROM invoices)")} AS above_average FROM invoices""")
q("agg18_supplier_comparison", an.supplier_comparison, f"""SELECT supplier_company_id, legal_name AS supplier_name,
  count(*) AS invoice_count, {dbl("sum(total_value)")} AS total_amount, {avg("total_value")} AS avg_amount,
  min(invoice_date) AS first_invoice, max(invoice_date) AS latest_invoice FROM invoices
  LEFT JOIN companies ON supplier_company_id = company_id GROUP BY 1, 2 HAVING count(*) > 1
  ORDER BY total_amount DESC, 1 LIMIT 20""")
q("agg19_quarterly_breakdown", an.quarterly_breakdown, f"""SELECT year(invoice_date) AS year,
  quarter(invoice_date) AS quarter, count(*) AS transaction_count, {dbl("sum(taxable_value)")} AS total_taxable,
  {dbl("sum(total_tax)")} AS total_tax_paid, {dbl("sum(total_value)")} AS total_revenue, {avg(RATE)} AS avg_tax_rate
  FROM invoices WHERE {since(36)} GROUP BY 1, 2""")
q("agg20_cross_table_analysis", an.cross_table_analysis, f"""SELECT f.*, o.legal_name AS company_name, o.gstin FROM (
  SELECT legal_name AS supplier_name, count(*) AS invoice_count, {dbl("sum(total_value)")} AS total_amount,
    {avg(RATE)} AS avg_tax_rate, min(invoice_date) AS first_invoice, max(invoice_date) AS latest_invoice
  FROM invoices JOIN companies ON supplier_company_id = company_id GROUP BY supplier_company_id, legal_name) f
  LEFT JOIN companies o ON upper(trim(supplier_name)) = upper(trim(o.legal_name))""")
q("agg21_distinct_hsn", lambda k: k.items.where("hsn_code IS NOT NULL").groupBy("invoice_id").agg(
    F.countDistinct("hsn_code").alias("codes"), F.min("hsn_code").alias("first_code")),
  "SELECT invoice_id, count(DISTINCT hsn_code) AS codes, min(hsn_code) AS first_code FROM items GROUP BY 1")
q("agg22_processing_stats", db.processing_stats, f"""SELECT (SELECT count(*) FROM docs) AS documents,
  (SELECT CAST(round(CAST({avg('analysis_confidence')} AS DECIMAL(20,10)), 2) AS DOUBLE) FROM docs
   WHERE analysis_confidence > 0) AS avg_confidence, (SELECT count(*) FROM invoices) AS invoices,
  (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM products) AS products""")
q("agg23_general_counts", db.general_counts, "SELECT " + ", ".join(
    f"(SELECT count(*) FROM {view}) AS {name}" for name, view in (
        ("documents", "docs"), ("companies", "companies"), ("products", "products"), ("invoices", "invoices"),
        ("invoice_item", "items"), ("payment", "payment"), ("gst_companies", "gst_companies"))))
q("agg24_business_impact", db.business_impact, """SELECT invoice_id,
  CASE WHEN validation THEN 'PASSED' ELSE 'FAILED' END AS validation_result,
  CASE WHEN duplication THEN 'DUPLICATE DETECTED' ELSE 'UNIQUE' END AS duplication_result,
  CASE WHEN gstin <> '' THEN 'COMPLIANT' ELSE 'NON-COMPLIANT' END AS compliance_result
  FROM invoices LEFT JOIN companies ON supplier_company_id = company_id""")
q("agg25_relationships", db.relationships, """SELECT *, CASE WHEN item_count = 1 THEN 'one-to-one' ELSE 'one-to-many' END
  AS item_relation, CASE WHEN product_count = 1 THEN 'one-to-one' ELSE 'one-to-many' END AS product_relation
  FROM (SELECT invoice_id, count(*) AS item_count, count(DISTINCT product_id) AS product_count FROM items GROUP BY 1) x""")

_FLAGGED = "items i JOIN invoices h ON i.invoice_id = h.invoice_id"
for _group, _key, _from, _tax, _value, _taxable in (
        ("month", MONTH, "invoices", "total_tax", "total_value", "taxable_value"),
        ("supplier", "supplier_company_id", "invoices", "total_tax", "total_value", "taxable_value"),
        ("product", "product_id", _FLAGGED, "gst_amount", "total_amount", "i.taxable_value"),
        ("tax_rate", "gst_rate", _FLAGGED, "gst_amount", "total_amount", "i.taxable_value")):
    _r = f"CAST(CAST({_tax} AS DOUBLE) * 100 / CAST({_taxable} AS DOUBLE) AS DECIMAL(18,6))"
    for _kind, _cols in (
            ("tax_summary", f"{dbl(f'sum({_taxable})')} AS taxable, {dbl(f'sum({_tax})')} AS tax, {avg(_r)} AS avg_tax_rate"),
            ("supplier_analysis", f"count(*) AS rows, {dbl(f'sum({_value})')} AS value, {avg(_value)} AS avg_value"),
            ("monthly_trends", f"count(*) AS rows, {dbl(f'sum({_value})')} AS value, {dbl(f'sum({_tax})')} AS tax"),
            ("compliance_check", f"{pct('validation', 2)} AS validated_percent, {pct('duplication', 2)} AS duplicate_percent")):
        q(f"agg29_{_kind}_by_{_group}", lambda k, kind=_kind, g=_group: db.analysis(k, kind, g),
          f"SELECT CAST({_key} AS VARCHAR) AS group_key, {_cols} FROM {_from} GROUP BY 1")

# Windows
q("win01_growth", an.growth, f"""SELECT *, (monthly_total - prev_month_total) * 100 / prev_month_total AS growth_rate FROM (
  SELECT *, lag(monthly_total) OVER (ORDER BY month) AS prev_month_total FROM (
    SELECT {MONTH} AS month, count(*) AS invoice_count, {dbl("sum(total_value)")} AS monthly_total,
      {avg("total_value")} AS monthly_avg FROM invoices WHERE {since(24)} GROUP BY 1) a) b""")
q("win02_supplier_performance", an.supplier_performance, f"""SELECT f.*, legal_name AS supplier_name,
  rank() OVER (ORDER BY total_amount DESC) AS business_rank, rank() OVER (ORDER BY invoice_count DESC) AS frequency_rank,
  CAST({TODAY} - latest_invoice AS BIGINT) AS days_since_last FROM (
    SELECT supplier_company_id, count(*) AS invoice_count, {dbl("sum(total_value)")} AS total_amount,
      {avg("total_value")} AS avg_amount, min(invoice_date) AS first_invoice, max(invoice_date) AS latest_invoice,
      count(DISTINCT {MONTH}) AS active_months FROM invoices GROUP BY 1 HAVING count(*) >= 2) f
  LEFT JOIN companies ON supplier_company_id = company_id""")

# Listings
q("srt01_recent_invoices", db.recent_invoices, f"""SELECT invoice_id, invoice_num,
  coalesce(legal_name, 'Unknown Supplier') AS supplier, invoice_date, {dbl("total_value")} AS amount, status
  FROM invoices LEFT JOIN companies ON supplier_company_id = company_id
  ORDER BY invoices.created_at DESC, invoice_id LIMIT 10""")


def _latest(k):
    return se.latest_invoices(k).select(
        "invoice_id", "invoice_num", "invoice_date", F.col("supplier.name").alias("supplier"),
        F.col("supplier.gstin").alias("supplier_gstin"), F.col("buyer.name").alias("buyer"),
        F.col("amounts.total").cast("double").alias("total"), "status")


q("srt02_latest_invoices", _latest, f"""SELECT invoice_id, invoice_num, invoice_date, s.legal_name AS supplier,
  s.gstin AS supplier_gstin, b.legal_name AS buyer, {dbl("total_value")} AS total, status FROM invoices
  LEFT JOIN companies s ON supplier_company_id = s.company_id LEFT JOIN companies b ON buyer_company_id = b.company_id
  ORDER BY invoice_date DESC, invoice_id LIMIT 10""")
q("srt03_companies_by_name", se.companies_by_name, """SELECT company_id, c.legal_name, c.gstin, c.state, trade_name,
  g.status AS registry_status FROM companies c LEFT JOIN gst_companies g ON c.gstin = g.gstin
  ORDER BY c.legal_name, company_id LIMIT 15""")
q("srt04_products_by_name", lambda k: se.products_by_name(k).select("product_id", "canonical_name", "hsn_code"),
  "SELECT product_id, canonical_name, hsn_code FROM products ORDER BY canonical_name, product_id LIMIT 15")
q("srt05_latest_payments", lambda k: se.latest_payments(k).select(
    "payment_id", "payment_date", "payment_method", F.col("amount").cast("double").alias("amount"), "invoice_num"),
  f"""SELECT payment_id, payment_date, payment_method, {dbl("amount")} AS amount, invoice_num FROM payment p
  JOIN invoices i ON p.invoice_id = i.invoice_id ORDER BY payment_date DESC, payment_id LIMIT 10""")
q("set01_database_overview", an.database_overview, f"""SELECT 'invoices' AS table_name, count(*) AS record_count,
  min(invoice_date) AS earliest_date, max(invoice_date) AS latest_date, {dbl("sum(total_value)")} AS total_value,
  count(DISTINCT supplier_company_id) AS unique_parties FROM invoices
  UNION ALL SELECT 'companies', count(*), CAST(min(created_at) AS DATE), CAST(max(created_at) AS DATE), NULL,
  count(DISTINCT gstin) FROM companies""")
q("sub01_above_average", lambda k: k.invoices.where(
    F.col("total_value").cast("double") > k.invoices.agg(mean(F.col("total_value"))).scalar()).select("invoice_id"),
  f"SELECT invoice_id FROM invoices WHERE CAST(total_value AS DOUBLE) > (SELECT {avg('total_value')} FROM invoices)")
q("sub02_months_above_previous", lambda k: an.growth(k).where("growth_rate > 0").select("month", "growth_rate"),
  f"""SELECT month, growth_rate FROM (SELECT month, (v - p) * 100 / p AS growth_rate FROM (
  SELECT month, v, lag(v) OVER (ORDER BY month) AS p FROM (SELECT {MONTH} AS month, {dbl("sum(total_value)")} AS v
  FROM invoices WHERE {since(24)} GROUP BY 1) a) b) c WHERE growth_rate > 0""")
q("rsk01_anomaly_flags", an.anomaly_flags, f"""SELECT invoice_id, invoice_num, {dbl("total_value")} AS total_value,
  CASE WHEN CAST(total_value AS DOUBLE) > (SELECT m + 2 * sqrt(m2 - m * m) FROM (SELECT
      CAST(sum(total_value) AS DOUBLE) / count(*) AS m,
      CAST(sum(CAST(total_value AS DECIMAL(18,2)) * CAST(total_value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m2
      FROM invoices) x) THEN 'HIGH_VALUE_ANOMALY'
    WHEN CAST(total_tax AS DOUBLE) / CAST(taxable_value AS DOUBLE) > 0.3 THEN 'HIGH_TAX_RATE'
    WHEN total_value < 100 THEN 'LOW_VALUE_TRANSACTION' ELSE 'NORMAL' END AS anomaly_type
  FROM invoices WHERE {since(12)} ORDER BY total_value DESC, invoice_id LIMIT 50""")

# Lookups and filters
q("prj01_sample_rows", lambda k: se.sample_rows(k, "invoices").select(
    "invoice_id", "invoice_num", "invoice_date", F.col("total_value").cast("double").alias("total_value")),
  f"SELECT invoice_id, invoice_num, invoice_date, {dbl('total_value')} AS total_value FROM invoices ORDER BY 1 LIMIT 5")
q("prj02_table_info", lambda k: se.table_info(k).groupBy("table_name").agg(
    F.count("*").alias("columns"), F.max("row_count").alias("row_count")),
  "SELECT * FROM (" + " UNION ALL ".join(
      f"SELECT '{n}' AS table_name, CAST({c} AS BIGINT) AS columns, count(*) AS row_count FROM {v}" for n, c, v in (
          ("documents", 7, "docs"), ("companies", 9, "companies"), ("products", 7, "products"),
          ("invoices", 14, "invoices"), ("invoice_item", 18, "items"), ("payment", 10, "payment"),
          ("gst_companies", 18, "gst_companies"))) + ") x")
_FLAG_COLS = "SELECT invoice_id, invoice_num, CAST(total_value AS DOUBLE) AS total_value FROM invoices WHERE "
for _n, _args, _where in (("unvalidated", {"validation": False}, "NOT validation"),
                          ("validated", {"validation": True}, "validation"),
                          ("duplicate", {"duplication": True}, "duplication"),
                          ("unique", {"duplication": False}, "NOT duplication")):
    q(f"prj03_{_n}_invoices", lambda k, a=_args: se.invoices_by_flag(k, **a).withColumn(
        "total_value", F.col("total_value").cast("double")), _FLAG_COLS + _where)
q("prj04_invoice_status", lambda k: se.invoice_status(k, 42).select(
    "invoice_id", "invoice_num", "validation", "duplication", "status"),
  "SELECT invoice_id, invoice_num, validation, duplication, status FROM invoices WHERE invoice_id = 42")
q("prj05_status_labels", se.status_labels, """SELECT invoice_id, invoice_num, invoice_date, legal_name AS supplier,
  CASE WHEN validation THEN 'Validated' ELSE 'Not Validated' END AS validation_status,
  CASE WHEN duplication THEN 'Duplicate' ELSE 'Unique' END AS duplication_status
  FROM invoices LEFT JOIN companies ON supplier_company_id = company_id""")


def _probe(k):
    batch = k.invoices.selectExpr(
        "invoice_id AS batch_id", "CASE WHEN invoice_id % 3 = 0 THEN concat(invoice_num, 'X') ELSE invoice_num END "
        "AS invoice_num", "supplier_company_id", "total_value")
    return se.exact_duplicates_of(batch, k.invoices).select("batch_id")


q("prj06_exact_duplicate_exists", _probe, """SELECT invoice_id AS batch_id FROM invoices a WHERE invoice_id % 3 <> 0
  AND EXISTS (SELECT 1 FROM invoices b WHERE a.invoice_num = b.invoice_num
  AND a.supplier_company_id = b.supplier_company_id AND a.total_value = b.total_value)""")
q("prj07_company_by_gstin", lambda k: se.company_by_gstin(k, "16AAAAA0003A1Z5").unionByName(
    se.company_by_gstin(k, "17AAAAA0002A1Z5")).select("company_id", "legal_name", "gstin", "state"),
  "SELECT company_id, legal_name, gstin, state FROM companies WHERE gstin IN ('16AAAAA0003A1Z5', '17AAAAA0002A1Z5')")
q("prj08_document_preview", lambda k: se.document_preview(k, 25).select("doc_id", "doc_type", "filename", "preview"),
  """SELECT doc_id, doc_type, filename, CASE WHEN length(raw_data) > 25 THEN substr(raw_data, 1, 25) || '...'
  ELSE raw_data END AS preview FROM docs""")
q("prj09_documents_by_type", lambda k: se.documents_where(k, doc_type="B2B_INVOICE").select("doc_id", "filename"),
  "SELECT doc_id, filename FROM docs WHERE doc_type = 'B2B_INVOICE'")
q("prj09_documents_this_month", lambda k: se.documents_where(k, since=F.trunc(k.as_of, "month")).select("doc_id"),
  f"SELECT doc_id FROM docs WHERE created_at >= date_trunc('month', {TODAY})")
q("prj09_confident_documents", lambda k: se.documents_where(k, min_confidence=90).select("doc_id"),
  "SELECT doc_id FROM docs WHERE analysis_confidence > 90")
q("prj09_documents_by_json", lambda k: se.documents_where(k, json_path="$.amount", above=10000).select("doc_id"),
  "SELECT doc_id FROM docs WHERE CAST(json_extract_string(raw_data, '$.amount') AS DOUBLE) > 10000")
q("prj10_search_invoices", lambda k: se.search_invoices(
    k, supplier="supplier#00000000", number="inv-00", date_from="1996-01-01", date_to="2000-12-31",
    amount_min=1000, amount_max=400000, status="PAID", validation=True).select("invoice_id"),
  """SELECT invoice_id FROM invoices JOIN companies ON supplier_company_id = company_id
  WHERE lower(legal_name) LIKE '%supplier#00000000%' AND lower(invoice_num) LIKE '%inv-00%'
  AND invoice_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND total_value BETWEEN 1000 AND 400000
  AND status = 'PAID' AND validation""")
q("prj11_search_companies", lambda k: se.search_companies(k, name="supplier", status="Cancelled").select(
    "company_id", "legal_name", "gstin", "registry_status"),
  """SELECT company_id, c.legal_name, c.gstin, g.status AS registry_status FROM companies c
  JOIN gst_companies g ON c.gstin = g.gstin WHERE lower(c.legal_name) LIKE '%supplier%' AND g.status = 'Cancelled'""")
q("prj12_search_products", lambda k: se.search_products(k, name="ring", hsn="84000", rate=18, uom="NOS").select(
    "product_id", "canonical_name"),
  """SELECT product_id, canonical_name FROM products WHERE lower(canonical_name) LIKE '%ring%'
  AND hsn_code LIKE '84000%' AND default_tax_rate = 18 AND unit_of_measure = 'NOS'""")
q("prj13_track_payments", lambda k: se.track_payments(
    k, status="COMPLETED", date_from="1998-01-01", date_to="1998-12-31").select("payment_id", "payment_date"),
  """SELECT payment_id, payment_date FROM payment WHERE status = 'COMPLETED'
  AND payment_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
q("prj14_query_object", lambda k: se.query(
    k, "payment", {"payment_method": "UPI"}, ["invoices"], ["payment_id", "invoices.invoice_num"], 20, "-payment_id"),
  """SELECT payment_id, invoice_num AS invoices_invoice_num FROM payment p LEFT JOIN invoices i
  ON p.invoice_id = i.invoice_id WHERE payment_method = 'UPI' ORDER BY payment_id DESC LIMIT 20""")


def _inserted(k):
    ids = k.invoices.where("status = 'PROCESSED'").select("invoice_id")
    return se.inserted_records(k, "invoices", ids).where(
        F.col("field").isin("invoice_num", "total_value", "invoice_date")).select(
        "table_name", "record_id", "field", "description", "formatted_value")


q("prj15_inserted_records", _inserted, " UNION ALL ".join(
    f"""SELECT 'invoices' AS table_name, invoice_id AS record_id, '{f}' AS field, '{about}' AS description,
    {shown} AS formatted_value FROM invoices WHERE status = 'PROCESSED'""" for f, about, shown in (
        ("invoice_num", "number on the invoice", "invoice_num"),
        ("total_value", "value with tax", "'₹' || format('{:,.2f}', CAST(total_value AS DOUBLE))"),
        ("invoice_date", "invoice date", "CAST(invoice_date AS VARCHAR)"))))
q("prj16_formatted_values", lambda k: k.documents.select(
    "doc_id", *[fn.formatted_value(c, F.col(c)).alias(c) for c in (
        "created_at", "file_size_bytes", "analysis_confidence", "doc_type")]),
  """SELECT doc_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  CASE WHEN file_size_bytes > 1048576 THEN format('{:.1f} MB', file_size_bytes / 1048576.0)
       WHEN file_size_bytes > 1024 THEN format('{:.1f} KB', CAST(file_size_bytes AS DOUBLE) / 1024)
       ELSE CAST(file_size_bytes AS VARCHAR) || ' bytes' END AS file_size_bytes,
  CAST(analysis_confidence AS VARCHAR) || '%' AS analysis_confidence, doc_type FROM docs""")
q("prj17_display_defaults", db.invoices_with_defaults, f"""SELECT invoice_id,
  coalesce(nullif(trim(legal_name), ''), 'Unknown Supplier') AS supplier, coalesce(invoice_date, {TODAY}) AS invoice_date,
  {dbl("coalesce(total_value, 0)")} AS amount, coalesce(nullif(trim(city), ''), 'Unknown') AS city
  FROM invoices LEFT JOIN companies ON supplier_company_id = company_id""")

# Joins
q("jn01_invoices_with_supplier", lambda k: k.invoices.join(
    k.companies, F.col("supplier_company_id") == F.col("company_id"), "left").select("invoice_id", "legal_name", "gstin"),
  "SELECT invoice_id, legal_name, gstin FROM invoices LEFT JOIN companies ON supplier_company_id = company_id")


def _parties(k):
    s, b = k.companies.alias("s"), k.companies.alias("b")
    return (k.invoices.join(s, F.col("supplier_company_id") == F.col("s.company_id"), "left")
            .join(b, F.col("buyer_company_id") == F.col("b.company_id"), "left")
            .select("invoice_id", F.col("s.legal_name").alias("supplier"), F.col("b.legal_name").alias("buyer")))


q("jn02_invoices_with_parties", _parties, """SELECT invoice_id, s.legal_name AS supplier, b.legal_name AS buyer
  FROM invoices LEFT JOIN companies s ON supplier_company_id = s.company_id
  LEFT JOIN companies b ON buyer_company_id = b.company_id""")
q("jn03_companies_with_registry", lambda k: k.companies.join(
    k.registry.select("gstin", F.col("status").alias("registry_status"), "pan"), "gstin", "left").select(
        "company_id", "gstin", "registry_status", "pan"),
  """SELECT company_id, c.gstin, g.status AS registry_status, pan FROM companies c
  LEFT JOIN gst_companies g ON c.gstin = g.gstin""")
q("jn04_payments_with_invoice", lambda k: k.payments.join(
    k.invoices.select("invoice_id", "invoice_num"), "invoice_id").select("payment_id", "invoice_num"),
  "SELECT payment_id, invoice_num FROM payment p JOIN invoices i ON p.invoice_id = i.invoice_id")
q("jn05_items_with_product", lambda k: k.items.join(
    k.products.select("product_id", "canonical_name"), "product_id", "left").select("item_id", "canonical_name"),
  "SELECT item_id, canonical_name FROM items i LEFT JOIN products p ON i.product_id = p.product_id")


def _by_name(s, d):
    k = bridge.lake(s, d)
    extracted = bridge.raw(s, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("  "), F.lower("s_name"), F.lit(" ")).alias("written"))
    return extracted.join(k.companies, F.upper(F.trim("written")) == F.upper(F.trim("legal_name"))).select(
        "s_suppkey", "company_id")


add("jn06_normalized_name_join", _by_name, oracle("""SELECT s_suppkey, company_id FROM supplier JOIN companies
  ON upper(trim('  ' || lower(s_name) || ' ')) = upper(trim(legal_name))"""))


def _same_amount(k):
    rounded = k.invoices.withColumn("total_value", F.round("total_value", -3))
    found = neighbours.groups_with_members(rounded, ["supplier_company_id", "total_value"])
    return found.withColumn("total_value", F.col("total_value").cast("double"))


_SAME_AMOUNT = """SELECT invoice_id, supplier_company_id, CAST(total_value AS DOUBLE) AS total_value, group_size, first_id,
  CAST(group_size * (group_size - 1) // 2 AS BIGINT) AS pairs_in_group FROM (SELECT *,
    count(*) OVER w AS group_size, min(invoice_id) OVER w AS first_id FROM (SELECT invoice_id, supplier_company_id,
      round(total_value / 1000, 0) * 1000 AS total_value FROM invoices) r
    WINDOW w AS (PARTITION BY supplier_company_id, total_value)) x WHERE group_size > 1"""
q("jn07_same_supplier_and_amount", _same_amount, _SAME_AMOUNT)
q("jn08_amount_within_1000", lambda k: neighbours.within_amount(k.invoices, 1000).withColumn(
    "total_value", F.col("total_value").cast("double")),
  """SELECT a.invoice_id, CAST(a.total_value AS DOUBLE) AS total_value, count(b.invoice_id) AS partners FROM invoices a
  LEFT JOIN invoices b ON b.total_value > a.total_value - 1000 AND b.total_value < a.total_value + 1000
  AND a.invoice_id <> b.invoice_id GROUP BY 1, 2""")
NEAREST = """SELECT invoice_id, candidate_id, CAST(diff AS DOUBLE) AS amount_diff FROM (SELECT a.invoice_id,
  b.invoice_id AS candidate_id, abs(a.total_value - b.total_value) AS diff, row_number() OVER (PARTITION BY a.invoice_id
  ORDER BY abs(a.total_value - b.total_value), b.invoice_id) AS rn FROM invoices a JOIN invoices b
  ON b.total_value >= a.total_value - a.total_value * 0.01 AND b.total_value <= a.total_value + a.total_value * 0.01
  AND a.invoice_id <> b.invoice_id) x WHERE rn <= 10"""
q("jn09_amount_within_one_percent", lambda k: neighbours.nearest_by_amount(k.invoices).withColumn(
    "amount_diff", F.col("amount_diff").cast("double")), NEAREST)
SHARED = """SELECT invoice_id, candidate_id, shared_codes FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id
  ORDER BY shared_codes DESC, candidate_id) AS rn FROM (SELECT a.invoice_id, b.invoice_id AS candidate_id,
    count(DISTINCT a.hsn_code) AS shared_codes FROM items a JOIN items b ON a.hsn_code = b.hsn_code
    AND a.invoice_id <> b.invoice_id GROUP BY 1, 2) p) x WHERE rn <= 10"""
q("jn10_shared_hsn", lambda k: neighbours.most_shared_codes(k.items), SHARED)
# Fifty codes in all, each on a twelfth of the invoices.
q("jn10_shared_of_fifty", lambda k: neighbours.most_shared_codes(k.items.select("invoice_id", (F.col("product_id") % 50).cast("string").alias("hsn_code"))),
  SHARED.replace("items", "chapters"), "chapters AS (SELECT invoice_id, CAST(product_id % 50 AS VARCHAR) AS hsn_code FROM items)")
q("jn11_known_products", lambda k: k.items.join(k.products.where("product_id % 3 <> 0"), "product_id", "left_semi")
  .select("item_id"), "SELECT item_id FROM items WHERE product_id IN (SELECT product_id FROM products WHERE product_id % 3 <> 0)")
q("jn11_new_products", lambda k: k.items.join(k.products.where("product_id % 3 <> 0"), "product_id", "left_anti")
  .select("item_id"), "SELECT item_id FROM items WHERE product_id NOT IN (SELECT product_id FROM products WHERE product_id % 3 <> 0)")
q("fn24_bar_scaling", db.bar_scaling, f"""SELECT month, revenue, CASE WHEN hi = lo THEN 50 ELSE
  greatest(20.0, (revenue - lo) / (hi - lo) * 80 + 20) END AS height, CASE WHEN revenue / hi >= 0.8 THEN 'high'
  WHEN revenue / hi >= 0.6 THEN 'good' WHEN revenue / hi >= 0.4 THEN 'medium' ELSE 'low' END AS band
  FROM (SELECT *, min(revenue) OVER () AS lo, max(revenue) OVER () AS hi FROM (SELECT {MONTH} AS month,
  {dbl("sum(total_value)")} AS revenue FROM invoices GROUP BY 1) a) b ORDER BY month DESC LIMIT 6""")
q("fn25_share_percentages", db.share_percentages, f"""SELECT (SELECT {pct("gstin IS NOT NULL", 0)} FROM companies)
  AS gstin_percent, {pct("status <> 'PENDING'", 0)} AS completed_percent FROM invoices""")
