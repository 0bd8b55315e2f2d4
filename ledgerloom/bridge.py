"""Views of a star-schema sales data set (orders, lineitem, ...) as the core tables.

``lake(spark, folder)`` declares them with the DataFrame API; ``SQL`` holds the same
definitions as common table expressions for a second engine to check against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lake import Lake
from ledgerloom.session import use_all_cores

AS_OF = "2001-08-01"

DOC_TYPES = ("B2B_INVOICE", "EXPENSE_SLIP", "PAYMENT_PROOF", "PURCHASE_ORDER",
             "CREDIT_NOTE", "DEBIT_NOTE", "QUOTATION")


# Tables with heavy work per row, and the key they are spread by when they have few files.
_SPREAD = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id"}


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return use_all_cores(table, _SPREAD[name]) if name in _SPREAD else table


def _tax_id(nation: str, key: str, mark: str):
    return F.expr(
        f"CASE WHEN {key} % 10 = 0 THEN NULL ELSE concat(lpad(cast({nation} + 1 AS string), 2, '0'), "
        f"translate(lpad(cast(({key} div 10000) % 100000 AS string), 5, '0'), '0123456789', 'ABCDEFGHIJ'), "
        f"lpad(cast({key} % 10000 AS string), 4, '0'), '{mark}1Z5') END")


def _places(spark, folder):
    nation, region = raw(spark, folder, "nation"), raw(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left")


def _company_rows(rows, places, nation, key, name, mark, sign):
    return rows.join(places, rows[nation] == places.n_nationkey, "left").select(
        sign.alias("company_id"), F.col(name).alias("legal_name"),
        _tax_id(nation, key, mark).alias("gstin"), F.col("r_name").alias("city"),
        F.col("n_name").alias("state"), F.concat(F.lit("Plot "), F.col(key).cast("string")).alias("address"),
        F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"),
        F.expr(f"cast(date_add(DATE'1995-01-01', cast({key} % 365 AS int)) AS timestamp)").alias("created_at"))


def suppliers(spark, folder) -> DataFrame:
    return _company_rows(raw(spark, folder, "supplier"), _places(spark, folder),
                         "s_nationkey", "s_suppkey", "s_name", "A", F.col("s_suppkey"))


def buyers(spark, folder) -> DataFrame:
    """Customers as companies, with negative ids so that they never meet supplier ids."""
    return _company_rows(raw(spark, folder, "customer"), _places(spark, folder),
                         "c_nationkey", "c_custkey", "c_name", "B", -F.col("c_custkey") - 1)


def _heads(spark, folder) -> DataFrame:
    """Orders with their invoice supplier and whether buyer and supplier share a state."""
    orders, customer = raw(spark, folder, "orders"), raw(spark, folder, "customer")
    supplier = raw(spark, folder, "supplier")
    n_suppliers = supplier.agg(F.count("*")).scalar()
    heads = orders.withColumn("supplier_id", F.col("o_custkey") % n_suppliers)
    return (heads.join(customer.select("c_custkey", "c_nationkey"), heads.o_custkey == customer.c_custkey, "left")
            .join(supplier.select("s_suppkey", "s_nationkey"), F.col("supplier_id") == F.col("s_suppkey"), "left")
            .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "supplier_id",
                    F.coalesce(F.col("c_nationkey") == F.col("s_nationkey"), F.lit(False)).alias("same_state")))


def _line_money(spark, folder) -> DataFrame:
    line = raw(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "cast(round(cast(l_extendedprice AS decimal(15,2)) * (1 - cast(l_discount AS decimal(5,2))), 2) "
        "AS decimal(15,2)) AS taxable_value",
        "cast(l_tax AS decimal(5,2)) AS tax")
    return line.withColumn("gst_amount", F.expr("cast(round(taxable_value * tax, 2) AS decimal(15,2))"))


def items(spark, folder) -> DataFrame:
    """Item ids are a hash of the line's key: no global numbering pass over the table."""
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    lines = _line_money(spark, folder).withColumn(
        "item_id", F.expr(f"cast(conv(substr(md5({key}), 1, 15), 16, 10) AS bigint)"))
    lines = lines.join(_heads(spark, folder).select("o_orderkey", "same_state", "o_orderdate"),
                       F.col("l_orderkey") == F.col("o_orderkey"))
    absent = "CASE WHEN item_id % 5 = 0 THEN NULL ELSE 0 END"
    half_rate, half = "tax * 50", "round(gst_amount * 0.5, 2)"

    def part(inside: str, outside: str, kind: str, name: str):
        return F.expr(f"cast(CASE WHEN same_state THEN {inside} ELSE {outside} END AS {kind}) AS {name}")
    money, rate = "decimal(15,2)", "decimal(5,2)"
    return lines.select(
        "item_id", F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("product_id"),
        F.expr("cast(84000000 + l_partkey AS string) AS hsn_code"),
        F.expr("cast(l_quantity AS decimal(10,2)) AS quantity"),
        F.expr("cast(round(cast(cast(taxable_value AS double) / l_quantity AS decimal(20,6)), 2) "
               "AS decimal(10,2)) AS unit_price"),
        "taxable_value", F.expr("cast(tax * 100 AS decimal(5,2)) AS gst_rate"), "gst_amount",
        part(half_rate, absent, rate, "sgst_rate"), part(half, absent, money, "sgst_amount"),
        part(half_rate, absent, rate, "cgst_rate"), part(half, absent, money, "cgst_amount"),
        part(absent, "tax * 100", rate, "igst_rate"), part(absent, "gst_amount", money, "igst_amount"),
        F.expr("cast(taxable_value + gst_amount AS decimal(15,2)) AS total_amount"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


def described_items(spark, folder) -> DataFrame:
    """Items with their description; a separate view, so that plans that do not
    need the text do not pay for the product join."""
    part = raw(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("item_description"))
    return items(spark, folder).join(part, "product_id", "left")


def invoices(spark, folder) -> DataFrame:
    sums = _line_money(spark, folder).groupBy("l_orderkey").agg(
        F.sum("taxable_value").cast("decimal(15,2)").alias("taxable_value"),
        F.sum("gst_amount").cast("decimal(15,2)").alias("total_tax"))
    return _heads(spark, folder).join(sums, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "o_orderkey AS invoice_id", "o_orderkey AS doc_id",
        "concat('INV-', lpad(cast(o_orderkey % 9973 AS string), 6, '0')) AS invoice_num",
        "cast(o_orderdate AS date) AS invoice_date", "supplier_id AS supplier_company_id",
        "-o_custkey - 1 AS buyer_company_id", "taxable_value", "total_tax",
        "cast(taxable_value + total_tax + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS decimal(15,2)) "
        "AS total_value", "'INR' AS currency",
        "CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'P' THEN 'PROCESSED' ELSE 'PENDING' END AS status",
        "o_orderkey % 4 <> 0 AS validation", "o_orderkey % 10 = 0 AS duplication",
        "cast(o_orderdate AS timestamp) AS created_at")


def payments(spark, folder) -> DataFrame:
    methods = "element_at(array('UPI','NEFT','CARD','CASH'), cast(invoice_id % 4 AS int) + 1)"
    return invoices(spark, folder).where("status = 'PAID'").selectExpr(
        "invoice_id AS payment_id", "doc_id", "invoice_id", "date_add(invoice_date, 30) AS payment_date",
        f"{methods} AS payment_method", "total_value AS amount",
        "concat('TXN', cast(invoice_id % 5000 AS string)) AS transaction_ref",
        "cast(NULL AS string) AS bank_details", "'COMPLETED' AS status", "created_at")


def registry(spark, folder) -> DataFrame:
    known = suppliers(spark, folder).where("gstin IS NOT NULL AND company_id % 7 <> 0")
    return known.selectExpr(
        "company_id AS gst_id", "gstin",
        "CASE WHEN company_id % 13 = 0 THEN concat('Registered Entity ', cast(company_id AS string)) "
        "WHEN company_id % 5 = 0 THEN concat(legal_name, ' Private Limited') ELSE legal_name END AS legal_name",
        "CASE WHEN company_id % 13 = 0 THEN 'Unlisted' ELSE concat(legal_name, ' Traders') END AS trade_name",
        "substring(gstin, 3, 10) AS pan",
        "date_format(date_add(DATE'2017-07-01', cast(company_id % 900 AS int)), 'dd-MMM-yyyy') AS registration_date",
        "'Private Limited Company' AS constitution", "'Regular' AS taxpayer_type",
        "CASE WHEN company_id % 11 = 0 THEN 'Cancelled' ELSE 'Active' END AS status", "state",
        "cast(110000 + company_id % 900 AS string) AS pin_code", "'-' AS cancellation_date",
        "'State Office' AS state_jurisdiction", "'Central Office' AS centre_jurisdiction",
        "'Trading' AS nature_of_business", "'registry' AS api_source", "created_at AS last_verified", "created_at")


def products(spark, folder) -> DataFrame:
    return raw(spark, folder, "part").selectExpr(
        "p_partkey AS product_id", "p_name AS canonical_name",
        "cast(84000000 + p_partkey AS string) AS hsn_code", "cast(18 AS decimal(5,2)) AS default_tax_rate",
        "p_type AS description", "'NOS' AS unit_of_measure",
        "cast(date_add(DATE'1995-01-01', cast(p_partkey % 365 AS int)) AS timestamp) AS created_at")


def documents(spark, folder) -> DataFrame:
    types = ", ".join(f"'{t}'" for t in DOC_TYPES)
    return raw(spark, folder, "documents").selectExpr(
        "doc_id", f"element_at(array({types}), cast(doc_id % 7 AS int) + 1) AS doc_type",
        f"cast(date_sub(DATE'{AS_OF}', cast(doc_id % 400 AS int)) AS timestamp) AS created_at",
        "concat('doc_', cast(doc_id AS string), '.pdf') AS filename", "n_chars AS file_size_bytes",
        "cast(50 + cast(doc_id * 37 % 5000 AS decimal(6,0)) * 0.01 AS decimal(5,2)) AS analysis_confidence",
        """concat('{"source":"', source, '","amount":', cast(n_chars * 7 AS string), '}') AS raw_data""")


def messages(spark, folder) -> DataFrame:
    """Conversation turns as chat messages; minutes between turns grow so that gaps occur."""
    return raw(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn AS message_id", "cast(conv_id AS string) AS session_id",
        "role AS message_type", "text AS content", "turn",
        "cast(0.5 + cast((conv_id + turn) % 5 AS decimal(3,0)) * 0.1 AS decimal(4,2)) AS confidence_score",
        f"cast(timestampadd(MINUTE, cast((conv_id % 50) * 3 + turn * turn * 7 AS int), "
        f"TIMESTAMP_NTZ'{AS_OF} 00:00:00') AS timestamp_ntz) AS sent_at")


def lake(spark: SparkSession, folder: str, describe: bool = False) -> Lake:
    tables = {
        "documents": documents, "products": products, "invoices": invoices,
        "invoice_item": described_items if describe else items,
        "payment": payments, "gst_companies": registry,
        "companies": lambda s, f: suppliers(s, f).unionByName(buyers(s, f)),
    }
    return Lake(spark, lambda name: tables[name](spark, folder), AS_OF)


def _sql_tax_id(nation: str, key: str, mark: str) -> str:
    return (f"CASE WHEN {key} % 10 = 0 THEN NULL ELSE lpad(CAST({nation} + 1 AS VARCHAR), 2, '0') || "
            f"translate(lpad(CAST(({key} // 10000) % 100000 AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ') || "
            f"lpad(CAST({key} % 10000 AS VARCHAR), 4, '0') || '{mark}1Z5' END")


_SQL_TYPES = "[" + ", ".join(f"'{t}'" for t in DOC_TYPES) + "]"

SQL = f"""
companies AS (
  SELECT s_suppkey AS company_id, s_name AS legal_name, {_sql_tax_id('s_nationkey', 's_suppkey', 'A')} AS gstin,
         r_name AS city, n_name AS state, 'Plot ' || CAST(s_suppkey AS VARCHAR) AS address,
         CAST(DATE '1995-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT -c_custkey - 1, c_name, {_sql_tax_id('c_nationkey', 'c_custkey', 'B')}, r_name, n_name,
         'Plot ' || CAST(c_custkey AS VARCHAR),
         CAST(DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP)
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
products AS (
  SELECT p_partkey AS product_id, p_name AS canonical_name, CAST(84000000 + p_partkey AS VARCHAR) AS hsn_code,
         CAST(18 AS DECIMAL(5,2)) AS default_tax_rate, p_type AS description, 'NOS' AS unit_of_measure,
         CAST(DATE '1995-01-01' + CAST(p_partkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at FROM part),
heads AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, supplier_id,
         coalesce(c_nationkey = s_nationkey, FALSE) AS same_state
  FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS supplier_id FROM orders) o
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON supplier_id = s_suppkey),
line_money AS (
  SELECT *, CAST(round(taxable_value * tax, 2) AS DECIMAL(15,2)) AS gst_amount FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))), 2)
                AS DECIMAL(15,2)) AS taxable_value,
           CAST(l_tax AS DECIMAL(5,2)) AS tax FROM lineitem) x),
items AS (
  SELECT item_id, l_orderkey AS invoice_id, l_partkey AS product_id, CAST(84000000 + l_partkey AS VARCHAR) AS hsn_code,
         CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
         CAST(round(CAST(CAST(taxable_value AS DOUBLE) / l_quantity AS DECIMAL(20,6)), 2) AS DECIMAL(10,2)) AS unit_price,
         taxable_value, CAST(tax * 100 AS DECIMAL(5,2)) AS gst_rate, gst_amount,
         CAST(CASE WHEN same_state THEN tax * 50 ELSE absent END AS DECIMAL(5,2)) AS sgst_rate,
         CAST(CASE WHEN same_state THEN round(gst_amount * 0.5, 2) ELSE absent END AS DECIMAL(15,2)) AS sgst_amount,
         CAST(CASE WHEN same_state THEN tax * 50 ELSE absent END AS DECIMAL(5,2)) AS cgst_rate,
         CAST(CASE WHEN same_state THEN round(gst_amount * 0.5, 2) ELSE absent END AS DECIMAL(15,2)) AS cgst_amount,
         CAST(CASE WHEN same_state THEN absent ELSE tax * 100 END AS DECIMAL(5,2)) AS igst_rate,
         CAST(CASE WHEN same_state THEN absent ELSE gst_amount END AS DECIMAL(15,2)) AS igst_amount,
         CAST(taxable_value + gst_amount AS DECIMAL(15,2)) AS total_amount, p_name AS item_description
  FROM (SELECT m.*, same_state, p_name, CASE WHEN item_id % 5 = 0 THEN NULL ELSE 0 END AS absent FROM (
          SELECT *, CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
                 CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)), 1, 15) AS BIGINT) AS item_id
          FROM line_money) m JOIN heads ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey) y),
invoices AS (
  SELECT o_orderkey AS invoice_id, o_orderkey AS doc_id,
         'INV-' || lpad(CAST(o_orderkey % 9973 AS VARCHAR), 6, '0') AS invoice_num,
         CAST(o_orderdate AS DATE) AS invoice_date, supplier_id AS supplier_company_id,
         -o_custkey - 1 AS buyer_company_id, taxable_value, total_tax,
         CAST(taxable_value + total_tax + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(15,2)) AS total_value,
         'INR' AS currency, CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'P' THEN 'PROCESSED' ELSE 'PENDING' END AS status,
         o_orderkey % 4 <> 0 AS validation, o_orderkey % 10 = 0 AS duplication, CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM heads JOIN (SELECT l_orderkey, CAST(sum(taxable_value) AS DECIMAL(15,2)) AS taxable_value,
                          CAST(sum(gst_amount) AS DECIMAL(15,2)) AS total_tax
                   FROM line_money GROUP BY l_orderkey) s ON o_orderkey = l_orderkey),
payment AS (
  SELECT invoice_id AS payment_id, doc_id, invoice_id, invoice_date + 30 AS payment_date,
         ['UPI','NEFT','CARD','CASH'][CAST(invoice_id % 4 AS INTEGER) + 1] AS payment_method, total_value AS amount,
         'TXN' || CAST(invoice_id % 5000 AS VARCHAR) AS transaction_ref, 'COMPLETED' AS status, created_at
  FROM invoices WHERE status = 'PAID'),
gst_companies AS (
  SELECT company_id AS gst_id, gstin,
         CASE WHEN company_id % 13 = 0 THEN 'Registered Entity ' || CAST(company_id AS VARCHAR)
              WHEN company_id % 5 = 0 THEN legal_name || ' Private Limited' ELSE legal_name END AS legal_name,
         CASE WHEN company_id % 13 = 0 THEN 'Unlisted' ELSE legal_name || ' Traders' END AS trade_name,
         substr(gstin, 3, 10) AS pan,
         strftime(DATE '2017-07-01' + CAST(company_id % 900 AS INTEGER), '%d-%b-%Y') AS registration_date,
         CASE WHEN company_id % 11 = 0 THEN 'Cancelled' ELSE 'Active' END AS status, state,
         CAST(110000 + company_id % 900 AS VARCHAR) AS pin_code, created_at
  FROM companies WHERE company_id >= 0 AND gstin IS NOT NULL AND company_id % 7 <> 0),
docs AS (
  SELECT doc_id, {_SQL_TYPES}[CAST(doc_id % 7 AS INTEGER) + 1] AS doc_type,
         CAST(DATE '{AS_OF}' - CAST(doc_id % 400 AS INTEGER) AS TIMESTAMP) AS created_at,
         'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename, n_chars AS file_size_bytes,
         CAST(50 + CAST(doc_id * 37 % 5000 AS DECIMAL(6,0)) * 0.01 AS DECIMAL(5,2)) AS analysis_confidence,
         '{{"source":"' || source || '","amount":' || CAST(n_chars * 7 AS VARCHAR) || '}}' AS raw_data
  FROM documents),
messages AS (
  SELECT conv_id * 1000 + turn AS message_id, CAST(conv_id AS VARCHAR) AS session_id, role AS message_type,
         text AS content, turn, CAST(0.5 + CAST((conv_id + turn) % 5 AS DECIMAL(3,0)) * 0.1 AS DECIMAL(4,2)) AS confidence_score,
         TIMESTAMP '{AS_OF} 00:00:00' + to_minutes(CAST((conv_id % 50) * 3 + turn * turn * 7 AS INTEGER)) AS sent_at
  FROM conversations)"""


def oracle(body: str, *more: str) -> str:
    """A query text over the model views; ``more`` are further common table expressions."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + body
