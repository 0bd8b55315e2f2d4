"""Queries of scalar functions, nested data, pages, files, table maintenance and streaming in batch form."""

import uuid

from pyspark.sql import functions as F

from ledgerloom import bridge, datagen
from ledgerloom.bridge import oracle
from ledgerloom.catalog.duplicates import _FOUND as FOUND
from ledgerloom.catalog.registry import add
from ledgerloom.functions import scalars as fn
from ledgerloom.functions.arrays import found, jumps_of
from ledgerloom.functions.text import text_similarity
from ledgerloom.catalog.validation import CHECKS, FIRST, GATES, SUMS
from ledgerloom.operators import classify, duplicates, extract, nested, pages, risk, store, validation
from ledgerloom.session import cut_lineage, shared_dir
from ledgerloom.sources import files
from ledgerloom.sources.versions import Versions
from ledgerloom.streaming import jobs


def q(name, run, sql=None, *ctes):
    add(name, lambda s, d: run(bridge.lake(s, d)), None if sql is None else oracle(sql, *ctes))


def dbl(expr):
    return f"CAST({expr} AS DOUBLE)"


# Scalar functions ---------------------------------------------------------------------
_WRITTEN = "CASE WHEN invoice_id % 9 = 0 THEN 'abc' WHEN invoice_id % 10 = 0 THEN '' ELSE concat('₹ ', format_number(total_value, 2)) END"
q("fn01_clean_currency", lambda k: k.invoices.select("invoice_id", fn.clean_currency(F.expr(_WRITTEN)).alias("amount")),
  f"""SELECT invoice_id, CASE WHEN invoice_id % 9 = 0 OR invoice_id % 10 = 0 THEN 0::DOUBLE ELSE {dbl("total_value")} END AS amount FROM invoices""")
q("fn02_extract_number", lambda k: k.items.select("item_id", fn.extract_number(F.expr(
    "CASE WHEN item_id % 7 = 0 THEN '1.2.3' WHEN item_id % 11 = 0 THEN 'none' ELSE concat('about ', quantity, ' NOS 5') END")).alias("n")),
  f"SELECT item_id, CASE WHEN item_id % 7 = 0 OR item_id % 11 = 0 THEN 0::DOUBLE ELSE {dbl('quantity')} END AS n FROM items")
_DATE_TEXT = """CASE invoice_id % 6 WHEN 0 THEN date_format(invoice_date, 'd-MMM-yy') WHEN 1 THEN date_format(invoice_date, 'd-M-yyyy')
  WHEN 2 THEN date_format(invoice_date, 'yyyy-M-d') WHEN 3 THEN date_format(invoice_date, 'dd/MM/yyyy')
  WHEN 4 THEN concat('on ', date_format(invoice_date, 'dd-MMM-yyyy')) ELSE 'undated' END"""
q("fn03_parse_invoice_date", lambda k: k.invoices.select(
    "invoice_id", fn.parse_invoice_date(F.expr(_DATE_TEXT), "2025-01-01").alias("parsed")),
  """SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN CAST('20' || strftime(invoice_date, '%y-%m-%d') AS DATE)
  WHEN 5 THEN DATE '2025-01-01' ELSE invoice_date END AS parsed FROM invoices""")
q("fn04_parse_date_or_text", lambda k: k.invoices.select("invoice_id", fn.parse_invoice_date_or_text(F.expr(_DATE_TEXT)).alias("parsed")),
  """SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN '20' || strftime(invoice_date, '%y-%m-%d')
  WHEN 3 THEN strftime(invoice_date, '%d/%m/%Y') WHEN 5 THEN 'undated' ELSE CAST(invoice_date AS VARCHAR) END AS parsed FROM invoices""")
_GSTIN_TEXT = "CASE WHEN company_id % 4 = 0 THEN lower(gstin) WHEN company_id % 5 = 0 THEN substr(gstin, 1, 14) ELSE gstin END"
q("fn05_valid_gstin", lambda k: k.companies.select("company_id", fn.valid_gstin(F.expr(_GSTIN_TEXT)).alias("ok")),
  f"""SELECT company_id, coalesce(length(t) = 15 AND regexp_full_match(upper(t), '{fn.GSTIN}'), FALSE) AS ok
  FROM (SELECT company_id, {_GSTIN_TEXT} AS t FROM companies) x""")
q("fn06_pan_of", lambda k: k.companies.select("company_id", fn.pan_of(F.col("gstin")).alias("pan")),
  "SELECT company_id, substr(gstin, 3, 10) AS pan FROM companies")
q("fn07_valid_hsn", lambda k: k.products.select("product_id", fn.valid_hsn(F.expr(
    "substr(hsn_code, 1, cast(product_id % 9 AS int))")).alias("ok")), "SELECT product_id, product_id % 9 BETWEEN 4 AND 8 AS ok FROM products")
q("fn08_valid_tax_rate", lambda k: k.items.select("item_id", fn.valid_tax_rate(F.col("gst_rate")).alias("ok")),
  "SELECT item_id, gst_rate IN (0, 3, 5, 12, 18, 28) AS ok FROM items")
q("fn09_has_value", lambda k: k.items.select("item_id", fn.has_value(F.col("sgst_amount")).alias("ok")),
  "SELECT item_id, sgst_amount IS NOT NULL AND sgst_amount <> 0 AS ok FROM items")
_A, _B = "CAST(taxable_value AS DOUBLE)", "CAST(quantity * unit_price AS DOUBLE)"
q("fn10_numeric_similarity", lambda k: k.items.select("item_id", fn.numeric_similarity(
    F.col("taxable_value"), F.col("quantity") * F.col("unit_price"), 0.00001).alias("s")),
  f"""SELECT item_id, CASE WHEN {_A} = 0 AND {_B} = 0 THEN 1::DOUBLE WHEN {_A} = 0 OR {_B} = 0 THEN 0::DOUBLE
  WHEN abs({_A} - {_B}) / greatest(abs({_A}), abs({_B})) <= 0.00001::DOUBLE
  THEN 1 - abs({_A} - {_B}) / greatest(abs({_A}), abs({_B})) / 0.00001::DOUBLE ELSE 0::DOUBLE END AS s FROM items""")
q("fn11_ratio_similarity", lambda k: k.items.select("item_id", fn.ratio_similarity(F.col("taxable_value"), F.col("gst_amount")).alias("s")),
  """SELECT item_id, CASE WHEN taxable_value > 0 AND gst_amount > 0 THEN greatest(0::DOUBLE, 1 - abs(CAST(taxable_value AS DOUBLE)
  - CAST(gst_amount AS DOUBLE)) / greatest(CAST(taxable_value AS DOUBLE), CAST(gst_amount AS DOUBLE))) END AS s FROM items""")


def _texts(k):
    """Distinct pairs of product names of one type and brand digit, scored once each."""
    names = k.products.select(F.col("canonical_name").alias("a"), "description").distinct()
    pairs = names.join(names.withColumnRenamed("a", "b"), "description").select("a", "b").distinct()
    return pairs.select("a", "b", text_similarity(F.col("a"), F.col("b")).alias("similarity"))


q("fn12_text_similarity", _texts)
q("fn14_date_gap", lambda k: k.payments.join(k.invoices.select("invoice_id", "invoice_date"), "invoice_id").select(
    "payment_id", fn.date_gap_days(F.col("invoice_date"), F.expr("CASE WHEN payment_id % 5 = 0 THEN NULL ELSE payment_date END")).alias("gap")),
  "SELECT payment_id, CASE WHEN payment_id % 5 = 0 THEN NULL ELSE 30 END AS gap FROM payment")
q("fn15_safe_abs_diff", lambda k: k.items.select("item_id", fn.safe_abs_diff(
    F.col("igst_amount").cast("double"), F.expr("CASE WHEN item_id % 13 = 0 THEN 'x' ELSE cast(gst_amount AS string) END")).alias("diff")),
  """SELECT item_id, CASE WHEN item_id % 13 = 0 THEN 'infinity'::DOUBLE ELSE abs(CAST(coalesce(igst_amount, 0) AS DOUBLE)
  - CAST(gst_amount AS DOUBLE)) END AS diff FROM items""")
q("fn16_money", lambda k: k.items.select("item_id", fn.money(F.col("taxable_value") * F.expr("0.125")).cast("double").alias("m")),
  f"SELECT item_id, {dbl('round(taxable_value * 0.125, 2)')} AS m FROM items")


def _plain(s, d):
    marked = bridge.raw(s, d, "documents").select("doc_id", F.concat(
        F.lit("# Title\n**Note** for *you* with `code` and [link](http://x)\n- one\n---\n\n\n\nEnd. Next\n"), "lang").alias("t"), "text")
    return marked.select("doc_id", fn.clean_markdown(F.col("t")).alias("shown"), F.length(fn.clean_markdown(F.col("text"))).alias("n"))


add("fn17_clean_markdown", _plain)
add("fn18_detect_language", lambda s, d: bridge.raw(s, d, "documents").select("doc_id", fn.detect_language(F.col("text")).alias("l")),
    r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'multilingual' ELSE 'english' END AS l FROM documents")


def _first_sql(table, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in table) + f" ELSE '{otherwise}' END"


add("fn19_payment_method", lambda s, d: bridge.raw(s, d, "documents").select("doc_id", fn.detect_payment_method(F.col("text")).alias("m")),
    f"SELECT doc_id, {_first_sql(fn.PAYMENT_METHODS, 'UNKNOWN')} AS m FROM documents")
add("fn20_expense_category", lambda s, d: bridge.raw(s, d, "documents").select("doc_id", fn.detect_expense_category(F.col("text")).alias("c")),
    f"SELECT doc_id, {_first_sql(fn.EXPENSE_CATEGORIES, 'GENERAL')} AS c FROM documents")
q("fn21_clean_file_name", lambda k: k.documents.select("doc_id", fn.clean_file_name(F.concat(F.lit("a#b-"), "filename")).alias("f")),
  "SELECT doc_id, regexp_replace('a#b-' || filename, '[^A-Za-z0-9_-]', '', 'g') AS f FROM docs")
q("fn22_calendar", lambda k: k.invoices.select(
    "invoice_id", fn.month_of(F.col("invoice_date")).alias("month"), F.quarter("invoice_date").cast("bigint").alias("quarter"),
    F.date_diff(k.as_of, "invoice_date").cast("bigint").alias("age"), fn.months_back(F.col("invoice_date"), 12).alias("year_before")),
  f"""SELECT invoice_id, strftime(invoice_date, '%Y-%m') AS month, quarter(invoice_date) AS quarter,
  CAST(DATE '{bridge.AS_OF}' - invoice_date AS BIGINT) AS age, CAST(invoice_date - INTERVAL 12 MONTH AS DATE) AS year_before FROM invoices""")
q("fn23_standard_functions", lambda k: k.companies.selectExpr(
    "company_id", "nullif(city, 'ASIA') AS a", "coalesce(gstin, 'none') AS b", "upper(trim(concat(' ', legal_name, ' '))) AS c",
    "substr(legal_name, 1, 5) AS d", "length(legal_name) AS e", "abs(company_id) AS f"),
  """SELECT company_id, nullif(city, 'ASIA') AS a, coalesce(gstin, 'none') AS b, upper(trim(' ' || legal_name || ' ')) AS c,
  substr(legal_name, 1, 5) AS d, length(legal_name) AS e, abs(company_id) AS f FROM companies""")
q("fn26_confidence_text", lambda k: k.documents.select(
    "doc_id", fn.safe_confidence(F.expr("CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE cast(doc_id % 8 AS string) END")).alias("c"),
    fn.percent_text((F.col("doc_id") % 8 / 8).cast("string")).alias("p")),
  """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0::DOUBLE ELSE CAST(doc_id % 8 AS DOUBLE) END AS c,
  format('{:.1f}%', (doc_id % 8) * 12.5::DOUBLE) AS p FROM docs""")
q("set03_jaccard", lambda k: k.products.select("product_id", fn.jaccard(
    fn.words(F.col("canonical_name")), fn.words(F.lit("red widget ring"))).alias("j")),
  """SELECT product_id, CAST(len(list_intersect(string_split(canonical_name, ' '), ['red', 'widget', 'ring'])) AS DOUBLE) /
  len(list_distinct(list_concat(string_split(canonical_name, ' '), ['red', 'widget', 'ring']))) AS j FROM products""")

_OWN = "string_split({}, ' ')"
_LETTERS = "list_distinct(string_split(replace({}, ' ', ''), ''))"


def _overlap_sql(sets, a, b):
    a, b = sets.format(a), sets.format(b)
    return f"CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b})))"


q("fn13_name_similarity", lambda k: k.products.select("product_id", F.round(fn.name_similarity(
    F.col("canonical_name"), F.when(F.col("product_id") % 10 > 0, F.lit("red widget ring")).otherwise(" ")), 9).alias("similarity")),
  f"""SELECT product_id, CASE WHEN product_id % 10 = 0 THEN 0::DOUBLE ELSE round(0.7::DOUBLE * {_overlap_sql(_OWN, "canonical_name", "'red widget ring'")}
  + 0.3::DOUBLE * {_overlap_sql(_LETTERS, "canonical_name", "'red widget ring'")}, 9) END AS similarity FROM products""")

# Nested data --------------------------------------------------------------------------
q("nst08_json_recovery", lambda k: k.documents.select("doc_id", nested.recover_json(F.expr(
    "CASE doc_id % 3 WHEN 0 THEN raw_data WHEN 1 THEN concat('Here it is: ', raw_data, ' done') ELSE 'no data' END")).alias("r")).select(
    "doc_id", F.get_json_object("r.json", "$.amount").cast("bigint").alias("amount"), "r.recovered", "r.raw"),
  """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CAST(json_extract_string(raw_data, '$.amount') AS BIGINT) END AS amount,
  doc_id % 3 = 1 AS recovered, CASE WHEN doc_id % 3 = 2 THEN 'no data' END AS raw FROM docs""")


def _blocks(s, d):
    """Every document as OCR blocks. Each line of its text is a LINE, a LAYOUT, a WORD and a table CELL for each word, and a key
    (its first two words) with two value blocks, of which the second is there only for lines of over three words. One table places
    the words but every third, then the language in its first cell once more; another has no cells."""
    docs = bridge.raw(s, d, "documents").selectExpr("doc_id", "lang", "split(text, '\\n') AS lines").selectExpr(
        "*", "transform(lines, x -> filter(split(x, ' '), w -> w <> '')) AS words")

    def block(i, kind, text="cast(NULL AS string)", conf="90.0D", ent="cast(NULL AS array<string>)", row="cast(NULL AS int)", col="cast(NULL AS int)",
              layout="cast(NULL AS string)", links=()):
        rel = ", ".join(f"named_struct('Type', '{k}', 'Ids', {ids})" for k, ids in links)
        return (f"named_struct('Id', {i}, 'BlockType', '{kind}', 'Text', {text}, 'Confidence', {conf}, 'EntityTypes', {ent}, "
                f"'RowIndex', {row}, 'ColumnIndex', {col}, 'LayoutType', {layout}, 'Relationships', "
                f"cast(array({rel}) AS array<struct<Type:string,Ids:array<string>>>))")

    def words(start, length):
        return f"transform(slice(words[i], {start}, {length}), (w, j) -> concat('w', i, '.', j + {start} - 1))"
    line = ", ".join([
        "array(" + block("concat('l', i)", "LINE", "x", "cast(50 + i % 50 AS double)") + ", "
        + block("concat('y', i)", "LAYOUT", "x", layout="CASE i % 3 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'TEXT' END") + ")",
        f"transform(words[i], (w, j) -> {block('concat(' + repr('w') + ', i, ' + repr('.') + ', j)', 'WORD', 'w')})",
        "transform(words[i], (w, j) -> " + block("concat('c', i, '.', j)", "CELL", row="i + 1", col="j + 1", links=[("CHILD", "array(concat('w', i, '.', j))")]) + ")",
        "array(" + ", ".join([
            block("concat('k', i)", "KEY_VALUE_SET", conf="cast(60 + i % 40 AS double)", ent="array('KEY')",
                  links=[("VALUE", "array(concat('v', i), concat('u', i))"), ("CHILD", words(1, 2))]),
            block("concat('v', i)", "KEY_VALUE_SET", ent="array('VALUE')", links=[("CHILD", words(3, 1))]),
            block("concat(if(size(words[i]) > 3, 'u', 'x'), i)", "KEY_VALUE_SET", ent="array('VALUE')", links=[("CHILD", words(4, "size(words[i])"))])]) + ")"])
    kept = "flatten(transform(words, (ws, i) -> filter(transform(ws, (w, j) -> if((i + j) % 3 <> 2, concat('c', i, '.', j), NULL)), c -> c IS NOT NULL)))"
    tables = ", ".join([block("'t1'", "TABLE", conf="cast(70 + doc_id % 30 AS double)", links=[("CHILD", kept), ("CHILD", "array('d', 'none')")]),
                        block("'t2'", "TABLE"), block("'d'", "CELL", row="1", col="1", links=[("CHILD", "array('wd')")]), block("'wd'", "WORD", "lang")])
    return docs.selectExpr("cast(doc_id AS string) AS doc_id", f"concat(flatten(transform(lines, (x, i) -> concat({line}))), array({tables})) AS Blocks")


_TEXT_LINES = """lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS BIGINT) AS number, lang, i, list_filter(string_split(line, ' '), lambda w: w <> '') AS w
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) x)"""
_KEY_TEXT = "array_to_string(w[1:2], ' ')"
add("nst01_lines", lambda s, d: nested.blocks_to_lines(_blocks(s, d)).select(
    "doc_id", "total_lines", F.md5("full_text").alias("text_md5"), "average_confidence", "word_count"),
    r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, len(l) AS total_lines, md5(text) AS text_md5,
    CAST((200 * list_sum(list_transform(l, lambda x, i: 50 + (i - 1) % 50))::BIGINT + len(l)) // (2 * len(l)) AS DOUBLE) / 100 AS average_confidence,
    len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS word_count
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) x""")
add("nst02_form_fields", lambda s, d: nested.blocks_to_form_fields(_blocks(s, d)).select("doc_id", "key", "value", "confidence"),
    f"""WITH {_TEXT_LINES} SELECT doc_id, {_KEY_TEXT} AS key, CASE WHEN len(w) > 3 THEN array_to_string(w[4:], ' ') ELSE coalesce(w[3], '') END AS value,
    CAST(60 + i % 40 AS DOUBLE) AS confidence FROM lines WHERE len(w) > 0""")
add("nst03_tables", lambda s, d: nested.blocks_to_tables(_blocks(s, d)).select(
    "doc_id", "table_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("body"), "row_count", "column_count", "confidence"),
    f"""WITH {_TEXT_LINES}, placed AS (SELECT *, list_transform(w, lambda x, j: CASE WHEN (i + j - 1) % 3 = 2 THEN '' ELSE x END) AS c,
      CASE WHEN len(w) > 0 AND (i + len(w) - 1) % 3 = 2 THEN len(w) - 1 ELSE len(w) END AS n FROM lines),
    cells AS (SELECT doc_id, number, i, CASE WHEN i = 0 THEN greatest(n, 1) ELSE n END AS n,
      CASE WHEN i = 0 THEN list_concat([lang], c[2:n]) ELSE c[1:n] END AS c FROM placed),
    tail AS (SELECT doc_id AS t, max(i) AS last FROM cells WHERE n > 0 GROUP BY 1)
    SELECT doc_id, 't1' AS table_id, string_agg(array_to_string(c, '|'), chr(10) ORDER BY i) AS body, CAST(max(last) + 1 AS INTEGER) AS row_count,
      CAST(max(n) AS INTEGER) AS column_count, CAST(70 + max(number) % 30 AS DOUBLE) AS confidence FROM cells JOIN tail ON t = doc_id AND i <= last GROUP BY 1
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 't2', '', 0, 0, 90 FROM documents""")
add("nst04_layout", lambda s, d: nested.blocks_to_layout(_blocks(s, d)).select(
    "doc_id", "total_elements", F.array_join("element_types", ",").alias("types"),
    F.md5(F.array_join(F.transform("layout_elements", lambda e: F.concat_ws("|", e["layout_type"], e["text"])), "\n")).alias("elements_md5")),
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, len(l) AS total_elements, CASE WHEN len(l) > 1 THEN 'TEXT,TITLE' ELSE 'TITLE' END AS types,
    md5(array_to_string(list_transform(l, lambda x, i: CASE i % 3 WHEN 1 THEN 'TITLE|' WHEN 2 THEN 'TEXT|' ELSE '' END || x), chr(10))) AS elements_md5
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x""")
add("nst06_list_tables", lambda s, d: nested.list_tables(_blocks(s, d)).select("doc_id", "index", "block_id", "confidence", F.size("references").alias("n")),
    f"""WITH {_TEXT_LINES} SELECT doc_id, 1 AS "index", 't1' AS block_id, CAST(70 + max(number) % 30 AS DOUBLE) AS confidence,
    CAST(2 + sum(len(list_filter(range(len(w)), lambda j: (i + j) % 3 <> 2))) AS INTEGER) AS n FROM lines GROUP BY 1
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 't2', 90, 0 FROM documents""")
add("nst06_list_forms", lambda s, d: nested.list_forms(_blocks(s, d)).select("doc_id", "index", "block_id", "confidence", F.size("references").alias("n")),
    f"""WITH {_TEXT_LINES} SELECT doc_id, CAST(3 * i + 1 AS INTEGER) AS "index", 'k' || i AS block_id, CAST(60 + i % 40 AS DOUBLE) AS confidence,
      CAST(2 + least(len(w), 2) AS INTEGER) AS n FROM lines
    UNION ALL SELECT doc_id, 3 * i + 2, 'v' || i, 90, CASE WHEN len(w) > 2 THEN 1 ELSE 0 END FROM lines
    UNION ALL SELECT doc_id, 3 * i + 3, CASE WHEN len(w) > 3 THEN 'u' ELSE 'x' END || i, 90, greatest(len(w) - 3, 0) FROM lines""")
_TITLES = ("Bill to", "Receipt of", "Agreement between", "Application of", "Name of", "")
add("nst07_summary_type", lambda s, d: nested.blocks_to_form_fields(_blocks(s, d)).groupBy("doc_id").agg(
    F.sort_array(F.collect_list(F.struct("position", "key"))).alias("fields")).select("doc_id", nested.summary_type(F.concat(
        F.array(F.struct(F.lit(-1).alias("position"), F.element_at(F.array(*[F.lit(t) for t in _TITLES]), F.col("doc_id").cast("int") % 6 + 1).alias("key"))),
        F.col("fields"))).alias("kind")),
    f"""WITH {_TEXT_LINES}, keys AS (SELECT doc_id, lower([{', '.join(f"'{t}'" for t in _TITLES)}][max(number) % 6 + 1] || ' ' ||
      string_agg({_KEY_TEXT}, ' ' ORDER BY i)) AS k FROM lines WHERE len(w) > 0 GROUP BY 1)
    SELECT doc_id, CASE WHEN contains(k, 'invoice') OR contains(k, 'bill') THEN 'Invoice/Bill' WHEN contains(k, 'receipt') THEN 'Receipt'
      WHEN contains(k, 'contract') OR contains(k, 'agreement') THEN 'Contract/Agreement'
      WHEN contains(k, 'form') OR contains(k, 'application') THEN 'Form/Application' ELSE 'Unknown' END AS kind FROM keys""")


def _analysis(s, d):
    """Every order as an analysis document: header fields and a table with a row per line."""
    k = bridge.lake(s, d, describe=True)
    rows = k.items.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.array(
        F.col("item_id").cast("string"), "item_description", F.lit(""), "hsn_code", F.concat(F.col("quantity").cast("string"), F.lit(" NOS")),
        F.concat(F.lit("₹"), F.format_number("unit_price", 2)), F.format_number("taxable_value", 2)))).alias("r"))
    title = F.array(*[F.lit(t) for t in ("Sl", "Description of Goods", "Mark", "HSN/SAC", "Quantity", "Rate", "Taxable Amount")])
    total = F.array(*[F.lit(t) for t in ("Total", "", "", "", "", "", "1.00")])
    field = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(95.0).alias("confidence"))
    return k.invoices.join(rows, "invoice_id").select(
        F.struct(F.concat(F.lit("f"), F.col("invoice_id").cast("string")).alias("filename"),
                 F.col("invoice_id").cast("bigint").alias("file_size_bytes")).alias("file_info"),
        F.struct(F.array(field("Invoice No.", F.when(F.col("invoice_id") % 5 == 0, "").otherwise(F.col("invoice_num"))),
                         field("Dated", F.date_format("invoice_date", "d-MMM-yyyy")),
                         field("Taxable Value", F.format_number("taxable_value", 2)),
                         field("Tax Amount", F.format_number("total_tax", 2))).alias("form_fields")).alias("form_analysis"),
        F.struct(F.array(F.struct(F.concat(F.array(title), "r", F.array(total)).alias("rows"))).alias("tables")).alias("table_analysis"),
        F.struct(F.lit(90.0).alias("confidence_score")).alias("summary"),
        F.concat(F.lit("Tax invoice no: "), "invoice_num", F.lit(" pay within 30 days")).alias("ocr_text"))


add("ext01_headers", lambda s, d: extract.extract_headers(_analysis(s, d)).select(
    "filename", "invoice_num", "invoice_date", "taxable_value", "total_tax", "payment_terms"), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS filename, invoice_num, invoice_date, CAST(taxable_value AS DOUBLE) AS taxable_value,
    CAST(total_tax AS DOUBLE) AS total_tax, '30 DAYS' AS payment_terms FROM invoices"""))
def _with_tax_ids(s, d):
    """A third of the documents has the supplier's tax id in a field, a third in the text, a third not at all."""
    own = F.concat(F.lit("24AAAAA"), F.lpad((F.col("file_info.file_size_bytes") % 10000).cast("string"), 4, "0"), F.lit("A1Z5"))
    turn = F.col("file_info.file_size_bytes") % 3
    more = F.array(F.struct(F.lit("Supplier GSTIN/UIN").alias("key"), own.alias("value"), F.lit(90.0).alias("confidence")))
    fields = F.when(turn == 0, F.concat("form_analysis.form_fields", more)).otherwise(F.col("form_analysis.form_fields"))
    return _analysis(s, d).withColumns({
        "ocr_text": F.when(turn == 1, F.concat("ocr_text", F.lit(" GSTIN: "), own, F.lit(" State"))).otherwise(F.col("ocr_text")),
        "form_analysis": F.struct(fields.alias("form_fields"))})


add("ext02_supplier_gstin", lambda s, d: extract.extract_headers(_with_tax_ids(s, d)).select("filename", "supplier_gstin"), oracle(
    """SELECT 'f' || invoice_id AS filename, CASE WHEN invoice_id % 3 < 2 THEN '24AAAAA' || lpad(CAST(invoice_id % 10000 AS VARCHAR), 4, '0') || 'A1Z5' END
    AS supplier_gstin FROM invoices"""))
add("ext04_derived_total", lambda s, d: extract.extract_headers(_analysis(s, d)).select("filename", F.round("total_value", 2).alias("total_value")), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS filename, CASE WHEN total_tax <> 0 THEN
    CAST(taxable_value + total_tax AS DOUBLE) END AS total_value FROM invoices"""))
add("ext07_line_items", lambda s, d: extract.extract_line_items(_analysis(s, d)).select(
    "filename", "description", "hsn_code", "quantity", "unit_price", "taxable_value"), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS filename, item_description AS description, hsn_code, CAST(quantity AS DOUBLE) AS quantity,
    CAST(unit_price AS DOUBLE) AS unit_price, CAST(taxable_value AS DOUBLE) AS taxable_value FROM items"""))
add("ext08_line_items_by_position", lambda s, d: extract.extract_line_items_by_position(_analysis(s, d)).select(
    "filename", "description", "hsn_code", "taxable_value"), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS filename, CAST(item_id AS VARCHAR) AS description, '' AS hsn_code,
    CAST(taxable_value AS DOUBLE) AS taxable_value FROM items"""))


def _normalized(s, d):
    k = bridge.lake(s, d)
    made = store.normalize_extracted(extract.extract_invoices(_analysis(s, d)), k.companies, k.products)
    return made["invoices"].select("invoice_id", "invoice_num", "total_value").join(
        made["invoice_item"].groupBy("invoice_id").agg(F.count("*").alias("lines"), F.sum("taxable_value").alias("taxable")), "invoice_id")


add("ext09_load_defaults", lambda s, d: _normalized(s, d).select(
    "invoice_num", F.col("taxable").cast("double").alias("taxable"), "lines"), oracle(
    """SELECT invoice_num, CAST(taxable_value AS DOUBLE) AS taxable, lines FROM invoices JOIN (SELECT invoice_id AS i, count(*) AS lines
    FROM items GROUP BY 1) x ON i = invoice_id"""))
def _appended(s, d):
    """The five tables that one load adds to, written in one commit and read back: every row of each, ids followed to what they stand for."""
    k = bridge.lake(s, d)
    known = k.products.where("product_id % 3 <> 0")
    made = store.normalize_extracted(cut_lineage(extract.extract_invoices(_analysis(s, d))), k.companies, known)
    versions = Versions(s, f"{shared_dir(s).rstrip('/')}/store-{s.sparkContext.applicationId}-{uuid.uuid4().hex}")
    commit = versions.begin()
    for name, rows in made.items():
        commit.create(name, rows.schema, store_key(name), 16).append(name, rows)
    commit.finish()
    t = {name: versions.read(name) for name in made}

    def rows(frame, frame_name, *columns):
        return frame.select(F.lit(frame_name).alias("frame"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("row"))
    named = t["documents"].select("doc_id", "filename")
    suppliers = t["companies"].withColumnsRenamed({"company_id": "supplier_company_id"})
    products = known.select("product_id", F.col("hsn_code").alias("code"), "canonical_name").unionByName(
        t["products"].select("product_id", F.col("hsn_code").alias("code"), "canonical_name"))
    heads = t["invoices"].join(named, "doc_id").join(suppliers, "supplier_company_id")
    lines = t["invoice_item"].join(t["invoices"].join(named, "doc_id").select("invoice_id", "filename"), "invoice_id").join(products, "product_id")
    return (rows(t["documents"].withColumn("raw", F.col("raw_data").isNotNull()), "documents", "filename", "doc_type", "file_size_bytes", "analysis_confidence", "raw")
            .unionByName(rows(t["companies"], "companies", "legal_name", "gstin", "state", "city"))
            .unionByName(rows(t["products"], "products", "hsn_code", "canonical_name"))
            .unionByName(rows(heads, "invoices", "filename", "invoice_num", "invoice_date", "gstin", "taxable_value", "total_tax", "total_value", "currency",
                              "status", "validation", "duplication"))
            .unionByName(rows(lines, "invoice_item", "filename", "hsn_code", "code", "canonical_name", "item_description", "quantity", "unit_price",
                              "taxable_value", "gst_rate", "gst_amount", "total_amount")))


def store_key(name):
    return {"documents": "doc_id", "companies": "company_id", "products": "product_id"}.get(name, "invoice_id")


_GST = "CAST(round(taxable_value * 0.18, 2) AS DECIMAL(15,2))"
add("snk01_append_normalized", _appended, oracle(
    f"""SELECT 'documents' AS frame, concat_ws('|', 'f' || invoice_id, 'B2B_INVOICE', invoice_id, '90.00', 'true') AS row FROM invoices
    UNION ALL SELECT 'companies', '-|-|-|-' FROM invoices
    UNION ALL SELECT 'products', hsn_code || '|' || canonical_name FROM products WHERE product_id % 3 = 0 AND product_id IN (SELECT product_id FROM items)
    UNION ALL SELECT 'invoices', concat_ws('|', 'f' || invoice_id, invoice_num, invoice_date, '-', taxable_value, total_tax,
      CASE WHEN total_tax <> 0 AND taxable_value <> 0 THEN CAST(taxable_value + total_tax AS DECIMAL(15,2)) ELSE CAST(0 AS DECIMAL(15,2)) END,
      'INR', 'PROCESSED', 'false', 'false') FROM invoices
    UNION ALL SELECT 'invoice_item', concat_ws('|', 'f' || invoice_id, hsn_code, hsn_code, item_description, item_description, quantity, unit_price,
      taxable_value, '18.00', {_GST}, CAST(taxable_value + {_GST} AS DECIMAL(15,2))) FROM items"""))
add("snk10_normalize_analysis", lambda s, d: nested.normalize_analysis(_analysis_docs(s, d))["table_cells"].groupBy("document").agg(
    F.count("*").alias("cells"), F.max("row_index").alias("last_row")), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS document, (count(*) + 2) * 7 AS cells, count(*) + 1 AS last_row FROM items GROUP BY invoice_id"""))
add("agg26_analysis_summary", lambda s, d: nested.analysis_summary(_analysis_docs(s, d)).select(
    "document", "total_fields", "fields_with_values", "total_tables", "total_cells", "confidence_score", "document_type"), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS document, 4 AS total_fields, CASE WHEN invoice_id % 5 = 0 THEN 3 ELSE 4 END AS fields_with_values,
    1 AS total_tables, (count(*) + 2) * 7 AS total_cells, 95::DOUBLE AS confidence_score, 'Invoice/Bill' AS document_type FROM items GROUP BY invoice_id"""))


def _analysis_docs(s, d):
    null = lambda kind: F.lit(None).cast(kind)
    return _analysis(s, d).withColumns({
        "file_name": F.col("file_info.filename"),
        "file_info": F.struct("file_info.filename", null("bigint").alias("file_size_bytes"), null("string").alias("analyzed_at")),
        "summary": F.struct(null("string").alias("document_type"), "summary.confidence_score"),
        "table_analysis": F.struct(F.transform("table_analysis.tables", lambda t: F.struct(
            t["rows"].alias("rows"), null("int").alias("row_count"), null("int").alias("column_count"),
            null("double").alias("confidence"))).alias("tables"))})


def _told(s, d):
    docs = _analysis_docs(s, d)
    return docs.select(F.col("file_name").alias("document"), classify.analysis_text(docs).alias("told"))


add("cls01_analysis_text", _told, oracle(
    """SELECT 'f' || h.invoice_id AS document, lower(concat_ws(' ', 'f' || h.invoice_id,
      'Invoice No. ' || CASE WHEN h.invoice_id % 5 = 0 THEN '' ELSE invoice_num END, 'Dated ' || strftime(invoice_date, '%-d-%b-%Y'),
      'Taxable Value ' || format('{:,.2f}', CAST(taxable_value AS DOUBLE)), 'Tax Amount ' || format('{:,.2f}', CAST(total_tax AS DOUBLE)),
      'Sl Description of Goods Mark HSN/SAC Quantity Rate Taxable Amount', lines_, 'Total      1.00',
      'Tax invoice no: ' || invoice_num || ' pay within 30 days')) AS told
    FROM invoices h JOIN (SELECT invoice_id, string_agg(concat_ws(' ', item_id, item_description, '', hsn_code, quantity || ' NOS',
      '₹' || format('{:,.2f}', CAST(unit_price AS DOUBLE)), format('{:,.2f}', CAST(taxable_value AS DOUBLE))), ' ' ORDER BY CAST(item_id AS VARCHAR), item_description, hsn_code,
      quantity || ' NOS', '₹' || format('{:,.2f}', CAST(unit_price AS DOUBLE))) AS lines_
      FROM items GROUP BY 1) i ON h.invoice_id = i.invoice_id"""))


# Portal pages -------------------------------------------------------------------------
_ID = "concat('24AAAAA', lpad(cast(page_id % 10000 AS string), 4, '0'), 'A1Z5')"


_STATES = ("24 - Gujarat (GJ)", "27 - Maharashtra", "Kerala")


def _portal(s, d):
    """Every page as a portal page: its own content and a details table lie in cells of a layout table; then come up to three filings
    in a table and sentences on filings. Name, trades and jurisdictions are taken from the page itself."""
    title, trade = "regexp_extract(html, '<title>(.*?)</title>', 1)", "regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"
    host = "regexp_extract(url, '//([^/]+)/', 1)"

    def row(label, value, when="true"):
        return f"if({when}, concat('<tr><td>{label}</td><td> ', {value}, '</td></tr>\\n'), '')"

    def filing(least, *cells):
        return f"if(page_id % 4 >= {least}, concat('<tr>', " + ", ".join(f"'<td>', {c}, '</td>'" for c in cells) + ", '</tr>'), '')"
    details = ", ".join([
        row("Legal Name", f"'<b>', {title}, '</b>'"), row("Company Status", "if(page_id % 2 = 0, 'Active', 'Cancelled')"),
        row("Trade Name", "'Trade &amp; Co ', page_id"), row("GSTIN", _ID.replace("A1Z5", "A2Z5"), "page_id % 3 = 0"), row("PAN", f"substr({_ID}, 3, 10)"),
        row("State", f"element_at(array({', '.join(map(repr, _STATES))}), cast(page_id % 3 AS int) + 1)"), row("PIN Code", "380000 + page_id % 1000"),
        row("TaxPayer Type", "'Regular'"), row("TaxPayer Type", "'Composition'", "page_id % 4 = 0"), row("Constitution of Business", "'Private'"),
        row("Registration Date", "date_add(DATE'2017-07-01', cast(page_id % 900 AS int))"), row("Cancellation Date", "'31/03/2020'", "page_id % 2 = 1"),
        row("State Jurisdiction", f"'Ward ', {host}"), row("Centre Jurisdiction", f"'Range ', {host}"),
        row("Nature of Business Activities", f"'▪ Trade ▪ ', {trade}")])
    filings = ", ".join([
        filing(1, "'GSTR-3B'", "'Jan 2019'", "'12-Feb-2019'"), filing(2, "'GSTR-1'", "'Feb 2019'", "'11-Mar-2019'", "'Late'", "'₹', page_id"),
        filing(3, "'GSTR-9'", "'2018-19'", "'31-Dec-2019'", "'Filed'", "'-'", "'₹7'", "page_id")])
    return bridge.raw(s, d, "pages").selectExpr(
        "page_id", f"concat('https://portal/taxpayer/', {_ID}, '/') AS url", f"""concat('Alpha ', page_id, ' Pvt Ltd (Active)\\n', {_ID}, '\\n<table><tr><td><table>',
        {details}, '</table></td><td>', html, '</td></tr></table><table>', {filings}, '</table>\\n',
        if(page_id % 5 = 0, 'recently filed the following GST Returns: ▪ GSTR10 for the Return Period of Q1. 2019 was filed on 1.4.2019\\n',
        'GSTR-1 for the Return Period of Mar 2019 was filed on 11-Apr-2019. GSTR-1 for the Return Period of Feb 2019 was filed on 1-Mar-2019.'),
        ' GST: ', element_at(array('18', '7', '5'), cast(page_id % 3 AS int) + 1), '% \\n') AS html""")


_PAGE_ID = "'24AAAAA' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || 'A1Z5'"
add("src11_portal_pages", lambda s, d: bridge.raw(s, d, "pages").select("url", F.length("html").alias("n")),
    "SELECT url, length(html) AS n FROM pages")
_TRADE = """'Trade, ' || regexp_extract(html, '<li><a href="[^"]*">([^<]*)</a>', 1)"""
_TITLE = "trim(regexp_extract(html, '<title>(.*?)</title>', 1))"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"
_STATE = "CASE page_id % 3 WHEN 0 THEN 'Gujarat' WHEN 1 THEN 'Maharashtra' ELSE 'Kerala' END"
add("pag01_taxpayer_pages", lambda s, d: pages.parse_taxpayer_pages(_portal(s, d)),
    f"""SELECT 'https://portal/taxpayer/' || {_PAGE_ID} || '/' AS url, CASE WHEN page_id % 3 = 0 THEN replace({_PAGE_ID}, 'A1Z5', 'A2Z5') ELSE {_PAGE_ID} END AS gstin,
    {_TITLE} AS legal_name, CASE WHEN page_id % 2 = 0 THEN 'Active' ELSE 'Cancelled' END AS status,
    'Trade & Co ' || page_id AS trade_name, substr({_PAGE_ID}, 3, 10) AS pan, {_STATE} AS state, CAST(380000 + page_id % 1000 AS VARCHAR) AS pin_code,
    CASE WHEN page_id % 4 = 0 THEN 'Composition' ELSE 'Regular' END AS taxpayer_type, 'Private' AS constitution,
    CAST(DATE '2017-07-01' + CAST(page_id % 900 AS INTEGER) AS VARCHAR) AS registration_date, CASE WHEN page_id % 2 = 1 THEN '31/03/2020' END AS cancellation_date,
    'Ward ' || regexp_extract(url, '//([^/]+)/', 1) AS state_jurisdiction, 'Range ' || regexp_extract(url, '//([^/]+)/', 1) AS centre_jurisdiction,
    {_TRADE} AS nature_of_business FROM pages""")


def _cleaned_fields(s, d):
    """State and trades as a page's table has them, and cleaned."""
    read = _portal(s, d).withColumn("pairs", pages.labelled(pages.table_rows(F.col("html")))).withColumn("jumps", jumps_of(F.col("pairs")))

    def raw(label):
        return found(F.col("pairs"), F.col("jumps"), F.lit(label))["value"]
    return read.select("page_id", raw("State").alias("written_state"), raw("Nature of Business Activities").alias("written_work")).withColumns({
        "state": pages.clean_state(F.col("written_state")), "work": pages.clean_activities(F.col("written_work"))})


add("pag02_field_cleanup", _cleaned_fields,
    f"""SELECT page_id, [{', '.join(map(repr, _STATES))}][page_id % 3 + 1] AS written_state, '▪ ' || replace({_TRADE}, 'Trade, ', 'Trade ▪ ') AS written_work,
    {_STATE} AS state, {_TRADE} AS work FROM pages""")
_FILINGS = f"""rows_ AS (SELECT page_id, {_PAGE_ID} AS gstin, page_id % 4 AS n FROM pages),
  filings AS (SELECT gstin, 0 AS position, 'GSTR-3B' AS return_type, 'Jan 2019' AS period, '12-Feb-2019' AS filed_date, 'Filed' AS status,
      CAST(NULL AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS liability FROM rows_ WHERE n >= 1
    UNION ALL SELECT gstin, 1, 'GSTR-1', 'Feb 2019', '11-Mar-2019', 'Late', '₹' || page_id, NULL FROM rows_ WHERE n >= 2
    UNION ALL SELECT gstin, 2, 'GSTR-9', '2018-19', '31-Dec-2019', 'Filed', '₹7', CAST(page_id AS VARCHAR) FROM rows_ WHERE n >= 3
    UNION ALL SELECT gstin, n, 'GSTR-1', 'Mar 2019', '11-Apr-2019', 'Filed', NULL, NULL FROM rows_ WHERE n < 3 AND page_id % 5 <> 0
    UNION ALL SELECT gstin, n + 1, 'GSTR-1', 'Feb 2019', '1-Mar-2019', 'Filed', NULL, NULL FROM rows_ WHERE n < 2 AND page_id % 5 <> 0
    UNION ALL SELECT gstin, 0, 'GSTR10', 'Q1. 2019', '1.4.2019', 'Filed', NULL, NULL FROM rows_ WHERE n = 0 AND page_id % 5 = 0)"""
add("pag03_return_filings", lambda s, d: pages.parse_returns(_portal(s, d)), f"WITH {_FILINGS} SELECT * FROM filings")
add("pag04_return_filings_from_text", lambda s, d: pages.parse_returns(_portal(s, d).withColumn("html", F.regexp_replace("html", "<td>GSTR", "<td>-"))),
    f"""WITH {_FILINGS} SELECT gstin, CASE period WHEN 'Feb 2019' THEN 1 ELSE 0 END AS position, return_type, period, filed_date, 'Filed' AS status,
    CAST(NULL AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS liability FROM (SELECT gstin, 'GSTR-1' AS return_type, unnest(['Mar 2019', 'Feb 2019']) AS period,
      unnest(['11-Apr-2019', '1-Mar-2019']) AS filed_date FROM rows_ WHERE page_id % 5 <> 0
    UNION ALL SELECT gstin, 'GSTR10', 'Q1. 2019', '1.4.2019' FROM rows_ WHERE page_id % 5 = 0) x""")
add("pag05_gstin_and_heading", lambda s, d: _portal(s, d).select(
    "page_id", pages.gstin_of_url(F.col("url")).alias("gstin"), pages.name_of_heading(pages.page_text(F.col("html"))).alias("name")),
    f"SELECT page_id, {_PAGE_ID} AS gstin, 'Alpha ' || CAST(page_id AS VARCHAR) || ' Pvt Ltd' AS name FROM pages")
add("pag06_name_near_gstin", lambda s, d: _portal(s, d).select("page_id", pages.name_near_gstin(
    pages.page_text(F.col("html")), pages.gstin_of_url(F.col("url"))).alias("name")),
    "SELECT page_id, 'Alpha ' || CAST(page_id AS VARCHAR) || ' Pvt Ltd (Active)' AS name FROM pages")


def _hsn_pages(s, d):
    code = "concat('84', lpad(cast(page_id % 1000000 AS string), 6, '0'))"
    return bridge.raw(s, d, "pages").selectExpr(
        f"{code} AS hsn_code", "url", f"""CASE WHEN page_id % 4 = 3 THEN html ELSE concat('<table><tr><th>No.</th><th>HSN/SAC Code Input</th>
        <th>HSN/SAC Code Description</th></tr><tr><td>1</td><td>', {code}, '</td><td>MACHINE PART ', cast(page_id AS string), '</td><td>VALID</td></tr></table>
        Rate: 18% ', html) END AS html""")


add("pag07_hsn_pages", lambda s, d: pages.parse_hsn_pages(_hsn_pages(s, d)).select("hsn_code", "valid", "description", "cgst_rate"),
    """SELECT '84' || lpad(CAST(page_id % 1000000 AS VARCHAR), 6, '0') AS hsn_code, page_id % 4 <> 3 AS valid,
    CASE WHEN page_id % 4 = 3 THEN 'HSN/SAC code not found or invalid' ELSE 'MACHINE PART ' || CAST(page_id AS VARCHAR) END AS description,
    CASE WHEN page_id % 4 <> 3 THEN '9.0%' END AS cgst_rate FROM pages""")
add("pag08_rate_in_text", lambda s, d: _portal(s, d).select("page_id", pages.rate_in_text(pages.page_text(F.col("html"))).alias("rate")),
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '18' WHEN 2 THEN '5' END AS rate FROM pages")

# Files and table maintenance ----------------------------------------------------------
q("src07_scan_table", lambda k: k.table("products").select("product_id", "hsn_code"), "SELECT product_id, hsn_code FROM products")


def _listing(s, d):
    docs = bridge.raw(s, d, "documents")
    names = docs.selectExpr("concat(cast(doc_id AS string), '_ocr.json') AS name").unionByName(docs.where("doc_id % 3 <> 0").selectExpr(
        "concat('textract_analysis_', cast(doc_id AS string), CASE WHEN doc_id % 2 = 0 THEN '_2025.json' ELSE '.json' END) AS name"))
    return names


LISTING = """stored AS (SELECT 'textract_analysis_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '_2025.json' ELSE '.json' END AS name
  FROM documents WHERE doc_id % 3 <> 0)"""
add("src08_pair_documents", lambda s, d: files.pair_documents(_listing(s, d)).select("doc_id", "analysis"), "WITH " + LISTING + """
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, min(name) AS analysis FROM documents JOIN stored
  ON starts_with(name, 'textract_analysis_' || CAST(doc_id AS VARCHAR)) GROUP BY 1""")
add("src09_latest_file", lambda s, d: files.latest_file_per_key(bridge.raw(s, d, "events").selectExpr(
    "user_id AS key", "concat('snapshot_', cast(event_id AS string)) AS path", "ts AS modified_at")),
    "SELECT user_id AS key, 'snapshot_' || CAST(arg_max(event_id, ts) AS VARCHAR) AS path FROM events GROUP BY 1")
add("src10_resolve_files", lambda s, d: files.resolve_analysis_files(_listing(s, d), bridge.raw(s, d, "documents").selectExpr(
    "cast(doc_id AS string) AS name")).select("name", "analysis", "tier"), "WITH " + LISTING + """
  SELECT wanted AS name, arg_max(stored.name, (-tier, stored.name)) AS analysis, -max(-tier) AS tier FROM (
    SELECT CAST(doc_id AS VARCHAR) AS wanted, name, 1 AS tier FROM documents, stored WHERE name = 'textract_analysis_' || CAST(doc_id AS VARCHAR) || '.json'
    UNION ALL SELECT CAST(doc_id AS VARCHAR), name, 2 FROM documents, stored WHERE starts_with(name, 'textract_analysis_' || CAST(doc_id AS VARCHAR) || '_'))
  x JOIN stored USING (name) GROUP BY 1""")


def _kept(s, rows, name, key, buckets=32):
    """The rows as a table of a versioned store in the shared folder."""
    versions = Versions(s, f"{shared_dir(s).rstrip('/')}/store-{s.sparkContext.applicationId}-{uuid.uuid4().hex}")
    versions.begin().create(name, rows.schema, key, buckets).append(name, rows).finish()
    return versions


def _upserted(s, d):
    """A third of the registry is suspended a day later: the buckets of these are written anew."""
    registry = bridge.lake(s, d).registry
    updates = registry.where("gst_id % 3 = 0").withColumns({
        "status": F.lit("Suspended"), "last_verified": F.col("last_verified") + F.expr("INTERVAL 1 DAY")})
    versions = _kept(s, registry, "gst_companies", "gstin")
    versions.begin().change("gst_companies", updates, lambda rows: store.upsert_registry(rows, updates)).finish()
    return versions.read("gst_companies")


_REGISTRY = """SELECT gst_id, gstin, legal_name, trade_name, pan, registration_date, 'Private Limited Company' AS constitution, 'Regular' AS taxpayer_type,
  {status} AS status, state, pin_code, '-' AS cancellation_date, 'State Office' AS state_jurisdiction, 'Central Office' AS centre_jurisdiction,
  'Trading' AS nature_of_business, 'registry' AS api_source, {verified} AS last_verified, created_at FROM gst_companies""".format
add("snk02_upsert_registry", _upserted, oracle(_REGISTRY(
    status="CASE WHEN gst_id % 3 = 0 THEN 'Suspended' ELSE status END", verified="CASE WHEN gst_id % 3 = 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END")))


def _companies(k):
    batch = k.companies.selectExpr("company_id AS row_id", "legal_name", "CASE WHEN company_id % 4 = 0 THEN concat('99', substr(gstin, 3)) "
                                   "ELSE gstin END AS gstin", "state", "city")
    linked, _added = store.get_or_insert_companies(batch, k.companies.where("company_id % 3 <> 0"))
    return linked.select("row_id", (F.col("company_id") == F.col("row_id")).alias("known"))


q("snk03_get_or_insert_companies", _companies, """SELECT company_id AS row_id, coalesce(gstin IS NOT NULL AND company_id % 4 <> 0 AND
  company_id % 3 <> 0, FALSE) AS known FROM companies""")
q("snk04_enrich_company", lambda k: store.enrich_companies(k.companies, k.registry).select("company_id", "legal_name", "state", "address"),
  """SELECT company_id, coalesce(g.legal_name, c.legal_name) AS legal_name, coalesce(g.state, c.state) AS state,
  CASE WHEN g.gstin IS NOT NULL THEN g.state || ' - ' || pin_code ELSE address END AS address
  FROM companies c LEFT JOIN gst_companies g ON c.gstin = g.gstin""")


def _products(k):
    batch = k.products.selectExpr("product_id AS row_id", "CASE WHEN product_id % 10 = 0 THEN '' ELSE hsn_code END AS hsn_code", "canonical_name")
    linked, _added = store.get_or_insert_products(batch, k.products.where("product_id % 3 <> 0"))
    return linked.select("row_id", F.when(F.col("product_id") == F.col("row_id"), "known").when(F.col("product_id").isNull(), "none")
                         .otherwise("new").alias("outcome"))


q("snk05_get_or_insert_products", _products, """SELECT product_id AS row_id, CASE WHEN product_id % 10 = 0 THEN 'none'
  WHEN product_id % 3 <> 0 THEN 'known' ELSE 'new' END AS outcome FROM products""")
def _flagged_store(s, d):
    k = bridge.lake(s, d)
    versions = _kept(s, k.invoices, "invoices", "invoice_id")
    flags = versions.read("invoices").where("invoice_id % 5 = 0").select("invoice_id", F.lit(True).alias("validation"))
    versions.begin().change("invoices", flags, lambda rows: store.set_flags(rows, flags)).finish()
    return versions.read("invoices").withColumns({c: F.col(c).cast("double") for c in ("taxable_value", "total_tax", "total_value")})


add("snk06_set_flags", _flagged_store, oracle(f"""SELECT invoice_id, doc_id, invoice_num, invoice_date, supplier_company_id, buyer_company_id,
  {dbl("taxable_value")} AS taxable_value, {dbl("total_tax")} AS total_tax, {dbl("total_value")} AS total_value, currency, status,
  validation OR invoice_id % 5 = 0 AS validation, duplication, created_at FROM invoices"""))


def _typed_store(s, d):
    documents = bridge.lake(s, d).documents
    versions = _kept(s, documents, "documents", "filename")
    types = versions.read("documents").where("doc_id % 5 = 0").select("filename", F.lit("QUOTATION").alias("doc_type"))
    versions.begin().change("documents", types, lambda rows: store.set_document_types(rows, types)).finish()
    return versions.read("documents").withColumn("analysis_confidence", F.col("analysis_confidence").cast("double"))


add("snk11_update_document_type", _typed_store, oracle(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'QUOTATION' ELSE doc_type END AS doc_type, created_at, filename,
  file_size_bytes, {dbl("analysis_confidence")} AS analysis_confidence, raw_data FROM docs"""))


def _merged_store(s, d):
    """The half of the registry that is not stored is added from snapshot files; stored rows stay as they are."""
    registry = bridge.lake(s, d).registry
    versions = _kept(s, registry.where("gst_id % 2 = 0"), "gst_companies", "gstin")
    snapshots = registry.withColumn("status", F.lit("from a file"))
    versions.begin().insert_new("gst_companies", snapshots).finish()
    return versions.read("gst_companies")


add("reg04_cache_merge", _merged_store, oracle(_REGISTRY(status="CASE WHEN gst_id % 2 = 0 THEN status ELSE 'from a file' END", verified="created_at")))
add("snk08_registry_records", lambda s, d: _records(s, d))


def _records(s, d):
    from ledgerloom.sources.sinks import registry_records

    k = bridge.lake(s, d)
    filings = k.payments.join(k.invoices.select("invoice_id", "supplier_company_id"), "invoice_id").join(
        k.companies.select(F.col("company_id").alias("supplier_company_id"), "gstin"), "supplier_company_id").selectExpr(
        "gstin", "payment_method AS return_type", "date_format(payment_date, 'MMM yyyy') AS period",
        "date_format(payment_date, 'dd-MMM-yyyy') AS filed_date")
    return registry_records(k.registry, filings).select("gstin", "gst_returns.total_returns_filed")


# Windows of event time, in batch form -------------------------------------------------
def _events(s, d):
    return bridge.raw(s, d, "events").withColumn("amount", F.expr("cast(value AS decimal(15,2))"))


add("str03_windowed_revenue", lambda s, d: jobs.windowed_revenue(_events(s, d), "ts", "amount").select(
    F.col("window_start").cast("date").alias("day"), "events", F.col("revenue").cast("double").alias("revenue")),
    """SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS revenue
    FROM events GROUP BY 1""")
add("str04_session_activity", lambda s, d: jobs.session_activity(_events(s, d), "ts", "user_id", "12 hours").groupBy("user_id").agg(
    F.count("*").alias("sessions"), F.sum("events").alias("events")),
    """SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN ts > lag(ts) OVER (
    PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh
    FROM events) x GROUP BY 1""")


# Faults put into the tables and found again -------------------------------------------
def _recall(s, d):
    """Share of invoices a check flags after each fault, on the stored invoices made consistent."""
    k = bridge.lake(s, d, describe=True)
    money = "decimal(15,2)"
    base = datagen.taxed(k.items.withColumn("taxable_value", (F.col("quantity") * F.col("unit_price")).cast(money)), F.lit(18)).select(
        *k.items.columns)
    heads = datagen.headers_of(k.invoices.drop("taxable_value", "total_tax", "total_value"), base)
    parts = []
    for fault in ("arithmetic_error", "summation_error", "logical_adjustment"):
        bad, lines = datagen.inject(heads, base, fault)
        parts.append(validation.verdicts(bad, lines).agg(
            F.lit(fault).alias("fault"), F.count("*").alias("invoices"), F.count_if(~F.col("overall_passed")).alias("not_passed"),
            F.count_if(F.col("tests_failed") > 0).alias("flagged")))
    bad, _lines = datagen.inject(heads, base, "same_invoice_diff_date")
    parts.append(duplicates.exact_matches(bad).agg(
        F.lit("same_invoice_diff_date").alias("fault"), F.count("*").alias("invoices"), F.lit(0).cast("bigint").alias("not_passed"),
        F.count("*").alias("flagged")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


add("gen02_fault_recall", _recall)


# Document checks and reports ----------------------------------------------------------
def _sections(s, d):
    docs = _analysis_docs(s, d).withColumn("summary", F.when(~F.col("file_name").rlike("[05]$"), F.col("summary")))
    return validation.input_sections(docs).select("file_name", F.array_join("missing_sections", ",").alias("missing"), "complete")


add("val17_input_sections", _sections, oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS file_name, CASE WHEN invoice_id % 5 = 0 THEN 'summary' ELSE '' END AS missing,
    invoice_id % 5 <> 0 AS complete FROM invoices"""))
add("nst05_field_map", lambda s, d: _analysis(s, d).select(
    F.col("file_info.filename").alias("filename"), nested.field_map(F.col("form_analysis.form_fields")).alias("m")).select(
    "filename", F.size("m").alias("fields"), F.try_element_at("m", F.lit("invoice no.")).alias("number")), oracle(
    """SELECT 'f' || CAST(invoice_id AS VARCHAR) AS filename, CASE WHEN invoice_id % 5 = 0 THEN 3 ELSE 4 END AS fields,
    CASE WHEN invoice_id % 5 <> 0 THEN invoice_num END AS number FROM invoices"""))


def _logged(s, d):
    docs = _analysis(s, d)
    return extract.extraction_log(docs, extract.extract_invoices(docs)).select(
        "filename", "fields", "tables", "line_items", "success", F.size("confident_keys").alias("confident"))


add("ext10_extraction_log", _logged, oracle(
    """SELECT 'f' || CAST(h.invoice_id AS VARCHAR) AS filename, 4 AS fields, 1 AS tables, n AS line_items,
    taxable_value > 0 AS success, 4 AS confident FROM invoices h JOIN (SELECT invoice_id, count(*) AS n FROM items GROUP BY 1) i
    ON h.invoice_id = i.invoice_id"""))


def _reports(s, d):
    k = bridge.lake(s, d)
    names = k.companies.select(F.col("company_id").alias("supplier_company_id"), F.col("legal_name").alias("supplier_name"))
    rows = risk.report_rows(k.invoices, validation.run_all_checks(k.invoices, k.items), duplicates.exact_matches(k.invoices), names)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return rows.select("invoice_id", F.col("header.supplier_name").alias("supplier"), size("valid_checks").alias("valid"),
                       size("tests").alias("tests"), size("matches").alias("matches"))


add("rsk07_report_rows", _reports, oracle(
    """SELECT h.invoice_id, legal_name AS supplier, coalesce(valid, 0) AS valid, coalesce(run, 0) AS tests,
    CASE WHEN count(*) OVER (PARTITION BY supplier_company_id, upper(trim(invoice_num))) > 1 THEN 1 ELSE 0 END AS matches
    FROM invoices h LEFT JOIN companies ON supplier_company_id = company_id LEFT JOIN (SELECT invoice_id,
      sum(CASE WHEN passed AND NOT is_suggestion THEN 1 ELSE 0 END) AS valid, sum(CASE WHEN is_suggestion THEN 0 ELSE 1 END) AS run
      FROM checks GROUP BY 1) c ON h.invoice_id = c.invoice_id""", FIRST, GATES, SUMS, CHECKS))


def _scored_reports(s, d):
    k = bridge.lake(s, d, describe=True)
    names = k.companies.select(F.col("company_id").alias("supplier_company_id"), F.col("legal_name").alias("supplier_name"))
    rows = risk.report_rows(k.invoices, validation.run_all_checks(k.invoices, k.items), cut_lineage(duplicates.duplicate_matches(k.invoices, k.items)), names)
    partners = F.aggregate(F.coalesce("matches.partners", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda n, p: n + p)
    return rows.select("invoice_id", F.col("header.supplier_name").alias("supplier"), partners.alias("matches"),
                       F.round(F.array_max("matches.confidence"), 6).alias("best_confidence"))


add("rsk07_scored_report_rows", _scored_reports, oracle(
    """SELECT h.invoice_id, legal_name AS supplier, coalesce(matches, 0) AS matches, round(confidence, 6) AS best_confidence
    FROM invoices h LEFT JOIN companies ON supplier_company_id = company_id LEFT JOIN best b ON h.invoice_id = b.invoice_id""", *FOUND))
