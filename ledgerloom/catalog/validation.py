"""Queries of the validation family."""

from pyspark.sql import functions as F

from ledgerloom import bridge
from ledgerloom.bridge import oracle
from ledgerloom.catalog.registry import add
from ledgerloom.operators import validation as v


def _z(c):
    return f"coalesce({c}, 0)"


_HV = "({0} IS NOT NULL AND {0} <> 0)".format
_TAX = f"greatest({_z('sgst_amount')} + {_z('cgst_amount')}, {_z('igst_amount')}, {_z('gst_amount')})"


def _rate(kind):
    amount, rate = f"{kind}_amount", f"{kind}_rate"
    return (f"taxable_value IS NOT NULL AND {rate} IS NOT NULL AND {amount} IS NOT NULL",
            f"{_HV('taxable_value')} AND {_HV(rate)} AND {_HV(amount)}",
            f"taxable_value * {rate} * 0.01", amount)


# test -> (line has the needed fields, line can be evaluated, expected, actual)
ITEM_SQL = {
    "line_item_total": ("quantity IS NOT NULL AND unit_price IS NOT NULL AND taxable_value IS NOT NULL",
                        f"{_HV('quantity')} AND {_HV('unit_price')} AND {_HV('taxable_value')}",
                        "quantity * unit_price", "taxable_value"),
    "gst_calculation": _rate("gst"), "sgst_calculation": _rate("sgst"),
    "cgst_calculation": _rate("cgst"), "igst_calculation": _rate("igst"),
    "total_tax_components": (
        "sgst_amount IS NOT NULL AND cgst_amount IS NOT NULL AND igst_amount IS NOT NULL",
        "(" + " + ".join(f"CASE WHEN {_HV(c)} THEN 1 ELSE 0 END" for c in (
            "sgst_amount", "cgst_amount", "igst_amount", "gst_amount")) + ") >= 2",
        f"{_z('sgst_amount')} + {_z('cgst_amount')} + {_z('igst_amount')}", _z("gst_amount")),
    "item_total_with_tax": (
        "taxable_value IS NOT NULL AND gst_amount IS NOT NULL AND sgst_amount IS NOT NULL AND "
        "cgst_amount IS NOT NULL AND igst_amount IS NOT NULL AND total_amount IS NOT NULL",
        f"{_HV('taxable_value')} AND {_HV('total_amount')}", f"taxable_value + {_TAX}", "total_amount"),
}
NEEDS = {r.test_id: r.needs for r in v.ITEM_RULES}
HEADER_SQL = {
    "invoice_taxable_sum": (_HV("taxable_value"), "items_taxable", "taxable_value"),
    "invoice_tax_sum": (_HV("total_tax"), "items_tax", "total_tax"),
    "invoice_grand_total": (f"{_HV('taxable_value')} AND {_HV('total_tax')} AND {_HV('total_value')}",
                            "round(taxable_value + total_tax, 2)", "round(total_value, 2)"),
}
TAX_TESTS = [r.test_id for r in v.RULES.values() if r.tax_related]


def _missing_sql(test):
    """Comma list of the missing fields, header fields on the header, the rest on the first line."""
    parts = []
    for name in NEEDS[test]:
        source = "h.taxable_value" if name == "taxable_value" else f"f.{name}"
        parts.append(f"CASE WHEN NOT {_HV(source)} THEN '{name}' END")
    return f"concat_ws(', ', {', '.join(parts)})"


FIRST = """first_item AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY item_id) AS rn
  FROM items) q WHERE rn = 1)"""
GATES = "gates AS (SELECT invoice_id, " + ", ".join(
    f"bool_or({needs}) AS can_{t}" for t, (needs, *_r) in ITEM_SQL.items()) + " FROM items GROUP BY invoice_id)"
SUMS = f"""sums AS (SELECT invoice_id, count(*) AS n_items, sum({_z('taxable_value')}) AS items_taxable,
  sum({_TAX}) AS items_tax FROM items GROUP BY invoice_id)"""


def _item_rows(test):
    _needs, run, expected, actual = ITEM_SQL[test]
    return f"""SELECT i.invoice_id, '{test}' AS test_id, i.item_id,
      CAST(CASE WHEN {run} THEN {expected} ELSE 0 END AS DECIMAL(30,6)) AS expected,
      CAST(CASE WHEN {run} THEN {actual} ELSE 0 END AS DECIMAL(30,6)) AS actual,
      CASE WHEN {run} THEN abs({expected} - ({actual})) <= 0.05 ELSE TRUE END AS passed,
      NOT ({run}) AS is_suggestion
      FROM items i JOIN gates g ON i.invoice_id = g.invoice_id WHERE can_{test}
    UNION ALL SELECT * FROM (SELECT h.invoice_id, '{test}' AS test_id, CAST(NULL AS BIGINT) AS item_id, 0 AS expected,
      0 AS actual, TRUE AS passed, TRUE AS is_suggestion
      FROM invoices h JOIN gates g ON h.invoice_id = g.invoice_id JOIN first_item f ON f.invoice_id = h.invoice_id
      WHERE NOT can_{test} AND {_missing_sql(test)} <> '') q"""


def _header_rows(test):
    run, expected, actual = HEADER_SQL[test]
    shown = expected if test != "invoice_grand_total" else f"CASE WHEN {run} THEN {expected} ELSE 0 END"
    return f"""SELECT h.invoice_id, '{test}' AS test_id, CAST(NULL AS BIGINT) AS item_id,
      CAST({shown} AS DECIMAL(30,6)) AS expected, CAST(CASE WHEN {run} THEN {actual} ELSE 0 END AS DECIMAL(30,6)) AS actual,
      CASE WHEN {run} THEN abs({expected} - {actual}) <= 0.05 ELSE TRUE END AS passed, NOT ({run}) AS is_suggestion
      FROM invoices h JOIN sums s ON h.invoice_id = s.invoice_id"""


def _rows(test):
    return _item_rows(test) if test in ITEM_SQL else _header_rows(test)


def _out(source):
    return (f"SELECT invoice_id, test_id, item_id, CAST(expected AS DOUBLE) AS expected, "
            f"CAST(actual AS DOUBLE) AS actual, passed, is_suggestion FROM ({source}) r")


ALL_TESTS = [*ITEM_SQL, *HEADER_SQL]
CHECKS = "checks AS (" + "\nUNION ALL ".join(_rows(t) for t in ALL_TESTS) + ")"
_TAX_LIST = ", ".join(f"'{t}'" for t in TAX_TESTS)
VERDICTS = f"""verdicts AS (SELECT c.invoice_id, invoice_num,
  CAST(sum(CASE WHEN NOT is_suggestion THEN 1 ELSE 0 END) AS BIGINT) AS tests_run,
  CAST(sum(CASE WHEN NOT is_suggestion AND passed THEN 1 ELSE 0 END) AS BIGINT) AS tests_passed,
  CAST(sum(CASE WHEN NOT passed THEN 1 ELSE 0 END) AS BIGINT) AS tests_failed,
  CAST(sum(CASE WHEN NOT passed AND test_id IN ({_TAX_LIST}) THEN 1 ELSE 0 END) AS BIGINT) AS tax_tests_failed,
  CAST(sum(CASE WHEN is_suggestion THEN 1 ELSE 0 END) AS BIGINT) AS suggestions,
  sum(CASE WHEN NOT passed AND test_id NOT IN ({_TAX_LIST}) THEN 1 ELSE 0 END) = 0 AS overall_passed
  FROM checks c JOIN invoices i ON c.invoice_id = i.invoice_id GROUP BY c.invoice_id, invoice_num)"""
VERDICT_CTES = (FIRST, GATES, SUMS, CHECKS, VERDICTS)


def _checked(spark, d, test):
    lake = bridge.lake(spark, d)
    rows = v.check(test, lake.invoices, lake.items)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("expected", "actual")})


def _verdicts(spark, d):
    lake = bridge.lake(spark, d)
    return v.verdicts(lake.invoices, lake.items)


for _i, _test in enumerate(ALL_TESTS, 1):
    add(f"val{_i:02d}_{_test}", lambda s, d, t=_test: _checked(s, d, t), oracle(_out(_rows(_test)), FIRST, GATES, SUMS))

add("val11_verdicts", _verdicts, oracle("SELECT * FROM verdicts", *VERDICT_CTES))


def _discovered(spark, d):
    lake = bridge.lake(spark, d)
    return v.discover_tests(lake.invoices, lake.items).select("invoice_id", "test_id", "applies")


_DISCOVER = "\nUNION ALL ".join(
    [f"""SELECT h.invoice_id, '{t}' AS test_id, can_{t} AS applies, {_missing_sql(t)} AS missing
     FROM invoices h JOIN gates g ON h.invoice_id = g.invoice_id JOIN first_item f ON f.invoice_id = h.invoice_id"""
     for t in ITEM_SQL]
    + [f"SELECT invoice_id, '{t}' AS test_id, TRUE AS applies, '' AS missing FROM invoices" for t in HEADER_SQL])
add("val12_discover_tests", _discovered, oracle(
    f"SELECT invoice_id, test_id, applies FROM ({_DISCOVER}) q WHERE applies OR missing <> ''", FIRST, GATES))


def _missing(spark, d):
    lake = bridge.lake(spark, d)
    return v.missing_fields(lake.invoices, lake.items)


add("val13_missing_fields", _missing, oracle(
    f"SELECT invoice_id, test_id, missing FROM ({_DISCOVER}) q WHERE NOT applies AND missing <> ''", FIRST, GATES))


def _breakdown(spark, d):
    lake = bridge.lake(spark, d)
    shifted = lake.invoices.withColumn("total_tax", F.expr(
        "cast(total_tax + CASE WHEN invoice_id % 50 = 0 THEN 3 ELSE 0 END AS decimal(15,2))"))
    return v.line_breakdown(shifted, lake.items).select(
        "invoice_id", "test_id", "item_id", *[F.col(c).cast("double").alias(c) for c in (
            "line_value", "sgst_amount", "cgst_amount", "igst_amount", "gst_amount")])


add("val14_line_breakdown", _breakdown, oracle(
    f"""SELECT i.invoice_id, 'invoice_tax_sum' AS test_id, item_id, CAST({_TAX} AS DOUBLE) AS line_value,
    CAST(sgst_amount AS DOUBLE) AS sgst_amount, CAST(cgst_amount AS DOUBLE) AS cgst_amount,
    CAST(igst_amount AS DOUBLE) AS igst_amount, CAST(gst_amount AS DOUBLE) AS gst_amount
    FROM items i JOIN (SELECT h.invoice_id FROM invoices h JOIN sums s ON h.invoice_id = s.invoice_id
      WHERE total_tax + CASE WHEN h.invoice_id % 50 = 0 THEN 3 ELSE 0 END <> 0
        AND abs(items_tax - (total_tax + CASE WHEN h.invoice_id % 50 = 0 THEN 3 ELSE 0 END)) > 0.05) b
    ON i.invoice_id = b.invoice_id""", SUMS))


def _valid(spark, d):
    lake = bridge.lake(spark, d)
    rows = v.valid_checks(v.run_all_checks(lake.invoices, lake.items))
    return rows.select("invoice_id", "test_id", "item_id", F.col("expected").cast("double").alias("expected"),
                       F.col("actual").cast("double").alias("actual"))


add("val15_valid_checks", _valid, oracle(
    "SELECT invoice_id, test_id, item_id, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual "
    "FROM checks WHERE passed AND NOT is_suggestion", FIRST, GATES, SUMS, CHECKS))


def _required(spark, d):
    lake = bridge.lake(spark, d)
    names = lake.companies.select(F.col("company_id").alias("supplier_company_id"),
                                  F.col("legal_name").alias("supplier_name"))
    extracted = lake.invoices.join(names, "supplier_company_id", "left").withColumns({
        "invoice_num": F.expr("CASE WHEN invoice_id % 17 = 0 THEN '' ELSE invoice_num END"),
        "taxable_value": F.expr("CASE WHEN invoice_id % 19 = 0 THEN NULL ELSE taxable_value END")})
    return v.required_fields(extracted).select(
        "invoice_id", F.concat_ws("; ", "issues").alias("issues"), "valid")


add("val16_required_fields", _required, oracle(
    """SELECT invoice_id, concat_ws('; ', CASE WHEN invoice_id % 17 = 0 THEN 'missing invoice number' END,
    CASE WHEN coalesce(legal_name, '') = '' THEN 'missing supplier name' END,
    CASE WHEN invoice_id % 19 = 0 OR taxable_value <= 0 THEN 'invalid taxable value' END) AS issues,
    NOT (invoice_id % 17 = 0 OR coalesce(legal_name, '') = '' OR invoice_id % 19 = 0 OR taxable_value <= 0) AS valid
    FROM invoices LEFT JOIN companies ON supplier_company_id = company_id"""))


def _rules(spark, d):
    lake = bridge.lake(spark, d)
    # Faults for the rules that nothing in these tables breaks.
    items = lake.items.withColumns({"gst_rate": F.expr("CASE WHEN item_id % 97 = 0 THEN gst_rate + 1 ELSE gst_rate END"),
                                    "quantity": F.expr("CASE WHEN item_id % 89 = 0 THEN -quantity ELSE quantity END")})
    payments = lake.payments.withColumns({"status": F.expr("CASE WHEN payment_id % 83 = 0 THEN 'LOST' ELSE status END"),
                                          "amount": F.expr("CASE WHEN payment_id % 79 = 0 THEN -amount ELSE amount END")})
    documents = lake.documents.withColumn("doc_type", F.expr("CASE WHEN doc_id % 71 = 0 THEN 'LETTER' ELSE doc_type END"))
    registry = lake.registry.withColumn("status", F.expr("CASE WHEN gst_id % 5 = 0 THEN 'Closed' ELSE status END"))
    return v.data_rules(lake.invoices, items, payments, lake.companies, documents, registry)


_SPLIT = f"abs({_z('sgst_amount')} + {_z('cgst_amount')} - {_z('gst_amount')}) <= 0.05"
_RATED = f"({_z('gst_rate')} + CASE WHEN item_id % 97 = 0 THEN 1 ELSE 0 END)"
_THROUGH = f"abs({_z('igst_amount')} - {_z('gst_amount')}) <= 0.05"
add("val18_data_rules", _rules, oracle(
    f"""SELECT 'intra_state_split' AS rule, item_id AS record_id FROM taxed WHERE same AND NOT ({_SPLIT})
    UNION ALL SELECT 'inter_state_igst', item_id FROM taxed WHERE NOT same AND NOT ({_THROUGH})
    UNION ALL SELECT 'unique_number_per_supplier', invoice_id FROM (SELECT invoice_id,
        count(*) OVER (PARTITION BY supplier_company_id, invoice_num) AS n FROM invoices) q WHERE n > 1
    UNION ALL SELECT 'payment_above_total', payment_id FROM payment p JOIN invoices i ON p.invoice_id = i.invoice_id
        WHERE amount > total_value
    UNION ALL SELECT 'unique_reference_per_method', payment_id FROM (SELECT payment_id,
        count(*) OVER (PARTITION BY payment_method, transaction_ref) AS n FROM payment) q WHERE n > 1
    UNION ALL SELECT 'negative_amount', invoice_id FROM invoices WHERE taxable_value < 0 OR total_tax < 0 OR total_value < 0
    UNION ALL SELECT 'unknown_status', invoice_id FROM invoices
        WHERE status NOT IN ('PENDING', 'PROCESSED', 'PAID', 'CANCELLED')
    UNION ALL SELECT 'intra_state_rates', item_id FROM taxed WHERE same AND abs({_z('sgst_rate')} + {_z('cgst_rate')} - {_RATED}) > 0.01
    UNION ALL SELECT 'inter_state_rate', item_id FROM taxed WHERE NOT same AND abs({_z('igst_rate')} - {_RATED}) > 0.01
    UNION ALL SELECT 'negative_item', item_id FROM items WHERE unit_price < 0 OR taxable_value < 0 OR gst_amount < 0 OR total_amount < 0
        OR CASE WHEN item_id % 89 = 0 THEN -quantity ELSE quantity END < 0
    UNION ALL SELECT 'negative_payment', payment_id FROM payment WHERE CASE WHEN payment_id % 79 = 0 THEN -amount ELSE amount END < 0
    UNION ALL SELECT 'unknown_payment_status', payment_id FROM payment WHERE payment_id % 83 = 0
        OR status NOT IN ('PENDING', 'COMPLETED', 'FAILED', 'CANCELLED')
    UNION ALL SELECT 'unknown_document_type', doc_id FROM docs WHERE doc_id % 71 = 0
    UNION ALL SELECT 'unknown_registry_status', gst_id FROM gst_companies WHERE gst_id % 5 = 0""",
    """taxed AS (SELECT i.*, coalesce(s.state = b.state, FALSE) AS same FROM items i
    JOIN invoices h ON i.invoice_id = h.invoice_id LEFT JOIN companies s ON h.supplier_company_id = s.company_id
    LEFT JOIN companies b ON h.buyer_company_id = b.company_id)"""))


def _report(spark, d):
    lake = bridge.lake(spark, d)
    return v.validation_report(lake.invoices, lake.items).select(
        "invoice_id", "invoice_num", F.col("total_value").cast("double").alias("total_value"),
        "test_order", "test_id", "item_id", "outcome")


_ORDER = "CASE c.test_id " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(v.RULES)) + " END"
add("val19_validation_report", _report, oracle(
    f"""SELECT c.invoice_id, invoice_num, CAST(total_value AS DOUBLE) AS total_value,
    {_ORDER} AS test_order, c.test_id, item_id, CASE WHEN is_suggestion THEN 'SUGGESTION' WHEN passed THEN 'PASS'
    WHEN c.test_id IN ({_TAX_LIST}) THEN 'FAIL (IGNORED)' ELSE 'FAIL' END AS outcome
    FROM checks c JOIN invoices i ON c.invoice_id = i.invoice_id""", FIRST, GATES, SUMS, CHECKS))


def _overview(spark, d):
    return v.overview(_verdicts(spark, d)).withColumn("success_rate", F.col("success_rate").cast("double"))


add("agg28_validation_overview", _overview, oracle(
    """SELECT count(*) AS total_invoices, CAST(sum(CASE WHEN overall_passed THEN 1 ELSE 0 END) AS BIGINT) AS passed_invoices,
    CAST(sum(CASE WHEN overall_passed THEN 0 ELSE 1 END) AS BIGINT) AS failed_invoices,
    CAST(sum(tests_run) AS BIGINT) AS tests_run, CAST(sum(tests_failed) AS BIGINT) AS tests_failed,
    round(100.0 * sum(CASE WHEN overall_passed THEN 1 ELSE 0 END) / count(*), 2) AS success_rate FROM verdicts""",
    *VERDICT_CTES))
