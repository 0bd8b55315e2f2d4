"""Arithmetic checks of invoice lines and headers.

Item rules look at one line, header rules compare a header with the sums of its lines.
A rule that cannot be evaluated on a row (a needed value is missing or zero) gives a
*suggestion* instead of a pass or a failure. All comparisons are exact decimals.

Verdicts need one shuffle: lines are folded to one small row per invoice with partial
aggregation, then joined to headers on the same key. The long form (one row per test)
is only produced when asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.classify import DOC_TYPES

TOLERANCE = "0.05"


# Rules are put together as SQL text and parsed once each: a call to the engine for every
# part of every rule would take longer than the query on a small table.

def _amount_sql(name: str) -> str:
    return f"coalesce({name}, CAST(0 AS DECIMAL(15,2)))"


def _filled_sql(name: str) -> str:
    return f"({name} IS NOT NULL AND {name} <> 0)"


def _amount(name: str) -> Column:
    return F.expr(_amount_sql(name))


def line_tax() -> Column:
    """The tax of a line: whichever of split, interstate and combined tax is largest."""
    sgst, cgst, igst, gst = (_amount_sql(f"{kind}_amount") for kind in ("sgst", "cgst", "igst", "gst"))
    return F.expr(f"greatest({sgst} + {cgst}, {igst}, {gst})")


@dataclass(frozen=True)
class Rule:
    test_id: str
    title: str
    needs: tuple[str, ...]                  # fields that must be filled on some line
    tax_related: bool
    level: str = "item"
    expected: Callable[[], Column] | None = None
    actual: Callable[[], Column] | None = None
    evaluable: Callable[[], Column] | None = None   # on this line

    def applies(self) -> Column:
        return F.expr(" AND ".join(f"{f} IS NOT NULL" for f in self.needs))


def _filled(*names: str) -> Callable[[], Column]:
    return lambda: F.expr(" AND ".join(map(_filled_sql, names)))


def _rate_rule(kind: str) -> Rule:
    rate, amount = f"{kind}_rate", f"{kind}_amount"
    return Rule(
        f"{kind}_calculation", f"{kind.upper()} Amount Calculation", ("taxable_value", rate, amount), True,
        expected=lambda: F.col("taxable_value") * F.col(rate) * F.expr("0.01"),
        actual=lambda: F.col(amount), evaluable=_filled("taxable_value", rate, amount))


def _at_least_two_taxes() -> Column:
    names = ("sgst_amount", "cgst_amount", "igst_amount", "gst_amount")
    return F.expr(" + ".join(f"CAST({_filled_sql(n)} AS INT)" for n in names) + " >= 2")


ITEM_RULES = (
    Rule("line_item_total", "Line Item Total Calculation", ("quantity", "unit_price", "taxable_value"), False,
         expected=lambda: F.col("quantity") * F.col("unit_price"), actual=lambda: F.col("taxable_value"),
         evaluable=_filled("quantity", "unit_price", "taxable_value")),
    _rate_rule("gst"), _rate_rule("sgst"), _rate_rule("cgst"), _rate_rule("igst"),
    Rule("total_tax_components", "Total Tax Components", ("sgst_amount", "cgst_amount", "igst_amount"), True,
         expected=lambda: _amount("sgst_amount") + _amount("cgst_amount") + _amount("igst_amount"),
         actual=lambda: _amount("gst_amount"), evaluable=_at_least_two_taxes),
    Rule("item_total_with_tax", "Item Total with Tax",
         ("taxable_value", "gst_amount", "sgst_amount", "cgst_amount", "igst_amount", "total_amount"), True,
         expected=lambda: F.col("taxable_value") + line_tax(), actual=lambda: F.col("total_amount"),
         evaluable=_filled("taxable_value", "total_amount")),
)

HEADER_RULES = (
    Rule("invoice_taxable_sum", "Invoice Taxable Value Sum", ("taxable_value",), False, "invoice",
         expected=lambda: F.col("items_taxable"), actual=lambda: F.col("taxable_value"),
         evaluable=_filled("taxable_value")),
    Rule("invoice_tax_sum", "Invoice Tax Sum", ("total_tax",), True, "invoice",
         expected=lambda: F.col("items_tax"), actual=lambda: F.col("total_tax"),
         evaluable=_filled("total_tax")),
    Rule("invoice_grand_total", "Invoice Grand Total", ("taxable_value", "total_tax", "total_value"), True, "invoice",
         expected=lambda: F.round(F.col("taxable_value") + F.col("total_tax"), 2),
         actual=lambda: F.round("total_value", 2), evaluable=_filled("taxable_value", "total_tax", "total_value")),
)

RULES = {rule.test_id: rule for rule in (*ITEM_RULES, *HEADER_RULES)}

# Fields that name a header value when a rule reports what it misses.
_HEADER_FIELDS = {
    "taxable_value": "taxable_value", "total_tax": "total_tax", "total_value": "total_value",
}


def _within(rule: Rule, tolerance: str) -> Column:
    limit = F.lit(tolerance).cast("decimal(10,4)")
    return F.abs(rule.expected() - rule.actual()) <= limit


def fold_items(items: DataFrame, tolerance: str = TOLERANCE, rules=ITEM_RULES) -> DataFrame:
    """One row per invoice: sums, and per item rule whether it applies, runs and failures."""
    columns = [
        F.count("*").alias("n_items"),
        F.sum(_amount("taxable_value")).alias("items_taxable"),
        F.sum(line_tax()).alias("items_tax"),
        # Which fields of the first line are filled, as bits: a number keeps the aggregation hashed.
        F.min_by(F.expr(" + ".join(f"CAST({_filled_sql(c)} AS INT) * {1 << i}" for i, c in enumerate(_ITEM_FIELDS))), "item_id").alias("first_item"),
    ]
    for rule in rules:
        run = rule.evaluable()
        columns += [
            F.bool_or(rule.applies()).alias(f"can_{rule.test_id}"),
            F.count_if(run).alias(f"run_{rule.test_id}"),
            F.count_if(run & ~_within(rule, tolerance)).alias(f"fail_{rule.test_id}"),
        ]
    return items.groupBy("invoice_id").agg(*columns)


_ITEM_FIELDS = ("quantity", "unit_price", "gst_rate", "gst_amount", "sgst_rate", "sgst_amount",
                "cgst_rate", "cgst_amount", "igst_rate", "igst_amount", "total_amount")


def _headers(invoices: DataFrame, folded: DataFrame) -> DataFrame:
    head = invoices.select("invoice_id", "invoice_num", "taxable_value", "total_tax", "total_value")
    return head.join(folded, "invoice_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def _can(rule: Rule) -> Column:
    return F.expr("n_items > 0" if rule.level == "invoice" else f"coalesce(can_{rule.test_id}, false)")


def _missing(rule: Rule) -> Column:
    """Names of the fields a rule misses: header fields on the header, the rest on the first line."""
    tests = []
    for name in rule.needs:
        if name in _HEADER_FIELDS:
            tests.append(f"CASE WHEN NOT {_filled_sql(name)} THEN '{name}' END")
        else:
            tests.append(f"CASE WHEN n_items > 0 AND first_item & {1 << _ITEM_FIELDS.index(name)} = 0 THEN '{name}' END")
    return F.expr(f"array_compact(array({', '.join(tests)}))")


def discover_tests(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """One row per invoice and rule: does it apply, and if not, which fields are missing.

    A rule that neither applies nor misses a field is left out.
    """
    heads = _headers(invoices, fold_items(items))
    rows = F.array(*[
        F.struct(F.lit(rule.test_id).alias("test_id"), _can(rule).alias("applies"),
                 _missing(rule).alias("missing")) for rule in RULES.values()])
    found = heads.select("invoice_id", F.explode_outer(rows).alias("t")).select("invoice_id", "t.*")
    return (found.where("applies OR size(missing) > 0")
            .select("invoice_id", "test_id", "applies",
                    F.when(~F.col("applies"), F.concat_ws(", ", "missing")).alias("missing")))


def missing_fields(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Rule-level suggestions: the rules that cannot run and why."""
    return discover_tests(invoices, items).where(~F.col("applies")).drop("applies")


_TEST_FIELDS = ("test_id", "title", "item_id", "expected", "actual", "passed", "is_suggestion",
                "tax_related", "message")


def _test_struct(rule: Rule, item_id: Column, tolerance: str) -> Column:
    run = rule.evaluable()
    passed = F.when(run, _within(rule, tolerance)).otherwise(True)
    wide = "decimal(30,6)"
    expected = F.when(run, rule.expected().cast(wide)).otherwise(F.lit(0).cast(wide))
    if rule.test_id in ("invoice_taxable_sum", "invoice_tax_sum"):
        expected = rule.expected().cast(wide)   # the sum is known even when the header is not
    actual = F.when(run, rule.actual().cast(wide)).otherwise(F.lit(0).cast(wide))
    return F.struct(
        F.lit(rule.test_id).alias("test_id"), item_id.alias("item_id"), expected.alias("expected"), actual.alias("actual"),
        passed.alias("passed"), (~run).alias("is_suggestion"), F.lit(None).cast("string").alias("missing"))


def _told(chosen) -> dict[str, Column]:
    """What follows from a test's id and values. It is made from the rows, so that a report without it does not make it for every test."""
    def by_test(value):
        return reduce(lambda cases, r: cases.when(F.col("test_id") == r.test_id, value(r)), chosen[1:], F.when(F.col("test_id") == chosen[0].test_id, value(chosen[0])))
    title = by_test(lambda r: F.lit(r.title))
    message = (F.when(F.col("missing").isNotNull(), F.concat(F.lit("Cannot perform "), title, F.lit(": missing "), F.col("missing")))
               .when(F.col("is_suggestion"), F.concat(F.lit("Cannot check "), title, F.lit(": a value is missing or zero")))
               .when(~F.col("passed"), F.format_string("%s: expected %s, found %s", title, F.col("expected").cast("string"),
                                                       F.col("actual").cast("string"))))
    return {"title": title, "tax_related": by_test(lambda r: F.lit(r.tax_related)), "message": message}


def run_all_checks(invoices: DataFrame, items: DataFrame, tolerance: str = TOLERANCE,
                   only: tuple[str, ...] | None = None) -> DataFrame:
    """Long form: one row per invoice, rule and (for item rules) line."""
    chosen = [r for r in RULES.values() if only is None or r.test_id in only]
    item_rules = [r for r in chosen if r.level == "item"]
    heads = _headers(invoices, fold_items(items, tolerance, item_rules))
    parts = []
    if item_rules:
        gates = heads.select("invoice_id", *[_can(r).alias(f"can_{r.test_id}") for r in item_rules])
        tests = F.array(*[F.when(F.col(f"can_{r.test_id}"), _test_struct(r, F.col("item_id"), tolerance))
                          for r in item_rules])
        parts.append(items.join(gates, "invoice_id")
                     .select("invoice_id", F.explode_outer(F.array_compact(tests)).alias("t")))
    per_invoice = [F.when(F.col("n_items") > 0, _test_struct(r, F.lit(None).cast("bigint"), tolerance))
                   for r in chosen if r.level == "invoice"]
    for rule in chosen:
        wide = F.lit(0).cast("decimal(30,6)")
        per_invoice.append(F.when(~_can(rule) & (F.size(_missing(rule)) > 0), F.struct(
            F.lit(rule.test_id).alias("test_id"), F.lit(None).cast("bigint").alias("item_id"), wide.alias("expected"),
            wide.alias("actual"), F.lit(True).alias("passed"), F.lit(True).alias("is_suggestion"),
            F.concat_ws(", ", _missing(rule)).alias("missing"))))
    parts.append(heads.select("invoice_id", F.explode_outer(F.array_compact(F.array(*per_invoice))).alias("t")))
    # An outer explode and a filter after it: a plain explode makes the optimizer test the
    # array for emptiness first, which computes every rule a second time.
    rows = reduce(DataFrame.unionByName, parts).where("t IS NOT NULL")
    return rows.select("invoice_id", "t.*").withColumns(_told(chosen)).select("invoice_id", *_TEST_FIELDS)


def check(test_id: str, invoices: DataFrame, items: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """One rule in long form, for all invoices."""
    return run_all_checks(invoices, items, tolerance, only=(test_id,)).drop("title", "message", "tax_related")


def verdicts(invoices: DataFrame, items: DataFrame, tolerance: str = TOLERANCE,
             ignore_tax: bool = True) -> DataFrame:
    """Test counts and the overall result of every invoice, without building the long form.

    Tax-related failures do not fail an invoice while ``ignore_tax`` holds. An invoice
    to which no rule applies is not passed.
    """
    heads = _headers(invoices, fold_items(items, tolerance))

    def total(terms):
        return sum(terms, F.lit(0).cast("bigint"))

    ran, failed, tax_failed, suggested = [], [], [], []
    for rule in RULES.values():
        can = _can(rule)
        if rule.level == "item":
            run = F.when(can, F.col(f"run_{rule.test_id}")).otherwise(0)
            fail = F.when(can, F.col(f"fail_{rule.test_id}")).otherwise(0)
            skipped = F.when(can, F.col("n_items") - F.col(f"run_{rule.test_id}"))
        else:
            run = F.when(can & rule.evaluable(), 1).otherwise(0)
            fail = F.when(can & rule.evaluable() & ~_within(rule, tolerance), 1).otherwise(0)
            skipped = F.when(can, F.when(rule.evaluable(), 0).otherwise(1))
        ran.append(run)
        failed.append(fail)
        if rule.tax_related:
            tax_failed.append(fail)
        suggested.append(skipped.otherwise(F.when(F.size(_missing(rule)) > 0, 1).otherwise(0)))
    counted = heads.select(
        "invoice_id", "invoice_num", total(ran).alias("tests_run"),
        total(failed).alias("tests_failed"), total(tax_failed).alias("tax_tests_failed"),
        total(suggested).alias("suggestions"))
    deciding = F.col("tests_failed") - F.col("tax_tests_failed") if ignore_tax else F.col("tests_failed")
    return counted.select(
        "invoice_id", "invoice_num", "tests_run", (F.col("tests_run") - F.col("tests_failed")).alias("tests_passed"),
        "tests_failed", "tax_tests_failed", "suggestions",
        ((deciding == 0) & (F.col("tests_run") + F.col("suggestions") > 0)).alias("overall_passed"))


def overview(verdict: DataFrame) -> DataFrame:
    """Counts over all verdicts and the share that passed, in percent."""
    return verdict.agg(
        F.count("*").alias("total_invoices"), F.count_if("overall_passed").alias("passed_invoices"),
        F.count_if(~F.col("overall_passed")).alias("failed_invoices"),
        F.sum("tests_run").alias("tests_run"), F.sum("tests_failed").alias("tests_failed"),
    ).withColumn("success_rate", F.expr(
        "round(try_divide(cast(passed_invoices * 100 AS decimal(20,2)), total_invoices), 2)"))


def line_breakdown(invoices: DataFrame, items: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """The lines behind every failed header sum, as rows (an invoice can have any number)."""
    failed = (run_all_checks(invoices, items, tolerance, only=("invoice_taxable_sum", "invoice_tax_sum"))
              .where("NOT passed").select("invoice_id", "test_id"))
    value = F.when(F.col("test_id") == "invoice_tax_sum", line_tax()).otherwise(_amount("taxable_value"))
    return failed.join(items, "invoice_id").select(
        "invoice_id", "test_id", "item_id", value.alias("line_value"), "sgst_amount", "cgst_amount",
        "igst_amount", "gst_amount")


def valid_checks(checks: DataFrame) -> DataFrame:
    return checks.where("passed AND NOT is_suggestion")


def required_fields(extracted: DataFrame) -> DataFrame:
    """Problems that keep a freshly extracted invoice from being stored."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    issues = F.array_compact(F.array(
        F.when(empty("invoice_num"), F.lit("missing invoice number")),
        F.when(empty("supplier_name"), F.lit("missing supplier name")),
        F.when(F.coalesce(F.col("taxable_value") <= 0, F.lit(True)), F.lit("invalid taxable value"))))
    return extracted.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def input_sections(documents: DataFrame) -> DataFrame:
    """Which sections an analysis document lacks."""
    sections = ("file_info", "form_analysis", "table_analysis", "summary", "ocr_text")
    missing = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in sections]))
    return documents.withColumn("missing_sections", missing).withColumn("complete", F.size("missing_sections") == 0)


# What status and type columns may hold.
INVOICE_STATUSES = ("PENDING", "PROCESSED", "PAID", "CANCELLED")
PAYMENT_STATUSES = ("PENDING", "COMPLETED", "FAILED", "CANCELLED")
REGISTRY_STATUSES = ("Active", "Cancelled", "Suspended")
RATE_TOLERANCE = "0.01"


def data_rules(invoices: DataFrame, items: DataFrame, payments: DataFrame, companies: DataFrame,
               documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Violations of the declared data rules: (rule, record_id). A missing tax part is zero, a missing status breaks no rule.

    Uniqueness rules report every member of a clashing group. Group sizes come from a
    partial aggregation and a join back, so a huge group is never gathered in one place.
    """
    state = companies.select("company_id", "state")
    sides = (invoices.join(state.withColumnsRenamed({"company_id": "supplier_company_id", "state": "s_state"}),
                           "supplier_company_id", "left")
             .join(state.withColumnsRenamed({"company_id": "buyer_company_id", "state": "b_state"}),
                   "buyer_company_id", "left").select("invoice_id", "s_state", "b_state"))
    taxed = items.join(sides, "invoice_id")
    near = lambda a, b: F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(10,4)")
    split = near(_amount("sgst_amount") + _amount("cgst_amount"), _amount("gst_amount"))
    through = near(_amount("igst_amount"), _amount("gst_amount"))
    equal = lambda a, b: F.abs(a - b) <= F.lit(RATE_TOLERANCE).cast("decimal(10,4)")
    half_rates = equal(_amount("sgst_rate") + _amount("cgst_rate"), _amount("gst_rate"))
    one_rate = equal(_amount("igst_rate"), _amount("gst_rate"))
    same = F.coalesce(F.col("s_state") == F.col("b_state"), F.lit(False))

    def report(rule, frame, record):
        return frame.select(F.lit(rule).alias("rule"), F.col(record).cast("bigint").alias("record_id"))

    def clashes(frame, keys):
        crowded = frame.groupBy(*keys).count().where("count > 1").drop("count")
        return frame.join(crowded, list(keys), "left_semi")

    paid = payments.join(invoices.select("invoice_id", "total_value"), "invoice_id")
    parts = [
        report("intra_state_split", taxed.where(same & ~split), "item_id"),
        report("inter_state_igst", taxed.where(~same & ~through), "item_id"),
        report("unique_number_per_supplier", clashes(invoices, ("supplier_company_id", "invoice_num")), "invoice_id"),
        report("payment_above_total", paid.where("amount > total_value"), "payment_id"),
        report("unique_reference_per_method", clashes(payments, ("payment_method", "transaction_ref")), "payment_id"),
        report("negative_amount", invoices.where("taxable_value < 0 OR total_tax < 0 OR total_value < 0"),
               "invoice_id"),
        report("unknown_status", invoices.where(~F.col("status").isin(*INVOICE_STATUSES)), "invoice_id"),
        report("intra_state_rates", taxed.where(same & ~half_rates), "item_id"),
        report("inter_state_rate", taxed.where(~same & ~one_rate), "item_id"),
        report("negative_item", items.where("quantity < 0 OR unit_price < 0 OR taxable_value < 0 OR gst_amount < 0 OR total_amount < 0"),
               "item_id"),
        report("negative_payment", payments.where("amount < 0"), "payment_id"),
        report("unknown_payment_status", payments.where(~F.col("status").isin(*PAYMENT_STATUSES)), "payment_id"),
        report("unknown_document_type", documents.where(~F.col("doc_type").isin(*[t.name for t in DOC_TYPES])), "doc_id"),
        report("unknown_registry_status", registry.where(~F.col("status").isin(*REGISTRY_STATUSES)), "gst_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def validation_report(invoices: DataFrame, items: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Readable rows: header columns next to each test, ordered by rule and line."""
    position = F.create_map(*[x for i, t in enumerate(RULES) for x in (F.lit(t), F.lit(i))])
    checks = run_all_checks(invoices, items, tolerance)
    outcome = (F.when(F.col("is_suggestion"), "SUGGESTION").when(F.col("passed"), "PASS")
               .when(F.col("tax_related"), "FAIL (IGNORED)").otherwise("FAIL"))
    heads = invoices.select("invoice_id", "invoice_num", "total_value")
    return checks.join(heads, "invoice_id").select(
        "invoice_id", "invoice_num", "total_value", position[F.col("test_id")].alias("test_order"),
        "test_id", "item_id", outcome.alias("outcome"), "expected", "actual", "message")
