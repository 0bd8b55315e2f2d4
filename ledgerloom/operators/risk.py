"""Confidence, wording and approval that follow from validation and duplicate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases by condition.
ADVICE = {
    "failed": ("Review invoice calculations for mathematical accuracy",
               "Verify data extraction quality from source documents",
               "Check for manual entry errors in invoice processing"),
    "duplicate": ("Investigate potential duplicate submission", "Cross-reference with payment records",
                  "Implement additional duplicate prevention controls"),
    "clean": ("Proceed with standard invoice processing", "Archive for compliance records",
              "Update vendor processing metrics"),
}
HIGH_VALUE = 100000


def reasoning_confidence(passed: Column, failed: Column, run: Column, duplicate: Column, confidence: Column) -> Column:
    """1, less up to 30 % for failed tests and up to half for a sure duplicate; within 0.1 and 1."""
    tests = F.when(~passed, 1 - F.try_divide(failed.cast("double"), run.cast("double")) * 0.3).otherwise(1.0)
    copies = F.when(duplicate, 1 - confidence * 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(tests, F.lit(1.0)) * copies))


def business_impact(passed: Column, duplicate: Column, amount: Column) -> Column:
    return F.concat(F.concat_ws(
        ". ",
        F.when(~passed, "Financial accuracy concerns due to validation failures"),
        F.when(~passed & (amount > HIGH_VALUE), "High-value transaction requires careful review"),
        F.when(duplicate, "Potential duplicate payment risk"),
        F.when(duplicate, "Process efficiency impact due to duplicate detection"),
        F.when(passed & ~duplicate, "Low risk transaction - standard processing recommended"),
        F.when(passed & ~duplicate, "Good data quality and no duplicate concerns")), F.lit("."))


def recommendations(passed: Column, duplicate: Column) -> Column:
    """At most five pieces of advice."""
    def when(condition, key):
        return F.when(condition, F.array(*[F.lit(a) for a in ADVICE[key]])).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(when(~passed, "failed"), when(duplicate, "duplicate"), when(passed & ~duplicate, "clean")), 1, 5)


def validation_reason(failed: Column, run: Column) -> Column:
    return F.when(failed == 0, "All arithmetic validations passed successfully, indicating mathematical consistency."
                  ).otherwise(F.format_string(
                      "%d out of %d validation tests failed, indicating potential calculation errors or data "
                      "extraction issues.", failed, run))


def duplication_reason(duplicate: Column, confidence: Column) -> Column:
    return F.when(duplicate, F.format_string(
        "Potential duplicate detected with %.1f%% confidence based on pattern matching.", confidence * 100)
    ).otherwise("No significant duplicate patterns detected across comparison criteria.")


def approval_status(passed: Column, duplicate: Column) -> Column:
    return F.when(passed & ~duplicate, "APPROVED").otherwise("REQUIRES REVIEW")


def assess(results: DataFrame) -> DataFrame:
    """All of the above for rows with overall_passed, tests_failed, tests_run, is_duplicate,
    duplicate_confidence and total_value."""
    c = F.col
    return results.select(
        "*", reasoning_confidence(c("overall_passed"), c("tests_failed"), c("tests_run"), c("is_duplicate"),
                                  c("duplicate_confidence")).alias("reasoning_confidence"),
        business_impact(c("overall_passed"), c("is_duplicate"), c("total_value")).alias("business_impact"),
        recommendations(c("overall_passed"), c("is_duplicate")).alias("recommendations"),
        validation_reason(c("tests_failed"), c("tests_run")).alias("validation_reason"),
        duplication_reason(c("is_duplicate"), c("duplicate_confidence")).alias("duplication_reason"),
        approval_status(c("overall_passed"), c("is_duplicate")).alias("approval_status"))


def report_rows(invoices: DataFrame, checks: DataFrame, matches: DataFrame, names: DataFrame,
                shown_checks: int | None = None, shown_tests: int | None = None, shown_matches: int | None = None) -> DataFrame:
    """One nested row per invoice for a report: header, passed checks, tests, matches from the best on.

    Lists are whole unless a length to show is given.
    """
    def first(rows, order, n, fields, name):
        ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy("invoice_id").orderBy(*order)))
        kept = ranked if n is None else ranked.where(F.col("_rn") <= n)
        return kept.groupBy("invoice_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))
    tests = ("test_id", "item_id", "expected", "actual", "passed")
    valid = first(checks.where("passed AND NOT is_suggestion"), ("test_id", "item_id"), shown_checks, tests, "valid_checks")
    run = first(checks.where("NOT is_suggestion"), ("test_id", "item_id"), shown_tests, tests, "tests")
    best = first(matches, (F.desc("confidence"), "candidate_id"), shown_matches,
                 ("candidate_id", "partners", "match_type", "confidence"), "matches")
    return (invoices.join(names, "supplier_company_id", "left").join(valid, "invoice_id", "left")
            .join(run, "invoice_id", "left").join(best, "invoice_id", "left")
            .select("invoice_id", F.struct("invoice_num", "invoice_date", "supplier_name", "total_value").alias("header"),
                    "valid_checks", "tests", "matches"))
