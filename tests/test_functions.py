"""Golden values of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.functions.text import ratio_bound, text_similarity


def values(spark, make, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_clean_currency(spark):
    assert values(spark, fn.clean_currency, ["₹1,208,074.56", "1 000", "abc", "", None, "1 000"]) == [1208074.56, 1000.0, 0.0, 0.0, 0.0, 1000.0]


def test_extract_number(spark):
    assert values(spark, fn.extract_number, ["6.00 NOS", "1.2.3", "none", None, "."]) == [6.0, 0.0, 0.0, 0.0, 0.0]


def test_dates(spark):
    d = dt.date(2025, 8, 20)
    texts = ["20-Aug-25", "20-8-2025", "2025-8-20", "20/8/2025", "2025/8/20", "20-Aug-2025", "on 20-Aug-25."]
    assert values(spark, fn.parse_invoice_date, texts) == [d] * 7
    assert values(spark, lambda c: fn.parse_invoice_date(c, "2025-01-01"), ["31-08-25", None, "x", "99-Aug-25"]) == [dt.date(2025, 1, 1)] * 4
    assert values(spark, lambda c: fn.parse_invoice_date(c, parity=True), ["20-Aug-2025"]) == [dt.date(2020, 8, 20)]
    assert values(spark, fn.parse_invoice_date_or_text, ["5-Mar-25", "5-3-2025", "2025-3-5", "5/3/2025", "x", None]) == [
        "2025-03-05", "2025-03-05", "2025-03-05", "5/3/2025", "x", None]


def test_ids_and_rates(spark):
    assert values(spark, fn.valid_gstin, ["24AAXFA5297L1ZN", "24aaxfa5297l1zn", "29AAACW3775F004", "24AAXFA5297L1Z", None]) == [True, True, False, False, False]
    assert values(spark, fn.pan_of, ["24AAXFA5297L1ZN", "24aaxfa"]) == ["AAXFA5297L", None]
    assert values(spark, fn.valid_hsn, ["8404 9000", "840", "840490001", None]) == [True, False, False, False]
    assert values(spark, fn.valid_tax_rate, [18.0, 9.0, None], "double") == [True, False, False]


def test_similarities(spark):
    rows = spark.createDataFrame([(100.0, 100.0), (100.0, 97.5), (100.0, 90.0), (0.0, 0.0), (0.0, 5.0), (None, 5.0)], "a double, b double")
    got = [r[0] for r in rows.select(fn.numeric_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.5, 0.0, 1.0, 0.0, 0.0])
    texts = spark.createDataFrame([("steel pipe", "steel pipes"), ("", ""), (None, "a")], "a string, b string")
    got = [tuple(r) for r in texts.select(text_similarity(F.col("a"), F.col("b")), ratio_bound(F.coalesce("a", F.lit("")), F.col("b"))).collect()]
    assert got[0][0] == pytest.approx(20 / 21) and got[1] == (1.0, 1.0) and got[2][0] == 0.0
    assert all(s <= bound + 1e-9 for s, bound in got)


def test_texts(spark):
    assert values(spark, fn.clean_markdown, ["# Title\n**bold** and *it* `c` [l](http://u)", "- a\n- b", "End. Next", "```x\ny```z"]) == [
        "Title<br/>bold and it c l", "• a<br/>• b", "End.<br/>Next", "z"]
    assert values(spark, fn.detect_language, ["abc", "añb", None]) == ["english", "multilingual", "english"]
    assert values(spark, fn.detect_payment_method, ["by NEFT", "PhonePe", "x", "visa"]) == ["NEFT", "UPI", "UNKNOWN", "CARD"]
    assert values(spark, fn.detect_expense_category, ["Taxi", "lunch", "diesel", "q"]) == ["TRAVEL", "FOOD", "FUEL", "GENERAL"]
    assert values(spark, fn.clean_file_name, ["3P#1_a-b.pdf"]) == ["3P1_a-bpdf"]
    assert values(spark, fn.percent_text, ["0.875", "x", None]) == ["87.5%", "0.0%", "0.0%"]


def test_formatted_values(spark):
    assert values(spark, lambda c: fn.formatted_value("total_value", c), [1234567.5, None], "double") == ["₹1,234,567.50", "NULL"]
    assert values(spark, lambda c: fn.formatted_value("file_size_bytes", c), [500, 1280, 3 * 1048576], "bigint") == ["500 bytes", "1.2 KB", "3.0 MB"]
    assert values(spark, lambda c: fn.formatted_value("gst_rate", c.cast("decimal(5,2)")), ["18"]) == ["18.00%"]


def test_sql_functions(spark):
    fn.register_sql_functions(spark)
    row = spark.sql("""SELECT clean_currency('₹1,200.50') a, extract_number('6.00 NOS') b, valid_gstin('24AAXFA5297L1ZN') c,
        pan_of('24AAXFA5297L1ZN') d, valid_hsn('84049000') e, valid_tax_rate(18) f, has_value(0) g,
        round(numeric_similarity(100, 97.5), 6) h, date_gap_days(DATE'2025-01-05', DATE'2025-01-01') i""").first()
    assert tuple(row) == (1200.5, 6.0, True, "AAXFA5297L", True, True, False, 0.5, 4)
