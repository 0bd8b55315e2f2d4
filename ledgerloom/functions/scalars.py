"""Column-to-Column functions: cleaning, parsing, checks and similarities.

Everything here stays in the JVM; the one function that cannot is in ``text.py``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tax rates in force, tax id pattern, income tax id pattern.
TAX_RATES = (0, 3, 5, 12, 18, 28)
GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"


def _as_double(text: Column) -> Column:
    return text.try_cast("double")


AMOUNT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DIGITS = r"^(\d+\.?\d*|\.\d+)$"


def clean_currency(text: Column) -> Column:
    """Amount written with a rupee sign, thousands commas or blanks; 0.0 when unreadable."""
    bare = F.regexp_replace(text, r"(?U)[₹,\s]", "")
    return F.coalesce(F.when(bare.rlike(AMOUNT), _as_double(bare)), F.lit(0.0))


def extract_number(text: Column) -> Column:
    """First run of digits and dots as a number; 0.0 when there is none or it is unreadable."""
    run = F.regexp_extract(text, r"[\d.]+", 0)
    return F.coalesce(F.when(run.rlike(DIGITS), _as_double(run)), F.lit(0.0))


_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _date_from(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"),
                                F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name), F.lit(0).cast("bigint"))


def parse_invoice_date(text: Column, default: str | None = None, parity: bool = False) -> Column:
    """Date found anywhere in a text, tried as d-Mon-y, d-m-yyyy, yyyy-m-d, d/m/yyyy, yyyy/m/d.

    Four-digit years are read whole. ``parity=True`` keeps the older reading in which
    the first two digits after a month name are the year. ``default`` stands in for
    texts without a date.
    """
    named = r"(\d{1,2})-(" + "|".join(_MONTHS) + r")-(\d{2})" if parity else \
        r"(\d{1,2})-(" + "|".join(_MONTHS) + r")-(\d{4}|\d{2})"
    year = F.regexp_extract(text, named, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    tries = [_date_from(year, _month_number(F.regexp_extract(text, named, 2)), F.regexp_extract(text, named, 1))]
    for mark in ("-", "/"):
        day_first = rf"(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{4}})"
        year_first = rf"(\d{{4}}){mark}(\d{{1,2}}){mark}(\d{{1,2}})"
        tries.append(_date_from(*[F.regexp_extract(text, day_first, g) for g in (3, 2, 1)]))
        tries.append(_date_from(*[F.regexp_extract(text, year_first, g) for g in (1, 2, 3)]))
    return F.coalesce(*tries, F.lit(default).cast("date"))


def parse_invoice_date_or_text(text: Column) -> Column:
    """The strict variant: ISO text of a d-Mon-yy, d-m-yyyy or yyyy-m-d date, else the text as it is."""
    found = F.when(~F.contains(text, F.lit("/")), parse_invoice_date(text))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), text)


def valid_gstin(text: Column) -> Column:
    return F.coalesce((F.length(text) == 15) & F.upper(text).rlike(f"^{GSTIN}$"), F.lit(False))


def pan_of(gstin: Column) -> Column:
    """The income tax id inside a tax id, if it looks like one."""
    pan = F.substring(gstin, 3, 10)
    return F.when(pan.rlike(PAN), pan)


def valid_hsn(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, "[^0-9]", "")).between(4, 8), F.lit(False))


def valid_tax_rate(rate: Column) -> Column:
    return F.coalesce(rate.isin(*TAX_RATES), F.lit(False))


def has_value(value: Column) -> Column:
    return value.isNotNull() & (value != 0)


def numeric_similarity(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """1 for equal, falling to 0 at a relative difference of ``tolerance``."""
    a, b = a.cast("double"), b.cast("double")
    ratio = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))
    return (F.when(a.isNull() | b.isNull(), 0.0).when((a == 0) & (b == 0), 1.0)
            .when((a == 0) | (b == 0), 0.0).when(ratio <= tolerance, 1 - ratio / F.lit(tolerance)).otherwise(0.0))


def ratio_similarity(a: Column, b: Column) -> Column:
    """1 minus the relative difference of two positive amounts; NULL when not both positive."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two arrays; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        both.cast("double") / F.size(F.array_union(a, b)))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, " ", ""), ""), lambda c: c != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """0.7 of the word overlap plus 0.3 of the letter overlap; 0 when a side is empty."""
    score = jaccard(words(a), words(b)) * 0.7 + jaccard(letters(a), letters(b)) * 0.3
    empty = (F.coalesce(F.trim(a), F.lit("")) == "") | (F.coalesce(F.trim(b), F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(score)


def date_gap_days(a: Column, b: Column) -> Column:
    """Days between two dates (or ISO texts); NULL when either is missing or unreadable."""
    return F.abs(F.date_diff(a.try_cast("date"), b.try_cast("date")))


def safe_abs_diff(a: Column, b: Column) -> Column:
    """Absolute difference, missing as 0; infinity when a text is not a number."""
    def number(x):
        return F.when(x.isNull(), 0.0).otherwise(x.try_cast("double"))
    return F.coalesce(F.abs(number(a) - number(b)), F.lit(float("inf")))


def money(value: Column) -> Column:
    """Half-up to two decimals; exact for decimal input."""
    return F.round(value, 2)


# Ordered passes that reduce marked-up text to plain lines: (pattern, replacement).
_MARKDOWN = (
    (r"(?m)^#{1,6}\s*", ""),
    (r"\*\*(.*?)\*\*", "$1"), (r"__(.*?)__", "$1"),
    (r"\*(.*?)\*", "$1"), (r"_(.*?)_", "$1"),
    (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^[-*]{3,}\s*$", ""), (r"(?m)^[-*+]\s+", "• "),
    (r"\.(\s+)([A-Z])", ".<br/>$2"),
    (r"\n\s*\n\s*\n+", "\n\n"), (r"\n(?!\n)", "<br/>"), (r"\n\n", "<br/><br/>"),
)


def clean_markdown(text: Column) -> Column:
    return F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, *p), _MARKDOWN, text), r"^\s+|\s+$", "")


def detect_language(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]"), "multilingual").otherwise("english")


# First match wins.
PAYMENT_METHODS = (
    ("UPI", "upi|phonepe|paytm|googlepay|bhim"), ("NEFT", "neft"), ("RTGS", "rtgs"), ("IMPS", "imps"),
    ("CARD", "card|visa|master|rupay"), ("CASH", "cash"), ("CHEQUE", "cheque|check"))
EXPENSE_CATEGORIES = (
    ("TRAVEL", "travel|taxi|cab|auto|bus|train|flight|hotel|accommodation"),
    ("FOOD", "food|meal|breakfast|lunch|dinner|restaurant|cafe"),
    ("FUEL", "fuel|petrol|diesel|gas|cng"), ("MEDICAL", "medical|doctor|hospital|medicine|pharmacy"),
    ("OFFICE", "stationery|office|supplies|equipment"), ("COMMUNICATION", "mobile|phone|internet|broadband"),
    ("ENTERTAINMENT", "entertainment|movie|event"))


def first_match(text: Column, table, otherwise: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(label)) for label, pattern in table], F.lit(otherwise))


def detect_payment_method(text: Column) -> Column:
    return first_match(text, PAYMENT_METHODS, "UNKNOWN")


def detect_expense_category(text: Column) -> Column:
    return first_match(text, EXPENSE_CATEGORIES, "GENERAL")


def clean_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\p{Alnum}_-]", "")


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def months_back(as_of: Column, n: int) -> Column:
    return F.add_months(as_of, -n)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent of two counts, rounded as a decimal; 0 when the whole is 0."""
    exact = F.try_divide(part.cast("decimal(18,0)") * 100, whole.cast("decimal(18,0)"))
    return F.coalesce(F.round(exact, digits), F.lit(0)).cast("double")


def safe_confidence(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def percent_text(value: Column) -> Column:
    return F.format_string("%.1f%%", safe_confidence(value) * 100)


MONEY_FIELDS = ("taxable_value", "total_tax", "total_value", "gst_amount", "sgst_amount", "cgst_amount",
                "igst_amount", "total_amount", "unit_price")
RATE_FIELDS = ("gst_rate", "sgst_rate", "cgst_rate", "igst_rate", "default_tax_rate", "analysis_confidence")


def formatted_value(field: str, value: Column) -> Column:
    """A stored value as a person would write it, by the field it comes from."""
    if field.endswith("_at"):
        shown = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    elif field in MONEY_FIELDS:
        shown = F.concat(F.lit("₹"), F.format_number(value, 2))
    elif field in RATE_FIELDS:
        shown = F.concat(value.cast("string"), F.lit("%"))
    elif field == "file_size_bytes":
        size = value.cast("decimal(18,0)")   # binary fractions are exact decimals; ties go to even

        def scaled(unit: str) -> Column:
            return F.bround(size * F.lit(unit).cast("decimal(20,20)"), 1).cast("decimal(20,1)").cast("string")
        shown = (F.when(value > 1024 * 1024, F.concat(scaled("0.00000095367431640625"), F.lit(" MB")))
                 .when(value > 1024, F.concat(scaled("0.0009765625"), F.lit(" KB")))
                 .otherwise(F.concat(value.cast("string"), F.lit(" bytes"))))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def or_default(value: Column, default) -> Column:
    """The value, or a default where it is missing or empty text."""
    return F.coalesce(F.when(F.trim(value) != "", value), F.lit(default))


def _sql(pattern: str) -> str:
    """A pattern inside an SQL string."""
    return pattern.replace("\\", "\\\\")


_BARE = "regexp_replace(s, '(?U)[₹,\\\\s]', '')"
_RUN = "regexp_extract(s, '[\\\\d.]+', 0)"


def register_sql_functions(spark) -> None:
    """Make the pure-SQL functions callable from SQL text in this session."""
    for signature, returns, body in (
        ("clean_currency(s STRING)", "DOUBLE",
         f"coalesce(CASE WHEN {_BARE} RLIKE '{_sql(AMOUNT)}' THEN try_cast({_BARE} AS DOUBLE) END, 0.0D)"),
        ("extract_number(s STRING)", "DOUBLE",
         f"coalesce(CASE WHEN {_RUN} RLIKE '{_sql(DIGITS)}' THEN try_cast({_RUN} AS DOUBLE) END, 0.0D)"),
        ("valid_gstin(s STRING)", "BOOLEAN",
         f"coalesce(length(s) = 15 AND upper(s) RLIKE '^{GSTIN}$', false)"),
        ("pan_of(s STRING)", "STRING", f"CASE WHEN substring(s, 3, 10) RLIKE '{_sql(PAN)}' THEN substring(s, 3, 10) END"),
        ("valid_hsn(s STRING)", "BOOLEAN",
         "coalesce(length(regexp_replace(s, '[^0-9]', '')) BETWEEN 4 AND 8, false)"),
        ("valid_tax_rate(r DOUBLE)", "BOOLEAN", f"coalesce(r IN {TAX_RATES}, false)"),
        ("has_value(x DOUBLE)", "BOOLEAN", "x IS NOT NULL AND x <> 0"),
        ("numeric_similarity(a DOUBLE, b DOUBLE)", "DOUBLE",
         "CASE WHEN a IS NULL OR b IS NULL THEN 0D WHEN a = 0 AND b = 0 THEN 1D WHEN a = 0 OR b = 0 THEN 0D "
         "ELSE greatest(0D, 1 - abs(a - b) / greatest(abs(a), abs(b)) / 0.05D) END"),
        ("date_gap_days(a DATE, b DATE)", "INT", "abs(datediff(a, b))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
