"""Rule-based document classification: every document scored against all types in one projection.

The rules are a handful of word lists, so they are column expressions rather than a
joined table: one pass over the text, no shuffle, no explosion of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.session import use_all_cores

# Patterns, word lists, weights and thresholds of the document types.
TAX_ID = r"\d{2}[A-Z]{5}\d{4}[A-Z]{1}\d[Z]{1}[A-Z\d]{1}"
COMPANY_FORM = r"(pvt\.?\s*ltd|private\s*limited)"
TAX_NAMES = r"(cgst|sgst|igst)"

HEAVY_WORDS = ("gstin", "pvt ltd", "private limited", "taxable value", "cgst", "sgst", "igst")
MEDIUM_WORDS = ("invoice", "bill", "supplier", "company")
KEY_TERMS = ("gstin", "pvt ltd", "taxable value", "cgst", "sgst", "igst", "invoice")


@dataclass(frozen=True)
class DocType:
    name: str
    threshold: float
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]
    negatives: tuple[str, ...]
    strong: tuple[str, ...] = field(default=())


DOC_TYPES = (
    DocType("B2B_INVOICE", 0.5, (
        "invoice", "bill", "tax invoice", "commercial invoice", "gstin", "gst", "invoice number", "invoice no",
        "bill no", "taxable value", "igst", "cgst", "sgst", "supplier", "buyer", "invoice date", "due date",
        "payment terms", "pvt ltd", "private limited", "company", "corporation", "total", "amount", "quantity",
        "rate", "hsn"), (
        r"invoice\s*(no|number|#)", r"tax\s*invoice", r"commercial\s*invoice", rf"gstin[:]*\s*{TAX_ID}", TAX_ID,
        TAX_NAMES, r"taxable\s*(value|amount)", r"hsn\s*(code|no)", COMPANY_FORM, r"₹\s*[\d,]+\.?\d*",
        r"rs\.?\s*[\d,]+\.?\d*", r"\d{2}[-/]\w{3}[-/]\d{2,4}", r"[A-Z]{2,}[/-]\d{2}[-/]\d{2}[/-]\d+"),
        ("receipt", "expense", "reimbursement", "petty cash"),
        (TAX_ID, COMPANY_FORM, r"(cgst|sgst|igst)\s*[:@]\s*[\d.]+%?", r"taxable\s*(value|amount)",
         r"invoice\s*(no|number)")),
    DocType("EXPENSE_SLIP", 0.6, (
        "expense", "receipt", "reimbursement", "petty cash", "travel", "food", "fuel", "conveyance", "hotel", "taxi",
        "auto", "cab", "meal", "breakfast", "lunch", "dinner", "parking", "toll", "medical", "medicine", "doctor",
        "stationery", "office supplies"), (
        r"expense\s*(receipt|slip)", r"reimbursement", r"petty\s*cash", r"travel\s*(expense|bill)",
        r"hotel\s*(bill|receipt)", r"taxi\s*(receipt|bill)", r"fuel\s*(receipt|bill)"),
        ("invoice", "commercial", "tax invoice")),
    DocType("PAYMENT_PROOF", 0.6, (
        "payment", "paid", "transaction", "transfer", "upi", "neft", "rtgs", "imps", "bank", "payment successful",
        "transaction id", "reference number", "utr number", "credited", "debited", "account", "paytm", "phonepe",
        "googlepay", "razorpay", "payment confirmation"), (
        r"payment\s*(successful|confirmed|completed)", r"transaction\s*(id|reference)", r"utr\s*(no|number)",
        r"(neft|rtgs|imps|upi)", r"credited.*account", r"debited.*account", r"payment\s*of.*rs"),
        ("invoice", "bill", "expense")),
    DocType("PURCHASE_ORDER", 0.7, (
        "purchase order", "po", "order", "procurement", "vendor", "supplier", "delivery", "shipment", "order number",
        "po number", "delivery date", "terms and conditions", "specifications"), (
        r"purchase\s*order", r"p\.?o\.?\s*(no|number)", r"order\s*(no|number)", r"delivery\s*date", r"procurement"),
        ("invoice", "payment", "receipt")),
    DocType("CREDIT_NOTE", 0.8, (
        "credit note", "credit memo", "return", "refund", "credit", "adjustment", "discount", "allowance"), (
        r"credit\s*(note|memo)", r"return\s*(note|memo)", r"refund", r"credit\s*adjustment"),
        ("invoice", "debit")),
    DocType("DEBIT_NOTE", 0.8, (
        "debit note", "debit memo", "charge", "additional charges", "penalty", "interest", "late fee"), (
        r"debit\s*(note|memo)", r"additional\s*charge", r"penalty", r"late\s*fee"), ("credit", "refund")),
    DocType("QUOTATION", 0.7, (
        "quotation", "quote", "estimate", "proposal", "price list", "rate card", "offer", "proforma", "validity",
        "terms", "specifications"), (
        r"quotation\s*(no|number)", r"quote\s*(no|number)", r"estimate", r"proforma\s*invoice",
        r"price\s*(quote|quotation)"), ("invoice", "payment", "receipt")),
)


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as data: one row per type, kind and entry."""
    rows = [(t.name, t.threshold, kind, entry) for t in DOC_TYPES for kind, entries in (
        ("keyword", t.keywords), ("pattern", t.patterns), ("negative", t.negatives), ("strong", t.strong))
        for entry in entries]
    return spark.createDataFrame(rows, "document_type string, threshold double, kind string, entry string")


def analysis_text(docs: DataFrame) -> Column:
    """File name, form keys and values, table cells, OCR text and summary type, as one lower-case text."""
    fields = F.transform("form_analysis.form_fields", lambda f: F.concat_ws(" ", f["key"], f["value"]))
    cells = F.transform("table_analysis.tables", lambda t: F.concat_ws(" ", F.flatten(t["rows"])))
    return F.lower(F.concat_ws(" ", "file_info.filename", F.concat_ws(" ", fields), F.concat_ws(" ", cells),
                               "ocr_text", "summary.document_type"))


def weight(word: str) -> float:
    return 2.0 if word in HEAVY_WORDS else 1.5 if word in MEDIUM_WORDS else 1.0


def _found(text: Column, pattern: str) -> Column:
    """Pattern search with case and character classes as in Unicode, in text of any case."""
    return text.rlike(f"(?iU){pattern}")


class Spotted:
    """Columns that say which words and patterns a text contains, each tested once.

    They are columns of their own rather than parts of the score expressions, because the
    optimizer keeps a column that is used several times but repeats an expression that is.
    Texts are lower-case here, so patterns are searched in lower case without the flag.
    """

    def __init__(self, df: DataFrame, text: str, kinds=DOC_TYPES):
        words = dict.fromkeys(w for k in kinds for w in (*k.keywords, *k.negatives))
        patterns = dict.fromkeys(p for k in kinds for p in (*k.patterns, *k.strong))
        patterns.update(dict.fromkeys((TAX_ID, COMPANY_FORM, TAX_NAMES)))
        self._words = {w: f"_w{i}" for i, w in enumerate(words)}
        self._patterns = {p: f"_p{i}" for i, p in enumerate(patterns)}
        # As SQL text, here and in the sums: one call to the engine for each column instead of one for each part.
        self.df = df.selectExpr(
            "*", *[f"contains({text}, {_quoted(w)}) AS {c}" for w, c in self._words.items()],
            *[f"{text} RLIKE {_quoted(('(?U)' if BACKSLASH in p else '') + p.lower())} AS {c}" for p, c in self._patterns.items()])

    def word(self, word: str) -> str:
        """Name of the column for a word."""
        return self._words[word]

    def pattern(self, pattern: str) -> str:
        return self._patterns[pattern]


BACKSLASH = "\\"


def _quoted(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace(BACKSLASH, 2 * BACKSLASH).replace("'", BACKSLASH + "'") + "'"


def _sum(tests: list[str], points: list[float]) -> Column:
    """Sum of the points of the tests that hold, added as decimals so that it is exact."""
    kind = "DECIMAL(12,4)"
    return F.expr(" + ".join([f"CAST('0' AS {kind})"] + [f"CASE WHEN {t} THEN CAST('{p}' AS {kind}) ELSE CAST('0' AS {kind}) END"
                                                         for t, p in zip(tests, points)])).cast("double")


def keyword_score(seen: Spotted, kind: DocType) -> Column:
    hits = _sum([seen.word(w) for w in kind.keywords], [weight(w) for w in kind.keywords])
    return F.least(hits / F.lit(len(kind.keywords) * 1.5), F.lit(1.0))


def pattern_score(seen: Spotted, kind: DocType) -> Column:
    return _sum([seen.pattern(p) for p in kind.patterns], [1.0] * len(kind.patterns)) / F.lit(float(len(kind.patterns)))


def strong_count(seen: Spotted, kind: DocType) -> Column:
    return F.expr(" + ".join(["0"] + [f"CAST({seen.pattern(p)} AS INT)" for p in kind.strong]))


def strong_bonus(seen: Spotted, kind: DocType) -> Column:
    return F.least(_sum([seen.pattern(p) for p in kind.strong], [0.15] * len(kind.strong)), F.lit(0.4))


def negative_penalty(seen: Spotted, kind: DocType) -> Column:
    return F.least(_sum([seen.word(w) for w in kind.negatives], [0.1] * len(kind.negatives)), F.lit(0.3))


def final_score(seen: Spotted, kind: DocType) -> Column:
    bonus = strong_bonus(seen, kind)
    base = keyword_score(seen, kind) * 0.5 + pattern_score(seen, kind) * 0.3 + bonus * 0.2
    score = F.greatest(F.lit(0.0), base + bonus - negative_penalty(seen, kind))
    if kind.strong:
        certain = F.expr(" AND ".join(map(seen.pattern, (TAX_ID, COMPANY_FORM, TAX_NAMES))))
        score = F.when(certain, F.greatest(score, F.lit(0.85))).otherwise(score)
    return score


def lowered(df: DataFrame, text: str, key: str, *more: Column) -> DataFrame:
    source = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_raw"), *more)
    return use_all_cores(source, key).withColumn("_text", F.lower("_raw"))


def score_types(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per document with the score of every type as a column."""
    seen = Spotted(lowered(df, text, key), "_text")
    return seen.df.select(key, *[final_score(seen, t).alias(t.name) for t in DOC_TYPES])


def classify(df: DataFrame, text: str, key: str, fields: str | None = None, tables: str | None = None) -> DataFrame:
    """The type of every document: always one of the known types, with a confidence.

    Result: key, document_type, confidence_score, forced, keywords, alternates, reasoning, metadata.
    ``fields`` and ``tables`` name arrays of the document; the metadata say whether they hold anything.
    """
    def filled(name, alias):
        return (F.coalesce(F.size(name) > 0, F.lit(False)) if name else F.lit(False)).alias(alias)
    seen = Spotted(lowered(df, text, key, filled(fields, "_fields"), filled(tables, "_tables")), "_text")
    points = seen.df.select(
        key, "_raw", "_text", "_fields", "_tables", *[F.col(c) for c in seen.df.columns if c.startswith(("_w", "_p"))],
        strong_count(seen, DOC_TYPES[0]).alias("_strong"), *[final_score(seen, t).alias(t.name) for t in DOC_TYPES])
    scored = points.withColumn("_scores", F.array(*[
        F.struct(F.col(t.name).alias("score"), F.lit(-i).alias("rank"), F.lit(t.name).alias("type"))
        for i, t in enumerate(DOC_TYPES)]))
    best = scored.withColumn("_best", F.array_max("_scores"))
    kind = F.col("_best.type")

    def per_type(make):
        return F.coalesce(*[F.when(kind == t.name, make(t)) for t in DOC_TYPES])
    threshold = per_type(lambda t: F.when(F.col("_strong") > 0, min(t.threshold, 0.4)).otherwise(t.threshold)
                         if t.strong else F.lit(t.threshold))
    forced = F.col("_best.score") < threshold
    words = per_type(lambda t: F.expr(
        "array_compact(array(" + ", ".join(f"CASE WHEN {seen.word(w)} THEN {_quoted(w)} END" for w in t.keywords) + "))"))
    against = per_type(lambda t: F.expr(
        "array_compact(array(" + ", ".join(f"CASE WHEN {seen.word(w)} THEN {_quoted(w)} END" for w in t.negatives) + "))"))
    matched = per_type(lambda t: F.expr(" + ".join(f"CAST({seen.pattern(p)} AS INT)" for p in t.patterns)))
    certain = F.expr(" AND ".join(map(seen.pattern, (TAX_ID, COMPANY_FORM, TAX_NAMES)))) & kind.isin(*[t.name for t in DOC_TYPES if t.strong])
    others = F.filter("_scores", lambda s: (s["type"] != kind) & (s["score"] > 0.2))
    ranked = F.slice(F.reverse(F.array_sort(others)), 1, 3)
    decided = best.select(
        key, "_raw", "_text", "_strong", kind.alias("document_type"),
        F.when(forced, F.greatest(F.col("_best.score"), F.lit(0.6))).otherwise(F.col("_best.score"))
        .alias("confidence_score"), F.col("_best.score").alias("raw_score"), forced.alias("forced"),
        words.alias("keywords"), against.alias("_against"), matched.alias("_matched"), certain.alias("_certain"), "_fields", "_tables",
        F.transform(ranked, lambda s: F.struct(s["type"].alias("type"), s["score"].alias("score"))).alias("alternates"))
    return decided.select(
        key, "document_type", "confidence_score", "forced", "keywords", "alternates",
        _reasoning().alias("reasoning"), document_metadata(
            F.col("_raw"), F.col("document_type"), F.col("_fields"), F.col("_tables")).alias("metadata"))


def alternates(classified: DataFrame, key: str) -> DataFrame:
    """One row per other type a document could be, best first."""
    # Outer, then filtered: a plain inline would score every text a second time to test for rows.
    return classified.select(key, F.inline_outer("alternates")).where("type IS NOT NULL")


def _reasoning() -> Column:
    """What spoke for the type: sure signs, words, strong signs, patterns, words that speak against it, confidence."""
    key_words = F.filter("keywords", lambda w: w.isin(*KEY_TERMS))
    score = F.col("raw_score")
    band = (F.when(score > 0.8, "Very high").when(score > 0.65, "High").when(score > 0.5, "Moderate").otherwise("Low"))
    return F.array_compact(F.array(
        F.when(F.col("forced"), F.concat(F.lit("Closest type, score below the threshold of "), F.col("document_type"))),
        F.when(F.col("_certain"), F.lit("Tax id, company form and tax names together")),
        F.when(F.size(key_words) > 0, F.concat(F.lit("Key business terms: "), F.array_join(F.slice(key_words, 1, 5), ", ")))
        .when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.array_join(F.slice("keywords", 1, 5), ", "))),
        F.when((F.col("_strong") > 0) & (F.col("document_type") == "B2B_INVOICE"),
               F.format_string("Strong indicators: %d", F.col("_strong"))),
        F.when(F.col("_matched") > 0, F.format_string("Structure patterns: %d", F.col("_matched"))),
        F.when(F.size("_against") > 0, F.concat(F.lit("Conflicting terms: "), F.array_join("_against", ", "))),
        F.concat(band, F.lit(" confidence"))))


def document_metadata(text: Column, kind: Column, has_fields: Column, has_tables: Column) -> Column:
    """What the document shows, as far as it matters for the type; other parts are NULL."""
    text = F.coalesce(text, F.lit(""))
    invoice, proof, slip = kind == "B2B_INVOICE", kind == "PAYMENT_PROOF", kind == "EXPENSE_SLIP"
    return F.struct(
        F.length(text).alias("text_length"), has_fields.alias("has_form_fields"), has_tables.alias("has_tables"),
        fn.detect_language(text).alias("language"),
        F.when(invoice, text.rlike(TAX_ID)).alias("has_gstin"),
        F.when(invoice, _found(text, TAX_NAMES)).alias("has_tax_details"),
        F.when(invoice, _found(text, r"invoice\s*(no|number)")).alias("has_invoice_number"),
        F.when(proof, _found(text, "(transaction|utr|reference).*id")).alias("has_transaction_id"),
        F.when(proof, _found(text, r"(rs|₹|inr).*\d")).when(slip, _found(text, r"(rs|₹|inr|total).*\d"))
        .alias("has_amount"),
        F.when(proof, fn.detect_payment_method(text)).alias("payment_method"),
        F.when(slip, fn.detect_expense_category(text)).alias("expense_category"))


def classification_accuracy(predicted: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Share of right types and of confident enough ones. Labels: key, expected_type, expected_confidence_min."""
    joined = predicted.join(labels, key)
    right = F.col("document_type") == F.col("expected_type")
    sure = F.col("confidence_score") * 100 >= F.col("expected_confidence_min")
    return joined.agg(F.count("*").alias("documents"),
                      fn.percent(F.count_if(right), F.count("*"), 2).alias("type_accuracy"),
                      fn.percent(F.count_if(sure), F.count("*"), 2).alias("confidence_ok"),
                      fn.percent(F.count_if(right & sure), F.count("*"), 2).alias("overall"))
