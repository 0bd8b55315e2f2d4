"""Chat messages: what a question asks for, and figures about sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.lake import Lake
from ledgerloom.plans import analysis, dashboard, search

# Words that point to a subject (first group that matches wins).
SUBJECTS = (
    ("invoice", ("invoice", "bill", "receipt")),
    ("company", ("company", "supplier", "buyer", "gstin", "gst")),
    ("product", ("product", "hsn", "item")),
    ("financial", ("analysis", "report", "summary", "total", "trend")),
    ("validation", ("validate", "check", "verify")),
    ("payment", ("payment", "paid", "due", "outstanding")),
)
SIMPLE_FINANCIAL = ("total", "sum", "amount", "analysis", "report")
SIMPLE_NAMES = {"invoice": "invoice_query", "company": "company_query", "product": "product_query",
                "financial": "financial_analysis", "validation": "validation_query", "payment": "payment_query"}
# Words that make a question complex; each group counts once.
PATTERN_GROUPS = {
    "multi_table_analysis": ("join", "across", "between", "correlation", "relationship"),
    "time_series_analysis": ("trend", "over time", "monthly", "quarterly", "year-over-year", "temporal", "seasonal"),
    "statistical_analysis": ("average", "mean", "median", "percentile", "variance", "standard deviation", "distribution"),
    "comparative_analysis": ("compare", "versus", "vs", "difference", "ratio", "proportion", "benchmark"),
    "aggregation_analysis": ("sum", "total", "count", "group by", "aggregate", "breakdown", "segment"),
    "pattern_detection": ("pattern", "anomaly", "outlier", "unusual", "irregular", "exception"),
    "advanced_filtering": ("where", "filter", "condition", "criteria", "having", "such that"),
    "performance_analysis": ("efficiency", "performance", "optimization", "speed", "throughput"),
    "compliance_analysis": ("compliance", "regulation", "rule", "policy", "standard", "requirement"),
    "forecasting_analysis": ("predict", "forecast", "project", "estimate", "future", "scenario"),
}
# Subject: [(more groups than this, intent), ...] tried in order, then the plain intent.
COMPLEX = {
    "invoice": ([(2, "complex_invoice_analysis")], "invoice_search"),
    "company": ([(1, "complex_company_analysis")], "company_lookup"),
    "product": ([(1, "complex_product_analysis")], "product_search"),
    "financial": ([(3, "advanced_financial_analysis"), (1, "complex_financial_analysis")], "financial_analysis"),
    "validation": ([(1, "complex_validation")], "validation"),
    "payment": ([(1, "complex_payment_analysis")], "payment_tracking"),
}
PHRASES = {
    "invoice_search": ("find invoices", "search invoices", "show me invoices", "list invoices", "invoices from",
                       "invoices by", "invoices between", "invoices above", "invoices below", "pending invoices",
                       "paid invoices"),
    "company_lookup": ("company details", "company information", "find company", "lookup company", "GST details",
                       "supplier info", "buyer info", "company profile"),
    "financial_analysis": ("total amount", "sum of", "average", "analysis", "report", "summary", "trends", "monthly",
                           "quarterly", "tax analysis", "compliance report"),
    "gst_validation": ("validate GST", "check GST", "verify GST", "GST status", "taxpayer details", "is GST valid",
                       "GST information"),
    "invoice_validation": ("validate invoice", "check invoice", "invoice errors", "arithmetic check",
                           "tax calculation", "duplicate invoice"),
}
HEDGES = ("for example", "typically", "approximately", "estimated", "sample", "mock", "placeholder")
FINANCIAL_TERMS = ("₹", "INR", "amount", "tax", "total", "rate", "%")


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def simple_intent(text: Column) -> Column:
    low = F.lower(text)
    tests = [F.when(_any(low, SIMPLE_FINANCIAL if s == "financial" else words), F.lit(SIMPLE_NAMES[s]))
             for s, words in SUBJECTS]
    return F.coalesce(*tests, F.lit("general_query"))


def complexity(text: Column) -> Column:
    low = F.lower(text)
    return sum((_any(low, words).cast("int") for words in PATTERN_GROUPS.values()), F.lit(0))


def detected_patterns(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(n)) for n, words in PATTERN_GROUPS.items()]))


def intent(text: Column) -> Column:
    """The subject of a question, refined by how many pattern groups it touches."""
    low, score = F.lower(text), complexity(text)
    tests = []
    for subject, words in SUBJECTS:
        steps, plain = COMPLEX[subject]
        refined = reduce(lambda rest, step: F.when(score > step[0], F.lit(step[1])).otherwise(rest),
                         reversed(steps), F.lit(plain))
        tests.append(F.when(_any(low, words), refined))
    return F.coalesce(*tests, F.when(score > 2, F.lit("advanced_database_query")), F.lit("general_query"))


def phrase_intents(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(_any(low, [p.lower() for p in phrases]), F.lit(name)) for name, phrases in PHRASES.items()]))


def route(lake: Lake, name: str, patterns: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The reports that answer an intent, by report name. Nothing runs until one is collected."""
    by_pattern = {
        "time_series_analysis": ("time_series", analysis.period_statistics),
        "statistical_analysis": ("statistics", analysis.value_statistics),
        "comparative_analysis": ("supplier_comparison", analysis.supplier_comparison),
    }
    by_finance = {"aggregation_analysis": ("quarterly_breakdown", analysis.quarterly_breakdown),
                  "pattern_detection": ("anomaly_detection", analysis.anomaly_flags)}
    advanced = [("growth", analysis.growth), ("supplier_performance", analysis.supplier_performance)]
    plain = {
        "invoice": [("invoices", search.latest_invoices)], "company": [("companies", search.companies_by_name)],
        "product": [("products", search.products_by_name)], "payment": [("payments", search.latest_payments)],
        "validation": [("flags", dashboard.flag_counts)], "general": [("counts", dashboard.general_counts)],
        "financial": [("totals", dashboard.financial_totals), ("months", dashboard.monthly_totals),
                      ("suppliers", dashboard.top_suppliers)],
    }
    if name == "complex_invoice_analysis":
        chosen = [by_pattern[p] for p in patterns if p in by_pattern]
    elif name == "advanced_financial_analysis":
        chosen = advanced
    elif name == "advanced_database_query":
        chosen = [("overview", analysis.database_overview), ("cross_table", analysis.cross_table_analysis)]
    elif name.startswith("complex_"):
        chosen = [by_finance[p] for p in patterns if p in by_finance]
    else:
        subject = next((s for s in plain if name.startswith(s)), "general")
        chosen = plain[subject]
    return {report: run(lake) for report, run in chosen}


def session_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        (F.sum("confidence_score").cast("double") / F.count("confidence_score")).alias("avg_confidence"))


def last_queries(messages: DataFrame, n: int = 5) -> DataFrame:
    """The latest user messages of every session; the limit applies before the shuffle too."""
    latest = W.partitionBy("session_id").orderBy(F.desc("sent_at"), F.desc("message_id"))
    asked = messages.where("message_type = 'user'")
    return asked.withColumn("position", F.row_number().over(latest)).where(F.col("position") <= n)


def recent_focus(messages: DataFrame, now: Column, n: int = 3) -> DataFrame:
    """The most frequent intents of every session within the last hour."""
    recent = messages.where((F.col("sent_at") >= now - F.expr("INTERVAL 1 HOUR")) & (F.col("sent_at") <= now))
    counted = recent.groupBy("session_id", intent(F.col("content")).alias("query_type")).agg(F.count("*").alias("asked"))
    order = W.partitionBy("session_id").orderBy(F.desc("asked"), "query_type")
    return counted.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def pattern_frequency(messages: DataFrame) -> DataFrame:
    """Per intent: how often, and the confidence of the latest message."""
    kind = intent(F.col("content")).alias("query_type")
    return messages.groupBy(kind).agg(
        F.count("*").alias("frequency"),
        F.max_by("confidence_score", F.struct("sent_at", "message_id")).alias("last_confidence"))


def answer_risk(text: Column, confidence: Column) -> Column:
    """(unsafe, needs_verification): hedged wording next to a financial term, or low confidence."""
    unsafe = _any(F.lower(text), HEDGES) & _any(text, FINANCIAL_TERMS)
    return F.struct(unsafe.alias("unsafe"), (unsafe | (confidence < 0.7)).alias("needs_verification"))
