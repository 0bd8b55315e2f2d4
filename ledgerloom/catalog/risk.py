"""Queries of registry matching, risk rules and batch figures."""

from pyspark.sql import functions as F

from ledgerloom import bridge
from ledgerloom.bridge import oracle
from ledgerloom.catalog.duplicates import _FOUND as FOUND
from ledgerloom.catalog.registry import add
from ledgerloom.catalog.validation import VERDICT_CTES
from ledgerloom.operators import batch as ba
from ledgerloom.operators import duplicates as du
from ledgerloom.operators import registry as rg
from ledgerloom.operators import risk as rk
from ledgerloom.operators import validation as v
from ledgerloom.plans.returns import returns_summary
from ledgerloom.session import cut_lineage

LAST = "1::DOUBLE"


def similarity_sql(a, b):
    """0.7 word overlap plus 0.3 letter overlap of two lower-case names."""
    def overlap(x, y):
        return (f"(CAST(len(list_intersect({x}, {y})) AS DOUBLE) / "
                f"len(list_distinct(list_concat({x}, {y}))))")
    words = [f"list_distinct(list_filter(regexp_split_to_array(trim({s}), '\\s+'), lambda w: w <> ''))" for s in (a, b)]
    chars = [f"list_distinct(list_filter(string_split(replace({s}, ' ', ''), ''), lambda w: w <> ''))" for s in (a, b)]
    return (f"(CASE WHEN coalesce(trim({a}), '') = '' OR coalesce(trim({b}), '') = '' THEN 0::DOUBLE ELSE "
            f"{overlap(*words)} * 0.7::DOUBLE + {overlap(*chars)} * 0.3::DOUBLE END)")


_BEST = f"greatest({similarity_sql('lower(c.legal_name)', 'lower(g.legal_name)')}, {similarity_sql('lower(c.legal_name)', 'lower(g.trade_name)')})"
CHECKED = f"""checked AS (SELECT company_id, c.gstin, c.legal_name, g.legal_name AS registry_name, g.status AS registry_status,
  g.gstin IS NOT NULL AS is_valid, CASE WHEN g.gstin IS NOT NULL THEN {_BEST} END AS name_match_score
  FROM companies c LEFT JOIN gst_companies g ON c.gstin = g.gstin WHERE c.gstin IS NOT NULL)"""


def _sides(s, d):
    k = bridge.lake(s, d)
    return k.companies, k.registry


add("reg01_validate_gstin", lambda s, d: rg.validate_companies(*_sides(s, d)), oracle(
    "SELECT *, coalesce(name_match_score < 0.5, FALSE) AS name_mismatch FROM checked", CHECKED))
_ASK = "Supplier#000000025 Private"
add("reg02_search_by_name", lambda s, d: rg.search_by_name(_sides(s, d)[1], _ASK, 0.5).select(
    "gstin", "legal_name", "similarity_score"), oracle(
    f"""SELECT gstin, legal_name, similarity_score FROM (SELECT *, greatest(
    {similarity_sql(f"lower('{_ASK}')", 'lower(legal_name)')}, {similarity_sql(f"lower('{_ASK}')", 'lower(trade_name)')})
    AS similarity_score FROM gst_companies) x WHERE similarity_score >= 0.5"""))


def _names(s, d):
    k = bridge.lake(s, d)
    right = k.registry.select(F.col("legal_name").alias("name")).unionByName(
        k.registry.select(F.col("trade_name").alias("name")))
    return rg.similar_names(k.companies.select(F.col("legal_name").alias("name")), right, 0.6)


_PAIRS = f"""SELECT left_name, right_name, {similarity_sql('left_name', 'right_name')} AS similarity_score
  FROM (SELECT DISTINCT lower(legal_name) AS left_name FROM companies) a,
  (SELECT DISTINCT lower(legal_name) AS right_name FROM gst_companies UNION SELECT lower(trade_name) FROM gst_companies) b"""
add("jn12_fuzzy_name_join", _names, oracle(f"SELECT * FROM ({_PAIRS}) x WHERE similarity_score >= 0.6"))


def _recommended(s, d):
    k = bridge.lake(s, d)
    return rg.recommendations(k.companies, k.registry)


add("reg03_recommendations", _recommended, oracle(
    f"""SELECT company_id, CASE WHEN rejected THEN 'reject' WHEN name_match_score < 0.5 THEN 'review' ELSE 'proceed' END AS action,
    CASE WHEN rejected THEN 0::DOUBLE ELSE CASE WHEN name_match_score < 0.5 THEN name_match_score ELSE 1::DOUBLE END *
      CASE WHEN lower(registry_status) <> 'active' THEN 0.8::DOUBLE ELSE 1::DOUBLE END END AS confidence,
    concat_ws('; ', CASE WHEN rejected THEN 'unknown tax id' END, CASE WHEN name_match_score < 0.5 THEN 'name mismatch' END,
      CASE WHEN lower(registry_status) <> 'active' THEN 'registration not active' END) AS warnings,
    CASE WHEN NOT rejected THEN similar_gstins END AS similar_gstins
    FROM (SELECT c.company_id, c.gstin IS NOT NULL AND NOT k.is_valid AS rejected, name_match_score, registry_status,
      similar_gstins FROM companies c LEFT JOIN checked k ON c.company_id = k.company_id
      LEFT JOIN (SELECT company_id, string_agg(gstin, ', ' ORDER BY score DESC, gstin) AS similar_gstins FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, gstin) AS rn FROM (
          SELECT company_id, g.gstin, {_BEST} AS score FROM companies c, gst_companies g) p
        WHERE score >= 0.6) q WHERE rn <= 2 GROUP BY 1) s ON c.company_id = s.company_id) r""", CHECKED))


def _asked(s, d):
    chat = bridge.messages(s, d).withColumn("content", F.expr(
        "concat('please verify ', CASE WHEN message_id % 3 = 0 THEN '16aaaaa0002a1z5 ' ELSE '' END, content)"))
    found = chat.select("message_id", rg.gstin_in_text(F.col("content")).alias("gstin")).where("gstin IS NOT NULL")
    return found.join(rg.validate_companies(*_sides(s, d)).select("gstin", "is_valid"), "gstin", "left")


add("reg05_gstin_in_text", _asked, oracle(
    r"""SELECT message_id, f.gstin, is_valid FROM (SELECT message_id, upper(list_filter(regexp_split_to_array(
      'please verify ' || CASE WHEN message_id % 3 = 0 THEN '16aaaaa0002a1z5 ' ELSE '' END || content, '\s+'),
      lambda w: length(w) = 15 AND regexp_matches(w, '^[\p{L}\p{N}]+$'))[1]) AS gstin FROM messages) f
    LEFT JOIN checked c ON f.gstin = c.gstin WHERE f.gstin IS NOT NULL""", CHECKED))

# Risk ---------------------------------------------------------------------------------
EXACT = """exact AS (SELECT invoice_id, count(*) OVER (PARTITION BY supplier_company_id, invoice_num) > 1 AS is_duplicate FROM invoices)"""


def _results(s, d):
    k = bridge.lake(s, d)
    crowded = k.invoices.groupBy(F.col("supplier_company_id").alias("s"), F.col("invoice_num").alias("n")).agg((F.count("*") > 1).alias("is_duplicate"))
    heads = k.invoices.select("invoice_id", "invoice_num", "supplier_company_id", "total_value").join(
        crowded, F.col("supplier_company_id").eqNullSafe(F.col("s")) & F.col("invoice_num").eqNullSafe(F.col("n"))).select("invoice_id", "total_value", "is_duplicate")
    found = v.verdicts(k.invoices, k.items).join(heads, "invoice_id")
    return found.withColumn("duplicate_confidence", F.when(F.col("is_duplicate"), 0.95).otherwise(0.0))


RESULTS = """results AS (SELECT v.*, is_duplicate, CASE WHEN is_duplicate THEN 0.95::DOUBLE ELSE 0::DOUBLE END AS duplicate_confidence,
  total_value FROM verdicts v JOIN exact e ON v.invoice_id = e.invoice_id JOIN invoices i ON v.invoice_id = i.invoice_id)"""
RISK_CTES = (*VERDICT_CTES, EXACT, RESULTS)


def _assessed(*columns):
    return lambda s, d: rk.assess(_results(s, d)).select("invoice_id", *columns)


add("rsk02_reasoning_confidence", _assessed("reasoning_confidence"), oracle(
    """SELECT invoice_id, greatest(0.1::DOUBLE, least(1::DOUBLE, (CASE WHEN NOT overall_passed THEN
    1 - CAST(tests_failed AS DOUBLE) / CAST(tests_run AS DOUBLE) * 0.3::DOUBLE ELSE 1::DOUBLE END) *
    (CASE WHEN is_duplicate THEN 1 - duplicate_confidence * 0.5::DOUBLE ELSE 1::DOUBLE END))) AS reasoning_confidence FROM results""",
    *RISK_CTES))
add("rsk03_business_impact", _assessed("business_impact"), oracle(
    """SELECT invoice_id, concat_ws('. ',
    CASE WHEN NOT overall_passed THEN 'Financial accuracy concerns due to validation failures' END,
    CASE WHEN NOT overall_passed AND total_value > 100000 THEN 'High-value transaction requires careful review' END,
    CASE WHEN is_duplicate THEN 'Potential duplicate payment risk' END,
    CASE WHEN is_duplicate THEN 'Process efficiency impact due to duplicate detection' END,
    CASE WHEN overall_passed AND NOT is_duplicate THEN 'Low risk transaction - standard processing recommended' END,
    CASE WHEN overall_passed AND NOT is_duplicate THEN 'Good data quality and no duplicate concerns' END) || '.'
    AS business_impact FROM results""", *RISK_CTES))
_LISTS = {n: "[" + ", ".join(f"'{a}'" for a in texts) + "]" for n, texts in rk.ADVICE.items()}
add("rsk04_recommendations", lambda s, d: rk.assess(_results(s, d)).select(
    "invoice_id", F.array_join("recommendations", "; ").alias("recommendations")), oracle(
    f"""SELECT invoice_id, array_to_string(list_concat(list_concat(CASE WHEN NOT overall_passed THEN {_LISTS['failed']} ELSE [] END,
    CASE WHEN is_duplicate THEN {_LISTS['duplicate']} ELSE [] END),
    CASE WHEN overall_passed AND NOT is_duplicate THEN {_LISTS['clean']} ELSE [] END)[1:5], '; ') AS recommendations FROM results""",
    *RISK_CTES))
add("rsk05_reason_texts", _assessed("validation_reason", "duplication_reason"), oracle(
    """SELECT invoice_id, CASE WHEN tests_failed = 0 THEN
    'All arithmetic validations passed successfully, indicating mathematical consistency.' ELSE
    CAST(tests_failed AS VARCHAR) || ' out of ' || CAST(tests_run AS VARCHAR) ||
    ' validation tests failed, indicating potential calculation errors or data extraction issues.' END AS validation_reason,
    CASE WHEN is_duplicate THEN 'Potential duplicate detected with 95.0% confidence based on pattern matching.'
    ELSE 'No significant duplicate patterns detected across comparison criteria.' END AS duplication_reason FROM results""",
    *RISK_CTES))
add("rsk06_approval_status", _assessed("approval_status"), oracle(
    """SELECT invoice_id, CASE WHEN overall_passed AND NOT is_duplicate THEN 'APPROVED' ELSE 'REQUIRES REVIEW' END
    AS approval_status FROM results""", *RISK_CTES))



def _scored_results(s, d):
    """Validation verdicts with the scored duplicate verdict, which is written once."""
    k = bridge.lake(s, d, describe=True)
    scored = cut_lineage(du.duplicate_verdicts(k.invoices, du.duplicate_matches(k.invoices, k.items)))
    return v.verdicts(k.invoices, k.items).join(k.invoices.select("invoice_id", "total_value"), "invoice_id").join(
        scored.select("invoice_id", "is_duplicate", F.col("confidence").alias("duplicate_confidence")), "invoice_id")


SCORED_RESULTS = """results AS (SELECT v.*, coalesce(b.confidence > 0.7, FALSE) AS is_duplicate, coalesce(b.confidence, 0::DOUBLE) AS duplicate_confidence,
  total_value FROM verdicts v JOIN invoices i ON v.invoice_id = i.invoice_id LEFT JOIN best b ON v.invoice_id = b.invoice_id)"""
add("rsk08_scored_assessment", lambda s, d: rk.assess(_scored_results(s, d)).select(
    "invoice_id", "is_duplicate", F.round("reasoning_confidence", 6).alias("reasoning_confidence"), "business_impact",
    F.array_join("recommendations", "; ").alias("recommendations"), "validation_reason", "duplication_reason", "approval_status"), oracle(
    f"""SELECT invoice_id, is_duplicate, round(greatest(0.1::DOUBLE, least(1::DOUBLE, (CASE WHEN NOT overall_passed THEN
    1 - CAST(tests_failed AS DOUBLE) / CAST(tests_run AS DOUBLE) * 0.3::DOUBLE ELSE 1::DOUBLE END) *
    (CASE WHEN is_duplicate THEN 1 - duplicate_confidence * 0.5::DOUBLE ELSE 1::DOUBLE END))), 6) AS reasoning_confidence,
    concat_ws('. ',
    CASE WHEN NOT overall_passed THEN 'Financial accuracy concerns due to validation failures' END,
    CASE WHEN NOT overall_passed AND total_value > 100000 THEN 'High-value transaction requires careful review' END,
    CASE WHEN is_duplicate THEN 'Potential duplicate payment risk' END,
    CASE WHEN is_duplicate THEN 'Process efficiency impact due to duplicate detection' END,
    CASE WHEN overall_passed AND NOT is_duplicate THEN 'Low risk transaction - standard processing recommended' END,
    CASE WHEN overall_passed AND NOT is_duplicate THEN 'Good data quality and no duplicate concerns' END) || '.' AS business_impact,
    array_to_string(list_concat(list_concat(CASE WHEN NOT overall_passed THEN {_LISTS['failed']} ELSE [] END,
    CASE WHEN is_duplicate THEN {_LISTS['duplicate']} ELSE [] END),
    CASE WHEN overall_passed AND NOT is_duplicate THEN {_LISTS['clean']} ELSE [] END)[1:5], '; ') AS recommendations,
    CASE WHEN tests_failed = 0 THEN 'All arithmetic validations passed successfully, indicating mathematical consistency.' ELSE
    CAST(tests_failed AS VARCHAR) || ' out of ' || CAST(tests_run AS VARCHAR) ||
    ' validation tests failed, indicating potential calculation errors or data extraction issues.' END AS validation_reason,
    CASE WHEN is_duplicate THEN printf('Potential duplicate detected with %.1f%% confidence based on pattern matching.', duplicate_confidence * 100)
    ELSE 'No significant duplicate patterns detected across comparison criteria.' END AS duplication_reason,
    CASE WHEN overall_passed AND NOT is_duplicate THEN 'APPROVED' ELSE 'REQUIRES REVIEW' END AS approval_status FROM results""",
    *VERDICT_CTES, *FOUND, SCORED_RESULTS))

# Batches ------------------------------------------------------------------------------


def _batch(s, d):
    k = bridge.lake(s, d)
    names = k.companies.select(F.col("company_id").alias("supplier_company_id"), F.col("legal_name").alias("supplier_name"))
    types = ", ".join(f"'{t}'" for t in bridge.DOC_TYPES)
    return k.invoices.join(names, "supplier_company_id", "left").selectExpr(
        "cast(invoice_id AS string) AS doc_id", "invoice_id % 23 <> 0 AS success",
        "cast(0.5 + cast(invoice_id % 50 AS decimal(4,0)) * 0.1 AS decimal(8,2)) AS processing_time", "supplier_name",
        f"element_at(array({types}), cast(invoice_id % 7 AS int) + 1) AS document_type", "total_value AS total_amount",
        "total_tax", "validation AS validation_passed", "duplication AS is_duplicate",
        "CASE WHEN invoice_id % 46 = 0 THEN 'timeout' WHEN invoice_id % 23 = 0 THEN NULL END AS error")


BATCH = f"""batch AS (SELECT CAST(invoice_id AS VARCHAR) AS doc_id, invoice_id % 23 <> 0 AS success,
  CAST(0.5 + CAST(invoice_id % 50 AS DECIMAL(4,0)) * 0.1 AS DECIMAL(8,2)) AS processing_time, legal_name AS supplier_name,
  [{', '.join(f"'{t}'" for t in bridge.DOC_TYPES)}][CAST(invoice_id % 7 AS INTEGER) + 1] AS document_type,
  total_value AS total_amount, total_tax, validation AS validation_passed, duplication AS is_duplicate,
  CASE WHEN invoice_id % 46 = 0 THEN 'timeout' END AS error
  FROM invoices LEFT JOIN companies ON supplier_company_id = company_id)"""


def _c(condition):
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


SUMMARY = f"""summary AS (SELECT count(*) AS total_documents, {_c("success")} AS successful, {_c("NOT success")} AS failed,
  CAST(sum(processing_time) AS DOUBLE) AS total_time, CAST(sum(processing_time) AS DOUBLE) / count(*) AS average_time,
  CAST(sum(CASE WHEN success THEN total_amount END) AS DOUBLE) AS total_amount,
  CAST(sum(CASE WHEN success THEN total_tax END) AS DOUBLE) AS total_tax,
  count(DISTINCT CASE WHEN success THEN supplier_name END) AS unique_suppliers,
  {_c("validation_passed")} AS validation_passed, {_c("NOT validation_passed")} AS validation_failed,
  {_c("is_duplicate")} AS duplicates, {_c("NOT is_duplicate")} AS unique_documents FROM batch)"""
_TYPE_COUNTS = ", ".join(
    f"(SELECT count(*) FROM batch WHERE success AND document_type = '{t}') AS {t}" for t in bridge.DOC_TYPES)


def _summary(s, d):
    found = ba.batch_summary(_batch(s, d))
    return found.select("*", *[F.col("document_types")[t].alias(t) for t in bridge.DOC_TYPES]).drop("document_types")


add("bat01_batch_summary", _summary, oracle(f"SELECT *, {_TYPE_COUNTS} FROM summary", BATCH, SUMMARY))
add("bat02_top_suppliers", lambda s, d: ba.top_suppliers(_batch(s, d)), oracle(
    """SELECT supplier_name, CAST(sum(total_amount) AS DOUBLE) AS amount, count(*) AS invoice_count FROM batch
    WHERE success AND supplier_name IS NOT NULL GROUP BY 1 ORDER BY amount DESC, 1 LIMIT 10""", BATCH))
add("bat03_batch_insights", lambda s, d: ba.batch_insights(ba.batch_summary(_batch(s, d))), oracle(
    """SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position, insight FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k, unnest([
    CASE WHEN successful > 0 THEN printf('Processed %d of %d documents (%.1f%%)', successful, total_documents, successful * 100.0 / total_documents) END,
    CASE WHEN successful > 0 THEN 'Total invoice value: ₹' || format('{:,.2f}', CAST(total_amount AS DOUBLE)) END,
    CASE WHEN successful > 0 THEN printf('Average processing time: %.2fs per document', CAST(average_time AS DOUBLE)) END,
    CASE WHEN successful > 0 AND validation_passed > 0 THEN printf('Validation success rate: %.1f%%', validation_passed * 100.0 / (validation_passed + validation_failed)) END,
    CASE WHEN successful > 0 AND duplicates > 0 THEN printf('%d potential duplicates detected', duplicates) END,
    CASE WHEN successful > 0 AND unique_suppliers > 0 THEN printf('Invoices from %d suppliers', unique_suppliers) END]) AS insight FROM summary) x
    WHERE insight IS NOT NULL""", BATCH, SUMMARY))
add("bat04_failed_documents", lambda s, d: ba.failed_documents(_batch(s, d)), oracle(
    "SELECT doc_id, coalesce(error, 'Unknown error') AS error FROM batch WHERE NOT success", BATCH))
_P = "CAST(round(CAST(100.0 * {} / ({}) AS DECIMAL(20,8)), 1) AS DOUBLE)".format
add("bat05_batch_rates", lambda s, d: ba.batch_rates(ba.batch_summary(_batch(s, d))), oracle(
    f"""SELECT 60::DOUBLE / average_time AS documents_per_minute, total_amount / CAST(successful AS DOUBLE) AS mean_invoice_value,
    {_P('validation_passed', 'validation_passed + validation_failed')} AS validation_rate,
    {_P('duplicates', 'duplicates + unique_documents')} AS duplicate_rate FROM summary""", BATCH, SUMMARY))


def _returns(s, d):
    """Filings from the event table: one per event, the user as the taxpayer."""
    types = "CASE event_type WHEN 'click' THEN 'GSTR-1' WHEN 'view' THEN 'GSTR-3B' ELSE 'GSTR-9' END"
    return bridge.raw(s, d, "events").selectExpr(
        "cast(user_id AS string) AS gstin", f"{types} AS return_type", "date_format(ts, 'MMM yyyy') AS period",
        "CASE WHEN event_id % 31 = 0 THEN '' ELSE date_format(ts, 'dd-MMM-yyyy') END AS filed_date")


def _returns_summary(s, d, by_date=False):
    found = returns_summary(_returns(s, d), by_date)
    return found.select(
        "gstin", "total_filings", *[F.col("return_types")[t].alias(t.replace("-", "_")) for t in ("GSTR-1", "GSTR-3B", "GSTR-9")],
        F.col("filing_frequency")["2024"].alias("year_2024"), F.col("latest_filing.date_str").alias("latest"),
        F.col("latest_filing.return_type").alias("latest_type"), F.col("oldest_filing.date_str").alias("oldest"))


def _returns_sql(order):
    return oracle(f"""SELECT gstin, count(*) AS total_filings, nullif({_c("return_type = 'GSTR-1'")}, 0) AS GSTR_1,
    nullif({_c("return_type = 'GSTR-3B'")}, 0) AS GSTR_3B, nullif({_c("return_type = 'GSTR-9'")}, 0) AS GSTR_9,
    nullif({_c("filed_date LIKE '%2024%'")}, 0) AS year_2024,
    arg_max(filed_date, {order}) FILTER (filed_date <> '') AS latest,
    arg_max(return_type, {order}) FILTER (filed_date <> '') AS latest_type,
    arg_min(filed_date, {order}) FILTER (filed_date <> '') AS oldest FROM filings GROUP BY 1""",
                  """filings AS (SELECT CAST(user_id AS VARCHAR) AS gstin, CASE event_type WHEN 'click' THEN 'GSTR-1'
    WHEN 'view' THEN 'GSTR-3B' ELSE 'GSTR-9' END AS return_type, strftime(ts, '%b %Y') AS period, CAST(ts AS DATE) AS day,
    CASE WHEN event_id % 31 = 0 THEN '' ELSE strftime(ts, '%d-%b-%Y') END AS filed_date FROM events)""")


add("agg27_returns_summary", _returns_summary, _returns_sql("(filed_date, return_type, period)"))
add("agg27_returns_summary_by_date", lambda s, d: _returns_summary(s, d, True), _returns_sql("(day, filed_date, return_type, period)"))
