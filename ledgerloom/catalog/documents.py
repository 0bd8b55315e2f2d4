"""Queries of classification and of chat messages."""

from pyspark.sql import functions as F

from ledgerloom import bridge
from ledgerloom.bridge import AS_OF, oracle
from ledgerloom.catalog.registry import add
from ledgerloom.operators import classify as c
from ledgerloom.operators import messages as m

# Every document gets one of these lines after its own text, so that all types occur.
LINES = (
    "TAX INVOICE No 77 dated 20-Aug-25 GSTIN: 24AAXFA5297L1ZN Alpha Pvt Ltd taxable value 100 CGST: 9% SGST: 9% HSN code 84",
    "Taxi receipt travel expense reimbursement food lunch hotel bill",
    "Payment successful UPI transaction id 991 credited to account of bank",
    "Purchase order number 5 vendor delivery date procurement",
    "Credit note refund adjustment return memo discount allowance debit memo penalty late fee additional charges interest",
    "Debit note penalty late fee additional charge",
    "Quotation no 8 estimate proforma invoice price quote offer")
_SPARK_LINES = "array(" + ", ".join(f"'{x}'" for x in LINES) + ")"
_SQL_LINES = "[" + ", ".join(f"'{x}'" for x in LINES) + "]"


def _texts(spark, d):
    return bridge.raw(spark, d, "documents").selectExpr(
        "doc_id", f"concat(text, ' ', element_at({_SPARK_LINES}, cast(doc_id % 7 AS int) + 1)) AS body")


TEXTS = f"texts AS (SELECT doc_id, text || ' ' || {_SQL_LINES}[CAST(doc_id % 7 AS INTEGER) + 1] AS body FROM documents)"
LOW = "low AS (SELECT doc_id, body, lower(body) AS t FROM texts)"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _re(pattern, column="t"):
    return f"regexp_matches({column}, {_quoted(pattern)}, 'i')"


def _points(tests, points):
    return "CAST(" + " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for t, p in zip(tests, points)) + " AS DOUBLE)"


def _has(words):
    return [f"contains(t, {_quoted(w)})" for w in words]


def kw_sql(k):
    return f"least({_points(_has(k.keywords), [c.weight(w) for w in k.keywords])} / CAST({len(k.keywords) * 1.5} AS DOUBLE), 1::DOUBLE)"


def pat_sql(k):
    return f"({_points([_re(p) for p in k.patterns], [1] * len(k.patterns))} / CAST({len(k.patterns)} AS DOUBLE))"


def bonus_sql(k):
    if not k.strong:
        return "0::DOUBLE"
    return f"least({_points([_re(p) for p in k.strong], [0.15] * len(k.strong))}, 0.4::DOUBLE)"


def neg_sql(k):
    return f"least({_points(_has(k.negatives), [0.1] * len(k.negatives))}, 0.3::DOUBLE)"


def score_sql(k):
    score = (f"greatest(0::DOUBLE, kw_{k.name} * 0.5::DOUBLE + pat_{k.name} * 0.3::DOUBLE + bonus_{k.name} * 0.2::DOUBLE "
             f"+ bonus_{k.name} - neg_{k.name})")
    if k.strong:
        sure = f"{_re(c.TAX_ID)} AND {_re(c.COMPANY_FORM)} AND {_re(c.TAX_NAMES)}"
        score = f"CASE WHEN {sure} THEN greatest({score}, 0.85::DOUBLE) ELSE {score} END"
    return f"{score} AS {k.name}"


PARTS = "parts AS (SELECT *, " + ", ".join(
    f"{f(k)} AS {n}_{k.name}" for k in c.DOC_TYPES
    for n, f in (("kw", kw_sql), ("pat", pat_sql), ("bonus", bonus_sql), ("neg", neg_sql))) + " FROM low)"
SCORES = "scores AS (SELECT doc_id, body, t, " + ", ".join(score_sql(k) for k in c.DOC_TYPES) + " FROM parts)"
_NAMES = [k.name for k in c.DOC_TYPES]
BEST = f"""best AS (SELECT *, CASE {' '.join(f"WHEN {n} = top THEN '{n}'" for n in _NAMES)} END AS document_type,
  ({' + '.join(f"CASE WHEN {_re(p)} THEN 1 ELSE 0 END" for p in c.DOC_TYPES[0].strong)}) AS strong
  FROM (SELECT *, greatest({', '.join(_NAMES)}) AS top FROM scores) x)"""
DECIDED = f"""decided AS (SELECT *, top < limit_ AS forced, CASE WHEN top < limit_ THEN greatest(top, 0.6::DOUBLE) ELSE top END
  AS confidence_score FROM (SELECT *, CASE document_type {' '.join(
      f"WHEN '{k.name}' THEN " + (f"CASE WHEN strong > 0 THEN {min(k.threshold, 0.4)} ELSE {k.threshold} END" if k.strong else str(k.threshold))
      for k in c.DOC_TYPES)} END AS limit_ FROM best) y)"""
CHAIN = (TEXTS, LOW, PARTS, SCORES, BEST, DECIDED)


def _part(make):
    def run(spark, d):
        seen = c.Spotted(c.lowered(_texts(spark, d), "body", "doc_id"), "_text")
        return seen.df.select("doc_id", *[make(seen, k).cast("double").alias(k.name) for k in c.DOC_TYPES])
    return run


for _i, _name, _make, _prefix in ((2, "keyword_score", c.keyword_score, "kw"), (3, "pattern_score", c.pattern_score, "pat"),
                                  (4, "strong_bonus", c.strong_bonus, "bonus"), (5, "negative_penalty", c.negative_penalty, "neg")):
    add(f"cls{_i:02d}_{_name}", _part(_make), oracle(
        "SELECT doc_id, " + ", ".join(f"{_prefix}_{n} AS {n}" for n in _NAMES) + " FROM parts", TEXTS, LOW, PARTS))
add("cls06_final_scores", lambda s, d: c.score_types(_texts(s, d), "body", "doc_id"),
    oracle("SELECT doc_id, " + ", ".join(_NAMES) + " FROM scores", TEXTS, LOW, PARTS, SCORES))


def _classified(s, d):
    return c.classify(_texts(s, d), "body", "doc_id")


add("cls07_decision", lambda s, d: _classified(s, d).select("doc_id", "document_type", "confidence_score", "forced"),
    oracle("SELECT doc_id, document_type, confidence_score, forced FROM decided", *CHAIN))
_ALTERNATES = oracle(f"""SELECT doc_id, type, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY score DESC, ord) AS rn FROM ({' UNION ALL '.join(
      f"SELECT doc_id, '{n}' AS type, {n} AS score, {i} AS ord FROM decided WHERE document_type <> '{n}' AND {n} > 0.2"
      for i, n in enumerate(_NAMES))}) u) v WHERE rn <= 3""", *CHAIN)
add("cls08_alternates", lambda s, d: c.alternates(_classified(s, d), "doc_id"), _ALTERNATES)


def _three_best(s, d):
    scores = c.score_types(_texts(s, d), "body", "doc_id")
    entries = F.array(*[F.struct(F.col(n).alias("score"), F.lit(-i).alias("ord"), F.lit(n).alias("type"))
                        for i, n in enumerate(_NAMES)])
    best = F.slice(F.reverse(F.array_sort(F.filter(entries, lambda e: e["score"] > 0.2))), 1, 3)
    return scores.select("doc_id", F.inline_outer(best)).where("type IS NOT NULL").select("doc_id", "type", "score")


add("srt06_best_types", _three_best, oracle(f"""SELECT doc_id, type, score FROM (SELECT *, row_number() OVER (
  PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM ({' UNION ALL '.join(
      f"SELECT doc_id, '{n}' AS type, {n} AS score, {i} AS ord FROM scores WHERE {n} > 0.2"
      for i, n in enumerate(_NAMES))}) u) v WHERE rn <= 3""", TEXTS, LOW, PARTS, SCORES))
_METHOD = "CASE " + " ".join(f"WHEN {_re(p)} THEN '{n}'" for n, p in c.fn.PAYMENT_METHODS) + " ELSE 'UNKNOWN' END"
_CATEGORY = "CASE " + " ".join(f"WHEN {_re(p)} THEN '{n}'" for n, p in c.fn.EXPENSE_CATEGORIES) + " ELSE 'GENERAL' END"
_LANGUAGE = r"CASE WHEN regexp_matches(body, '[^\x00-\x7F]') THEN 'multilingual' ELSE 'english' END"
def _structured(s, d):
    """Texts whose lines with a colon are form fields and whose long lines are tables."""
    given = _texts(s, d).withColumns({"fields": F.filter(F.split("body", "\n"), lambda x: F.contains(x, F.lit(":"))),
                                      "tables": F.filter(F.split("body", "\n"), lambda x: F.length(x) > 400)})
    return c.classify(given, "body", "doc_id", "fields", "tables")


add("cls09_metadata", lambda s, d: _structured(s, d).select("doc_id", "metadata.*"), oracle(
    f"""SELECT doc_id, length(body) AS text_length, contains(body, ':') AS has_form_fields,
    len(list_filter(string_split(body, chr(10)), lambda x: length(x) > 400)) > 0 AS has_tables, {_LANGUAGE} AS language,
    CASE WHEN document_type = 'B2B_INVOICE' THEN regexp_matches(body, '{c.TAX_ID}') END AS has_gstin,
    CASE WHEN document_type = 'B2B_INVOICE' THEN {_re(c.TAX_NAMES)} END AS has_tax_details,
    CASE WHEN document_type = 'B2B_INVOICE' THEN {_re(r"invoice\s*(no|number)")} END AS has_invoice_number,
    CASE WHEN document_type = 'PAYMENT_PROOF' THEN {_re("(transaction|utr|reference).*id")} END AS has_transaction_id,
    CASE WHEN document_type = 'PAYMENT_PROOF' THEN {_re(r"(rs|₹|inr).*\d")}
         WHEN document_type = 'EXPENSE_SLIP' THEN {_re(r"(rs|₹|inr|total).*\d")} END AS has_amount,
    CASE WHEN document_type = 'PAYMENT_PROOF' THEN {_METHOD} END AS payment_method,
    CASE WHEN document_type = 'EXPENSE_SLIP' THEN {_CATEGORY} END AS expense_category FROM decided""", *CHAIN))
def _of_kind(make):
    return "CASE document_type " + " ".join(f"WHEN '{k.name}' THEN {make(k)}" for k in c.DOC_TYPES) + " END"


def _seen_words(words):
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {_quoted(w)} END" for w, t in zip(words, _has(words))) + "], lambda w: w IS NOT NULL)"


_TOLD = f"""told AS (SELECT *, {_of_kind(lambda k: _seen_words(k.keywords))} AS found, {_of_kind(lambda k: _seen_words(k.negatives))} AS against,
  {_of_kind(lambda k: "(" + " + ".join(f"CASE WHEN {_re(p)} THEN 1 ELSE 0 END" for p in k.patterns) + ")")} AS matched,
  {_of_kind(lambda k: f"({_re(c.TAX_ID)} AND {_re(c.COMPANY_FORM)} AND {_re(c.TAX_NAMES)})" if k.strong else "FALSE")} AS certain FROM decided)"""
_TERMS = f"""terms AS (SELECT *, list_filter(found, lambda w: w IN ({", ".join(map(_quoted, c.KEY_TERMS))})) AS key_terms FROM told)"""
add("cls10_reasoning", lambda s, d: _classified(s, d).select(
    "doc_id", F.array_join("reasoning", "; ").alias("reasoning"), F.array_join("keywords", ",").alias("keywords")), oracle(
    """SELECT doc_id, concat_ws('; ', CASE WHEN forced THEN 'Closest type, score below the threshold of ' || document_type END,
    CASE WHEN certain THEN 'Tax id, company form and tax names together' END,
    CASE WHEN len(key_terms) > 0 THEN 'Key business terms: ' || array_to_string(key_terms[1:5], ', ')
         WHEN len(found) > 0 THEN 'Keywords: ' || array_to_string(found[1:5], ', ') END,
    CASE WHEN strong > 0 AND document_type = 'B2B_INVOICE' THEN 'Strong indicators: ' || strong END,
    CASE WHEN matched > 0 THEN 'Structure patterns: ' || matched END,
    CASE WHEN len(against) > 0 THEN 'Conflicting terms: ' || array_to_string(against, ', ') END,
    CASE WHEN top > 0.8::DOUBLE THEN 'Very high' WHEN top > 0.65::DOUBLE THEN 'High' WHEN top > 0.5::DOUBLE THEN 'Moderate' ELSE 'Low' END || ' confidence')
    AS reasoning, array_to_string(found, ',') AS keywords FROM terms""", *CHAIN, _TOLD, _TERMS))


def _accuracy(s, d):
    types = "array(" + ", ".join(f"'{n}'" for n in _NAMES) + ")"
    labels = bridge.raw(s, d, "documents").selectExpr(
        "doc_id", f"element_at({types}, cast(doc_id % 7 AS int) + 1) AS expected_type", "50 AS expected_confidence_min")
    return c.classification_accuracy(_classified(s, d), labels, "doc_id")


def _share(condition):
    return (f"CAST(round(CAST(100.0 * sum(CASE WHEN {condition} THEN 1 ELSE 0 END) / count(*) AS DECIMAL(20,8)), 2) "
            "AS DOUBLE)")


_RIGHT = f"document_type = [{', '.join(map(_quoted, _NAMES))}][CAST(doc_id % 7 AS INTEGER) + 1]"
_SURE = "confidence_score * 100 >= 50"
add("cls11_accuracy", _accuracy, oracle(
    f"""SELECT count(*) AS documents, {_share(_RIGHT)} AS type_accuracy, {_share(_SURE)} AS confidence_ok,
    {_share(f"{_RIGHT} AND {_SURE}")} AS overall FROM decided""", *CHAIN))


def _rule_hits(s, d):
    """How many documents contain each keyword of each type: the rule table joined to the texts."""
    rules = c.rule_table(s).where("kind = 'keyword'")
    low = c.lowered(_texts(s, d), "body", "doc_id").select("doc_id", F.col("_text").alias("t"))
    # 119 words against each text: the rules are a fixed list, so they are columns here too.
    hits = low.agg(*[F.count_if(F.contains(F.col("t"), F.lit(w))).alias(f"{k.name}|{w}")
                     for k in c.DOC_TYPES for w in k.keywords])
    long = hits.select(F.explode(F.array(*[
        F.struct(F.lit(k.name).alias("document_type"), F.lit(w).alias("entry"), F.col(f"`{k.name}|{w}`").alias("documents"))
        for k in c.DOC_TYPES for w in k.keywords])).alias("h")).select("h.*")
    return rules.join(long, ["document_type", "entry"]).select("document_type", "threshold", "entry", "documents")


add("cls12_rule_hits", _rule_hits, oracle(" UNION ALL ".join(
    f"SELECT '{k.name}' AS document_type, CAST({k.threshold} AS DOUBLE) AS threshold, {_quoted(w)} AS entry, "
    f"CAST(sum(CASE WHEN contains(t, {_quoted(w)}) THEN 1 ELSE 0 END) AS BIGINT) AS documents FROM low"
    for k in c.DOC_TYPES for w in k.keywords), TEXTS, LOW))

# Chat messages ------------------------------------------------------------------------
ASKED = (
    "show me invoices from March", "find company with GSTIN 24AAXFA5297L1ZN", "list hsn codes of products",
    "total amount and monthly trend compared across suppliers with average", "validate invoice 12",
    "which payments are outstanding", "compare the average distribution with the forecast where it is unusual", "hello",
    "for example the tax is approximately 18%")
_SPARK_ASKED = "array(" + ", ".join(f"'{x}'" for x in ASKED) + ")"
_SQL_ASKED = "[" + ", ".join(f"'{x}'" for x in ASKED) + "]"


def _chat(s, d):
    return bridge.messages(s, d).withColumn("content", F.expr(
        f"concat(content, ' ', element_at({_SPARK_ASKED}, cast((turn + cast(session_id AS bigint)) % 9 AS int) + 1))"))


CHAT = f"""chat AS (SELECT * REPLACE (content || ' ' || {_SQL_ASKED}[CAST((turn + CAST(session_id AS BIGINT)) % 9 AS INTEGER) + 1]
  AS content) FROM messages)"""


def _any_sql(words, column="lower(content)"):
    return "(" + " OR ".join(f"contains({column}, {_quoted(w)})" for w in words) + ")"


_COMPLEXITY = "(" + " + ".join(f"CASE WHEN {_any_sql(w)} THEN 1 ELSE 0 END" for w in m.PATTERN_GROUPS.values()) + ")"


def _refined(subject):
    steps, plain = m.COMPLEX[subject]
    return "CASE " + " ".join(f"WHEN {_COMPLEXITY} > {n} THEN '{label}'" for n, label in steps) + f" ELSE '{plain}' END"


_INTENT = "CASE " + " ".join(f"WHEN {_any_sql(w)} THEN {_refined(n)}" for n, w in m.SUBJECTS) + \
    f" WHEN {_COMPLEXITY} > 2 THEN 'advanced_database_query' ELSE 'general_query' END"
_SIMPLE = "CASE " + " ".join(
    f"WHEN {_any_sql(m.SIMPLE_FINANCIAL if n == 'financial' else w)} THEN '{m.SIMPLE_NAMES[n]}'" for n, w in m.SUBJECTS) + \
    " ELSE 'general_query' END"
INTENTS = f"intents AS (SELECT *, {_INTENT} AS query_type, {_COMPLEXITY} AS complexity FROM chat)"
add("txt01_simple_intent", lambda s, d: _chat(s, d).select("message_id", m.simple_intent(F.col("content")).alias("intent")),
    oracle(f"SELECT message_id, {_SIMPLE} AS intent FROM chat", CHAT))
add("txt02_intent", lambda s, d: _chat(s, d).select(
    "message_id", m.intent(F.col("content")).alias("query_type"), m.complexity(F.col("content")).alias("complexity")),
    oracle("SELECT message_id, query_type, complexity FROM intents", CHAT, INTENTS))
add("txt03_routed_reports", lambda s, d: m.route(bridge.lake(s, d), "advanced_financial_analysis")["growth"].select(
    "month", "invoice_count"),
    oracle(f"""SELECT strftime(invoice_date, '%Y-%m') AS month, count(*) AS invoice_count FROM invoices
    WHERE invoice_date >= DATE '{AS_OF}' - INTERVAL 24 MONTH GROUP BY 1"""))
add("txt04_phrase_intents", lambda s, d: _chat(s, d).select(
    "message_id", F.array_join(m.phrase_intents(F.col("content")), ",").alias("intents")),
    oracle("SELECT message_id, concat_ws(',', " + ", ".join(
        f"CASE WHEN {_any_sql([p.lower() for p in ps])} THEN '{n}' END" for n, ps in m.PHRASES.items()) +
        ") AS intents FROM chat", CHAT))
add("txt05_session_stats", lambda s, d: m.session_stats(_chat(s, d)), oracle(
    """SELECT session_id, count(*) AS messages, CAST(sum(confidence_score) AS DOUBLE) / count(confidence_score)
    AS avg_confidence FROM chat GROUP BY 1""", CHAT))
add("txt05_last_queries", lambda s, d: m.last_queries(_chat(s, d)).select("session_id", "message_id", "position"), oracle(
    """SELECT * FROM (SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id
    ORDER BY sent_at DESC, message_id DESC) AS position FROM chat WHERE message_type = 'user') x WHERE position <= 5""", CHAT))
_NOW = f"{AS_OF} 01:30:00"
add("txt06_recent_focus", lambda s, d: m.recent_focus(_chat(s, d), F.lit(_NOW).cast("timestamp_ntz")), oracle(
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY asked DESC, query_type) AS position
    FROM (SELECT session_id, query_type, count(*) AS asked FROM intents WHERE sent_at >= TIMESTAMP '{_NOW}' - INTERVAL 1 HOUR
    AND sent_at <= TIMESTAMP '{_NOW}' GROUP BY 1, 2) a) b WHERE position <= 3""", CHAT, INTENTS))
add("txt07_pattern_frequency", lambda s, d: m.pattern_frequency(_chat(s, d)).withColumn(
    "last_confidence", F.col("last_confidence").cast("double")), oracle(
    """SELECT query_type, count(*) AS frequency, CAST(arg_max(confidence_score, (sent_at, message_id)) AS DOUBLE)
    AS last_confidence FROM intents GROUP BY 1""", CHAT, INTENTS))
add("txt08_answer_risk", lambda s, d: _chat(s, d).select(
    "message_id", m.answer_risk(F.col("content"), F.col("confidence_score")).alias("r")).select("message_id", "r.*"), oracle(
    f"""SELECT message_id, unsafe, unsafe OR confidence_score < 0.7 AS needs_verification FROM (SELECT *,
    {_any_sql(m.HEDGES)} AND {_any_sql(m.FINANCIAL_TERMS, "content")} AS unsafe FROM chat) x""", CHAT))
