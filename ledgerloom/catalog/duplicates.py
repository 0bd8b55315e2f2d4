"""Queries of duplicate detection."""

from pyspark.sql import functions as F

from ledgerloom import bridge
from ledgerloom.bridge import oracle
from ledgerloom.catalog.registry import add
from ledgerloom.catalog.reports import NEAREST, SHARED
from ledgerloom.operators import duplicates as du
from ledgerloom.operators import store


def _lake(s, d):
    return bridge.lake(s, d, describe=True)


def _group_sql(keys, where="TRUE"):
    return f"""SELECT invoice_id, {keys}, group_size, first_id, CAST(group_size * (group_size - 1) // 2 AS BIGINT) AS pairs_in_group
    FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS group_size, min(invoice_id) OVER (PARTITION BY {keys}) AS first_id
    FROM invoices WHERE {where}) x WHERE group_size > 1"""


add("dup01_same_supplier", lambda s, d: du.same_supplier(bridge.lake(s, d).invoices), oracle(_group_sql("supplier_company_id")))
add("dup02_same_number", lambda s, d: du.same_number(bridge.lake(s, d).invoices), oracle(_group_sql("invoice_num", "invoice_num <> ''")))
add("dup03_similar_amount", lambda s, d: du.similar_amount(bridge.lake(s, d).invoices).withColumn(
    "amount_diff", F.col("amount_diff").cast("double")), oracle(NEAREST))
add("dup04_shared_hsn", lambda s, d: du.shared_hsn(bridge.lake(s, d).items), oracle(SHARED))
_CANDIDATES = f"""SELECT p.invoice_id, candidate_id, CASE WHEN a.supplier_company_id = b.supplier_company_id THEN 'same_supplier'
  WHEN a.invoice_num = b.invoice_num THEN 'same_number' WHEN listed = 3 THEN 'similar_amount' ELSE 'shared_hsn' END AS scenario
  FROM (SELECT invoice_id, candidate_id, min(listed) AS listed FROM (SELECT invoice_id, candidate_id, 3 AS listed FROM ({NEAREST}) n
    UNION ALL SELECT invoice_id, candidate_id, 4 FROM ({SHARED}) h) u GROUP BY 1, 2) p
  JOIN invoices a ON p.invoice_id = a.invoice_id JOIN invoices b ON candidate_id = b.invoice_id"""


def _candidates(s, d):
    k = bridge.lake(s, d)
    return du.candidate_pairs(k.invoices, k.items)


def _union(s, d):
    k = bridge.lake(s, d)
    return du.candidate_union(k.invoices, k.items)


_UNION = ("groups AS (SELECT *, count(*) OVER s AS n_s, min(invoice_id) OVER s AS f_s, count(*) OVER n AS n_n, min(invoice_id) OVER n AS f_n FROM invoices "
          "WINDOW s AS (PARTITION BY supplier_company_id), n AS (PARTITION BY invoice_num))", f"""all_of AS (
  SELECT invoice_id, f_s AS candidate_id, n_s AS group_size, 'same_supplier' AS scenario FROM groups WHERE n_s > 1
  UNION ALL SELECT invoice_id, f_n, n_n, 'same_number' FROM groups WHERE n_n > 1 AND invoice_num <> ''
  UNION ALL SELECT invoice_id, candidate_id, NULL, scenario FROM ({_CANDIDATES}) c WHERE scenario NOT IN ('same_supplier', 'same_number'))""")
add("win05_first_scenario", _candidates, oracle(_CANDIDATES))
add("dup05_candidate_union", _union, oracle("SELECT * FROM all_of", *_UNION))
add("set02_candidate_union", lambda s, d: du.candidate_counts(_union(s, d)), oracle("SELECT invoice_id, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN scenario = '{n}' THEN coalesce(group_size - 1, 1) END), 0) AS BIGINT) AS {n}"
    for n in ("same_supplier", "same_number", "similar_amount", "shared_hsn")) + " FROM all_of GROUP BY 1", *_UNION))
add("win04_nearest_ten", lambda s, d: du.similar_amount(bridge.lake(s, d).invoices).groupBy("invoice_id").agg(
    F.count("*").alias("candidates"), F.max("amount_diff").cast("double").alias("largest_diff")),
    oracle(f"SELECT invoice_id, count(*) AS candidates, max(amount_diff) AS largest_diff FROM ({NEAREST}) n GROUP BY 1"))
def _details(s, d):
    k = _lake(s, d)
    return du.detail_rows(k.invoices, k.items, k.companies, bridge.lake(s, d).products)


_PLAIN = {"quantity", "unit_price", "taxable_value", "gst_rate", "total_amount", "invoice_taxable", "invoice_tax", "invoice_total"}
add("dup06_detail_rows", lambda s, d: _details(s, d).select(*[
    F.col(c).cast("double").alias(c) if c in _PLAIN else F.col(c) for c in _details(s, d).columns]), oracle(
    """SELECT h.invoice_id, invoice_num, invoice_date, CAST(h.taxable_value AS DOUBLE) AS invoice_taxable, CAST(total_tax AS DOUBLE) AS invoice_tax,
    CAST(total_value AS DOUBLE) AS invoice_total, supplier_company_id, legal_name AS supplier_name, gstin AS supplier_gstin, item_id, i.product_id,
    item_description AS description, i.hsn_code, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
    CAST(i.taxable_value AS DOUBLE) AS taxable_value, CAST(gst_rate AS DOUBLE) AS gst_rate, CAST(total_amount AS DOUBLE) AS total_amount,
    canonical_name AS product_name FROM invoices h LEFT JOIN items i ON h.invoice_id = i.invoice_id
    LEFT JOIN companies ON supplier_company_id = company_id LEFT JOIN products p ON i.product_id = p.product_id"""))


def _listed_scores(s, d):
    """The ten nearest by amount and by shared codes of every invoice, all scored."""
    k = _lake(s, d)
    pairs = du.once(
        du.similar_amount(k.invoices, 10).select("invoice_id", "candidate_id")
        .unionByName(du.shared_hsn(k.items, 10).select("invoice_id", "candidate_id")))
    return du.score_pairs(pairs, k.invoices, k.items)


_PAIRS = f"""pairs AS (SELECT invoice_id, candidate_id FROM ({NEAREST}) n
  UNION SELECT invoice_id, candidate_id FROM ({SHARED}) h)"""
_SIM = """(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0::DOUBLE WHEN {a} = 0 AND {b} = 0 THEN 1::DOUBLE WHEN {a} = 0 OR {b} = 0 THEN 0::DOUBLE
  WHEN abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) / greatest(abs(CAST({a} AS DOUBLE)), abs(CAST({b} AS DOUBLE))) <= 0.05::DOUBLE
  THEN 1 - abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) / greatest(abs(CAST({a} AS DOUBLE)), abs(CAST({b} AS DOUBLE))) / 0.05::DOUBLE
  ELSE 0::DOUBLE END)""".format
add("dup10_hsn_ratio", lambda s, d: _listed_scores(s, d).select("invoice_id", "candidate_id", "hsn_ratio"), oracle(
    """SELECT invoice_id, candidate_id, CAST(len(list_intersect(a.codes, b.codes)) AS DOUBLE) /
    len(list_distinct(list_concat(a.codes, b.codes))) AS hsn_ratio FROM pairs JOIN sets a ON invoice_id = a.id
    JOIN sets b ON candidate_id = b.id""", _PAIRS,
    "sets AS (SELECT invoice_id AS id, list(DISTINCT hsn_code) AS codes FROM items GROUP BY 1)"))
_RATE_BEST = f"""SELECT p.invoice_id, p.candidate_id, a.item_id, max(({_SIM(a='a.unit_price', b='b.unit_price')} +
  {_SIM(a='a.quantity', b='b.quantity')}) / 2) AS best FROM pairs p JOIN items a ON p.invoice_id = a.invoice_id
  JOIN items b ON p.candidate_id = b.invoice_id GROUP BY 1, 2, 3"""
add("dup11_rate_score", lambda s, d: _listed_scores(s, d).select(
    "invoice_id", "candidate_id", F.round("rate_score", 6).alias("rate_score")), oracle(
    f"""SELECT p.invoice_id, p.candidate_id, round(coalesce(sum(CASE WHEN best > 0.8 THEN best END), 0) / greatest(n1, n2), 6)
    AS rate_score FROM ({_RATE_BEST}) p
    JOIN (SELECT invoice_id AS i1, count(*) AS n1 FROM items GROUP BY 1) x ON i1 = p.invoice_id
    JOIN (SELECT invoice_id AS i2, count(*) AS n2 FROM items GROUP BY 1) y ON i2 = p.candidate_id GROUP BY 1, 2, n1, n2""", _PAIRS))
# Code and description both come from the part: lines with one code have one text, and lines with
# different codes stay under the limits of product and line similarity. So only the former count.
_RATIO = """(CASE WHEN a.{c} > 0 AND b.{c} > 0 THEN greatest(0::DOUBLE, 1 - abs(CAST(a.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE)) /
  greatest(CAST(a.{c} AS DOUBLE), CAST(b.{c} AS DOUBLE))) END)""".format
_PRICE, _WORTH = _RATIO(c="unit_price"), _RATIO(c="taxable_value")
_PAIR_SCORES = ("sizes AS (SELECT invoice_id AS id, count(*) AS n, list(DISTINCT hsn_code) AS codes FROM items GROUP BY 1)", f"""coded AS (
  SELECT p.invoice_id, candidate_id, a.item_id,
    max((0.65::DOUBLE + coalesce(0.2::DOUBLE * {_PRICE}, 0) + coalesce(0.3::DOUBLE * {_WORTH}, 0)) /
      (0.65::DOUBLE + CASE WHEN {_PRICE} IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN {_WORTH} IS NULL THEN 0 ELSE 0.3::DOUBLE END)) AS item,
    max(0.6::DOUBLE + 0.2::DOUBLE * {_SIM(a='a.quantity', b='b.quantity')} + 0.2::DOUBLE * {_SIM(a='a.unit_price', b='b.unit_price')}) AS line
  FROM pairs p JOIN items a ON p.invoice_id = a.invoice_id JOIN items b ON candidate_id = b.invoice_id AND a.hsn_code = b.hsn_code
  GROUP BY 1, 2, 3)""", """coded_pairs AS (
  SELECT invoice_id, candidate_id, sum(CASE WHEN item > 0.8 THEN item END) AS items, count(*) FILTER (item > 0.8) AS matching,
    sum(CASE WHEN line > 0.7 THEN line END) AS lines FROM coded GROUP BY 1, 2)""", f"""rated_pairs AS (
  SELECT invoice_id, candidate_id, sum(CASE WHEN best > 0.8 THEN best END) AS rates FROM ({_RATE_BEST}) r GROUP BY 1, 2)""", """scores AS (
  SELECT p.invoice_id, p.candidate_id, coalesce(matching, 0) AS matching_products, coalesce(items, 0::DOUBLE) / a.n AS product_score,
    coalesce(lines, 0::DOUBLE) / greatest(a.n, b.n) AS line_score, coalesce(rates, 0::DOUBLE) / greatest(a.n, b.n) AS rate_score,
    CAST(len(list_intersect(a.codes, b.codes)) AS DOUBLE) / len(list_distinct(list_concat(a.codes, b.codes))) AS hsn_ratio,
    len(list_intersect(a.codes, b.codes)) AS shared_codes
  FROM pairs p JOIN sizes a ON p.invoice_id = a.id JOIN sizes b ON candidate_id = b.id
  LEFT JOIN coded_pairs c ON p.invoice_id = c.invoice_id AND p.candidate_id = c.candidate_id
  LEFT JOIN rated_pairs r ON p.invoice_id = r.invoice_id AND p.candidate_id = r.candidate_id)""")
add("dup08_product_score", lambda s, d: _listed_scores(s, d).select(
    "invoice_id", "candidate_id", "matching_products", F.round("product_score", 6).alias("product_score")), oracle(
    "SELECT invoice_id, candidate_id, matching_products, round(product_score, 6) AS product_score FROM scores", _PAIRS, *_PAIR_SCORES))
add("dup09_line_score", lambda s, d: _listed_scores(s, d).select("invoice_id", "candidate_id", F.round("line_score", 6).alias("line_score")), oracle(
    "SELECT invoice_id, candidate_id, round(line_score, 6) AS line_score FROM scores", _PAIRS, *_PAIR_SCORES))


# Everything that is compared: one supplier, one number, and the lists. Then the cascade, step by step.
_COMPARED = f"""pairs AS (SELECT a.invoice_id, b.invoice_id AS candidate_id FROM invoices a JOIN invoices b
    ON a.supplier_company_id = b.supplier_company_id AND a.invoice_id <> b.invoice_id
  UNION SELECT a.invoice_id, b.invoice_id FROM invoices a JOIN invoices b ON a.invoice_num = b.invoice_num AND a.invoice_num <> '' AND a.invoice_id <> b.invoice_id
  UNION SELECT invoice_id, candidate_id FROM ({NEAREST}) n UNION SELECT invoice_id, candidate_id FROM ({SHARED}) h)"""
_FOUND = (_COMPARED, *_PAIR_SCORES, """step1 AS (SELECT s.*, a.supplier_company_id = b.supplier_company_id AS same,
    a.supplier_company_id = b.supplier_company_id AND upper(trim(a.invoice_num)) = upper(trim(b.invoice_num)) AND trim(a.invoice_num) <> '' AS exact,
    CASE WHEN a.supplier_company_id = b.supplier_company_id AND product_score >= 0.85 THEN product_score * 0.9::DOUBLE ELSE 0::DOUBLE END AS c1
  FROM scores s JOIN invoices a ON s.invoice_id = a.invoice_id JOIN invoices b ON candidate_id = b.invoice_id)""",
  """step2 AS (SELECT *, line_score > 0.8 AND c1 < 0.85 AS by_line, CASE WHEN line_score > 0.8 AND c1 < 0.85 THEN 0.8::DOUBLE + line_score * 0.05::DOUBLE
    ELSE c1 END AS c2 FROM step1)""",
  """step3 AS (SELECT *, hsn_ratio > 0.8 AND c2 < 0.75 AS by_code, CASE WHEN hsn_ratio > 0.8 AND c2 < 0.75 THEN greatest(c2, 0.7::DOUBLE + hsn_ratio * 0.05::DOUBLE)
    ELSE c2 END AS c3 FROM step2)""",
  """found AS (SELECT * FROM (SELECT invoice_id, candidate_id, matching_products, shared_codes, product_score, line_score, hsn_ratio, rate_score,
    CASE WHEN exact THEN 'EXACT_INVOICE_NUMBER_SAME_COMPANY' WHEN by_line THEN 'PRODUCT_LINE_DUPLICATION' WHEN c1 > 0 THEN 'SAME_COMPANY_PRODUCT_DUPLICATION'
      WHEN by_code THEN 'HSN_PATTERN_MATCH' WHEN rate_score > 0.85 AND c3 < 0.7 THEN 'RATE_PATTERN_MATCH' END AS match_type,
    CASE WHEN exact THEN 0.95::DOUBLE WHEN rate_score > 0.85 AND c3 < 0.7 THEN greatest(c3, 0.65::DOUBLE + rate_score * 0.05::DOUBLE) ELSE c3 END AS confidence
    FROM step3) x WHERE confidence > 0.5)""",
  "best AS (SELECT invoice_id, max(confidence) AS confidence, count(*) AS matches FROM found GROUP BY 1)")


def _matches(s, d):
    k = _lake(s, d)
    return du.duplicate_matches(k.invoices, k.items)


def _verdicts(s, d):
    return du.duplicate_verdicts(bridge.lake(s, d).invoices, _matches(s, d))


_RECOMMEND = """CASE WHEN confidence >= 0.85 THEN 'HIGH_CONFIDENCE_DUPLICATE' WHEN confidence >= 0.7 THEN
  'LIKELY_DUPLICATE_REVIEW_REQUIRED' WHEN confidence >= 0.5 THEN 'POSSIBLE_DUPLICATE_INVESTIGATE' ELSE 'NOT_A_DUPLICATE' END"""
_SCORES = ("product_score", "line_score", "hsn_ratio", "rate_score")
#: The exact ones as the operator gives them, a row an invoice; lines of two invoices are nowhere the same, so all others are pairs.
_MATCHED = (*_FOUND, f"""matched AS (
  SELECT invoice_id, min(candidate_id) AS candidate_id, count(*) AS partners, match_type, 0.95::DOUBLE AS confidence, NULL::BIGINT AS matching_products,
    NULL::BIGINT AS shared_codes, {", ".join(f"NULL::DOUBLE AS {c}" for c in _SCORES)}
  FROM found WHERE match_type = 'EXACT_INVOICE_NUMBER_SAME_COMPANY' GROUP BY invoice_id, match_type
  UNION ALL SELECT invoice_id, candidate_id, 1, match_type, confidence, matching_products, shared_codes, {", ".join(_SCORES)}
  FROM found WHERE match_type <> 'EXACT_INVOICE_NUMBER_SAME_COMPANY')""")
add("dup12_matches", lambda s, d: _matches(s, d).withColumns({c: F.round(c, 6) for c in ("confidence", *_SCORES)}), oracle(
    f"""SELECT invoice_id, candidate_id, partners, match_type, round(confidence, 6) AS confidence, matching_products, shared_codes,
    {", ".join(f"round({c}, 6) AS {c}" for c in _SCORES)}, {_RECOMMEND} AS recommendation FROM matched""", *_MATCHED))
add("dup12_exact_matches", lambda s, d: du.exact_matches(bridge.lake(s, d).invoices), oracle(
    """SELECT a.invoice_id, min(b.invoice_id) AS candidate_id, count(*) AS partners,
    'EXACT_INVOICE_NUMBER_SAME_COMPANY' AS match_type, 0.95::DOUBLE AS confidence FROM invoices a JOIN invoices b
    ON upper(trim(a.invoice_num)) = upper(trim(b.invoice_num)) AND a.supplier_company_id = b.supplier_company_id
    AND a.invoice_id <> b.invoice_id GROUP BY 1"""))
# Totals rounded to 2000 so that equal amounts within a week occur.
add("dup13_amount_and_date", lambda s, d: du.amount_date_matches(bridge.lake(s, d).invoices.withColumn(
    "total_value", F.round(F.col("total_value") / 2000, 0) * 2000)).withColumn("confidence", F.round("confidence", 6)), oracle(
    """SELECT invoice_id, CAST(m % 1000000000000 AS BIGINT) AS candidate_id, CAST(m // 1000000000000 AS BIGINT) AS days_apart, partners,
    'SAME_SUPPLIER_AMOUNT_DATE' AS match_type, round(0.85::DOUBLE - (m // 1000000000000) * 0.03::DOUBLE, 6) AS confidence FROM (
      SELECT a.invoice_id, min(abs(a.invoice_date - b.invoice_date) * 1000000000000 + b.invoice_id) AS m, count(*) AS partners
      FROM r a JOIN r b ON a.supplier_company_id = b.supplier_company_id AND a.v = b.v AND a.invoice_id <> b.invoice_id
      AND abs(a.invoice_date - b.invoice_date) <= 7 GROUP BY 1) x""",
    "r AS (SELECT *, round(CAST(total_value AS DECIMAL(20,6)) / 2000.0, 0) * 2000 AS v FROM invoices)"))


def _share(s, d):
    k = bridge.lake(s, d)
    return k.invoices.select("invoice_id", (F.col("invoice_id") % 101 / 100).cast("double").alias("confidence"))


add("dup14_recommendation", lambda s, d: _share(s, d).where("confidence > 0.5").withColumn(
    "recommendation", du.recommendation(F.col("confidence"))), oracle(
    f"""SELECT invoice_id, confidence, {_RECOMMEND} AS recommendation FROM (SELECT invoice_id,
    CAST(invoice_id % 101 AS DOUBLE) / 100 AS confidence FROM invoices) x WHERE confidence > 0.5"""))
VERDICTS = oracle(
    """SELECT h.invoice_id, invoice_num, coalesce(confidence > 0.7, FALSE) AS is_duplicate, round(coalesce(confidence, 0::DOUBLE), 6) AS confidence,
    coalesce(matches, 0) AS matches, CASE WHEN confidence > 0.7 THEN 'MARK_AS_DUPLICATE' WHEN confidence IS NOT NULL THEN 'MANUAL_REVIEW_REQUIRED'
    ELSE 'APPROVE_AS_UNIQUE' END AS recommended_action FROM invoices h LEFT JOIN best b ON h.invoice_id = b.invoice_id""", *_FOUND)
add("dup15_verdicts", lambda s, d: _verdicts(s, d).withColumn("confidence", F.round("confidence", 6)), VERDICTS)
add("dup15_exact_verdicts", lambda s, d: du.duplicate_verdicts(
    bridge.lake(s, d).invoices, du.exact_matches(bridge.lake(s, d).invoices)), oracle(
    """SELECT invoice_id, invoice_num, n > 1 AS is_duplicate, CASE WHEN n > 1 THEN 0.95::DOUBLE ELSE 0::DOUBLE END AS confidence,
    n - 1 AS matches, CASE WHEN n > 1 THEN 'MARK_AS_DUPLICATE' ELSE 'APPROVE_AS_UNIQUE' END AS recommended_action
    FROM (SELECT *, count(*) OVER (PARTITION BY supplier_company_id, upper(trim(invoice_num))) AS n FROM invoices) x"""))
def _evidence(s, d):
    fields = ("matching_products", "shared_codes", *_SCORES)
    return du.evidence(_matches(s, d)).select("invoice_id", "candidate_id", "match_type", F.round("confidence", 6).alias("confidence"), F.array_join(
        "evidence", "; ").alias("evidence"), *[F.round(F.try_element_at("matching_fields", F.lit(c)).cast("double"), 6).alias(c) for c in fields])


add("dup16_evidence", _evidence, oracle(f"""SELECT invoice_id, candidate_id, match_type, round(confidence, 6) AS confidence, concat_ws('; ',
  CASE WHEN match_type = 'EXACT_INVOICE_NUMBER_SAME_COMPANY' THEN 'Same invoice number and supplier' END, {", ".join(
    f"CASE WHEN {c} {op} THEN '{name} similarity: ' || printf('%.1f%%', round({c} * 100, 1)) END" for c, op, name in (
        ("product_score", ">= 0.85", "Product"), ("line_score", "> 0.8", "Line"), ("hsn_ratio", "> 0.8", "Tariff code"), ("rate_score", "> 0.85", "Rate")))}) AS evidence,
  {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("matching_products", "shared_codes", *_SCORES))} FROM matched""", *_MATCHED))


def _flagged(s, d):
    k = bridge.lake(s, d)
    found = du.duplicate_verdicts(k.invoices, du.exact_matches(k.invoices))
    return store.set_flags(k.invoices, found.select("invoice_id", F.col("is_duplicate").alias("duplication"))).select(
        "invoice_id", "duplication", "validation")


add("dup17_flag_write_back", _flagged, oracle(
    """SELECT invoice_id, count(*) OVER (PARTITION BY supplier_company_id, upper(trim(invoice_num))) > 1 AS duplication,
    validation FROM invoices"""))
def _scored_flags(s, d):
    k = bridge.lake(s, d)
    return store.set_flags(k.invoices, _verdicts(s, d).select("invoice_id", F.col("is_duplicate").alias("duplication"))).select(
        "invoice_id", "duplication", "validation")


add("dup17_scored_flag_write_back", _scored_flags, oracle(
    """SELECT h.invoice_id, coalesce(confidence > 0.7, FALSE) AS duplication, validation FROM invoices h
    LEFT JOIN best b ON h.invoice_id = b.invoice_id""", *_FOUND))
add("dup18_number_supplier_total", lambda s, d: du.groups_with_members(
    bridge.lake(s, d).invoices.withColumn("total_value", F.round("total_value", -5).cast("double")),
    ["invoice_num", "supplier_company_id", "total_value"]),
    oracle("""SELECT invoice_id, invoice_num, supplier_company_id, CAST(v AS DOUBLE) AS total_value, group_size, first_id,
    CAST(group_size * (group_size - 1) // 2 AS BIGINT) AS pairs_in_group FROM (SELECT *, count(*) OVER w AS group_size,
    min(invoice_id) OVER w AS first_id FROM (SELECT *, round(total_value / 100000.0, 0) * 100000 AS v FROM invoices) r
    WINDOW w AS (PARTITION BY invoice_num, supplier_company_id, v)) x WHERE group_size > 1"""))
add("dup19_match_summary", lambda s, d: du.match_summary(_matches(s, d)).withColumns({
    "match_types": F.array_join("match_types", ","), "best_confidence": F.round("best_confidence", 6)}), oracle(
    """SELECT invoice_id, count(*) AS matches, string_agg(DISTINCT match_type, ',' ORDER BY match_type) AS match_types,
    count(*) FILTER (confidence >= 0.85) AS high_confidence, round(max(confidence), 6) AS best_confidence FROM found GROUP BY 1""", *_FOUND))
add("dup20_scenario_labels", lambda s, d: du.exact_matches(bridge.lake(s, d).invoices).join(
    du.scenario_labels(s), "match_type").select("invoice_id", "match_type", "declared_confidence"), oracle(
    """SELECT invoice_id, 'EXACT_INVOICE_NUMBER_SAME_COMPANY' AS match_type, 0.95::DOUBLE AS declared_confidence FROM (
    SELECT *, count(*) OVER (PARTITION BY supplier_company_id, upper(trim(invoice_num))) AS n FROM invoices) x WHERE n > 1"""))
add("agg11_confidence_bands", lambda s, d: du.confidence_bands(_verdicts(s, d)), oracle(
    """SELECT CASE WHEN c > 0.8 THEN 'high' WHEN c > 0.6 THEN 'medium' WHEN c > 0.4 THEN 'low' ELSE 'very low' END AS band, count(*) AS invoices
    FROM (SELECT coalesce(confidence, 0) AS c FROM invoices h LEFT JOIN best b ON h.invoice_id = b.invoice_id) x GROUP BY 1""", *_FOUND))
add("win03_best_line_match", lambda s, d: _best_line(s, d), oracle(
    """SELECT invoice_id, candidate_id, item_id, other_item FROM (SELECT p.invoice_id, candidate_id, a.item_id, b.item_id AS other_item,
    row_number() OVER (PARTITION BY p.invoice_id, candidate_id, a.item_id ORDER BY abs(a.taxable_value - b.taxable_value), b.item_id) AS rn
    FROM pairs p JOIN items a ON p.invoice_id = a.invoice_id JOIN items b ON candidate_id = b.invoice_id
    AND a.hsn_code = b.hsn_code) x WHERE rn = 1""", _PAIRS))


def _best_line(s, d):
    """For each line of a pair, the line of the other invoice with the same code and nearest value."""
    from pyspark.sql import Window as W

    k = bridge.lake(s, d)
    pairs = du.once(du.similar_amount(k.invoices, 10).select("invoice_id", "candidate_id")
                    .unionByName(du.shared_hsn(k.items, 10).select("invoice_id", "candidate_id")))
    joined = du.lines_on_same_code(pairs, k.items, ("taxable_value",)).select(
        "invoice_id", "candidate_id", F.col("a_item_id").alias("item_id"), F.col("b_item_id").alias("other_item"),
        F.abs(F.col("a_taxable_value") - F.col("b_taxable_value")).alias("gap"))
    order = W.partitionBy("invoice_id", "candidate_id", "item_id").orderBy("gap", "other_item")
    return joined.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(
        "invoice_id", "candidate_id", "item_id", "other_item")


def _line_pairs(s, d):
    """Lines of listed pairs on the same code, with the built-in parts of their similarity."""
    k = bridge.lake(s, d)
    pairs = du.once(du.similar_amount(k.invoices, 10).select("invoice_id", "candidate_id")
                    .unionByName(du.shared_hsn(k.items, 10).select("invoice_id", "candidate_id")))
    return du.lines_on_same_code(pairs, k.items, ("unit_price", "quantity")).select(
        "invoice_id", "candidate_id", F.col("a_item_id").alias("a_item"), F.col("b_item_id").alias("b_item"),
        du.rate_similarity("a_", "b_").alias("similarity"))


add("jn13_line_pairs", _line_pairs, oracle(
    f"""SELECT p.invoice_id, candidate_id, a.item_id AS a_item, b.item_id AS b_item,
    ({_SIM(a='a.unit_price', b='b.unit_price')} + {_SIM(a='a.quantity', b='b.quantity')}) / 2 AS similarity
    FROM pairs p JOIN items a ON p.invoice_id = a.invoice_id JOIN items b ON candidate_id = b.invoice_id
    AND a.hsn_code = b.hsn_code""", _PAIRS))


def _listed(k):
    return du.once(du.listed_pairs(k.invoices, k.items))


def _all_line_pairs(s, d):
    k = _lake(s, d)
    return du.line_pairs(_listed(k), k.items, ("quantity", "unit_price")).select("invoice_id", "candidate_id", F.col("a_item_id").alias("a_item"), F.col("b_item_id").alias("b_item"),
                                                     du.rate_similarity("a_", "b_").alias("similarity"))


def _best_by_similarity(s, d):
    k = _lake(s, d)
    return du.best_lines(du.listed_pairs(k.invoices, k.items), k.items)


# The whole of JN13 and WIN3: lines with different or missing codes too, and the best by similarity. Text similarity has no SQL; tests compare the latter.
add("jn13_all_line_pairs", _all_line_pairs, oracle(
    f"""SELECT p.invoice_id, candidate_id, a.item_id AS a_item, b.item_id AS b_item,
    ({_SIM(a='a.unit_price', b='b.unit_price')} + {_SIM(a='a.quantity', b='b.quantity')}) / 2 AS similarity
    FROM pairs p JOIN items a ON p.invoice_id = a.invoice_id JOIN items b ON candidate_id = b.invoice_id""", _PAIRS))
add("win03_best_line_by_similarity", _best_by_similarity)
