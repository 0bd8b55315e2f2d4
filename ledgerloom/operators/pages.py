"""Portal pages as rows (url, html) to registry records, filings and tariff codes.

Pages are cut into tags and texts with one regular expression on the column; tables come from
one fold over their tags that knows how deep it is. A page never leaves the JVM or its task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.functions.arrays import below, bound, by_id, found, jumps_of

# Labels of the details table and the columns they fill.
LABELS = {
    "Legal Name": "legal_name", "Company Status": "status", "Trade Name": "trade_name", "GSTIN": "gstin", "PAN": "pan", "State": "state",
    "PIN Code": "pin_code", "TaxPayer Type": "taxpayer_type", "Constitution of Business": "constitution",
    "Registration Date": "registration_date", "Cancellation Date": "cancellation_date",
    "State Jurisdiction": "state_jurisdiction", "Centre Jurisdiction": "centre_jurisdiction",
    "Nature of Business Activities": "nature_of_business",
}
RETURN_TYPES = r"GSTR-(1|3B|2|4|5|6|7|8|9)|GSTR1|GSTR3B"
COMPANY_WORDS = "LTD|LIMITED|PRIVATE|PVT|COMPANY|CORP"
PAGE_RATES = ("0", "5", "12", "18", "28")
RATE_PATTERNS = (r"(?i)GST[:\s]*(\d{1,2})%", r"(?i)Rate[:\s]*(\d{1,2})%", r"(?i)(\d{1,2})%[:\s]*GST",
                 r"(?i)Tax[:\s]*(\d{1,2})%")
TEXT_RETURNS = (
    r"(?i)(GSTR-?[0-9][AB]?)\s+for\s+the\s+Return\s+Period\s+of\s+([^.]+?)\s+was\s+filed\s+on\s+([^.]+)",
    r"(?i)(GSTR[0-9][AB]?)\s+.*?([A-Za-z]+ 20\d{2})\s+.*?filed.*?(\d{1,2}-[A-Za-z]+-20\d{2})",
    r"(?i)(GSTR-[0-9][AB]?)\s*-\s*([^-]+?)\s*-\s*Filed:\s*([^,\n]+)",
)
RECENT_LIST = r"(?s)recently filed the following GST Returns:(.+?)(?:\n|$)"
LISTED_RETURN = r"(GSTR\d+[AB]?)\s+for\s+the\s+Return\s+Period\s+of\s+([^▪]+?)was\s+filed\s+on\s+([^▪]+)"
BOILERPLATE = "cookies|website|marketing"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES, text)


def page_text(html: Column) -> Column:
    """Text of a page without tags; line breaks stay where they are."""
    return _decoded(F.regexp_replace(html, r"<[^>]*>", ""))


# Tags, comments and the texts between them, in page order.
_TOKEN = r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<"
_TABLE_TAG = r"(?i)^<(/?(?:table|tr|td|th))\b"


def _text_of(tokens: Column) -> Column:
    """The texts of a run of tokens, each without white space around it."""
    texts = F.filter(tokens, lambda t: ~t.rlike(r"^<."))
    return F.trim(_decoded(F.array_join(F.transform(texts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), "")))


def _cell_spans(tokens: Column) -> Column:
    """(cells, rows): of every cell its row, numbered as rows begin, and the tokens it spans; the number of rows.

    ``top`` is what is open in the innermost table (row and first token of the cell, -1 for none), ``outer`` the same of the
    tables around it. A cell ends at its end tag or where another cell, row or the table's end begins, as browsers read it.
    A cell outside of any row is none.
    """
    number = lambda n: F.lit(n).cast("int")
    empty = F.struct(number(-1).alias("row"), number(-1).alias("start"), F.lit("").alias("kind"))
    tags = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), F.lower(F.regexp_extract(t, _TABLE_TAG, 1)).alias("name"))),
                    lambda t: t["name"] != "")
    closing = F.concat(tags, F.array(F.struct(F.size(tokens).alias("at"), F.lit("/page").alias("name"))))
    no_cells = F.array().cast("array<struct<id:struct<row:int,start:int>,stop:int,kind:string>>")

    def state(top, outer, rows, cells):
        return F.struct(top.alias("top"), outer.alias("outer"), rows.alias("rows"), cells.alias("cells"))

    def opened(row, start, kind):
        return F.struct(row.alias("row"), start.alias("start"), kind.alias("kind"))

    def step(s, tag):
        top, name, at = s["top"], tag["name"], tag["at"]
        is_open = (top["row"] >= 0) & (top["start"] >= 0)
        ended = F.struct(F.struct(top["row"].alias("row"), top["start"].alias("start")).alias("id"), at.alias("stop"), top["kind"].alias("kind"))
        # A new table begins inside of the open cell; all other tags end it.
        cells = F.when(is_open & (name != "table"), F.concat(s["cells"], F.array(ended))).otherwise(s["cells"])
        return (F.when(name == "table", state(empty, F.concat(s["outer"], F.array(top)), s["rows"], cells))
                .when(name == "/table", state(F.coalesce(F.try_element_at(s["outer"], F.lit(-1)), empty),
                                              F.slice(s["outer"], 1, F.greatest(F.size(s["outer"]) - 1, F.lit(0))), s["rows"], cells))
                .when(name == "tr", state(opened(s["rows"], number(-1), F.lit("")), s["outer"], s["rows"] + 1, cells))
                .when(name == "/tr", state(empty, s["outer"], s["rows"], cells))
                .when(name.isin("td", "th"), state(opened(top["row"], at + 1, name), s["outer"], s["rows"], cells))
                .otherwise(state(opened(top["row"], number(-1), F.lit("")), s["outer"], s["rows"], cells)))

    def left_open(s):
        """Cells of outer tables that nothing closed last to the end of the page."""
        rest = F.transform(F.filter(s["outer"], lambda o: (o["row"] >= 0) & (o["start"] >= 0)), lambda o: F.struct(
            F.struct(o["row"].alias("row"), o["start"].alias("start")).alias("id"), F.size(tokens).alias("stop"), o["kind"].alias("kind")))
        return F.struct(F.concat(s["cells"], rest).alias("cells"), s["rows"].alias("rows"))
    none_open = F.array().cast("array<struct<row:int,start:int,kind:string>>")
    return F.aggregate(closing, state(empty, none_open, number(0), no_cells), step, left_open)


def table_rows(html: Column, cells: str = "td") -> Column:
    """Rows of all tables, as they begin, as arrays of cell texts (``cells``: tag names, joined by |).

    A row has the cells of its own table only; the text of a cell is all text in it, tables within it included.
    """
    kinds = cells.split("|")

    def rows(tokens, seen):
        index = by_id(F.filter(seen["cells"], lambda c: c["kind"].isin(*kinds)))

        def cells_of(r, index, jumps):
            before = lambda r: below(index, jumps, F.struct(r.alias("row"), F.lit(-1).alias("start")), lambda at: at + 1)
            return bound(before(r), lambda a: F.transform(F.slice(index, a + 1, before(r + 1) - a), lambda c: _text_of(
                F.slice(tokens, c["id"]["start"] + 1, c["stop"] - c["id"]["start"]))))
        numbers = F.filter(F.sequence(F.lit(0), seen["rows"]), lambda r: r < seen["rows"])
        return bound(index, lambda index: bound(jumps_of(index), lambda jumps: F.transform(numbers, lambda r: cells_of(r, index, jumps))))
    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return bound(tokens, lambda tokens: bound(_cell_spans(tokens), lambda seen: rows(tokens, seen)))


def labelled(rows: Column) -> Column:
    """(id, turned, value) of the rows of two cells, sorted by label, of equal labels the last first."""
    return by_id(F.filter(F.transform(rows, lambda r, i: F.struct(
        F.get(r, F.lit(0)).alias("id"), F.bitwise_not(i).alias("turned"), F.get(r, F.lit(1)).alias("value"), (F.size(r) == 2).alias("pair"))),
        lambda r: r["pair"]))


def gstin_of_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, rf"({fn.GSTIN})", 1), F.lit(""))


def name_of_heading(text: Column) -> Column:
    """The words before the first bracket at the start of a page."""
    return F.nullif(F.trim(F.regexp_extract(text, r"^([^(]+)\s*\([^)]+\)", 1)), F.lit(""))


def clean_state(text: Column) -> Column:
    """'24 - Name (NN)' to 'Name'."""
    inner = F.trim(F.regexp_extract(text, r"\d+\s*-\s*(.+?)(?:\s*\([^)]+\))?$", 1))
    return F.coalesce(F.nullif(inner, F.lit("")), text)


def clean_activities(text: Column) -> Column:
    """A bulleted list to one with commas."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"▪\s*([^▪]+)"), F.lit(1)), lambda x: F.trim(x))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(text)


def parse_taxpayer_pages(pages: DataFrame) -> DataFrame:
    """One registry record per page whose address holds a tax id. Of equal labels the later row counts; a tax id in the
    table goes before that of the address."""
    read = pages.withColumns({"gstin": gstin_of_url(F.col("url"))}).where("gstin IS NOT NULL").withColumns({
        "_pairs": labelled(table_rows(F.col("html"))), "_text": page_text(F.col("html"))}).withColumn("_jumps", jumps_of(F.col("_pairs")))
    columns = []
    for label, name in LABELS.items():
        value = found(F.col("_pairs"), F.col("_jumps"), F.lit(label))["value"]
        if name == "state":
            value = clean_state(value)
        elif name == "nature_of_business":
            value = clean_activities(value)
        elif name == "legal_name":
            value = F.coalesce(F.nullif(value, F.lit("")), name_of_heading(F.col("_text")))
        elif name == "gstin":
            value = F.coalesce(value, F.col("gstin"))
        columns.append(value.alias(name))
    return read.select("url", *columns)


def _filing(kind, period, filed, status, amount, liability) -> Column:
    return F.struct(kind.alias("return_type"), period.alias("period"), filed.alias("filed_date"), status.alias("status"),
                    amount.alias("amount"), liability.alias("liability"))


def _text_filings(text: Column) -> Column:
    nothing = F.lit(None).cast("string")
    found = []
    for pattern in TEXT_RETURNS:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
        found.append(F.transform(F.arrays_zip(*groups), lambda z: _filing(
            F.trim(z["0"]), F.trim(z["1"]), F.trim(z["2"]), F.lit("Filed"), nothing, nothing)))
    return F.concat(*found)


def _listed_filings(text: Column) -> Column:
    """Filings of the sentence that lists the latest returns, with bullets between them."""
    nothing = F.lit(None).cast("string")
    part = F.regexp_extract(text, RECENT_LIST, 1)
    groups = [F.regexp_extract_all(part, F.lit(LISTED_RETURN), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*groups), lambda z: _filing(
        F.trim(z["0"]), F.trim(z["1"]), F.trim(z["2"]), F.lit("Filed"), nothing, nothing))


def parse_returns(pages: DataFrame, keep: int | None = None) -> DataFrame:
    """(gstin, position, filing columns): filings from tables and, where those have fewer than three,
    from sentences that name a type and period not seen yet; where there are none at all, from the list of
    recently filed returns. The first ``keep`` of a page if given."""
    nothing = F.lit(None).cast("string")

    def from_row(r):
        extra = F.filter(F.slice(r, 5, F.size(r)), lambda c: (c != "") & (F.contains(c, F.lit("₹")) | c.rlike(r"\d")))
        return _filing(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(2)), F.coalesce(F.get(r, F.lit(3)), F.lit("Filed")),
                       F.get(extra, F.lit(0)), F.when(F.size(extra) > 1, F.try_element_at(extra, F.lit(-1))).otherwise(nothing))
    read = pages.select(
        gstin_of_url(F.col("url")).alias("gstin"),
        F.transform(F.filter(table_rows(F.col("html")), lambda r: (F.size(r) >= 3) & F.upper(F.get(r, F.lit(0))).rlike(RETURN_TYPES)),
                    from_row).alias("tabled"), _text_filings(page_text(F.col("html"))).alias("told"), _listed_filings(page_text(F.col("html"))).alias("listed")
    ).where("gstin IS NOT NULL")

    def same(a):
        return lambda b: (b["return_type"] == a["return_type"]) & (b["period"] == a["period"])
    fresh = F.filter("told", lambda f, i: ~F.exists("tabled", same(f)) & ~F.exists(F.slice("told", 1, i), same(f)))
    every = (F.when(F.size("tabled") + F.size("told") == 0, F.col("listed"))
             .when(F.size("tabled") < 3, F.concat("tabled", fresh)).otherwise(F.col("tabled")))
    # Outer, then filtered: a plain explode would read every page twice.
    return read.select("gstin", F.posexplode_outer(every if keep is None else F.slice(every, 1, keep)).alias("position", "f")).where(
        "f IS NOT NULL").select("gstin", "position", "f.*")


def name_near_gstin(text: Column, gstin: Column) -> Column:
    """A long line with a company word within five lines of the first mention of a tax id."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, gstin)), F.lit(True)).cast("int")
    start = F.greatest(F.lit(1), at - 5)
    near = F.when(at > 0, F.slice(lines, start, at + 5 - start + 1))
    fits = F.filter(near, lambda x: (F.length(x) > 10) & ~F.contains(x, gstin) & ~x.rlike(r"^\d+$")
                    & F.upper(x).rlike(COMPANY_WORDS))
    return F.get(fits, F.lit(0))


def rate_in_text(text: Column) -> Column:
    """First rate in force that one of the patterns finds, patterns in order."""
    def first(pattern):
        numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.get(F.filter(numbers, lambda n: n.isin(*PAGE_RATES)), F.lit(0))
    return F.coalesce(*[first(p) for p in RATE_PATTERNS])


def parse_hsn_pages(pages: DataFrame) -> DataFrame:
    """Tariff code pages: (hsn_code, valid, description, rates). ``pages``: hsn_code, url, html.

    The description is the first fitting cell after the code in a result table, else the
    longest fitting cell after it in any table, else the first fitting line near it.
    """
    code = F.col("hsn_code")
    read = pages.select("hsn_code", table_rows(F.col("html"), "td|th").alias("_rows"), page_text(F.col("html")).alias("_text"),
                        F.contains("html", F.lit("HSN/SAC Code Input")).alias("_results"))

    def after(r):
        at = F.array_position(F.transform(r, lambda c: F.contains(c, code)), F.lit(True)).cast("int")
        return F.when(at > 0, F.slice(r, at + 1, F.size(r)))

    def plain(c, least):
        return (F.length(c) > least) & ~F.lower(c).rlike(BOILERPLATE) & ~c.rlike(r"^\d+$")
    cells = F.flatten(F.transform(F.filter("_rows", lambda r: F.exists(r, lambda c: F.contains(c, code))), after))
    listed = F.filter(cells, lambda c: plain(c, 10) & ~F.upper(c).isin("VALID", "INVALID"))
    longest = F.array_max(F.transform(F.filter(listed, lambda c: ~F.contains(c, F.lit("%"))),
                                      lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    lines = F.transform(F.split("_text", "\n"), lambda x: F.trim(x))
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, code)), F.lit(True)).cast("int")
    start = F.greatest(F.lit(1), at - 2)
    near = F.filter(F.slice(lines, start, at + 4 - start + 1), lambda x: plain(x, 15) & ~F.contains(x, code)
                    & ~F.lower(x).rlike("rate|gst|analytics"))
    described = F.coalesce(F.when(F.col("_results"), F.get(listed, F.lit(0))), longest, F.when(at > 0, F.get(near, F.lit(0))),
                           F.concat(F.lit("HSN Code "), code, F.lit(" - Details not available")))
    valid = F.contains("_text", code)
    rate = F.when(valid, rate_in_text(F.col("_text")))
    half = F.when(rate.cast("int") > 0, F.concat((rate.cast("double") / 2).cast("string"), F.lit("%")))
    full = F.when(rate.isNotNull(), F.concat(rate, F.lit("%")))
    return read.select(
        "hsn_code", valid.alias("valid"), F.when(valid, described).otherwise("HSN/SAC code not found or invalid").alias("description"),
        full.alias("gst_rate"), half.alias("cgst_rate"), half.alias("sgst_rate"),
        F.when(rate.cast("int") > 0, full).alias("igst_rate"))
