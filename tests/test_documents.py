"""Nested documents, extraction, classification, pages, files and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classify, extract, nested, pages, store
from ledgerloom.plans.returns import returns_summary
from ledgerloom.sources import files, sinks

ROWS = [["Sl", "Description of Goods", "HSN/SAC", "Part", "Quantity", "Rate", "Taxable Amount"],
        ["1", "BASKET", "84049000", "", "6.00 NOS", "₹170,632.00", "1,023,792.00"],
        ["2", "VALVE", "84818030", "x", "1.2.3", "10", "5"], ["", "skip", "", "", "1", "1", "1"],
        ["Total", "", "", "", "", "", "1,023,797.00"], ["3", "short", "1"], ["a", "Total", "1", "2", "3", "4", "5"]]


def document(**change):
    doc = {"file_info": {"filename": "a#1.pdf", "file_size_bytes": 10},
           "form_analysis": {"form_fields": [
               {"key": "Invoice No.", "value": "SB/1", "confidence": 95.0}, {"key": " Dated ", "value": "20-Aug-25", "confidence": 80.0},
               {"key": "Supplier GSTIN/UIN", "value": "24AAGCI9537F1ZG", "confidence": 99.0},
               {"key": "Taxable Value", "value": "", "confidence": 50.0}, {"key": "Amount", "value": "₹ 100.50", "confidence": 91.0},
               {"key": "Tax Amount", "value": "old", "confidence": 70.0}, {"key": "tax amount", "value": "18.09", "confidence": 70.0}]},
           "table_analysis": {"tables": [{"rows": ROWS, "row_count": 7, "column_count": 7, "confidence": 88.0},
                                         {"rows": [["only a header"]], "confidence": 1.0}]},
           "summary": {"document_type": "Invoice/Bill", "confidence_score": 89.0}}
    return {**doc, **change}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("analysis")
    (folder / "textract_analysis_1.json").write_text(json.dumps(document()))
    failed = document(form_analysis={"error": "no call"}, table_analysis={"error": "no call"}, summary={})
    failed["file_info"] = {"filename": "b.pdf"}
    (folder / "textract_analysis_2.json").write_text(json.dumps(failed))
    return files.read_analysis(spark, str(folder)).withColumn("ocr_text", F.lit("TAX INVOICE NO: X-9 terms 45 days 27AAAAA0000A1Z5"))


def test_headers(docs):
    got = {r["filename"]: r.asDict() for r in extract.extract_headers(docs).collect()}
    a, b = got["a#1.pdf"], got["b.pdf"]
    assert (a["invoice_num"], str(a["invoice_date"]), a["supplier_gstin"], a["taxable_value"], a["total_tax"]) == (
        "SB/1", "2025-08-20", "24AAGCI9537F1ZG", 100.5, 18.09)
    assert a["total_value"] == pytest.approx(118.59) and a["payment_terms"] == "45 DAYS"
    assert (b["invoice_num"], b["supplier_gstin"], b["total_value"]) == ("X-9", "27AAAAA0000A1Z5", None)


def test_line_items(docs):
    rows = [tuple(r)[3:8] for r in extract.extract_line_items(docs).orderBy("row_index").collect()]
    assert rows == [("BASKET", "84049000", 6.0, 170632.0, 1023792.0), ("VALVE", "84818030", 0.0, 10.0, 5.0)]
    simple = extract.extract_line_items_by_position(docs).collect()
    assert {r["description"] for r in simple} == {"1", "2", "a"}


def test_normalized_rows_agree_and_repeat(spark, docs):
    companies = spark.createDataFrame([(7, "Known", "24AAGCI9537F1ZG")], "company_id long, legal_name string, gstin string")
    products = spark.createDataFrame([(3, "BASKET", "84049000")], "product_id long, canonical_name string, hsn_code string")
    made = store.normalize_extracted(extract.extract_invoices(docs), companies, products)
    again = store.normalize_extracted(extract.extract_invoices(docs), companies, products)
    heads = {r["invoice_num"]: r.asDict() for r in made["invoices"].collect()}
    assert heads["SB/1"]["supplier_company_id"] == 7 and float(heads["SB/1"]["total_value"]) == 118.59
    lines = made["invoice_item"].collect()
    assert len(lines) == 2 and {r["product_id"] == 3 for r in lines} == {True, False}
    assert sorted(r["item_id"] for r in lines) == sorted(r["item_id"] for r in again["invoice_item"].collect())
    assert made["products"].count() == 1 and made["companies"].count() == 1
    log = {r["filename"]: r.asDict() for r in extract.extraction_log(docs, extract.extract_invoices(docs)).collect()}
    assert log["a#1.pdf"]["success"] and log["a#1.pdf"]["line_items"] == 2
    assert log["a#1.pdf"]["confident_keys"] == ["Invoice No.", "Supplier GSTIN/UIN", "Amount"]


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_invoices_take_their_lines_from_their_own_row(docs):
    one, two = extract.extract_invoices(docs), extract.extract_invoices(docs.unionByName(docs))
    assert "Join" not in optimized(one)
    lines = {r["filename"]: [tuple(x) for x in r["line_items"]] for r in one.collect()}
    assert lines == {"b.pdf": [], "a#1.pdf": [(0, 1, "BASKET", "84049000", 6.0, 170632.0, 1023792.0), (0, 2, "VALVE", "84818030", 0.0, 10.0, 5.0)]}
    by = lambda r: r["filename"]
    assert sorted(two.collect(), key=by) == sorted(one.collect(), key=by)


def test_line_items_find_their_columns_once_a_table(docs):
    plan = optimized(extract.extract_line_items(docs))
    assert plan.index("posexplode(rows") < plan.index("array_max")


def test_normalize_and_summary(docs):
    made = nested.normalize_analysis(docs)
    assert made["form_fields"].count() == 7 and made["tables_meta"].count() == 2
    assert made["table_cells"].count() == sum(map(len, ROWS)) + 1
    got = {r["document"]: r.asDict() for r in nested.analysis_summary(docs).collect()}
    one = got["textract_analysis_1.json"]
    assert (one["total_fields"], one["fields_with_values"], one["total_tables"], one["total_cells"]) == (7, 6, 2, 50)
    assert one["document_type"] == "Invoice/Bill" and got["textract_analysis_2.json"]["total_fields"] == 0


def test_field_map_keeps_the_last(docs):
    row = docs.where("file_info.filename = 'a#1.pdf'").select(nested.field_map(F.col("form_analysis.form_fields")).alias("m")).first()
    assert row["m"]["tax amount"] == "18.09" and "taxable value" not in row["m"]


def block(i, kind, text=None, row=None, col=None, child=(), value=(), entity=None, conf=90.0, layout=None):
    links = [{"Type": k, "Ids": list(ids)} for k, ids in (("VALUE", value), ("CHILD", child)) if ids]
    return {"Id": i, "BlockType": kind, "Text": text, "Confidence": conf, "EntityTypes": entity, "RowIndex": row,
            "ColumnIndex": col, "LayoutType": layout, "Relationships": links or None}


def test_blocks(spark, tmp_path):
    blocks = [block("l1", "LINE", "Tax invoice", conf=80.0), block("l2", "LINE", "No 5", conf=91.0),
              block("k", "KEY_VALUE_SET", entity=["KEY"], child=["w1", "w2"], value=["v", "u"]),
              block("v", "KEY_VALUE_SET", entity=["VALUE"], child=["w3"]), block("u", "KEY_VALUE_SET", entity=["VALUE"], child=["w4"]),
              block("empty", "KEY_VALUE_SET", entity=["KEY"], value=["v"]),
              block("w1", "WORD", "Invoice"), block("w2", "WORD", "No"), block("w3", "WORD", "first"), block("w4", "WORD", "last"),
              block("t", "TABLE", child=["c1", "c2", "c3"]), block("c1", "CELL", row=1, col=1, child=["w1"]),
              block("c2", "CELL", row=3, col=2, child=["w3", "w4"]), block("c3", "CELL", row=1, col=3),
              block("y", "LAYOUT", "t", layout="TITLE"), block("z", "LAYOUT", "t", layout="TITLE")]
    (tmp_path / "b.json").write_text(json.dumps({"doc_id": "d", "Blocks": blocks}))
    df = files.read_blocks(spark, str(tmp_path))
    line = nested.blocks_to_lines(df).first()
    assert (line["full_text"], line["average_confidence"], line["word_count"]) == ("Tax invoice\nNo 5", 85.5, 4)
    assert [(r["key"], r["value"]) for r in nested.blocks_to_form_fields(df).collect()] == [("Invoice No", "last")]
    table = nested.blocks_to_tables(df).first()
    assert table["rows"] == [["Invoice", "", ""], [], ["", "first last"]] and (table["row_count"], table["column_count"]) == (3, 3)
    assert nested.blocks_to_layout(df).first()["element_types"] == ["TITLE"]
    assert [(r["index"], r["block_id"]) for r in nested.list_forms(df).collect()] == [(1, "k"), (2, "v"), (3, "u"), (4, "empty")]
    assert nested.list_tables(df).first()["references"] == ["c1", "c2", "c3"]


BLOCKS = ("doc_id string, Blocks array<struct<Id:string,BlockType:string,Text:string,Confidence:double,EntityTypes:array<string>,RowIndex:int,"
          "ColumnIndex:int,LayoutType:string,Relationships:array<struct<Type:string,Ids:array<string>>>>>")


def test_block_references(spark):
    odd = [block(None, "WORD", "lost"), block("w", "WORD", "old"), block("w", "WORD", "new"), block("n", "WORD"), block("x", "LINE", "no word"),
           block("k", "KEY_VALUE_SET", entity=["KEY"], child=["w", "none", "x", "n", "w"], value=["v", "k", "none"], conf=None),
           block("v", "KEY_VALUE_SET", entity=["VALUE"]), block("alone", "KEY_VALUE_SET", entity=["KEY"], child=["w"]),
           block("t", "TABLE", child=["c", "d", "none", "w"], conf=None), block("c", "CELL", row=2, col=2, child=["w"]), block("d", "CELL", row=2, col=2),
           block("bare", "TABLE"), block("zero", "TABLE", child=["z"]), block("z", "CELL", row=0, col=0, child=["w"]),
           block("first", "TABLE", child=["f"]), block("f", "CELL", child=["w"])]
    df = spark.createDataFrame([("a", odd), ("none", None), ("empty", [])], BLOCKS)
    fields, tables = nested.blocks_to_form_fields(df), nested.blocks_to_tables(df)
    assert [(r["key"], r["value"], r["confidence"]) for r in fields.collect()] == [("new new", "", 0.0), ("new", "", 90.0)]
    assert [(r["table_id"], r["rows"], r["row_count"], r["column_count"]) for r in tables.collect()] == [
        ("t", [[], ["", ""]], 2, 2), ("bare", [], 0, 0), ("zero", [], 0, 0), ("first", [["new"]], 1, 1)]
    assert [(r["table_id"], r["row"], r["col"], r["text"]) for r in nested.blocks_to_cells(df).collect()] == [
        ("t", 1, 1, ""), ("zero", -1, -1, "new"), ("first", 0, 0, "new")]
    for frame in (fields, tables, nested.blocks_to_cells(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_blocks_of_a_large_document(spark):
    """20,000 cells of 100 columns: the matrix comes back whole, found by halving."""
    n = 20_000
    blocks = [block(f"w{i}", "WORD", str(i)) for i in range(n)] + [
        block(f"c{i}", "CELL", row=i // 100 + 1, col=i % 100 + 1, child=[f"w{i}"]) for i in range(n)] + [
        block("t", "TABLE", child=[f"c{i}" for i in reversed(range(n))])]
    rows = nested.blocks_to_tables(spark.createDataFrame([("a", blocks)], BLOCKS)).first()["rows"]
    assert rows == [[str(r * 100 + c) for c in range(100)] for r in range(n // 100)]


def test_table_rows_with_gaps(spark):
    """Columns left of the first, equal places and rows without cells; a row is cut out of the sorted cells, not searched cell by cell."""
    places = {"a": (1, 3), "b": (1, 1), "c": (4, 2), "d": (2, 0), "e": (1, 3), "f": (4, 5), "g": (0, 1)}
    blocks = [block(f"w{i}", "WORD", i) for i in places] + [block(i, "CELL", row=r, col=c, child=[f"w{i}"]) for i, (r, c) in places.items()]
    made = nested.blocks_to_tables(spark.createDataFrame([("x", blocks + [block("t", "TABLE", child=list(places))])], BLOCKS))
    assert made.first()["rows"] == [["b", "", "e"], [], [], ["", "c", "", "", "f"]]
    assert "array_repeat" in optimized(made) and "sequence(0, coalesce" not in optimized(made)


CORPUS = [
    ("TAX INVOICE No SB/25 Invoice Date 20-Aug-25 GSTIN: 24AAXFA5297L1ZN Alpha Pvt Ltd taxable value CGST: 9% SGST: 9% HSN code", "B2B_INVOICE", 0.85),
    ("taxi receipt travel expense reimbursement taxi fare cab hotel bill food lunch", "EXPENSE_SLIP", 0.6),
    ("payment successful upi transaction id 123 credited to account via phonepe", "PAYMENT_PROOF", 0.6),
    ("purchase order po number 77 vendor delivery date order number procurement", "PURCHASE_ORDER", 0.6),
    ("some unclear words", "B2B_INVOICE", 0.6)]


def test_classification(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CORPUS)], "id int, body string")
    got = {r["id"]: r for r in classify.classify(df, "body", "id").collect()}
    for i, (_, kind, least) in enumerate(CORPUS):
        assert got[i]["document_type"] == kind and got[i]["confidence_score"] >= least
    assert got[0]["metadata"]["has_gstin"] and not got[0]["forced"] and got[4]["forced"]
    assert "gstin" in got[0]["keywords"] and got[0]["reasoning"]


def test_metadata_and_reasons(spark):
    df = spark.createDataFrame([(0, CORPUS[0][0] + " payment proof receipt purchase order", ["f"], []), (1, "", None, ["t"])],
                               "id int, body string, fields array<string>, tables array<string>")
    got = {r["id"]: r for r in classify.classify(df, "body", "id", "fields", "tables").collect()}
    assert [(got[i]["metadata"]["has_form_fields"], got[i]["metadata"]["has_tables"]) for i in (0, 1)] == [(True, False), (False, True)]
    told = "; ".join(got[0]["reasoning"])
    assert "Tax id, company form and tax names together" in told and "Structure patterns: " in told and "Conflicting terms: " in told
    assert not any("patterns" in r or "terms" in r for r in got[1]["reasoning"])
    plain = classify.classify(df, "body", "id").first()["metadata"]
    assert (plain["has_form_fields"], plain["has_tables"]) == (False, False)


def test_analysis_text(docs):
    text = docs.where("file_info.filename = 'a#1.pdf'").select(classify.analysis_text(docs).alias("t")).first()["t"]
    assert "a#1.pdf" in text and "invoice no. sb/1" in text and "basket" in text and "45 days" in text and "invoice/bill" in text


def test_pages(spark):
    html = """Alpha Works (Active)
    <table><tr><td>Legal Name</td><td><b>Alpha</b></td></tr><tr><td>Legal Name</td><td>Alpha Works</td></tr>
    <tr><td>State</td><td>24 - Gujarat (GJ)</td></tr><tr><td>Nature of Business Activities</td><td>▪ Trade ▪ Repair &amp; Service</td></tr>
    <tr><td>GSTR-3B</td><td>Jan 2019</td><td>12-Feb-2019</td></tr><tr><td>GSTR-1</td><td>Feb 2019</td><td>1-Mar-2019</td><td>Late</td><td>₹10</td><td>7</td></tr></table>
    GSTR-1 for the Return Period of Feb 2019 was filed on 2-Mar-2019. GSTR-1 for the Return Period of Mar 2019 was filed on 11-Apr-2019."""
    df = spark.createDataFrame([("http://p/24AAXFA5297L1ZN/x", html), ("http://p/none", "<p>x</p>")], "url string, html string")
    got = pages.parse_taxpayer_pages(df).collect()
    assert len(got) == 1 and (got[0]["legal_name"], got[0]["state"], got[0]["nature_of_business"]) == (
        "Alpha Works", "Gujarat", "Trade, Repair & Service")
    filed = [(r["return_type"], r["period"], r["status"], r["amount"], r["liability"])
             for r in pages.parse_returns(df).orderBy("position").collect()]
    assert filed == [("GSTR-3B", "Jan 2019", "Filed", None, None), ("GSTR-1", "Feb 2019", "Late", "₹10", "7"),
                     ("GSTR-1", "Mar 2019", "Filed", None, None)]


def test_nested_tables(spark):
    html = """<table><tr><td>menu<td><table><TR class="x"><th>h</th><td>State</td><td> 24 - <b>Gujarat</b> <!-- <td>no</td> -->(GJ)</td></tr>
    <tr><td>PAN</td><td>A &amp; B<tr><td>one cell</table></td><td>after</td></tr><tr><td>GSTR-1</td><td>p</td><td>d</td></tr></table></table>
    <td>stray</td><table><tr></tr><tr><td>left <table><tr><td>open"""
    df = spark.createDataFrame([(html,), ("",), ("<p>a < b</p>",), (None,)], "html string")
    got = [r["r"] for r in df.select(pages.table_rows(F.col("html")).alias("r")).collect()]
    inner = [["State", "24 -Gujarat(GJ)"], ["PAN", "A & B"], ["one cell"]]
    assert got == [[["menu", "hState24 -Gujarat(GJ)PANA & Bone cell", "after"], *inner, ["GSTR-1", "p", "d"], [], ["leftopen"], ["open"]], [], [], None]
    both = df.limit(1).select(pages.table_rows(F.col("html"), "td|th").alias("r")).first()["r"]
    assert both[1] == ["h", *inner[0]]
    plan = df.select(pages.table_rows(F.col("html")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_labels_and_listed_returns(spark):
    html = """<table><tr><td>GSTIN</td><td>24AAXFA5297L1ZZ</td></tr></table>
    recently filed the following GST Returns: ▪ GSTR10 for the Return Period of Mar. 2019 was filed on 11.04.2019 ▪ GSTR9C for the Return Period of 2.19 was filed on 1.5.19
    ▪ GSTR7 for the Return Period of x. was filed on y."""
    df = spark.createDataFrame([("http://p/24AAXFA5297L1ZN/x", html)], "url string, html string")
    assert pages.parse_taxpayer_pages(df).first()["gstin"] == "24AAXFA5297L1ZZ"
    filed = [(r["position"], r["return_type"], r["period"], r["filed_date"], r["status"]) for r in pages.parse_returns(df).collect()]
    assert filed == [(0, "GSTR10", "Mar. 2019", "11.04.2019", "Filed")]


def test_hsn_pages(spark):
    table = "<table><tr><th>HSN/SAC Code Input</th></tr><tr><td>1</td><td>84049000</td><td>PARTS OF BOILERS</td><td>VALID</td></tr></table> GST: 7% Rate: 18%"
    lines = "We use cookies on this website\n84049000\nAuxiliary plant for boilers\n"
    df = spark.createDataFrame([("84049000", "u", table), ("84049000", "v", lines), ("1111", "w", "nothing")], "hsn_code string, url string, html string")
    got = [(r["valid"], r["description"], r["gst_rate"], r["cgst_rate"]) for r in pages.parse_hsn_pages(df).collect()]
    assert got == [(True, "PARTS OF BOILERS", "18%", "9.0%"), (True, "Auxiliary plant for boilers", None, None),
                   (False, "HSN/SAC code not found or invalid", None, None)]


def test_returns_by_text_and_by_date(spark):
    rows = [("g", "GSTR-3B", "Jul", "29-Jul-2019"), ("g", "GSTR-1", "Oct", "04-Oct-2019"), ("g", "GSTR-3B", "Nov", "07-Nov-2019"), ("g", "GSTR-1", "x", "")]
    df = spark.createDataFrame(rows, "gstin string, return_type string, period string, filed_date string")
    by_text, by_date = returns_summary(df).first(), returns_summary(df, by_date=True).first()
    assert (by_text["latest_filing"]["date_str"], by_text["oldest_filing"]["date_str"]) == ("29-Jul-2019", "04-Oct-2019")
    assert (by_date["latest_filing"]["date_str"], by_date["oldest_filing"]["date_str"]) == ("07-Nov-2019", "29-Jul-2019")
    assert by_text["return_types"] == {"GSTR-3B": 2, "GSTR-1": 2} and by_text["filing_frequency"] == {"2019": 3}


def test_files(spark, tmp_path):
    for name in ("1_ocr.json", "17_ocr.json", "9_ocr.json", "textract_analysis_17.json", "textract_analysis_1_2025.json", "textract_analysis_17_2025.json"):
        (tmp_path / name).write_text(json.dumps({"filename": name, "ocr_text": "t"}))
    (tmp_path / "1_ocr.txt").write_text("line 1\nline 2")
    listed = files.list_files(spark, str(tmp_path))
    assert listed.count() == 6
    got = {r["doc_id"]: r["analysis"] for r in files.pair_documents(listed).collect()}
    # The id is a prefix, so document 1 also sees the files of 17 and takes the first by name.
    assert got == {"1": "textract_analysis_17.json", "17": "textract_analysis_17.json"}
    wanted = spark.createDataFrame([("17",), ("1",), ("x",)], "name string")
    tiers = {r["name"]: (r["analysis"], r["tier"]) for r in files.resolve_analysis_files(listed, wanted).collect()}
    assert tiers == {"17": ("textract_analysis_17.json", 1), "1": ("textract_analysis_1_2025.json", 2)}
    assert files.read_ocr(spark, str(tmp_path / "1_ocr.json")).first()["ocr_text"] == "t"
    assert files.read_ocr_text(spark, str(tmp_path / "1_ocr.txt")).first()["ocr_text"] == "line 1\nline 2"
    long = spark.createDataFrame([("3P1400001#5001866978",)], "name string")
    other = spark.createDataFrame([("textract_analysis_old-3P1400001_5001866978.json",)], "name string")
    assert files.resolve_analysis_files(other, long).first()["tier"] == 4


def test_sinks_and_readers(spark, tmp_path):
    registry = spark.createDataFrame([("g", "A")], "gstin string, legal_name string")
    filings = spark.createDataFrame([("g", "GSTR-1", "Jan", "01-Feb-2019")], "gstin string, return_type string, period string, filed_date string")
    sinks.write_registry_json(registry, filings, str(tmp_path / "r"))
    back = files.read_registry(spark, str(tmp_path / "r")).first()
    assert back["gst_returns"]["returns_summary"]["latest_filing"]["date_str"] == "01-Feb-2019"
    sinks.write_hsn_json(spark.createDataFrame([("8404", True)], "hsn_code string, valid boolean"), str(tmp_path / "h"))
    assert files.read_hsn(spark, str(tmp_path / "h")).first()["valid"]
    sinks.write_batch_report(registry, filings, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "summary")).count() == 1
    invoice = {"invoice_number": "I", "items": [{"description": "a", "quantity": 2.0}, {"description": "b"}], "totals": {"subtotal": 1.0}}
    (tmp_path / "s.json").write_text(json.dumps(invoice))
    assert files.structured_items(files.read_structured_invoice(spark, str(tmp_path / "s.json"))).count() == 2


def test_recover_json(spark):
    df = spark.createDataFrame([('{"a":1}',), ('x {"a":2} y',), ("none",), (None,)], "t string")
    got = [(r["r"]["json"], r["r"]["recovered"], r["r"]["raw"]) for r in df.select(nested.recover_json(F.col("t")).alias("r")).collect()]
    assert got[:3] == [('{"a":1}', False, None), ('{"a":2}', True, None), (None, False, "none")]
