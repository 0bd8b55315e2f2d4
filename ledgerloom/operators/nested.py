"""Nested documents to rows: OCR blocks, form fields, tables.

What stays within one document is done on its arrays, without a shuffle. References between
blocks are looked up in sorted arrays of the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.arrays import below, by_id, found, jumps_of


def _of_type(kind: str) -> Column:
    return F.filter("Blocks", lambda b: b["BlockType"] == kind)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return F.coalesce(F.round(F.try_divide(total, F.size(values)), 2), F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def blocks_to_lines(blocks: DataFrame) -> DataFrame:
    """Per document: text of its lines, their number, mean confidence and word count."""
    lines = _of_type("LINE")
    return (blocks.select("doc_id", lines.alias("l"))
            .select("doc_id", F.array_join(F.transform("l", lambda b: F.coalesce(b["Text"], F.lit(""))), "\n").alias("full_text"),
                    F.size("l").alias("total_lines"), _mean(F.transform("l", lambda b: b["Confidence"])).alias("average_confidence"))
            .withColumn("word_count", word_count(F.col("full_text"))))


# References ---------------------------------------------------------------------------

def _references(block: Column, kind: str) -> Column:
    no_ids = F.array().cast("array<string>")
    linked = F.filter(block["Relationships"], lambda r: r["Type"] == kind)
    return F.coalesce(F.flatten(F.transform(linked, lambda r: F.coalesce(r["Ids"], no_ids))), no_ids)


def _with_words(blocks: DataFrame) -> DataFrame:
    words = F.array_compact(F.transform("Blocks", lambda b, i: F.when(b["BlockType"] == "WORD", F.struct(
        b["Id"].alias("id"), F.bitwise_not(i).alias("turned"), b["Text"].alias("text")))))
    return blocks.select("doc_id", "Blocks", by_id(words).alias("words")).withColumn("word_jumps", jumps_of(F.col("words")))


def _text_below(block: Column) -> Column:
    """The words below a block, in order of its references."""
    return F.trim(F.array_join(F.transform(_references(block, "CHILD"), lambda i: found(
        F.col("words"), F.col("word_jumps"), i)["text"]), " "))


def blocks_to_form_fields(blocks: DataFrame) -> DataFrame:
    """(doc_id, position, key, value, confidence): key blocks with the text of their value block.

    Of several value blocks the last one counts, a reference to none or to a key is passed over, and a
    key without words is no field. References are resolved on the arrays of the row, without a shuffle.
    """
    sets = F.array_compact(F.transform("Blocks", lambda b, i: F.when(b["BlockType"] == "KEY_VALUE_SET", F.struct(
        b["Id"].alias("id"), F.bitwise_not(i).alias("turned"), i.alias("position"),
        F.coalesce(F.array_contains(b["EntityTypes"], "KEY"), F.lit(False)).alias("is_key"),
        _text_below(b).alias("text"), b["Confidence"].alias("confidence"), _references(b, "VALUE").alias("values")))))
    read = _with_words(blocks).select("doc_id", sets.alias("sets"))
    split = read.select("doc_id", F.filter("sets", lambda s: s["is_key"] & (s["text"] != "")).alias("keys"), by_id(F.filter(
        F.transform("sets", lambda s: F.struct(s["id"].alias("id"), s["turned"].alias("turned"), s["is_key"].alias("is_key"), s["text"].alias("text"))),
        lambda s: ~s["is_key"])).alias("values"))

    def value(k):
        texts = F.array_compact(F.transform(k["values"], lambda i: found(F.col("values"), F.col("jumps"), i)["text"]))
        return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))
    fields = F.transform("keys", lambda k: F.struct(
        k["position"].alias("position"), k["text"].alias("key"), value(k).alias("value"),
        F.coalesce(k["confidence"], F.lit(0.0)).alias("confidence")))
    made = split.withColumn("jumps", jumps_of(F.col("values"))).select("doc_id", fields.alias("fields"))
    # Outer, then filtered: a plain inline would resolve every document twice.
    return made.select("doc_id", F.inline_outer("fields")).where("key IS NOT NULL")


def _grids(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_id, position, confidence, grid): cells of a table sorted by place, of equal places the last first."""
    cells = F.array_compact(F.transform("Blocks", lambda b, i: F.when(b["BlockType"] == "CELL", F.struct(
        b["Id"].alias("id"), F.bitwise_not(i).alias("turned"), (F.coalesce(b["RowIndex"], F.lit(1)) - 1).alias("row"),
        (F.coalesce(b["ColumnIndex"], F.lit(1)) - 1).alias("col"), _text_below(b).alias("text")))))
    read = _with_words(blocks).select("doc_id", "Blocks", by_id(cells).alias("cells")).withColumn("jumps", jumps_of(F.col("cells")))

    def grid(table):
        placed = F.transform(_references(table, "CHILD"), lambda i: found(F.col("cells"), F.col("jumps"), i))
        return F.sort_array(F.array_compact(F.transform(placed, lambda c, i: F.when(c.isNotNull(), F.struct(
            F.struct(c["row"].alias("row"), c["col"].alias("col")).alias("id"), F.bitwise_not(i).alias("turned"), c["text"].alias("text"))))))
    tables = F.array_compact(F.transform("Blocks", lambda b, i: F.when(b["BlockType"] == "TABLE", F.struct(
        b["Id"].alias("table_id"), i.alias("position"), F.coalesce(b["Confidence"], F.lit(0.0)).alias("confidence"), grid(b).alias("grid")))))
    return read.select("doc_id", tables.alias("tables")).select("doc_id", F.inline_outer("tables")).where("grid IS NOT NULL")


def blocks_to_cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_id, position, confidence, row, col, text), 0-based; of two cells in one place the later stays."""
    first = F.filter("grid", lambda c, i: (i == 0) | (c["id"] != F.get("grid", i - 1)["id"]))
    cells = F.transform(first, lambda c: F.struct(c["id"]["row"].alias("row"), c["id"]["col"].alias("col"), c["text"].alias("text")))
    return _grids(blocks).select("doc_id", "table_id", "position", "confidence", cells.alias("cells")).select(
        "doc_id", "table_id", "position", "confidence", F.inline_outer("cells")).where("row IS NOT NULL")


def blocks_to_tables(blocks: DataFrame) -> DataFrame:
    """One row per table with its matrix: missing columns are empty text, rows keep their own length.

    A table without cells has no rows. Cells are found by their place in a sorted array, without a shuffle.
    """
    read = _grids(blocks).withColumns({"jumps": jumps_of(F.col("grid")), "last": F.try_element_at("grid", F.lit(-1))["id"]["row"]})
    grid, jumps = F.col("grid"), F.col("jumps")

    def start(r):
        """Place (from 1) of the first cell of a row in a column of at least 0."""
        return below(grid, jumps, F.struct(r.alias("row"), F.lit(0).alias("col")), lambda at: at + 2)

    def texts(cells):
        """Texts of a row's cells, sorted by column, with empty ones between; of equal places the first counts."""
        def col(i):
            return F.coalesce(F.get(cells, i)["id"]["col"], F.lit(-1))
        return F.flatten(F.transform(cells, lambda c, i: F.when((i > 0) & (col(i - 1) == c["id"]["col"]), F.array().cast("array<string>")).otherwise(
            F.concat(F.array_repeat(F.lit(""), c["id"]["col"] - col(i - 1) - 1), F.array(F.coalesce(c["text"], F.lit("")))))))
    # Two searches a row: where it begins, and where the next does.
    starts = F.transform(F.sequence(F.lit(0), "last"), lambda r: F.struct(start(r).alias("own"), start(r + 1).alias("next"), r.alias("row")))
    slices = F.transform(starts, lambda s: F.filter(F.slice(grid, s["own"], s["next"] - s["own"]), lambda c: c["id"]["row"] == s["row"]))
    rows = F.transform(slices, texts)
    nothing = F.array().cast("array<array<string>>")
    return read.select("doc_id", "table_id", "position", F.when(F.col("last") >= 0, rows).otherwise(nothing).alias("rows"), "confidence").withColumns({
        "row_count": F.size("rows"), "column_count": F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))})


def blocks_to_layout(blocks: DataFrame) -> DataFrame:
    found = blocks.select("doc_id", _of_type("LAYOUT").alias("l"))
    return found.select("doc_id", F.transform("l", lambda b: F.struct(
        b["BlockType"].alias("type"), b["LayoutType"].alias("layout_type"), b["Confidence"].alias("confidence"),
        F.coalesce(b["Text"], F.lit("")).alias("text"))).alias("layout_elements"), F.size("l").alias("total_elements"),
        F.array_sort(F.array_distinct(F.filter(F.transform("l", lambda b: b["LayoutType"]), lambda t: t.isNotNull())))
        .alias("element_types"))


def field_map(fields: Column) -> Column:
    """Lower-case trimmed key to value, for fields with a value; of equal keys the last one counts."""
    filled = F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    pairs = F.transform(filled, lambda f: F.struct(F.trim(F.lower(f["key"])).alias("key"), f["value"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def list_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """(doc_id, index, block_id, confidence, references) of TABLE or KEY_VALUE_SET blocks, from 1."""
    return blocks.select("doc_id", F.posexplode(_of_type(kind)).alias("i", "b")).select(
        "doc_id", (F.col("i") + 1).alias("index"), F.col("b.Id").alias("block_id"), F.col("b.Confidence").alias("confidence"),
        F.flatten(F.transform("b.Relationships", lambda r: r["Ids"])).alias("references"))


def list_tables(blocks: DataFrame) -> DataFrame:
    return list_blocks(blocks, "TABLE")


def list_forms(blocks: DataFrame) -> DataFrame:
    return list_blocks(blocks, "KEY_VALUE_SET")


def summary_type(fields: Column) -> Column:
    keys = F.lower(F.array_join(F.transform(fields, lambda f: f["key"]), " "))

    def has(*words):
        test = F.contains(keys, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(keys, F.lit(w))
        return test
    return (F.when(has("invoice", "bill"), "Invoice/Bill").when(has("receipt"), "Receipt")
            .when(has("contract", "agreement"), "Contract/Agreement").when(has("form", "application"), "Form/Application")
            .otherwise("Unknown"))


def recover_json(text: Column) -> Column:
    """(json, recovered, raw): the text if it is an object, else its outermost braces, else only the raw text."""
    whole = F.when(F.startswith(F.trim(text), F.lit("{")), F.get_json_object(text, "$"))
    inner = F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$")
    return F.struct(F.coalesce(whole, inner).alias("json"), (whole.isNull() & inner.isNotNull()).alias("recovered"),
                    F.when(whole.isNull() & inner.isNull(), text).alias("raw"))


def normalize_analysis(docs: DataFrame, key: str = "file_name") -> dict[str, DataFrame]:
    """documents, form_fields, tables_meta and table_cells of analysis documents, with 0-based indexes."""
    documents = docs.select(F.col(key).alias("document"), "file_info.filename", "file_info.file_size_bytes", "file_info.analyzed_at",
                            "summary.document_type", "summary.confidence_score")
    fields = docs.select(F.col(key).alias("document"), F.posexplode("form_analysis.form_fields").alias("field_index", "f")).select(
        "document", "field_index", F.coalesce("f.key", F.lit("")).alias("key"), F.coalesce("f.value", F.lit("")).alias("value"),
        F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"))
    tables = docs.select(F.col(key).alias("document"), F.posexplode("table_analysis.tables").alias("table_index", "t"))
    meta = tables.select("document", "table_index", F.coalesce("t.row_count", F.size("t.rows")).alias("row_count"),
                         F.coalesce("t.column_count", F.lit(0)).alias("column_count"),
                         F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"))
    cells = (tables.select("document", "table_index", F.posexplode("t.rows").alias("row_index", "r"))
             .select("document", "table_index", "row_index", F.posexplode("r").alias("col_index", "cell_text"))
             .withColumn("cell_text", F.coalesce("cell_text", F.lit(""))))
    return {"documents": documents, "form_fields": fields, "tables_meta": meta, "table_cells": cells}


def analysis_summary(docs: DataFrame, key: str = "file_name") -> DataFrame:
    """Per document: fields, fields with values, tables, cells (rows times width of the first), mean confidence."""
    fields = F.coalesce("form_analysis.form_fields", F.array().cast("array<struct<key:string,value:string,confidence:double>>"))
    tables = F.coalesce(F.transform("table_analysis.tables", lambda t: t["rows"]), F.array().cast("array<array<array<string>>>"))
    cells = F.aggregate(tables, F.lit(0), lambda n, rows: n + F.when(F.size(rows) > 0, F.size(rows) * F.size(F.get(rows, F.lit(0)))
                                                                     ).otherwise(0))
    return docs.select(
        F.col(key).alias("document"), F.size(fields).alias("total_fields"),
        F.size(F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != "")).alias("fields_with_values"),
        F.size(tables).alias("total_tables"), cells.alias("total_cells"),
        _mean(F.transform(fields, lambda f: f["confidence"])).alias("confidence_score"), summary_type(fields).alias("document_type"))
