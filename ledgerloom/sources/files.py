"""Readers of documents and registry records, and matching of their files.

Schemas are always given, so nothing is inferred by a pass over the data, and fields that a
file lacks are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import model
from ledgerloom.functions import scalars as fn

# Fixed value: how analysis files are named.
ANALYSIS_PREFIX = "textract_analysis_"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select("*", F.col("_metadata.file_name").alias("file_name"),
                        F.col("_metadata.file_modification_time").alias("modified_at"))


def read_analysis(spark, path: str) -> DataFrame:
    return _json(spark, path, model.ANALYSIS_DDL)


def read_blocks(spark, path: str) -> DataFrame:
    return _json(spark, path, model.BLOCKS_DDL)


def read_ocr(spark, path: str) -> DataFrame:
    return _json(spark, path, model.OCR_DDL)


def read_ocr_text(spark, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("ocr_text"))


def read_registry(spark, path: str) -> DataFrame:
    return _json(spark, path, model.REGISTRY_DDL)


def read_hsn(spark, path: str) -> DataFrame:
    return _json(spark, path, model.HSN_DDL)


def read_structured_invoice(spark, path: str) -> DataFrame:
    return _json(spark, path, model.STRUCTURED_DDL)


def structured_items(invoices: DataFrame) -> DataFrame:
    return invoices.select("invoice_number", F.posexplode("items").alias("position", "item")).select(
        "invoice_number", "position", "item.*")


def read_portal_pages(spark, path: str) -> DataFrame:
    """(url, html) from Parquet; only the two columns are read."""
    return spark.read.parquet(path).select("url", "html")


def list_files(spark, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, name, modified_at) of files below a folder, without reading their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.col("modificationTime").alias("modified_at"))


def _rest(name: Column) -> Column:
    return F.substring(name, F.lit(len(ANALYSIS_PREFIX) + 1), F.length(name))


def _analysis_files(files: DataFrame) -> DataFrame:
    name = F.col("name")
    return files.where(F.startswith(name, F.lit(ANALYSIS_PREFIX))).select(name.alias("analysis"), _rest(name).alias("rest"))


def pair_documents(files: DataFrame) -> DataFrame:
    """(doc_id, ocr, analysis): each OCR file with the first analysis file whose name starts with its id.

    The prefix condition becomes an equi-join: an analysis file offers every prefix of its
    name, at most a few hundred short texts.
    """
    ocr = files.select(F.regexp_extract("name", r"^(.+)_ocr\.json$", 1).alias("doc_id"), F.col("name").alias("ocr")
                       ).where("doc_id <> ''")
    offers = _analysis_files(files).select("analysis", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("rest")), lambda n: F.substring(F.col("rest"), F.lit(1), n))).alias("doc_id"))
    return ocr.join(offers.groupBy("doc_id").agg(F.min("analysis").alias("analysis")), "doc_id")


def latest_file_per_key(files: DataFrame, key: str = "key") -> DataFrame:
    return files.groupBy(key).agg(F.max_by("path", F.struct("modified_at", "path")).alias("path"))


def resolve_analysis_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, analysis, tier) for wanted document names, by four rules in order.

    1 the cleaned name exactly; 2 the cleaned name and '_'; 3 the original name and '_';
    4 the first 12 letters and digits anywhere in the file name, for names with more than 8.
    Within the first rule that finds a file, the last file by name is taken.
    """
    wanted = names.select("name").distinct().select(
        "name", fn.clean_file_name(F.col("name")).alias("clean"),
        F.lower(F.regexp_replace("name", "[^a-zA-Z0-9]", "")).alias("letters"))
    keys = wanted.select("name", F.explode(F.array_compact(F.array(
        F.struct(F.lit(1).alias("tier"), F.concat("clean", F.lit(".json")).alias("key")),
        F.struct(F.lit(2).alias("tier"), F.concat("clean", F.lit("_")).alias("key")),
        F.struct(F.lit(3).alias("tier"), F.concat("name", F.lit("_")).alias("key")),
        F.when(F.length("letters") > 8, F.struct(F.lit(4).alias("tier"), F.substring("letters", 1, 12).alias("key")))))
        ).alias("k")).select("name", "k.*")
    stored = _analysis_files(files).where(F.endswith(F.col("analysis"), F.lit(".json")))
    low = F.lower(F.regexp_replace("rest", "[^a-zA-Z0-9]", ""))
    positions = F.sequence(F.lit(1), F.length("rest"))
    prefixes = F.transform(positions, lambda n: F.substring(F.col("rest"), F.lit(1), n))
    ended = F.filter(prefixes, lambda p: F.endswith(p, F.lit("_")))

    def grams(size):
        last = F.length(low) - size + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(size)))
                      ).otherwise(F.array().cast("array<string>"))
    keyed = stored.select("analysis", F.explode(F.concat(
        F.array(F.struct(F.lit(1).alias("tier"), F.col("rest").alias("key"))),
        F.transform(ended, lambda p: F.struct(F.lit(2).alias("tier"), p.alias("key"))),
        F.transform(ended, lambda p: F.struct(F.lit(3).alias("tier"), p.alias("key"))),
        F.transform(F.array_distinct(F.concat(*[grams(n) for n in (9, 10, 11, 12)])),
                    lambda g: F.struct(F.lit(4).alias("tier"), g.alias("key"))))).alias("k")).select("analysis", "k.*")
    return keys.join(keyed, ["tier", "key"]).groupBy("name").agg(
        F.max_by(F.struct("analysis", "tier"), F.struct(-F.col("tier"), "analysis")).alias("r")).select("name", "r.*")
