"""Matching companies with the tax registry, by id and by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators.neighbours import smallest_ids


def _best_name(name: Column, legal: Column, trade: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.greatest(fn.name_similarity(low(name), low(legal)), fn.name_similarity(low(name), low(trade)))


def validate_companies(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Every company with a tax id: is it registered, and does the name agree?"""
    facts = registry.select("gstin", F.col("legal_name").alias("registry_name"), "trade_name",
                            F.col("status").alias("registry_status"))
    joined = companies.where("gstin IS NOT NULL").join(facts, "gstin", "left")
    known = F.col("registry_name").isNotNull()
    score = F.when(known, _best_name(F.col("legal_name"), F.col("registry_name"), F.col("trade_name")))
    return joined.select("company_id", "gstin", "legal_name", "registry_name", "registry_status",
                         known.alias("is_valid"), score.alias("name_match_score"),
                         F.coalesce(score < 0.5, F.lit(False)).alias("name_mismatch"))


def search_by_name(registry: DataFrame, name: str, threshold: float = 0.7) -> DataFrame:
    score = _best_name(F.lit(name), F.col("legal_name"), F.col("trade_name"))
    return (registry.withColumn("similarity_score", score).where(F.col("similarity_score") >= threshold)
            .orderBy(F.desc("similarity_score"), "gstin"))


def candidate_names(left: DataFrame, right: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(left_name, right_name): pairs of distinct lower-case names that can reach the threshold; none that does is missing.

    Words count 0.7 and letters 0.3, so a pair at the threshold t shares a part of its words of (t - 0.3) / 0.7 at
    least. Names of the same words are joined by these. Other pairs are joined by (word, both word counts, letter):

    * of n words, all but o - 1 are looked up, rarest first, where o is how many names of n and m words must share.
      For two names of two words that is both, so "A Limited" is never looked up by "limited" for them;
    * where different words leave less than 0.7 for the word overlap, the letters must make up for it: their least
      overlap gives how many of a name's letters, rarest first, one has to be common. A word that most names have
      meets only names that have such a letter as well.
    """
    if threshold <= 0.3:
        raise ValueError("names without a common word can reach 0.3: no word can serve as a key")
    overlap, slack = (threshold - 0.3) / 0.7, 1e-9

    def distinct(side):
        names = side.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
        return names.withColumns({"words": fn.words(F.col("name")), "letters": fn.letters(F.col("name"))})
    a, b = distinct(left), distinct(right)

    def frequency(part):
        return a.select(F.explode(part).alias(part)).unionAll(b.select(F.explode(part).alias(part))).groupBy(part).agg(F.count("*").alias("n"))
    common = {part: frequency(part) for part in ("words", "letters")}

    def rarest_first(names, part):
        rows = names.select("name", F.explode(part).alias(part)).join(common[part], part)
        return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", part))), lambda x: x[part]).alias(part))

    def up(value):
        return F.ceil(value - F.lit(slack)).cast("int")

    def keys(names, own, other, out):
        rows = rarest_first(names, "words").join(rarest_first(names, "letters"), "name").withColumn(own, F.size("words"))
        n, m = F.col(own), F.col(other)
        rows = rows.withColumn(other, F.explode(F.sequence(F.greatest(up(n * overlap), F.lit(1)), F.floor(n / F.lit(overlap) + slack).cast("int"))))
        shared = F.greatest(up((n + m) * (overlap / (1 + overlap))), F.lit(1))
        # The largest word overlap of names that do not have the same words.
        most = F.when(n == m, (n - 1) / (n + 1)).otherwise(F.least(n, m) / F.greatest(n, m))
        least = (F.lit(threshold) - most * 0.7) / 0.3
        count = F.size("letters")
        some = F.when(least > 0, F.slice("letters", 1, F.greatest(count - up(count * least) + 1, F.lit(1)))).otherwise(F.array(F.lit("")))
        return (rows.where((shared <= n) & (shared <= m) & (least <= 1 + slack))
                .select(F.col("name").alias(out), own, other, F.explode(F.slice("words", 1, n - shared + 1)).alias("word"), some.alias("some"))
                .select(out, own, other, "word", F.explode("some").alias("letter")))
    same = lambda names, out: names.select(F.col("name").alias(out), F.array_sort("words").alias("words"))
    equal = same(a, "left_name").join(same(b, "right_name"), "words").select("left_name", "right_name")
    keyed = keys(a, "l", "r", "left_name").join(keys(b, "r", "l", "right_name"), ["word", "l", "r", "letter"]).select("left_name", "right_name")
    return equal.unionByName(keyed).distinct()


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All (left_name, right_name, similarity_score) of distinct lower-case names at or above a threshold. Both inputs have
    one column ``name``."""
    pairs = candidate_names(left, right, threshold)
    scored = pairs.withColumn("similarity_score", fn.name_similarity(F.col("left_name"), F.col("right_name")))
    return scored.where(F.col("similarity_score") >= threshold)


def best_registry_matches(companies: DataFrame, registry: DataFrame, threshold: float = 0.7, k: int = 2) -> DataFrame:
    """(company_id, gstin, similarity_score, position): the k best registry rows by legal or trade name.

    Names are compared once per distinct name. Of registry rows that share a name the k
    smallest tax ids are enough, since all of them score the same.
    """
    names = registry.select("gstin", F.lower(F.trim("legal_name")).alias("right_name")).unionByName(
        registry.select("gstin", F.lower(F.trim("trade_name")).alias("right_name"))).where("right_name <> ''")
    mine = companies.select("company_id", F.lower(F.trim("legal_name")).alias("left_name"))
    pairs = similar_names(mine.select(F.col("left_name").alias("name")), names.select(F.col("right_name").alias("name")),
                          threshold)
    order = W.partitionBy("left_name").orderBy(F.desc("similarity_score"), "gstin")
    best = (pairs.join(smallest_ids(names.distinct(), "right_name", k, by="gstin"), "right_name")
            .select("left_name", "similarity_score", F.explode("ids").alias("gstin"))
            .groupBy("left_name", "gstin").agg(F.max("similarity_score").alias("similarity_score"))
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= k))
    return mine.join(best, "left_name").select("company_id", "gstin", "similarity_score", "position")


def recommendations(companies: DataFrame, registry: DataFrame, suggest: int = 2,
                    threshold: float = 0.6) -> DataFrame:
    """What to do with each company: proceed, review or reject, with the best similar registry names."""
    checked = validate_companies(companies, registry)
    found = best_registry_matches(companies, registry, threshold, suggest)
    similar = found.groupBy("company_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "gstin"))), lambda s: s["gstin"]), ", ").alias("similar_gstins"))
    rows = companies.select("company_id", F.col("gstin").alias("own_gstin")).join(
        checked.select("company_id", "is_valid", "name_match_score", "registry_status"), "company_id", "left")
    rejected = F.col("own_gstin").isNotNull() & ~F.col("is_valid")
    mismatch = F.col("name_match_score") < 0.5
    inactive = F.lower("registry_status") != "active"
    confidence = (F.when(rejected, 0.0).otherwise(
        F.when(mismatch, F.col("name_match_score")).otherwise(1.0) * F.when(inactive, 0.8).otherwise(1.0)))
    warnings = F.array_compact(F.array(
        F.when(rejected, F.lit("unknown tax id")), F.when(mismatch, F.lit("name mismatch")),
        F.when(inactive, F.lit("registration not active"))))
    return rows.join(similar, "company_id", "left").select(
        "company_id", F.when(rejected, "reject").when(mismatch, "review").otherwise("proceed").alias("action"),
        confidence.alias("confidence"), F.array_join(warnings, "; ").alias("warnings"),
        F.when(~rejected, F.col("similar_gstins")).alias("similar_gstins"))


def gstin_in_text(text: Column) -> Column:
    """The first word of 15 letters and digits, in upper case."""
    found = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) == 15) & w.rlike(r"(?U)^\p{Alnum}+$"))
    return F.upper(F.get(found, F.lit(0)))
