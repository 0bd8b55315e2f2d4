"""Duplicate invoices: candidates, similarity of line items, scored matches and verdicts.

The rules compare an invoice with every other invoice of its supplier, every invoice with
the same number, and the ten nearest by amount and by shared tariff codes. Done literally
this is quadratic per supplier. Here:

* Invoices with the same lines are folded to one *profile*, so copies cost nothing: scores
  are per pair of profiles, and results say how many partners a match stands for.
* Equal number and supplier needs no scoring. It is a group, not a set of pairs.
* For the rest, a pair can only match if enough lines agree on the tariff code, or on
  price and quantity within 2 %. Such pairs come from equi-joins on those keys, and each
  profile looks up only with its rarest keys: of n lines at most 20 % may stay unmatched,
  so one of the first ``ceil(0.2 n)`` must find its partner. No pair is lost.
* Line items of a pair are joined on the same keys, never crossed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerloom.functions import scalars as fn
from ledgerloom.functions.pairs import NO_ID, best, score
from ledgerloom.functions.text import matching_share, ratio_bound, text_similarity
from ledgerloom.session import cut_lineage, dealt
from ledgerloom.operators.neighbours import (amount_lists, groups_with_members, most_shared_codes, nearest_by_amount, shared_lists, smallest_ids)

# Confidence a scenario was declared with (labels only, the scorer has its own).
SCENARIO_WEIGHTS = (
    ("EXACT_INVOICE_NUMBER_SAME_COMPANY", 0.95), ("SAME_COMPANY_PRODUCT_DUPLICATION", 0.90),
    ("SAME_SUPPLIER_AMOUNT_DATE", 0.85), ("PRODUCT_LINE_DUPLICATION", 0.80),
    ("HSN_PATTERN_MATCH", 0.75), ("RATE_PATTERN_MATCH", 0.70))
# Weights of the weighted item similarity. The taxable ratio counts twice.
WEIGHTS = {"description": 0.40, "hsn_code": 0.25, "unit_price": 0.20, "taxable_value": 0.15}


# Candidates ---------------------------------------------------------------------------

def same_supplier(invoices: DataFrame) -> DataFrame:
    """Every invoice whose supplier has others, as members of the supplier's group."""
    return groups_with_members(invoices.where("supplier_company_id IS NOT NULL"), ["supplier_company_id"])


def same_number(invoices: DataFrame) -> DataFrame:
    """Every invoice whose (non-empty) number occurs again, whoever the supplier is."""
    return groups_with_members(invoices.where("invoice_num <> ''"), ["invoice_num"])


def similar_amount(invoices: DataFrame, k: int = 10) -> DataFrame:
    return nearest_by_amount(invoices, k)


def shared_hsn(items: DataFrame, k: int = 10) -> DataFrame:
    return most_shared_codes(items, k)


def listed_pairs(invoices: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The pairs of scenarios 3 (amount) and 4 (codes), at most k of each per invoice."""
    return nearest_by_amount(invoices, k).select("invoice_id", "candidate_id", F.lit(3).alias("listed")).unionByName(
        most_shared_codes(items, k).select("invoice_id", "candidate_id", F.lit(4).alias("listed")))


def candidate_pairs(invoices: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Distinct listed pairs with the first scenario each belongs to.

    The supplier and number scenarios are groups and are not spelled out as pairs, but a
    listed pair that also shares supplier or number carries that scenario.
    """
    return _first_scenarios(_narrow(invoices), items, k)


def _narrow(invoices: DataFrame) -> DataFrame:
    """What the scenarios read of invoices, made once."""
    return cut_lineage(invoices.select("invoice_id", "supplier_company_id", "invoice_num", "total_value"))


def _first_scenarios(invoices: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The pairs of ``_narrow`` invoices. An invoice's lists are put together in its row, and spelt out once, to meet the candidates."""
    rows = invoices.count()
    none = F.array().cast("array<bigint>")
    amounts = amount_lists(invoices, k).select("invoice_id", F.col("candidate_id").alias("by_amount"), none.alias("by_code"))
    codes = shared_lists(items, k).select("invoice_id", none.alias("by_amount"), F.col("candidate_id").alias("by_code"))
    # Sets of lists, since an invoice that is there twice has its list twice.
    lists = dealt(amounts.unionByName(codes), "invoice_id", 2 * rows).groupBy("invoice_id").agg(*[
        F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("by_amount", "by_code")])
    # The other side's number is looked up with its supplier, in a hashed part of the invoices: the pairs are not sorted.
    a = invoices.select("invoice_id", F.col("supplier_company_id").alias("s1"), F.col("invoice_num").alias("n1"))
    b = invoices.select(F.col("invoice_id").alias("candidate_id"), F.col("supplier_company_id").alias("s2"), F.col("invoice_num").alias("n2"))
    listed = F.concat(F.transform("by_amount", lambda i: F.struct(i.alias("candidate_id"), F.lit(3).alias("listed"))),
                      F.transform(F.array_except("by_code", "by_amount"), lambda i: F.struct(i.alias("candidate_id"), F.lit(4).alias("listed"))))
    pairs = lists.join(a, "invoice_id").select("invoice_id", "s1", "n1", F.inline(listed))
    names = F.array(*[F.lit(s) for s in ("same_supplier", "same_number", "similar_amount", "shared_hsn")])
    first = (F.when(F.col("s1") == F.col("s2"), 1).when((F.col("n1") == F.col("n2")) & (F.col("n1") != ""), 2)
             .otherwise(F.col("listed")))
    return _looked_up(dealt(pairs, "candidate_id", 20 * rows, 6_000_000), b, "candidate_id").select(
        "invoice_id", "candidate_id", F.element_at(names, first).alias("scenario"))


def candidate_union(invoices: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """All four scenarios in one relation: invoice_id, candidate_id, group_size, scenario.

    A listed pair (amount, codes) is a row with group_size NULL, and comes once, with the first of its
    scenarios. What an invoice shares its supplier or number with is a row a group: candidate_id is the
    group's smallest invoice and group_size its members, the invoice itself among them. All pairs of the
    group follow from these, and an invoice that shares nothing but its supplier has a row too.
    """
    def members(groups, scenario):
        return groups.select("invoice_id", F.col("first_id").alias("candidate_id"), "group_size", F.lit(scenario).alias("scenario"))
    invoices = _narrow(invoices)
    pairs = _first_scenarios(invoices, items, k).where(~F.col("scenario").isin("same_supplier", "same_number")).select(
        "invoice_id", "candidate_id", F.lit(None).cast("bigint").alias("group_size"), "scenario")
    return members(same_supplier(invoices), "same_supplier").unionByName(members(same_number(invoices), "same_number")).unionByName(pairs)


def candidate_counts(union: DataFrame) -> DataFrame:
    """Per invoice, how many candidates each scenario gives."""
    def partners(name):
        return F.coalesce(F.sum(F.when(F.col("scenario") == name, F.coalesce(F.col("group_size") - 1, F.lit(1)))), F.lit(0)).alias(name)
    return union.groupBy("invoice_id").agg(*[partners(n) for n in ("same_supplier", "same_number", "similar_amount", "shared_hsn")])


# Similarity of two lines --------------------------------------------------------------

def _text_of(column: str) -> Column:
    """Missing text compares as the word 'none'."""
    return F.lower(F.coalesce(F.col(column), F.lit("none")))


def _part(side: str | Column, name: str) -> Column:
    """A field of a line: of a packed one, or of columns with a prefix."""
    return F.col(f"{side}{name}") if isinstance(side, str) else side[name]


def _worded(side: str | Column) -> Column:
    return F.trim(_text_of(f"{side}description")) != "" if isinstance(side, str) else side["worded"]


def item_similarity(text: Column, a: str | Column, b: str | Column) -> Column:
    """Weighted mean of the factors that both lines have: description, code, price, taxable value.

    ``text`` is the similarity of the trimmed descriptions; ``a`` and ``b`` prefix the columns or are packed lines.
    """
    col = _part
    has_text = _worded(a) & _worded(b)
    code = lambda side: F.trim(F.coalesce(col(side, "hsn_code"), F.lit("None")))
    factors = (
        (F.when(has_text, text), WEIGHTS["description"]),
        (F.when((code(a) != "") & (code(b) != ""), (code(a) == code(b)).cast("double")), WEIGHTS["hsn_code"]),
        (fn.ratio_similarity(col(a, "unit_price"), col(b, "unit_price")), WEIGHTS["unit_price"]),
        (fn.ratio_similarity(col(a, "taxable_value"), col(b, "taxable_value")), 2 * WEIGHTS["taxable_value"]),
    )
    points = reduce(lambda x, y: x + y, [F.coalesce(f * w, F.lit(0.0)) for f, w in factors])
    weight = reduce(lambda x, y: x + y, [F.when(f.isNotNull(), w).otherwise(0.0) for f, w in factors])
    return F.coalesce(F.try_divide(points, weight), F.lit(0.0))


def line_similarity(text: Column, a: str | Column, b: str | Column) -> Column:
    """0.3 text, 0.3 equal code (missing equals missing), 0.2 quantity, 0.2 price."""
    equal = _part(a, "hsn_code").eqNullSafe(_part(b, "hsn_code")).cast("double")
    quantity = fn.numeric_similarity(_part(a, "quantity"), _part(b, "quantity"))
    return text * 0.3 + equal * 0.3 + quantity * 0.2 + rate_part(a, b) * 0.2


def rate_part(a: str | Column, b: str | Column) -> Column:
    return fn.numeric_similarity(_part(a, "unit_price"), _part(b, "unit_price"))


def rate_similarity(a: str | Column, b: str | Column) -> Column:
    return (rate_part(a, b) + fn.numeric_similarity(_part(a, "quantity"), _part(b, "quantity"))) / 2


# Lines of given pairs -----------------------------------------------------------------

def line_pairs(pairs: DataFrame, items: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Every line of the one invoice with every line of the other: a_ and b_ columns, all or the named ones beside
    the ids. The pairs bound the rows. A pair is joined with the packed lines of either side and spelt out last."""
    own = _lines(items)
    names = ["item_id", *(columns or [c for c in own.columns if c not in ("invoice_id", "item_id")])]
    packed = own.groupBy("invoice_id").agg(F.collect_list(F.struct(*names)).alias("own"))

    def side(key, name):
        return packed.select(F.col("invoice_id").alias(key), F.col("own").alias(name))
    joined = pairs.select("invoice_id", "candidate_id").join(side("invoice_id", "a"), "invoice_id").join(side("candidate_id", "b"), "candidate_id")
    spelt = joined.select("invoice_id", "candidate_id", F.explode("a").alias("a"), "b").select("invoice_id", "candidate_id", "a", F.explode("b").alias("b"))
    return spelt.select("invoice_id", "candidate_id", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in names])


def lines_on_same_code(pairs: DataFrame, items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The lines of the one invoice with those of the other on the same code: a_ and b_ item_id and the named columns.

    A pair first meets the hashes of the other's codes, and takes only those own lines along that can have a partner.
    """
    lines = cut_lineage(items.where("hsn_code IS NOT NULL").select("invoice_id", "hsn_code", "item_id", *columns))
    names = ("item_id", *columns)
    theirs = lines.groupBy(F.col("invoice_id").alias("candidate_id")).agg(F.collect_set(_mark(F.col("hsn_code"))).alias("marks"))
    own = lines.groupBy("invoice_id").agg(F.collect_list(F.struct(_mark(F.col("hsn_code")).alias("mark"), "hsn_code", *names)).alias("own"))
    met = _looked_up(_looked_up(pairs.select("invoice_id", "candidate_id"), theirs, "candidate_id"), own, "invoice_id")
    mine = met.select("invoice_id", "candidate_id", F.explode(F.filter("own", lambda x: F.array_contains("marks", x["mark"]))).alias("x")).select(
        "invoice_id", "candidate_id", "x.hsn_code", *[F.col(f"x.{c}").alias(f"a_{c}") for c in names])
    b = lines.select(F.col("invoice_id").alias("candidate_id"), "hsn_code", *[F.col(c).alias(f"b_{c}") for c in names])
    return _looked_up(mine, b, ["candidate_id", "hsn_code"])


def _mark(value: Column) -> Column:
    """Two bytes of a hash, for what goes with every pair: equal values have equal marks, others seldom."""
    return (F.pmod(F.hash(value), F.lit(1 << 16)) - (1 << 15)).cast("smallint")


def _looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Many narrow rows joined with a table that has few rows a key: hashed in each partition, so that the many are not sorted."""
    return rows.join(table.hint("shuffle_hash"), key, how)


def best_lines(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """For each line of a (distinct) pair the most similar line of the other invoice by ``item_similarity``, the smallest id
    of equals: invoice_id, candidate_id, item_id, other_item, similarity. A line without any similarity has no
    partner (NULL). A pair takes its invoice's lines to its candidate and is compared in its row; a task compares two texts
    once, and only where they can decide."""
    lines = _lines(items)
    numbers = ("unit_price", "taxable_value")
    code = F.trim(F.coalesce("hsn_code", F.lit("None")))
    line = F.struct(F.coalesce("item_id", F.lit(int(NO_ID))).alias("id"), F.when(code == "", 0).otherwise(F.xxhash64(code)).alias("code"),
                    F.trim(_text_of("description")).alias("text"), *[_plain_number(lines, c).alias(c) for c in numbers])
    packed = cut_lineage(lines.groupBy("invoice_id").agg(F.collect_list(line).alias("own")).select(
        "invoice_id", F.flatten(F.transform("own", lambda x: F.array(x["id"], x["code"]))).alias("ints"),
        F.flatten(F.transform("own", lambda x: F.array(*[x[c] for c in numbers]))).alias("nums"), F.col("own.text").alias("texts")))

    def side(key, name):
        return packed.select(F.col("invoice_id").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("ints", "nums", "texts")])
    rows = _looked_up(_looked_up(once(pairs), side("invoice_id", "a"), "invoice_id"), side("candidate_id", "b"), "candidate_id")
    keys = ["invoice_id", "candidate_id"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, *[f"{x}_{c}" for x in "ab" for c in ("ints", "nums", "texts")]).mapInArrow(
        best(_scales(lines)[1:], matching_share, keys), f"{kinds}, item_id long, other_item long, similarity double")


# Profiles -----------------------------------------------------------------------------

_LINE = ("description", "hsn_code", "quantity", "unit_price", "taxable_value")


def _lines(items: DataFrame) -> DataFrame:
    return items.select("invoice_id", "item_id", F.col("item_description").alias("description"), "hsn_code",
                        "quantity", "unit_price", "taxable_value")


def profiles(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, lines): each invoice with the smallest invoice that has the same lines, and
    the lines of those representatives.

    Lines are compared as a multiset through two independent sums of 64-bit hashes.
    """
    lines = _lines(items)
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in _LINE]
    wide = "decimal(38,0)"
    marks = lines.groupBy("invoice_id").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(*content).cast(wide)).alias("h1"),
        F.sum(F.xxhash64(F.lit("second"), *content).cast(wide)).alias("h2"))
    firsts = marks.groupBy("n", "h1", "h2").agg(F.min("invoice_id").alias("profile"))
    members = marks.join(firsts, ["n", "h1", "h2"]).select("invoice_id", "profile")
    own = firsts.select(F.col("profile").alias("invoice_id"), F.col("n").alias("lines"))
    return members, lines.join(own, "invoice_id").withColumnRenamed("invoice_id", "profile")


def _code_key() -> Column:
    return F.coalesce(F.trim("hsn_code"), F.lit("\u0000"))


def _log_cells(value: Column, step: float, reach: int) -> Column:
    """Whole numbers for the signed logarithmic cells within reach of a number; zero has its own,
    missing has none (NULL)."""
    value = value.cast("double")
    sign = F.signum(value).cast("bigint")
    cell = F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.floor(F.log(F.abs(value)) / F.log(F.lit(step))).cast("bigint"))
    spread = F.when(value == 0, 0).otherwise(reach)
    return F.transform(F.sequence(cell - spread, cell + spread), lambda c: c * 4 + sign + 1)


def _cells_near(name: str, reach: bool) -> Column:
    """Whole numbers for the signed logarithmic cells, 8 % wide, of a number; with reach of all numbers within 2 % of it, one or two."""
    value = F.col(name).cast("double")
    def cell(x):
        return F.floor(F.log(x) / F.log(F.lit(1.08)))
    size, wide = F.abs(value), F.lit(1.0205 if reach else 1.0)
    cells = F.when(value == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(cell(size / wide), cell(size * wide)))
    return F.transform(cells, lambda c: c * 4 + F.signum(value).cast("bigint") + 1)


def _rate_cells(reach: bool) -> Column:
    """Price and quantity cells in one number: lines whose rate similarity is above 0.8 have both within 2 %."""
    amounts = _cells_near("quantity", reach)
    return F.flatten(F.transform(_cells_near("unit_price", reach), lambda p: F.transform(
        amounts, lambda q: p * F.lit(1 << 32).cast("bigint") + q)))


def _price_keys(reach: int) -> Column:
    """Price cells 3 % wide: values within 2 % are at most one cell apart."""
    return _log_cells(F.col("unit_price"), 1.03, reach)


def _loose_keys(reach: int) -> Column:
    """Keys for lines without a code: a match needs taxable values (or else prices, or else
    text lengths) within a factor of 2.5."""
    def kind(name, value):
        cells = F.transform(_log_cells(value, 2.5, reach), lambda c: F.concat(F.lit(name), c.cast("string")))
        return F.coalesce(F.when(value > 0, cells), F.array().cast("array<string>"))
    length = F.length(F.trim(_text_of("description"))) + 1
    return F.concat(kind("v", F.col("taxable_value")), kind("u", F.col("unit_price")), kind("d", length))


def _codes_to_match(lines: Column) -> Column:
    """How many of the codes of n lines must be looked up: at most 20 % of the lines stay
    unmatched where a score is above 0.8, at most 15 % where it is 0.85 or more."""
    return F.greatest(F.floor(lines * 3 / F.lit(20)) + 1, F.ceil(lines / F.lit(5)))


def _rates_to_match(lines: Column) -> Column:
    return F.ceil(lines * 3 / F.lit(20))


def _no_code() -> Column:
    return _code_key() == ""


def _pairs_in_scopes(scoped: DataFrame, lines: DataFrame) -> DataFrame:
    """(scope, a, b): profiles of one scope that can match. ``scoped``: scope, profile, members."""
    own = scoped.join(lines, "profile")

    def keep(a, b, only=F.lit(True)):
        # A profile is paired with itself only where several invoices share it.
        return a.join(b, ["scope", "key"]).where(((F.col("a") != F.col("b")) | (F.col("members") > 1)) & only).select("scope", "a", "b")

    # Tariff codes: rarest first, missing codes last.
    codes = own.select("scope", "profile", "members", "lines", _code_key().alias("key")).distinct()
    sizes = codes.groupBy("scope", "key").agg(F.count("*").alias("block"))
    order = W.partitionBy("scope", "profile").orderBy(F.col("key").isin("", "\u0000"), "block", "key")
    asked = (codes.join(sizes, ["scope", "key"]).withColumn("rn", F.row_number().over(order))
             .where(F.col("rn") <= _codes_to_match(F.col("lines"))).select("scope", "key", F.col("profile").alias("a"), "members"))
    by_code = keep(asked, codes.select("scope", "key", F.col("profile").alias("b")))

    # Price and quantity cells. Any choice of ceil(0.15 n) lines would do; rare cells are cheap. The line that is looked up
    # has to find a partner by its numbers, and the partner's invoice can have few lines more.
    cells = own.select("scope", "profile", "members", "lines", "item_id", "unit_price", "quantity",
                       F.get(_rate_cells(False), F.lit(0)).alias("key")).where("key IS NOT NULL")
    blocks = cells.groupBy("scope", "key").agg(F.count("*").alias("block"))
    rarest = W.partitionBy("scope", "profile").orderBy("block", "item_id")

    def rates(name, *more):
        return [F.col("profile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("lines", "unit_price", "quantity")], *more]
    probes = (cells.join(blocks, ["scope", "key"]).withColumn("rn", F.row_number().over(rarest))
              .where(F.col("rn") <= _rates_to_match(F.col("lines")))
              .select("scope", *rates("a", "members"), F.explode(_rate_cells(True)).alias("key")))
    by_rate = keep(probes, cells.select("scope", "key", *rates("b")), (F.col("b_lines") * 17 <= F.col("a_lines") * 20) & (
        rate_similarity("a_", "b_") > 0.8))

    # Lines without a code can match any line, on either side, in the scopes that have any.
    if lines.where(_no_code()).isEmpty():
        return by_code.unionByName(by_rate).distinct()

    def loose(rows, reach, name):
        return rows.select("scope", F.col("profile").alias(name), *(["members"] if name == "a" else []),
                           F.explode(_loose_keys(reach)).alias("key")).distinct()
    bare = own.where(_no_code())
    around = own.join(bare.select("scope").distinct(), "scope", "left_semi")
    coded = around.where(~_no_code())
    by_text = keep(loose(bare, 1, "a"), loose(around, 0, "b")).unionByName(keep(loose(coded, 1, "a"), loose(bare, 0, "b")))
    return by_code.unionByName(by_rate).unionByName(by_text).distinct()


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with their code as it is compared, and whether they are the first of it."""
    first = F.row_number().over(W.partitionBy("profile", "hsn_code").orderBy("item_id")) == 1
    return lines.withColumn("code", _code_key()).withColumn("leads", first & F.coalesce(F.col("hsn_code") != "", F.lit(False)))


def _kind() -> Column:
    """A hash that equal code and text have in common."""
    return F.xxhash64(_code_key(), F.coalesce("hsn_code", F.lit("\u0000")), _text_of("description"))


def _packed(lines: DataFrame, marks: bool) -> DataFrame:
    """One row a profile: its lines by item id as the arrays of ``functions.pairs``, how many lines and codes it has, and whether they are
    plain; with ``marks`` also the hashes of codes and of rate cells that lines are found by."""
    text = _text_of("description")

    def hashed(reach):
        return F.coalesce(F.transform(_rate_cells(reach), _mark), F.array().cast("array<smallint>"))
    found_by = [_mark(_code_key()).alias("mark"), hashed(True).alias("near"), hashed(False).alias("cell")] if marks else []
    line = F.struct("item_id", "hsn_code", (_code_key() == "").alias("bare"), F.hash(_code_key()).alias("code"), _kind().alias("kind"), (F.trim(text) != "").alias("worded"), *[_plain_number(lines, c).alias(c) for c in _NUMBERS], *found_by)
    rows = lines.groupBy("profile").agg(F.sort_array(F.collect_list(line)).alias("own"), F.count("*").alias("n"))
    ids = F.array_distinct(F.array_compact("own.item_id"))
    leads = lambda x, i: F.coalesce(x["hsn_code"] != "", F.lit(False)) & (F.array_position("own.hsn_code", x["hsn_code"]) == i + 1)
    meta = lambda x, i: x["code"].cast("bigint") * 4 + F.when(x["worded"], 2).otherwise(0) + F.when(leads(x, i), 1).otherwise(0)
    packed = rows.select(
        "profile", "n", "own", F.flatten(F.transform("own", lambda x, i: F.array(x["kind"], meta(x, i)))).alias("ints"),
        F.flatten(F.transform("own", lambda x: F.array(*[x[c] for c in _NUMBERS]))).alias("nums"),
        ((F.size(ids) == F.size("own")) & ~F.exists("own", lambda x: x["bare"])).alias("plain"),
        F.size(F.array_distinct(F.filter("own.hsn_code", lambda c: c != ""))).cast("bigint").alias("codes"))
    more = [F.col("own.mark").alias("line_marks"), F.col("own.near").alias("line_near"), F.array_distinct("own.mark").alias("marks"),
            F.array_distinct(F.flatten("own.cell")).alias("cells")] if marks else []
    return packed.select(*[c for c in packed.columns if c != "own"], *more)


_NUMBERS = ("quantity", "unit_price", "taxable_value")


def _scales(lines: DataFrame) -> tuple[int, ...]:
    """The digits after the point of each number that is carried as a whole number, else 0."""
    kinds = [lines.schema[c].dataType for c in _NUMBERS]
    return tuple(k.scale for k in kinds) if all(isinstance(k, DecimalType) and k.precision <= 15 for k in kinds) else (0, 0, 0)


def _plain_number(lines: DataFrame, name: str) -> Column:
    """Decimals of at most 15 digits as whole numbers of their smallest part, which divided again are the same doubles; others as doubles."""
    if not all(isinstance(lines.schema[c].dataType, DecimalType) and lines.schema[c].dataType.precision <= 15 for c in _NUMBERS):
        return F.col(name).cast("double")
    return (F.col(name) * F.lit(10 ** lines.schema[name].dataType.scale)).cast("bigint")


_SCORED = ("simple boolean, matching_products long, shared_codes long, product_score double, line_score double, hsn_ratio double, rate_score double")


def _scored_in_row(rows: DataFrame, keys: list[str], scales: tuple[int, ...]) -> DataFrame:
    """The keys of rows that hold the packed lines of both sides, with the scores of ``functions.pairs``."""
    given = rows.select(*keys, "plain", "a_ints", "a_nums", "b_ints", "b_nums", "a_n", "a_codes", "b_n", "b_codes")
    kinds = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(score(scales, keys), f"{kinds}, {_SCORED}")


def profile_scores(pairs: DataFrame, lines: DataFrame, least: float = 0.0) -> DataFrame:
    """Scores of distinct profile pairs (a, b): product, line, hsn and rate similarity; pairs without any may be left out,
    and those where at most a share ``least`` of a's lines and of its codes can find a partner.

    With such a share a pair first meets the hashes of b's codes and rate cells, then a's lines, of which it takes along those
    that can have a partner. It is joined with the packed lines of b and scored in its row, texts by their hash. That
    is all there is to it where lines with one code have one text. The other pairs, and those with empty codes or
    repeated line ids, are scored line by line.
    """
    packed, scales = cut_lineage(_packed(lines, least > 0)), _scales(lines)

    def side(name, *columns):
        return packed.select(F.col("profile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    if least > 0:
        met = _looked_up(_looked_up(pairs.select("a", "b"), side("b", "plain", "marks", "cells"), "b"), side(
            "a", "ints", "nums", "n", "codes", "plain", "line_marks", "line_near"), "a")
        places = F.filter(F.sequence(F.lit(0), F.size("a_line_marks") - 1), lambda i: F.array_contains("b_marks", F.get("a_line_marks", i)) | F.arrays_overlap(
            "b_cells", F.get("a_line_near", i)))
        met = met.select("a", "b", "a_n", "a_codes", "a_ints", "a_nums", (F.col("a_plain") & F.col("b_plain")).alias("plain"), places.alias("places"))
        # The lowest bit of a line's second number says that it is the first of its code.
        led = F.size(F.filter("places", lambda i: F.get("a_ints", 2 * i + 1).bitwiseAND(1) == 1))
        open_ = met.where(~F.col("plain") | (F.size("places") > F.col("a_n") * least) | (led > F.col("a_codes") * least))

        def taken(name, width):
            return F.flatten(F.transform("places", lambda i: F.slice(name, i * width + 1, F.lit(width)))).alias(name)
        met = open_.select("a", "b", "a_n", "a_codes", "plain", taken("a_ints", 2), taken("a_nums", 3))
        joined = _looked_up(met, side("b", "ints", "nums", "n", "codes"), "b")
    else:
        met = _looked_up(pairs.select("a", "b"), side("a", "ints", "nums", "n", "codes", "plain"), "a")
        joined = _looked_up(met, side("b", "ints", "nums", "n", "codes", "plain"), "b").withColumn("plain", F.col("a_plain") & F.col("b_plain"))
    scored = _scored_in_row(joined, ["a", "b"], scales)
    kept = cut_lineage(scored.where("NOT simple OR matching_products > 0 OR shared_codes > 0 OR line_score > 0 OR rate_score > 0"))
    done, rest = kept.where("simple").drop("simple"), kept.where("NOT simple").select("a", "b")
    return done if rest.isEmpty() else done.unionByName(cut_lineage(_scores_by_line(rest, lines)))


def _scores_by_line(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The scores of any profile pairs, line by line, with texts compared once per distinct pair of texts."""
    marked = _marked(lines)
    sizes = marked.groupBy("profile").agg(F.first("lines").alias("lines"), F.count_if("leads").alias("codes"))

    def side(name, extra=()):
        return marked.select(F.col("profile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in (
            "item_id", *_LINE, "code", "leads")], *extra)
    a_lines, b_lines = side("a"), side("b")
    same_code = pairs.join(a_lines, "a").join(
        b_lines.withColumn("a_code", F.col("b_code")), ["b", "a_code"])
    bare_a = pairs.join(a_lines.where("a_code = ''"), "a").join(b_lines.where("b_code <> ''"), "b")
    bare_b = pairs.join(b_lines.where("b_code = ''"), "b").join(a_lines.where("a_code <> ''"), "a")
    columns = [*pairs.columns, *[c for c in a_lines.columns if c != "a"], *[c for c in b_lines.columns if c != "b"]]
    linked = reduce(DataFrame.unionByName, [f.select(*columns) for f in (same_code, bare_a, bare_b)])

    # Text is compared only where its best possible value could decide, once per distinct pair of texts.
    linked = linked.withColumns({"t1": _text_of("a_description"), "t2": _text_of("b_description")})
    bound = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(ratio_bound(F.col("t1"), F.col("t2")))
    loose_bound = F.lit(1.0)   # trimming can only be compared by its own text
    matters = (item_similarity(loose_bound, "a_", "b_") > 0.8) | (line_similarity(bound, "a_", "b_") > 0.7)
    texts = linked.where(matters & (F.col("t1") != F.col("t2"))).select("t1", "t2").distinct()
    trimmed = (F.trim("t1") == F.col("t1")) & (F.trim("t2") == F.col("t2"))
    compared = texts.withColumn("raw", text_similarity(F.col("t1"), F.col("t2"))).withColumn(
        "bare", F.when(trimmed, F.col("raw")))
    odd = compared.where("bare IS NULL").withColumn("bare", F.when(F.trim("t1") == F.trim("t2"), 1.0).otherwise(
        text_similarity(F.trim("t1"), F.trim("t2"))))
    compared = compared.where("bare IS NOT NULL").unionByName(odd)
    texted = linked.join(compared, ["t1", "t2"], "left")
    equal = F.when(F.col("t1") == F.col("t2"), 1.0)
    raw = F.coalesce(equal, F.col("raw"), F.lit(0.0))
    bare = F.coalesce(equal, F.col("bare"), F.lit(0.0))
    by_text = texted.select(
        "a", "b", "a_item_id", "a_leads", item_similarity(bare, "a_", "b_").alias("s_item"),
        line_similarity(raw, "a_", "b_").alias("s_line"), F.lit(0.0).alias("s_rate"),
        F.coalesce(F.col("a_hsn_code") == F.col("b_hsn_code"), F.lit(False)).alias("shared"))

    probe = marked.select(F.col("profile").alias("a"), F.col("item_id").alias("a_item_id"), "leads",
                          F.col("unit_price").alias("a_unit_price"), F.col("quantity").alias("a_quantity"),
                          F.explode(_price_keys(1)).alias("key"))
    target = marked.select(F.col("profile").alias("b"), F.col("unit_price").alias("b_unit_price"),
                           F.col("quantity").alias("b_quantity"), F.explode(_price_keys(0)).alias("key")).distinct()
    by_rate = pairs.select("a", "b").join(probe, "a").join(target, ["b", "key"]).select(
        "a", "b", "a_item_id", F.col("leads").alias("a_leads"), F.lit(0.0).alias("s_item"), F.lit(0.0).alias("s_line"),
        rate_similarity("a_", "b_").alias("s_rate"), F.lit(False).alias("shared"))

    best = by_text.unionByName(by_rate).groupBy("a", "b", "a_item_id").agg(
        F.max("s_item").alias("s_item"), F.max("s_line").alias("s_line"), F.max("s_rate").alias("s_rate"),
        F.bool_or(F.col("shared") & F.col("a_leads")).alias("shared"))

    def above(name, limit):
        return F.when(F.col(name) > limit, F.col(name))
    summed = best.groupBy("a", "b").agg(
        F.coalesce(F.avg(above("s_item", 0.80)), F.lit(0.0)).alias("item_avg"),
        F.count(above("s_item", 0.80)).alias("matching_products"),
        F.coalesce(F.sum(above("s_line", 0.7)), F.lit(0.0)).alias("line_sum"),
        F.coalesce(F.sum(above("s_rate", 0.8)), F.lit(0.0)).alias("rate_sum"),
        F.count_if("shared").alias("shared_codes"))
    mine = sizes.select(F.col("profile").alias("a"), F.col("lines").alias("n1"), F.col("codes").alias("c1"))
    theirs = sizes.select(F.col("profile").alias("b"), F.col("lines").alias("n2"), F.col("codes").alias("c2"))
    either = F.col("c1") + F.col("c2") - F.col("shared_codes")
    longer = F.greatest("n1", "n2").cast("double")
    return summed.join(mine, "a").join(theirs, "b").select(
        "a", "b", "matching_products", "shared_codes",
        (F.col("item_avg") * F.col("matching_products") / F.col("n1")).alias("product_score"),
        (F.col("line_sum") / longer).alias("line_score"),
        F.coalesce(F.try_divide(F.col("shared_codes").cast("double"), either), F.lit(0.0)).alias("hsn_ratio"),
        (F.col("rate_sum") / longer).alias("rate_score"))


# Scoring ------------------------------------------------------------------------------

def cascade(df: DataFrame, same_company: Column) -> DataFrame:
    """match_type and confidence from the scores of a pair that does not share number and supplier."""
    c = F.col
    step1 = F.when(same_company & (c("product_score") >= 0.85), c("product_score") * 0.90).otherwise(0.0)
    by_line = (c("line_score") > 0.8) & (c("_c1") < 0.85)
    by_code = (c("hsn_ratio") > 0.8) & (c("_c2") < 0.75)
    by_rate = (c("rate_score") > 0.85) & (c("_c3") < 0.70)
    return (df.withColumn("_c1", step1)
            .withColumn("_c2", F.when(by_line, 0.80 + c("line_score") * 0.05).otherwise(c("_c1")))
            .withColumn("_c3", F.when(by_code, F.greatest(c("_c2"), 0.70 + c("hsn_ratio") * 0.05)).otherwise(c("_c2")))
            .withColumn("confidence", F.when(by_rate, F.greatest(c("_c3"), 0.65 + c("rate_score") * 0.05))
                        .otherwise(c("_c3")))
            .withColumn("match_type", F.when(by_line, "PRODUCT_LINE_DUPLICATION")
                        .when(c("_c1") > 0, "SAME_COMPANY_PRODUCT_DUPLICATION")
                        .when(by_code, "HSN_PATTERN_MATCH").when(by_rate, "RATE_PATTERN_MATCH").otherwise("NO_MATCH"))
            .drop("_c1", "_c2", "_c3"))


def recommendation(confidence: Column) -> Column:
    return (F.when(confidence >= 0.85, "HIGH_CONFIDENCE_DUPLICATE").when(confidence >= 0.70, "LIKELY_DUPLICATE_REVIEW_REQUIRED")
            .when(confidence >= 0.50, "POSSIBLE_DUPLICATE_INVESTIGATE").otherwise("NOT_A_DUPLICATE"))


def _number(column: str) -> Column:
    shown = F.upper(F.trim(column))
    return F.when(shown != "", shown)


def exact_matches(invoices: DataFrame) -> DataFrame:
    """Same number (blanks and case aside) and supplier: one row per invoice of such a group."""
    numbered = invoices.select("invoice_id", "supplier_company_id", _number("invoice_num").alias("number")).where("number IS NOT NULL")
    keyed = numbered.withColumn("key", F.concat_ws("\u0001", F.coalesce(F.col("supplier_company_id").cast("string"), F.lit("")), "number"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keyed.join(crowded, "key")
    two = smallest_ids(members, "key", 2)
    other = F.when(F.col("ids")[0] == F.col("invoice_id"), F.col("ids")[1]).otherwise(F.col("ids")[0])
    return members.join(two, "key").select(
        "invoice_id", other.alias("candidate_id"), (F.col("size") - 1).alias("partners"),
        F.lit("EXACT_INVOICE_NUMBER_SAME_COMPANY").alias("match_type"), F.lit(0.95).alias("confidence"))


_SCORES = ("matching_products", "shared_codes", "product_score", "line_score", "hsn_ratio", "rate_score")


def once(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, dealt by their invoice, so that they meet it without being dealt again."""
    return pairs.select("invoice_id", "candidate_id").repartition("invoice_id").distinct()


def _texts_differ(packed: DataFrame, lines: DataFrame) -> bool:
    """Whether any code stands with two texts: only then, or where lines are not plain, can a pair have to be scored line by line.

    Packed lines have a short hash of their code; where that has two texts, the codes themselves are looked at.
    """
    def two(rows, *keys):
        return rows.groupBy(*keys).agg(F.min("kind").alias("least"), F.max("kind").alias("most")).where("least <> most")
    kinds = packed.where("ints IS NOT NULL").select(F.inline(F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.struct(
        F.shiftright(F.get("ints", i * 2 + 1), 2).cast("int").alias("code"), F.get("ints", i * 2).alias("kind")))))
    seen = cut_lineage(two(kinds, "code").select("code"))
    return not seen.isEmpty() and not two(lines.select(_code_key().alias("key"), F.hash(_code_key()).alias("code"), _kind().alias("kind")).join(
        seen, "code", "left_semi"), "key").isEmpty()


def score_pairs(pairs: DataFrame, invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Scores and confidence of given (invoice_id, candidate_id) pairs, all of them kept.

    A pair takes its invoice's packed lines along to its candidate, and is scored there in its row.
    """
    lines = _lines(items).withColumnRenamed("invoice_id", "profile")
    packed = _packed(lines, False).withColumnRenamed("profile", "invoice_id")
    head = cut_lineage(invoices.select("invoice_id", F.col("supplier_company_id").alias("s"), F.xxhash64(_number("invoice_num")).alias("h"),
                                       _number("invoice_num").isNotNull().alias("named")).join(packed, "invoice_id", "left"))

    def side(key, name):
        return head.select(F.col("invoice_id").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in head.columns if c != "invoice_id"])
    joined = _looked_up(_looked_up(pairs.select("invoice_id", "candidate_id"), side("invoice_id", "a"), "invoice_id"), side("candidate_id", "b"), "candidate_id")
    none, numbers = F.array().cast("array<bigint>"), F.array().cast(head.schema["nums"].dataType)
    same = F.col("a_s").eqNullSafe(F.col("b_s"))
    rows = joined.select(
        "invoice_id", "candidate_id", same.alias("same"), (same & F.col("a_named") & F.col("b_named") & (F.col("a_h") == F.col("b_h"))).alias("exact"),
        F.coalesce(F.col("a_plain") & F.col("b_plain"), F.lit(True)).alias("plain"), *[F.coalesce(f"{x}_ints", none).alias(f"{x}_ints") for x in "ab"],
        *[F.coalesce(f"{x}_nums", numbers).alias(f"{x}_nums") for x in "ab"], *[F.coalesce(f"{x}_{c}", F.lit(0)).alias(f"{x}_{c}") for x in "ab" for c in ("n", "codes")])
    scored = _scored_in_row(rows, ["invoice_id", "candidate_id", "same", "exact"], _scales(lines))
    if head.where("NOT plain").isEmpty() and not _texts_differ(head, lines):
        done = scored.drop("simple")
    else:
        scored = cut_lineage(scored)
        rest = scored.where("NOT simple").select(F.col("invoice_id").alias("a"), F.col("candidate_id").alias("b")).distinct()
        counted = lines.join(packed.select(F.col("invoice_id").alias("profile"), F.col("n").alias("lines")), "profile")
        by_line = _scores_by_line(rest, cut_lineage(counted)).withColumnsRenamed({"a": "invoice_id", "b": "candidate_id"})
        done = scored.where("simple").drop("simple").unionByName(
            scored.where("NOT simple").drop("simple", *_SCORES).join(by_line, ["invoice_id", "candidate_id"], "left").fillna(0, list(_SCORES)))
    rated = cascade(done, F.col("same"))
    return rated.select(
        "invoice_id", "candidate_id", *_SCORES,
        F.when(F.col("exact"), "EXACT_INVOICE_NUMBER_SAME_COMPANY").otherwise(F.col("match_type")).alias("match_type"),
        F.when(F.col("exact"), 0.95).otherwise(F.col("confidence")).alias("confidence"))


def duplicate_matches(invoices: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """All matches above 0.5, folded: invoice_id, candidate_id, partners, match_type, confidence, scores.

    A row stands for ``partners`` candidates with the same lines and the same relation to
    the invoice; ``candidate_id`` is the smallest of them.
    """
    # These tables are read by several later joins; each is written once to the shared folder.
    members, lines = map(cut_lineage, profiles(items))
    heads = cut_lineage(invoices.select("invoice_id", "supplier_company_id", "invoice_num", _number("invoice_num").alias("number")
                                        ).join(members, "invoice_id"))
    lonely = F.concat(F.lit("#"), F.col("invoice_id").cast("string"))
    # A scope is one supplier or one number; 'apart' names the invoices that are exact
    # matches of each other inside a scope, which are not scored again.
    # Missing suppliers are one supplier here, as in score_pairs and exact_matches.
    in_supplier = heads.select(
        F.concat(F.lit("S:"), F.coalesce(F.col("supplier_company_id").cast("string"), F.lit(""))).alias("scope"), "profile", "invoice_id",
        F.coalesce(F.concat(F.lit("="), "number"), lonely).alias("apart"))
    in_number = heads.where("invoice_num <> ''").select(
        F.concat(F.lit("N:"), "invoice_num").alias("scope"), "profile", "invoice_id",
        F.concat(F.lit("="), F.coalesce(F.col("supplier_company_id").cast("string"), F.lit(""))).alias("apart"))
    rows = in_supplier.unionByName(in_number)
    folded = cut_lineage(rows.groupBy("scope", "profile", "apart").agg(F.count("*").alias("n"), F.min("invoice_id").alias("least")))
    scoped = cut_lineage(folded.groupBy("scope", "profile").agg(F.sum("n").alias("members")))
    pairs = cut_lineage(_pairs_in_scopes(scoped, lines))

    # Listed pairs that no scope holds: different supplier and different number.
    of_a = heads.select("invoice_id", F.col("supplier_company_id").alias("s1"), F.col("invoice_num").alias("n1"), F.col("profile").alias("a"))
    of_b = heads.select(F.col("invoice_id").alias("candidate_id"), F.col("supplier_company_id").alias("s2"),
                        F.col("invoice_num").alias("n2"), F.col("profile").alias("b"))
    apart = ~F.col("s1").eqNullSafe(F.col("s2")) & ~F.coalesce(
        (F.col("n1") == F.col("n2")) & (F.col("n1") != ""), F.lit(False))
    listed = cut_lineage(_looked_up(_looked_up(once(listed_pairs(invoices, items, k)), of_a, "invoice_id"),
                                    of_b, "candidate_id").where(apart).select("invoice_id", "candidate_id", "a", "b"))
    # Dealt by b, where each pair goes first.
    wanted = pairs.select("a", "b").unionByName(listed.select("a", "b")).repartition("b").distinct()
    # No rule gives more than 0.5 unless four fifths of the lines, or of the codes, have a partner.
    scores = cut_lineage(profile_scores(wanted, lines, 0.79))

    matched = cascade(pairs.join(scores, ["a", "b"]), F.startswith(F.col("scope"), F.lit("S:"))).where("confidence > 0.5")
    two = (folded.withColumn("rn", F.row_number().over(W.partitionBy("scope", "profile").orderBy("least")))
           .where("rn <= 2").groupBy("scope", "profile")
           .agg(F.array_sort(F.collect_list(F.struct("least", "apart"))).alias("firsts"))
           .join(scoped, ["scope", "profile"]).withColumnRenamed("profile", "b"))
    own = folded.select("scope", F.col("profile").alias("b"), "apart", F.col("n").alias("excluded"))
    expanded = (rows.withColumnRenamed("profile", "a").join(matched, ["scope", "a"]).join(two, ["scope", "b"])
                .join(own, ["scope", "b", "apart"], "left"))
    partner = F.when(F.col("firsts")[0]["apart"] != F.col("apart"), F.col("firsts")[0]["least"]).otherwise(
        F.get("firsts", F.lit(1))["least"])
    columns = ["match_type", "confidence", *_SCORES]
    in_scopes = expanded.select(
        "invoice_id", partner.alias("candidate_id"),
        (F.col("members") - F.coalesce("excluded", F.lit(0))).alias("partners"), *columns).where("partners > 0")
    in_lists = cascade(listed.join(scores, ["a", "b"]), F.lit(False)).where("confidence > 0.5").select(
        "invoice_id", "candidate_id", F.lit(1).cast("bigint").alias("partners"), *columns)
    exact = exact_matches(invoices)
    for name in _SCORES:
        kind = "bigint" if name in ("matching_products", "shared_codes") else "double"
        exact = exact.withColumn(name, F.lit(None).cast(kind))
    found = in_scopes.unionByName(in_lists).unionByName(exact)
    return found.withColumn("recommendation", recommendation(F.col("confidence")))


def amount_date_matches(invoices: DataFrame, days: int = 7) -> DataFrame:
    """Opt-in rule: same supplier and equal total within some days, confidence falling with the gap: the nearest
    partner, and how many there are.

    Invoices of one supplier, total and day are folded to one row. A sweep over the days of (supplier, total,
    period of some days and the ones next to it) finds the days before and after and sums the days within reach, so
    one supplier with one total costs a row a day, and no window is a whole supplier.
    """
    span = days + 1
    day = F.date_diff("invoice_date", F.lit("1970-01-01").cast("date"))
    rows = invoices.where("invoice_date IS NOT NULL").select(
        "invoice_id", "supplier_company_id", "total_value", day.alias("day"), F.floor(day / span).alias("home"))
    folded = rows.groupBy("supplier_company_id", "total_value", "day", "home").agg(
        F.count("*").alias("n"), F.min("invoice_id").alias("least"), F.max("invoice_id").alias("most"))
    spread = folded.withColumn("period", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    order = W.partitionBy("supplier_company_id", "total_value", "period").orderBy("day")
    near = spread.select("*", F.lag(F.struct("day", "least")).over(order).alias("before"),
                         F.lead(F.struct("day", "least")).over(order).alias("after"),
                         F.sum("n").over(order.rangeBetween(-days, days)).alias("within")).where("period = home")
    gap_before, gap_after = F.col("day") - F.col("before.day"), F.col("after.day") - F.col("day")
    joined = rows.drop("home").join(near.drop("home", "period"), ["supplier_company_id", "total_value", "day"])
    same_day = F.when(F.col("n") > 1, F.struct(F.lit(0).alias("gap"), F.when(
        F.col("least") != F.col("invoice_id"), F.col("least")).otherwise(F.col("most")).alias("id")))
    best = F.array_min(F.array_compact(F.array(
        same_day, F.when(gap_before <= days, F.struct(gap_before.alias("gap"), F.col("before.least").alias("id"))),
        F.when(gap_after <= days, F.struct(gap_after.alias("gap"), F.col("after.least").alias("id"))))))
    return joined.withColumn("best", best).where("best IS NOT NULL").select(
        "invoice_id", F.col("best.id").alias("candidate_id"), F.col("best.gap").cast("bigint").alias("days_apart"),
        (F.col("within") - 1).alias("partners"), F.lit("SAME_SUPPLIER_AMOUNT_DATE").alias("match_type"), (0.85 - F.col("best.gap") * 0.03).alias("confidence"))


def duplicate_verdicts(invoices: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per invoice: is it a duplicate, how sure, and what to do."""
    best = matches.groupBy("invoice_id").agg(
        F.max("confidence").alias("confidence"), F.sum("partners").alias("matches"))
    sure = F.coalesce(F.col("confidence") > 0.7, F.lit(False))
    return invoices.select("invoice_id", "invoice_num").join(best, "invoice_id", "left").select(
        "invoice_id", "invoice_num", sure.alias("is_duplicate"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(sure, "MARK_AS_DUPLICATE").when(F.col("confidence").isNotNull(), "MANUAL_REVIEW_REQUIRED")
        .otherwise("APPROVE_AS_UNIQUE").alias("recommended_action"))


def verdicts_for(ids: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of asked ids; an id that is not stored asks for a check that it exists."""
    return ids.join(verdicts, "invoice_id", "left").withColumn(
        "recommended_action", F.coalesce("recommended_action", F.lit("VERIFY_INVOICE_EXISTS")))


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("invoice_id").agg(
        F.sum("partners").alias("matches"), F.array_sort(F.collect_set("match_type")).alias("match_types"),
        F.sum(F.when(F.col("confidence") >= 0.85, F.col("partners")).otherwise(0)).alias("high_confidence"),
        F.max("confidence").alias("best_confidence"))


def confidence_bands(verdicts: DataFrame) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c > 0.8, "high").when(c > 0.6, "medium").when(c > 0.4, "low").otherwise("very low")
    return verdicts.groupBy(band.alias("band")).agg(F.count("*").alias("invoices"))


def evidence(matches: DataFrame) -> DataFrame:
    """Readable reasons and the matching fields of every match."""
    c = F.col

    def share(name):
        return F.format_string("%.1f%%", c(name) * 100)
    exact = c("match_type") == "EXACT_INVOICE_NUMBER_SAME_COMPANY"
    texts = F.array_compact(F.array(
        F.when(exact, F.lit("Same invoice number and supplier")),
        F.when(c("product_score") >= 0.85, F.concat(F.lit("Product similarity: "), share("product_score"))),
        F.when(c("line_score") > 0.8, F.concat(F.lit("Line similarity: "), share("line_score"))),
        F.when(c("hsn_ratio") > 0.8, F.concat(F.lit("Tariff code similarity: "), share("hsn_ratio"))),
        F.when(c("rate_score") > 0.85, F.concat(F.lit("Rate similarity: "), share("rate_score")))))
    fields = F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(n) for n in _SCORES]), F.array(*[c(n).cast("string") for n in _SCORES])), lambda _, v: v.isNotNull())
    return matches.select("invoice_id", "candidate_id", "match_type", "confidence", texts.alias("evidence"),
                          fields.alias("matching_fields"))


def detail_rows(invoices: DataFrame, items: DataFrame, companies: DataFrame, products: DataFrame) -> DataFrame:
    """Header, supplier, line and product in one row per line: what a comparison looks at.

    Sums of the header are invoice_taxable, invoice_tax and invoice_total. An invoice without lines is one row.
    """
    supplier = companies.select(F.col("company_id").alias("supplier_company_id"),
                                F.col("legal_name").alias("supplier_name"), F.col("gstin").alias("supplier_gstin"))
    named = products.select("product_id", F.col("canonical_name").alias("product_name"))
    lines = items.select("invoice_id", "item_id", "product_id", F.col("item_description").alias("description"), "hsn_code", "quantity",
                         "unit_price", "taxable_value", "gst_rate", "total_amount").join(named, "product_id", "left")
    heads = invoices.select("invoice_id", "invoice_num", "invoice_date", F.col("taxable_value").alias("invoice_taxable"),
                            F.col("total_tax").alias("invoice_tax"), F.col("total_value").alias("invoice_total"), "supplier_company_id")
    return heads.join(supplier, "supplier_company_id", "left").join(lines, "invoice_id", "left")


def scenario_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(SCENARIO_WEIGHTS), "match_type string, declared_confidence double")
