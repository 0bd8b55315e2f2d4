"""Joins of invoices with similar invoices, kept linear in the size of the table.

Three rules hold throughout: equal keys are folded to one row before anything is
compared, so a value shared by a third of the table costs no more than any other; results
are either at most k partners per invoice, or counts; and no step gathers a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage, dealt


def smallest_ids(rows: DataFrame, key: str, k: int, by: str = "invoice_id") -> DataFrame:
    """The k smallest ids of each key as an array. The row limit is applied on the map side too."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(by))).where(F.col("_rn") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list(by)).alias("ids"))


def groups_with_members(rows: DataFrame, keys: list[str], by: str = "invoice_id") -> DataFrame:
    """Members of every group of two or more, each linked to the group's smallest id.

    Stands for all pairs of the group: ``pairs_in_group`` is their number, and any pair
    is two members with the same ``first_id`` and keys.
    """
    crowded = (rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(by).alias("first_id"))
               .where("group_size > 1"))
    return rows.select(by, *keys).join(crowded, keys).withColumn(
        "pairs_in_group", F.expr("group_size * (group_size - 1) div 2"))


def _value_bucket(value: Column) -> Column:
    """Buckets 2 % wide, so that a 1 % band reaches no further than the next bucket."""
    return F.floor(F.log(value.cast("double")) / F.log(F.lit(1.02)))


def nearest_by_amount(invoices: DataFrame, k: int = 10, percent: str = "0.01") -> DataFrame:
    """(invoice_id, candidate_id, amount_diff): up to k invoices nearest in total value.

    A candidate lies within the given share of the current total; ties go to the smaller
    id. A missing total counts as 0, whose band holds zero totals only; negative totals
    have an empty band.

    Work is done per distinct total: each takes the k distinct totals on either side in
    its bucket or the ones next to it, and at most k + 1 ids of each.
    """
    return amount_lists(invoices, k, percent).select("invoice_id", F.inline(F.arrays_zip("candidate_id", "amount_diff")))


def amount_lists(invoices: DataFrame, k: int = 10, percent: str = "0.01") -> DataFrame:
    """(invoice_id, candidate_id, amount_diff): what ``nearest_by_amount`` lists of each invoice, as two arrays."""
    totals = invoices.select("invoice_id", F.col("total_value").alias("t"))
    members = smallest_ids(totals.where("t >= 0"), "t", k + 1)
    positive = members.where("t > 0").withColumn("home", _value_bucket(F.col("t")))
    spread = positive.withColumn("bucket", F.explode(F.array(
        F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    around = W.partitionBy("bucket").orderBy("t").rowsBetween(-k, k)
    seen = spread.select("t", "bucket", "home", F.collect_list(F.struct("t", "ids")).over(around).alias("near"))
    share = F.lit(percent).cast("decimal(6,4)")
    low, high = F.col("t") - F.col("t") * share, F.col("t") + F.col("t") * share
    near = seen.where("bucket = home").select("t", "near", low.alias("low"), high.alias("high"))
    near = near.select("t", F.filter("near", lambda n: (n["t"] >= F.col("low")) & (n["t"] <= F.col("high"))).alias("near"))
    listed = F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct(
        F.abs(n["t"] - F.col("t")).alias("diff"), i.alias("id")))))
    best = near.select("t", F.slice(F.sort_array(listed), 1, k + 1).alias("best"))
    zero = members.where("t = 0").select("t", F.transform("ids", lambda i: F.struct(
        F.abs(F.col("t")).alias("diff"), i.alias("id"))).alias("best"))
    best = best.unionByName(zero)
    current = totals.withColumn("t", F.coalesce("t", F.lit(0).cast("decimal(15,2)")))
    others = F.slice(F.filter("best", lambda c: c["id"] != F.col("invoice_id")), 1, k)
    return current.join(best, "t").select("invoice_id", F.slice(F.array_remove("best.id", F.col("invoice_id")), 1, k).alias("candidate_id"),
                                          F.transform(others, lambda c: c["diff"]).alias("amount_diff"))


def within_amount(invoices: DataFrame, width: int = 1000) -> DataFrame:
    """(invoice_id, total_value, partners): how many other invoices differ by less than ``width``.

    Totals fall in buckets of that width. All of the own bucket qualifies; of the two next
    to it, those beyond the own offset. Offsets are counted by one running sum per bucket
    over distinct totals, so neither dense buckets nor repeated totals build pairs.
    """
    totals = invoices.where("total_value IS NOT NULL").select("invoice_id", F.col("total_value").alias("t"))
    folded = totals.groupBy("t").agg(F.count("*").alias("n")).withColumn(
        "b", F.floor(F.col("t") / width).cast("bigint")).withColumn("u", F.col("t") - F.col("b") * width)
    # kind 0: how much of this bucket lies below offset u (asked from the bucket below);
    # kind 1: data; kind 2: how much lies at or below u (asked from the bucket above).
    data = folded.select("b", "u", F.lit(1).alias("kind"), "n", "t")
    asks_up = folded.select((F.col("b") + 1).alias("b"), "u", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n"), "t")
    asks_down = folded.select((F.col("b") - 1).alias("b"), "u", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("n"), "t")
    rows = data.unionByName(asks_up).unionByName(asks_down)
    running = W.partitionBy("b").orderBy("u", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("b")
    counted = rows.select("t", "kind", F.sum("n").over(running).alias("upto"), F.sum("n").over(whole).alias("all"))
    part = (F.when(F.col("kind") == 1, F.col("all")).when(F.col("kind") == 0, F.col("upto"))
            .otherwise(F.col("all") - F.col("upto")))
    per_total = counted.groupBy("t").agg((F.sum(part) - 1).alias("partners"))
    return totals.join(per_total, "t").select("invoice_id", F.col("t").alias("total_value"), "partners")


def most_shared_codes(items: DataFrame, k: int = 10) -> DataFrame:
    """(invoice_id, candidate_id, shared_codes): up to k invoices with most shared distinct codes, ties to the smaller id.

    Invoices with the same codes are folded to one set, of which the k + 1 smallest ids can matter. A *list* is the
    k + 1 smallest ids of invoices that have all codes of a combination. A candidate that is not in the list of what it
    shares with an invoice has k others before it, so lists are enough; and a list that is not full holds all that any
    larger combination's list would, so only combinations with full lists are extended by a further code. Level by level
    there are fewer of them: with rare codes the second level ends it.

    An invoice whose codes are so many that extending costs more than the posting lists themselves leaves this for the
    plain way: of h codes with full lists a candidate that shares t + 1 of them has one of the h - t rarest, whose
    lists are joined, and what is found there finds the invoice too. Both ways give the same rows, and a set takes the one
    that makes fewer.
    """
    return shared_lists(items, k).select("invoice_id", F.inline(F.arrays_zip("candidate_id", "shared_codes")))


def shared_lists(items: DataFrame, k: int = 10) -> DataFrame:
    """(invoice_id, candidate_id, shared_codes): what ``most_shared_codes`` lists of each invoice, as two arrays.

    A set is one row from its lists to its result; only what is compared code by code is spelt out, and ranked by set
    before it joins that row. Steps by set are dealt to as many tasks as their rows need.
    """
    given = cut_lineage(items.where("hsn_code IS NOT NULL").select("invoice_id", "hsn_code").distinct())
    lines = given.count()
    # Codes as numbers, rarest first, in one order for all sets: combinations are arrays of numbers, eight bytes a code.
    sizes = cut_lineage(given.groupBy("hsn_code").agg(F.count("*").alias("size")).orderBy("size", "hsn_code")
                        .withColumn("code", F.monotonically_increasing_id()))
    own = given.join(sizes.select("hsn_code", "code"), "hsn_code").groupBy("invoice_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    own = cut_lineage(own.select("invoice_id", "codes", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit("second"), "codes").alias("h2")))
    named = own.groupBy("h1", "h2").agg(F.min("invoice_id").alias("set"), F.count("*").alias("n"))
    member = cut_lineage(own.join(named, ["h1", "h2"]).select("invoice_id", "set", "n", "codes"))
    sets = member.where(F.col("invoice_id") == F.col("set")).select("set", "n", "codes")
    # A set of one invoice is its own list.
    ids = cut_lineage(smallest_ids(member.where("n > 1"), "set", k + 1))

    level = sets.select("set", "n", F.explode("codes").alias("c")).select("set", "n", F.array("c").alias("combo"))
    support = sizes.where("size > 1").select(F.array("code").alias("combo"), F.col("size").alias("support"))
    listed, unsure, t = [], [], 1
    while True:
        if t > 1:  # written apart, since only few of the rare combinations come again: the rest is not shuffled for them
            support = cut_lineage(level.groupBy("combo").agg(F.sum("n").alias("support")).where("support > 1"))
        shared = cut_lineage(level.join(support, "combo"))
        alone = shared.where("n = 1").select("combo", F.col("set").alias("invoice_id"))
        several = shared.where("n > 1").select("combo", "set").join(ids, "set").select("combo", F.explode("ids").alias("invoice_id"))
        lists = cut_lineage(smallest_ids(alone.unionByName(several), "combo", k + 1))
        full = F.col("support") > k + 1
        # One row a set and level: what its full lists give, what the others hold, and which combinations are full.
        got = cut_lineage(dealt(shared.join(lists, "combo"), "set", lines).groupBy("set").agg(
            F.first("n").alias("n"), F.sort_array(F.flatten(F.collect_list(F.when(full, F.col("ids"))))).alias("merged"),
            F.sort_array(F.flatten(F.collect_list(F.when(~full, F.col("ids"))))).alias("rest"),
            F.count_if(full).alias("combinations"), F.collect_list(F.when(full, F.struct("combo", F.col("support").alias("size")))).alias("open"))
            .select("set", "n", "combinations", "open", "rest", F.slice(F.array_distinct("merged"), 1, k + 1).alias("merged")))
        # In full lists the k + 1 smallest of all of a set's are enough, and share t codes or are found with more.
        some = F.col("combinations") > 0
        listed.append(got.where(some).select("set", "n", F.lit(t).alias("shared"), F.col("merged").alias("ids")))
        if t == 1:
            # Without a full list a candidate stands in as many lists as it shares codes: counted in the row.
            counted = _most_frequent(got.where(~some).select("set", "n", "rest"), k + 1)
            unsure.append(got.where(some).select("set", F.explode(F.array_distinct("rest")).alias("candidate_id")))
        else:
            unsure.append(got.select("set", F.explode(F.array_distinct("rest")).alias("candidate_id")))
        # What extending makes of each set, and what its posting lists would.
        if t == 1:
            width = got.where(some).select("set", "n", "combinations", F.sort_array(F.transform(
                "open", lambda c: F.struct(c["combo"][0].alias("code"), c["size"].alias("size")))).alias("open"))
        else:
            codes = got.where(some).select("set", F.explode(F.array_distinct(F.flatten("open.combo"))).alias("code")).join(sizes.select("code", "size"), "code")
            width = codes.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("code", "size"))).alias("open")).join(
                got.select("set", "n", "combinations"), "set")
        h = F.size("open")
        rarest = F.slice("open", 1, F.greatest(h - t, F.lit(1)))
        lists_cost = F.aggregate(rarest, F.lit(0).cast("double"), lambda x, c: x + c["size"])
        costs = cut_lineage(width.withColumns({"extended": F.col("combinations") * (h - 1) / 2.0, "joined": lists_cost}).where(h > t))
        wide = costs.where("extended > joined")
        if not wide.isEmpty():
            postings = member.select("invoice_id", F.explode("codes").alias("code"))
            by_lists = cut_lineage(wide.select("set", F.explode(rarest["code"]).alias("code")).join(postings, "code").select("set", F.col("invoice_id").alias("candidate_id")).distinct())
            # Sets that leave are in no later list, so what they find finds them as well.
            turned = by_lists.join(member.select(F.col("invoice_id").alias("candidate_id"), F.col("set").alias("other")), "candidate_id").select("set", "other").distinct()
            members = sets.where("n = 1").select("set", F.array("set").alias("ids")).unionByName(ids)
            unsure += [by_lists, turned.join(members, "set").select(F.col("other").alias("set"), F.explode("ids").alias("candidate_id"))]
        narrow = costs.where("extended <= joined")
        if narrow.isEmpty():
            break
        if t == 1:  # the pairs of a set's codes need no join
            every = F.flatten(F.transform("open", lambda x, i: F.transform(F.slice("open", i + 2, F.size("open")), lambda y: F.array(x["code"], y["code"]))))
            level = narrow.select("set", "n", F.explode(every).alias("combo"))
        else:  # each by its further codes; what no other full combination supports comes too seldom to be extended again
            kept = got.select("set", F.col("open.combo").alias("combos")).join(narrow.select("set", "n", F.col("open.code").alias("codes")), "set")
            level = kept.select("set", "n", "codes", F.explode("combos").alias("combo")).withColumn("last", F.element_at("combo", -1)).select(
                "set", "n", "combo", F.explode(F.filter("codes", lambda c: c > F.col("last"))).alias("next")).select(
                "set", "n", F.concat("combo", F.array("next")).alias("combo"))
        t += 1
    pairs = reduce(DataFrame.unionByName, unsure).distinct()
    theirs = member.select(F.col("invoice_id").alias("candidate_id"), F.col("codes").alias("candidate_codes"))
    compared = pairs.join(sets.select("set", "codes"), "set").join(theirs, "candidate_id").select(
        "set", "candidate_id", F.size(F.array_intersect("codes", "candidate_codes")).cast("bigint").alias("shared_codes"))
    # Of what was compared the first k + 1 of a set. Each of them stands in one row of the set, with the candidates of every level.
    place = W.partitionBy("set").orderBy(F.desc("shared_codes"), "candidate_id")
    ranked = compared.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= k + 1)
    more = ranked.groupBy("set").agg(F.collect_list(F.struct((-F.col("shared_codes")).alias("less"), F.col("candidate_id").alias("id"))).alias("c"))
    for rows in listed[1:]:
        more = more.unionByName(rows.select("set", F.transform("ids", lambda i: F.struct((-F.col("shared")).cast("bigint").alias("less"), i.alias("id"))).alias("c")))
    more = cut_lineage(more.groupBy("set").agg(F.flatten(F.collect_list("c")).alias("more")))
    first = listed[0].select("set", "n", "ids", F.transform("ids", lambda i: F.lit(1).cast("bigint")).alias("shared")).unionByName(counted)
    joined = dealt(first, "set", lines // 4).join(more, "set", "left")
    # Sorted by what is shared; a candidate counts where it first stands.
    every = F.sort_array(F.concat("more", F.zip_with("ids", "shared", lambda i, x: F.struct((-x).alias("less"), i.alias("id")))))
    sorted_ids = F.transform("every", lambda c: c["id"])
    best = F.slice(F.filter("every", lambda c, i: F.array_position("sorted_ids", c["id"]) == i + 1), 1, k + 1)
    merged = (joined.withColumn("every", F.when(F.col("more").isNotNull(), every)).withColumn("sorted_ids", sorted_ids)
              .withColumn("best", F.when(F.col("every").isNotNull(), best)).select(
                  "set", "n", F.coalesce("best.id", "ids").alias("ids"), F.coalesce(F.transform("best", lambda c: -c["less"]), "shared").alias("shared")))
    # A set of one invoice is that invoice. Its own invoice is one of a set's k + 1 at most; what is left of them are its k.
    crowd = member.where("n > 1").select("invoice_id", "set").join(merged.where("n > 1").drop("n"), "set").drop("set")
    alone = merged.where("n = 1").select(F.col("set").alias("invoice_id"), "ids", "shared")
    return alone.unionByName(crowd).select(
        "invoice_id", F.slice(F.array_remove("ids", F.col("invoice_id")), 1, k).alias("candidate_id"),
        F.slice(F.filter("shared", lambda x, i: F.get("ids", i) != F.col("invoice_id")), 1, k).alias("shared_codes"))


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """Of each set's sorted ids with repeats (``rest``) the most frequent ones and their counts, as two arrays; equal counts by the smaller id."""
    single = rows.withColumn("single", F.array_distinct("rest"))
    begun = single.withColumn("begun", F.transform("single", lambda i: F.array_position("rest", i)))
    end = F.size("rest") + F.lit(1).cast("bigint")
    runs = F.transform("single", lambda i, at: F.struct((F.get("begun", at) - F.coalesce(F.get("begun", at + 1), end)).alias("less"), i.alias("id")))
    top = begun.select("set", "n", F.slice(F.sort_array(runs), 1, most).alias("c"))
    return top.select("set", "n", F.col("c.id").alias("ids"), F.transform("c", lambda c: -c["less"]).alias("shared"))
