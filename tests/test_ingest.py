"""The versioned store and the ingest on top of it."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import model
from ledgerloom.operators import duplicates, identity
from ledgerloom.sources.versions import Conflict, Versions
from ledgerloom.streaming import ingest, jobs
from test_documents import document

PLAIN = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.StringType())])


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def test_update_rewrites_only_its_buckets(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    versions.begin().create("a", PLAIN, "id", 16).append("a", spark.range(1000).selectExpr("id", "'x' AS x")).finish()
    before = files_of(tmp_path)
    keys = spark.createDataFrame([(3,), (4,)], "id long")
    versions.begin().change("a", keys, lambda rows: rows.withColumn("x", F.when(F.col("id").isin(3, 4), "z").otherwise(F.col("x")))).finish()
    after = files_of(tmp_path)
    assert before.items() <= after.items()  # nothing written is ever changed
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)}) <= 2
    assert {r.x: r["count"] for r in versions.read("a").groupBy("x").count().collect()} == {"x": 998, "z": 2}
    assert versions.read("a", 1).where("x = 'z'").count() == 0
    assert versions.of_keys("a", keys).count() == 2
    assert versions.sweep(keep=1) == 0 and versions.read("a").count() == 1000  # the first commit's other buckets are still used
    versions.begin().change("a", spark.range(1000), lambda rows: rows.where("id < 5")).finish()
    assert versions.read("a").count() == 5 and versions.sweep(keep=1) == 2 and versions.read("a").count() == 5


def test_second_writer_is_told(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    versions.begin().create("a", PLAIN, "id", 2).finish()
    one, two = versions.begin(), versions.begin()
    one.append("a", spark.range(3).selectExpr("id", "'1' AS x")).finish()
    with pytest.raises(Conflict):
        two.append("a", spark.range(9).selectExpr("id", "'2' AS x")).finish()
    assert versions.read("a").count() == 3


def test_rows_outside_the_given_keys_are_refused(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    versions.begin().create("a", PLAIN, "id", 64).append("a", spark.range(9).selectExpr("id", "'x' AS x")).finish()
    with pytest.raises(ValueError):
        versions.begin().change("a", spark.range(1), lambda rows: rows.unionByName(spark.range(100, 200).selectExpr("id", "'y' AS x")))


@pytest.mark.parametrize("failing", range(5))
def test_failure_between_writes_leaves_the_old_version(spark, tmp_path, failing, monkeypatch):
    """All five tables of a load, with a failure before each of the writes."""
    from ledgerloom.sources import versions as module

    versions = ingest.open_store(spark, str(tmp_path / "s"), 2)
    at = versions.manifest().version
    done, write = [], module.Commit._write

    def broken(self, table, rows):
        if len(done) == failing:
            raise OSError("disk")
        done.append(table)
        return write(self, table, rows)

    monkeypatch.setattr(module.Commit, "_write", broken)
    commit = versions.begin()
    with pytest.raises(OSError):
        for name, key in (("documents", "doc_id"), ("companies", "company_id"), ("products", "product_id"), ("invoices", "invoice_id"), ("invoice_item", "invoice_id")):
            commit.append(name, spark.range(3).select(F.col("id").alias(key)))
        commit.finish()
    assert len(done) == failing and versions.manifest().version == at
    assert all(versions.read(t).count() == 0 for t in model.TABLES)


def test_clashing_ids_keep_both_rows(spark):
    weak = lambda kind, *key: F.length(key[0]).cast("long")  # noqa: E731 - every name of one length clashes
    names = spark.createDataFrame([(n,) for n in ("aa", "bb", "cc", "d", "aa")], "name string")
    ids, added = identity.assign(identity.with_homes(names, "k", ["name"], weak), "k", spark.createDataFrame([], identity.SCHEMA))
    first = {r.digest: r.id for r in ids.collect()}
    assert len(first) == 4 and len(set(first.values())) == 4
    more = spark.createDataFrame([(n,) for n in ("ee", "bb")], "name string")
    again, fresh = identity.assign(identity.with_homes(more, "k", ["name"], weak), "k", added)
    second = {r.digest: r.id for r in again.collect()}
    assert fresh.count() == 1 and sum(first.get(d) == i for d, i in second.items()) == 1
    assert len({*first.values(), *second.values()}) == 5
    other, _ = identity.assign(identity.with_homes(more, "other", ["name"], weak), "other", added)
    assert other.count() == 2


def invoices_and_items(spark, n=160, seed=3):
    """Suppliers with shared numbers, near totals and shared codes; missing suppliers, numbers, codes and totals."""
    rng = random.Random(seed)
    heads, lines = [], []
    for i in range(n):
        total = rng.choice([None, 0.0, 100.0, 100.5, round(rng.uniform(50, 500), 2), -3.0])
        heads.append((i, i, rng.choice(["A-1", "a-1 ", "B", "", None, f"N{rng.randint(0, 60)}"]), rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), total))
        for k in range(rng.randint(0, 3)):
            code, price, quantity = rng.choice([None, "", "84", *[f"9{x}" for x in range(12)]]), rng.choice([10.0, 10.1, 25.0, 99.0]), rng.choice([1.0, 2.0, 5.0])
            lines.append((1000 * i + k, i, code, f"thing {code} {rng.randint(0, 2)}", quantity, price, price * quantity))
    heads = spark.createDataFrame(heads, "invoice_id long, doc_id long, invoice_num string, supplier_company_id long, total_value double").withColumn(
        "total_value", F.col("total_value").cast("decimal(15,2)"))
    lines = spark.createDataFrame(lines, "item_id long, invoice_id long, hsn_code string, item_description string, quantity double, unit_price double, taxable_value double")
    shape = ingest._shaped
    return shape("invoices", heads), shape("invoice_item", lines)


def test_batches_give_what_one_load_gives(spark, tmp_path):
    invoices, items = invoices_and_items(spark)
    whole = duplicates.duplicate_verdicts(invoices, duplicates.duplicate_matches(invoices, items))
    want = sorted((r.invoice_id, r.is_duplicate, round(r.confidence, 9), r.matches, r.recommended_action) for r in whole.collect())
    versions = ingest.open_store(spark, str(tmp_path / "s"), 4)
    for part in ("invoice_id % 4 = 1", "invoice_id % 4 <> 1", "invoice_id < 50"):  # the last has nothing new
        ids = invoices.where(part).select("invoice_id")
        ingest.load(versions, {"invoices": invoices.where(part), "invoice_item": items.join(ids, "invoice_id", "left_semi")})
    got = versions.read("duplicate_verdicts").collect()
    assert sorted((r.invoice_id, r.is_duplicate, round(r.confidence, 9), r.matches, r.recommended_action) for r in got) == want
    stored = ingest.lake(versions)
    assert {r.invoice_id: r.duplication for r in stored.invoices.collect()} == {w[0]: w[1] for w in want}
    assert stored.items.count() == items.count() and versions.read("invoice_keys").distinct().count() == versions.read("invoice_keys").count()


def test_only_the_batchs_parts_are_read(spark, tmp_path):
    """A batch with keys of its own opens few of the buckets."""
    versions = ingest.open_store(spark, str(tmp_path / "s"), 64)
    invoices, items = invoices_and_items(spark, 60)
    ingest.load(versions, {"invoices": invoices, "invoice_item": items})
    lone = ingest._shaped("invoices", spark.createDataFrame([(9001, "only", 77)], "invoice_id long, invoice_num string, supplier_company_id long").withColumn(
        "total_value", F.lit("123456.78").cast("decimal(15,2)")))
    commit, read = versions.begin(), []
    plain = versions.read
    versions.read = lambda table, at=None, buckets=None: read.append((table, buckets)) or plain(table, at, buckets)
    ingest.load(versions, {"invoices": lone, "invoice_item": items.where("false")}, commit)
    assert all(buckets is not None and len(buckets) <= 6 for _, buckets in read) and {"invoices", "invoice_keys"} <= {t for t, _ in read}
    del versions.read
    assert versions.read("duplicate_verdicts").where("invoice_id = 9001 AND NOT is_duplicate").count() == 1


def test_stream_of_documents(spark, tmp_path):
    versions, inbox = ingest.open_store(spark, str(tmp_path / "s"), 4), tmp_path / "inbox"
    inbox.mkdir()
    registry = spark.createDataFrame([(1, "24AAGCI9537F1ZG", "Isko", "Gujarat", "382445")], "gst_id long, gstin string, legal_name string, state string, pin_code string")
    versions.begin().append("gst_companies", registry).finish()

    def run(checkpoint):
        jobs_ = ingest.ingest(jobs.read_documents(spark, str(inbox)), versions, str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        jobs_.awaitTermination()
        return versions.manifest()

    (inbox / "a.json").write_text(json.dumps({**document(), "ocr_text": "x"}))
    run("c1")
    now = ingest.lake(versions)
    company = now.companies.first()
    assert (company.legal_name, company.state, company.address) == ("Isko", "Gujarat", "Gujarat - 382445")
    assert [tuple(r) for r in versions.read("ingest_log").select("valid", F.size("issues")).collect()] == [(True, 0)]
    (inbox / "b.json").write_text(json.dumps({**document(), "ocr_text": "x", "file_info": {"filename": "copy.pdf"}}))
    bare = document(file_info={"filename": "bare.pdf"}, form_analysis={"form_fields": []})
    (inbox / "c.json").write_text(json.dumps({**bare, "ocr_text": ""}))
    at = run("c1")
    now = ingest.lake(versions)
    assert (now.invoices.count(), now.items.count(), now.companies.count(), now.documents.count()) == (3, 6, 2, 3)
    assert now.invoices.where("duplication").count() == 3  # the third has the same lines
    assert versions.read("ingest_log").where("NOT valid").first().issues == ["missing invoice number", "missing supplier name", "invalid taxable value"]
    assert now.companies.where("gstin IS NULL").first().legal_name == "Unknown Supplier"
    assert now.items.where("product_id IS NULL").count() == 0 and now.products.count() == 2
    again = run("c2")  # the same files from the start
    assert ingest.lake(versions, again).invoices.count() == 3 and versions.read("invoice_keys").count() == versions.read("invoice_keys", at).count()
    assert run("c2").version == again.version
