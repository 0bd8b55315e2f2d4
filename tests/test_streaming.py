"""Streaming jobs driven by files."""

import json

from pyspark.sql import functions as F

from ledgerloom import model
from ledgerloom.lake import Lake
from ledgerloom.streaming import jobs
from test_documents import document


def test_ingest_is_idempotent(spark, tmp_path):
    root, inbox = str(tmp_path / "lake"), tmp_path / "inbox"
    inbox.mkdir()
    for name, schema in model.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    seen = []

    def after(verdicts, exact):
        seen.append((verdicts.count(), exact.count()))

    def run(checkpoint):
        query = jobs.ingest(jobs.read_documents(spark, str(inbox)), root, str(tmp_path / checkpoint), after).trigger(availableNow=True).start()
        query.awaitTermination()

    (inbox / "a.json").write_text(json.dumps({**document(), "ocr_text": "x"}))
    run("c1")
    second = {**document(), "ocr_text": "x", "file_info": {"filename": "copy.pdf"}}
    (inbox / "b.json").write_text(json.dumps(second))
    run("c1")
    lake = Lake.at(spark, root)
    assert (lake.invoices.count(), lake.items.count(), lake.companies.count()) == (2, 4, 1)
    assert seen == [(1, 0), (1, 1)]
    run("c2")   # the same files again from the start
    assert (Lake.at(spark, root).invoices.count(), Lake.at(spark, root).items.count()) == (2, 4)


def _events(spark, folder):
    rows = [(1, "2024-01-01 10:00:00", "10.50"), (1, "2024-01-01 10:30:00", "1.00"), (2, "2024-01-01 23:59:00", "5.00"),
            (1, "2024-01-01 12:00:00", "2.00"), (2, "2024-01-05 00:00:00", "0.00")]
    df = spark.createDataFrame(rows, "user_id long, t string, v string").selectExpr(
        "user_id", "cast(t AS timestamp) AS ts", "cast(v AS decimal(15,2)) AS amount")
    df.write.parquet(folder)
    return df


def _stream(spark, folder, make):
    source = spark.readStream.schema("user_id long, ts timestamp, amount decimal(15,2)").parquet(folder)
    query = make(source).writeStream.format("memory").queryName("out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table("out")


def test_windows_stream_and_batch(spark, tmp_path):
    batch = _events(spark, str(tmp_path / "e"))
    expected = {(str(r["window_start"]), r["events"], float(r["revenue"])) for r in jobs.windowed_revenue(batch, "ts", "amount").collect()}
    got = {(str(r["window_start"]), r["events"], float(r["revenue"])) for r in _stream(
        spark, str(tmp_path / "e"), lambda s: jobs.windowed_revenue(s, "ts", "amount")).collect()}
    # The last window is still open on the stream.
    assert got == {e for e in expected if not e[0].startswith("2024-01-05")} and len(got) == 1


def test_sessions(spark, tmp_path):
    batch = _events(spark, str(tmp_path / "e"))
    rows = sorted((r["user_id"], r["events"]) for r in jobs.session_activity(batch, "ts", "user_id").collect())
    assert rows == [(1, 1), (1, 2), (2, 1), (2, 1)]


def test_repeats(spark, tmp_path):
    rows = [("A", 1, "5.00", "2024-01-01 00:00:00"), ("A", 1, "5.00", "2024-01-01 01:00:00"), ("B", 1, "5.00", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "invoice_num string, supplier_company_id long, v string, t string").selectExpr(
        "invoice_num", "supplier_company_id", "cast(v AS decimal(15,2)) AS total_value", "cast(t AS timestamp) AS ts")
    df.write.parquet(str(tmp_path / "i"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "i"))

    def drain(frame, name):
        query = frame.writeStream.format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).count()
    assert drain(jobs.first_arrivals(source, "ts"), "firsts") == 2
    assert drain(jobs.repeats_of_stored(source, df.where(F.col("invoice_num") == "A")), "repeats") == 2


def test_files_of_one_name_stay_apart(spark, tmp_path):
    root, inbox = str(tmp_path / "lake"), tmp_path / "inbox"
    inbox.mkdir()
    for name, schema in model.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")

    def run():
        jobs.ingest(jobs.read_documents(spark, str(inbox)), root, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    one, two, three = ({**document(), "ocr_text": f"text {i}", "file_info": {"filename": "scan.pdf", "file_size_bytes": i}} for i in range(3))
    (inbox / "a.json").write_text(json.dumps(one))
    (inbox / "b.json").write_text(json.dumps(two))
    run()
    (inbox / "c.json").write_text(json.dumps(three))
    (inbox / "d.json").write_text(json.dumps(one))  # read again
    run()
    lake = Lake.at(spark, root)
    assert (lake.documents.count(), lake.invoices.count(), lake.items.count()) == (3, 3, 6)
    assert {r["file_size_bytes"] for r in lake.documents.collect()} == {0, 1, 2}
    assert lake.documents.where("raw_data IS NULL").count() == 0
    assert lake.items.groupBy("invoice_id").count().where("count <> 2").count() == 0
