"""Records of processing, baselines, retention and streams."""

import datetime as dt
import random
import re

import pytest
from helpers import text_screens
from pyspark.sql import functions as F

from veilscan import catalogs as c
from veilscan.operators import regression, ropa
from veilscan.plans.scan import audit
from veilscan.sources import baselines, ropa_sink, screens
from veilscan.streaming import streams


def test_names_split_over_screens(spark, monkeypatch):
    monkeypatch.setattr(ropa, "BUCKET", 3)
    rng = random.Random(3)
    pieces = ["South", "indian", "bank", "south indian", "INDIAN  bank", "net", "banking", "mobile", "sib", "mirror x", " ", "", "word", "internet", "a south"]
    texts = {i: rng.choice(pieces) for i in range(600)}
    session = lambda i: i % 60
    facts = ropa.app_name_facts(text_screens(spark, texts, session=session))
    got = {r.session_id: r.application_name for r in ropa.app_names(facts).collect()}
    rx = re.compile("|".join(r"\s+".join(p) for p in c.ROPA_APP_PHRASES), re.I)
    for s in range(60):
        joined = "\n".join(texts[i] for i in sorted(texts) if session(i) == s)
        assert (got[s] == c.ROPA_APP_FOUND) == bool(rx.search(joined)), joined


def test_record_and_sheet(spark, tmp_path):
    done = audit(text_screens(spark, {1: "KYC\nI agree\nfingerprint", 2: "Offer\nminor\nrecommended for you"}), folder=spark.conf.get("spark.checkpoint.dir"))
    record = ropa.ropa_entry(ropa.merge_scans(done.scanned, done.verdicts)).persist()
    row = record.first()
    assert row.grounds == "Consent" and row.consent_type == "Digital" and row.dpia_applicable == "Yes"
    assert row.includes_children == "Minors" and row.child_tracking == "Yes"
    assert row.process == "SCR-11" and row.department == ""
    fields = ropa.ropa_fields(record)
    edits = spark.createDataFrame([(1, "department", "Operations")], "session_id long, field string, value string")
    edited = ropa.edit_fields(fields, edits).filter("field = 'department'").first()
    assert (edited.value, edited.source) == ("Operations", "manual")
    inventory = ropa.session_inventory(ropa.merge_scans(done.scanned, done.verdicts))
    for fmt in ("csv", "json", "parquet"):
        ropa_sink.write_ropa(record, inventory, str(tmp_path / fmt), fmt)
    sheet = spark.read.csv(str(tmp_path / "csv" / "fiduciary_ropa"), header=True, multiLine=True, escape='"')
    assert sheet.columns == [h for _, _, h, _, _ in c.ROPA_COLUMNS]
    with pytest.raises(ValueError):
        ropa_sink.write_ropa(record, inventory, str(tmp_path / "x"), "xlsx")


def test_baseline_store(spark, tmp_path):
    store = str(tmp_path / "store")
    payload = '{"corrections_expected":["RULE-SEC-02","RULE-XX"]}'
    now = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([(1, "u1", " a ", now, payload), (2, "u1", "a", now, "{}"), (3, "u2", " ", now, "{}"), (4, "u2", "b", now, "{}")], baselines.SCHEMA)
    assert {r.id: r.status for r in baselines.save_baseline(store, new).collect()} == {1: "accepted", 2: "name taken", 3: "blank name", 4: "accepted"}
    assert "accepted" not in {r.status for r in baselines.save_baseline(store, new).collect()}
    rows = baselines.read_baselines(spark, store)
    assert [r.file_name for r in baselines.list_baselines(rows, "u1").collect()] == ["a"]
    assert [baselines.load_baseline(rows, i, "u1").first().status for i in (1, 4, 9)] == [200, 403, 404]
    assert baselines.delete_baseline(spark, store, 4, "u1").first().status == 403
    assert baselines.delete_baseline(spark, store, 4, "u2").first().status == 200
    assert baselines.delete_baseline(spark, store, 4, "u2").first().status == 404
    left = baselines.read_baselines(spark, store)
    found = spark.createDataFrame([(7, "RULE-SEC-02", "S", "second", 1), (5, "RULE-SEC-02", "S", "first", 1)], "screen_id long, rule_id string, act_section string, finding string, rule_order int")
    checked = regression.verify_corrections(regression.corrections_expected(left), found)
    assert [(r.rule_id, r.status, r.finding) for r in checked.orderBy("position").collect()] == [("RULE-SEC-02", "still_present", "first"), ("RULE-XX", "corrected", None)]


def test_retention(spark):
    table = text_screens(spark, {1: "a"})
    kept, deleted = screens.retention_filter(table, dt.datetime(2024, 1, 1, 0, 15, 0))
    assert kept.count() == 1 and deleted.first().deleted_count == 0
    kept, deleted = screens.retention_filter(table, dt.datetime(2024, 1, 1, 0, 15, 1))
    assert kept.count() == 0 and deleted.first().deleted_count == 1


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    table = text_screens(spark, {1: "KYC\nPAN ABCDE1234F", 2: "KYC\nPAN ABCDE1234F", 3: "Login\npassword"})
    table.write.parquet(source)
    stream = lambda: spark.readStream.schema(table.schema).parquet(source)
    out = str(tmp_path / "out")

    def sink(entities, verdicts, batch_id):
        verdicts.select("screen_id", "verdict").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    running = streams.stream_scan(stream(), sink, str(tmp_path / "c1"), str(tmp_path / "stages")).trigger(availableNow=True).start()
    running.awaitTermination(180)
    assert {r.screen_id: r.verdict for r in spark.read.parquet(out).collect()} == {1: "YES", 2: "YES", 3: "YES"}
    assert not list((tmp_path / "stages" / "veilscan").iterdir())
    kept = str(tmp_path / "kept")
    running = streams.stream_dedup(stream()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(kept)
    running.awaitTermination(120)
    assert spark.read.parquet(kept).count() == 2
    store, clock = str(tmp_path / "standing"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:10:00").cast("timestamp")))
    running = streams.stream_retention(stream(), store, str(tmp_path / "c3"), every="1 seconds", now=lambda: clock).start()
    running.processAllAvailable()
    running.stop()
    # Kept by one sweep, gone after the next; what is deleted is deleted from the store.
    assert spark.read.parquet(store).count() == table.count()
    oldest = table.agg(F.min("uploaded_at")).first()[0]
    later = F.lit(oldest).cast("timestamp") + F.expr("interval 15 minutes 1 second")
    streams.sweep_store(spark, store, later)
    left = table.filter(F.col("uploaded_at") > F.lit(oldest)).count()
    assert spark.read.schema(table.schema).parquet(store).count() == left < table.count()
    streams.sweep_store(spark, store, later + F.expr("interval 3 days"))
    assert spark.read.schema(table.schema).parquet(store).count() == 0
    assert streams.stream_dedup(table).count() == 2
