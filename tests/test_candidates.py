"""Candidates of values that a screen repeats."""

from pyspark.sql import functions as F

from veilscan.operators import resolve


def test_repeated_value_leaves_one_entry_per_type(spark):
    n = F.col("id")
    ev = spark.range(20_000).select(
        F.lit(1).alias("screen_id"), F.lit("k").alias("value_key"), F.concat(F.lit("v"), n).alias("value"),
        F.struct((n % 40).cast("int").alias("stage"), n.alias("start")).alias("ord"), F.concat(F.lit("T"), n % 3).alias("pii_type"),
        F.lit("rule").alias("source_rule"), F.lit(0.9).alias("ocr_confidence"), F.lit(False).alias("is_layout"),
        F.lit(None).cast("double").alias("spatial_confidence"), F.lit(None).cast("double").alias("validation_confidence"),
        F.lit(False).alias("aadhaar_valid"), F.lit(False).alias("aadhaar_checksum_valid"), n.alias("start"), (n + 1).alias("end"),
        F.lit(0).alias("line"), F.lit(0).alias("last_line"), (F.lit(0.5) + (n % 3) / 10).alias("evidence_confidence"))
    (row,) = resolve.candidates(ev).collect()
    assert row.candidate_types == ["T2", "T1", "T0"] and len(row.evidence) == 3 and row.evidence_count == 20_000
    assert (row.value, row.best_type, row.best_confidence) == ("v0", "T2", 0.7)
    # The best of a type is its first among equal confidences: T2 has stage 0 first at 80, T1 at 40.
    assert [e.start for e in row.evidence] == [80, 40, 0]
    assert resolve.candidates(ev.where("false")).collect() == []


def test_candidates_keep_every_match_of_their_value(spark):
    n = F.col("id")
    ev = spark.range(12).select(
        F.lit(1).alias("screen_id"), F.lit("k").alias("value_key"), F.concat(F.lit("v"), n).alias("value"),
        F.struct(F.lit(0).alias("stage"), n.alias("start")).alias("ord"), F.concat(F.lit("T"), n % 3).alias("pii_type"),
        F.lit("rule").alias("source_rule"), F.lit(0.9).alias("ocr_confidence"), F.lit(False).alias("is_layout"),
        F.lit(None).cast("double").alias("spatial_confidence"), F.lit(None).cast("double").alias("validation_confidence"),
        F.lit(False).alias("aadhaar_valid"), F.lit(False).alias("aadhaar_checksum_valid"), n.alias("start"), (n + 1).alias("end"),
        F.lit(0).alias("line"), F.lit(0).alias("last_line"), (F.lit(0.5) + (n % 3) / 10).alias("evidence_confidence"))
    found = resolve.candidates(ev)
    (row,) = found.collect()
    assert [m.start for m in row.matches] == [2, 5, 8, 11, 1, 4, 7, 10, 0, 3, 6, 9] and len(row.evidence) == 3
    # What resolution needs leaves the matches where they are.
    plan = resolve.resolve_entities(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "items" not in plan
