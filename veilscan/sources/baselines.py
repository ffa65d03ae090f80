"""The baseline store: an append-only table with a table of deletions next to it.

Nothing is ever rewritten, so a lost executor or a failed job leaves the store as it
was.  ``<store>/rows`` holds baselines partitioned by user, ``<store>/deleted`` ids.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.functions.text import strip

SCHEMA = "id bigint, user_id string, file_name string, created_at timestamp, payload string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_baselines(spark: SparkSession, store: str) -> DataFrame:
    """Baselines that have not been deleted."""
    rows = _read(spark, f"{store}/rows", SCHEMA)
    deleted = _read(spark, f"{store}/deleted", "id bigint")
    return without_deleted(rows, deleted)


def without_deleted(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Baselines whose id is not among the deleted ones."""
    kept = rows.join(deleted.select("id"), "id", "left_anti")
    return kept.select("id", "user_id", "file_name", "created_at", "payload")


def judge_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New baselines with ``status``: accepted, blank name, or name already taken.

    Names are trimmed; of several new ones with one name the first id wins.
    """
    named = new.withColumn("file_name", strip(F.coalesce("file_name", F.lit(""))))
    same = Window.partitionBy("user_id", "file_name").orderBy("id")
    taken = existing.select("user_id", "file_name").distinct().withColumn("_taken", F.lit(True))
    status = (
        F.when(F.col("file_name") == "", "blank name")
        .when(F.col("_taken") | (F.col("_nth") > 1), "name taken")
        .otherwise("accepted")
    )
    return (
        named.withColumn("_nth", F.row_number().over(same))
        .join(taken, ["user_id", "file_name"], "left")
        .select("id", "user_id", "file_name", "created_at", "payload", status.alias("status"))
    )


def save_baseline(store: str, new: DataFrame) -> DataFrame:
    """Append acceptable baselines; returns every new one with its status.

    The result is a written report, so it cannot change with the store.
    """
    spark = new.sparkSession
    # The report comes first and is what is appended from: the store changes with the write, so
    # nothing may be judged against it again.
    report = f"{store}/reports/{uuid.uuid4().hex}"
    judge_new(read_baselines(spark, store), new).write.parquet(report)
    judged = spark.read.parquet(report)
    accepted = judged.filter(F.col("status") == "accepted").drop("status")
    accepted.write.mode("append").partitionBy("user_id").parquet(f"{store}/rows")
    return judged


def list_baselines(store: DataFrame, user_id: str) -> DataFrame:
    """One user's baselines, newest first, without their payload."""
    return (
        store.filter(F.col("user_id") == user_id)
        .select("id", "file_name", "created_at")
        .orderBy(F.col("created_at").desc(), F.col("id"))
    )


def load_baseline(store: DataFrame, baseline_id: int, user_id: str) -> DataFrame:
    """The payload of one baseline, or why it cannot be shown (404 or 403)."""
    wanted = store.sparkSession.range(1).select(F.lit(baseline_id).cast("bigint").alias("id"))
    mine = F.col("user_id") == user_id
    status = F.when(F.col("user_id").isNull(), 404).when(~mine, 403).otherwise(200)
    return wanted.join(store, "id", "left").select(
        "id",
        status.alias("status"),
        F.when(mine, F.col("file_name")).alias("file_name"),
        F.when(mine, F.col("created_at")).alias("created_at"),
        F.when(mine, F.from_json("payload", "corrections_expected array<string>, images array<string>")).alias("payload"),
    )


def delete_baseline(spark: SparkSession, store: str, baseline_id: int, user_id: str) -> DataFrame:
    """Delete one baseline if it is the user's; returns its status (200, 403 or 404)."""
    outcome = load_baseline(read_baselines(spark, store), baseline_id, user_id).select("id", "status")
    status = outcome.first()["status"]  # one row by construction
    if status == 200:
        outcome.filter(F.col("status") == 200).select("id").write.mode("append").parquet(f"{store}/deleted")
    return spark.range(1).select(
        F.lit(baseline_id).cast("bigint").alias("id"), F.lit(status).alias("status")
    )
