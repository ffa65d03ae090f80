"""Tables of screens and blocks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.numbers import rounded
from veilscan.functions.text import WHITESPACE, canonical_text

SCREEN_COLUMNS = [
    "screen_id", "session_id", "user_id", "filename", "uploaded_at", "full_text", "avg_confidence",
]
# Base time of rows whose source table has none.
EPOCH_2024 = 1704067200


def _screens(df: DataFrame) -> DataFrame:
    """Fill the columns a text source does not have."""
    defaults = {
        "user_id": F.concat(F.lit("user"), (F.col("screen_id") % 50).cast("string")),
        "filename": F.concat(F.lit("screen_"), F.col("screen_id").cast("string")),
        "uploaded_at": F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("screen_id") * 60),
        "avg_confidence": F.lit(1.0),
    }
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select(*SCREEN_COLUMNS)


def spread(table: DataFrame) -> DataFrame:
    """Use all cores on an input that comes in fewer pieces than there are cores.

    Scanning text is all computation, and a small file is often a single row group.
    Large inputs have more splits than cores and pass through untouched.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def strip_tags(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, entities decoded."""
    text = F.regexp_replace(
        html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " "
    )
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|nav|title|br)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def read_screens(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per screen from a ``documents``, ``pages``, ``conversations`` or ``screens`` table.

    The text of a screen is one value: a conversation's turns are joined in turn order.
    """
    table = spark.read.parquet(path)
    if kind != "conversations":
        table = spread(table)
    if kind == "screens":
        return _screens(table)
    if kind == "documents":
        return _screens(
            table.select(
                F.col("doc_id").alias("screen_id"),
                (F.lit(1000) + F.regexp_extract("source", r"(\d+)$", 1).try_cast("long")).alias("session_id"),
                canonical_text(F.col("text")).alias("full_text"),
            )
        )
    if kind == "pages":
        return _screens(
            table.select(
                F.col("page_id").alias("screen_id"),
                F.xxhash64(F.parse_url("url", F.lit("HOST"))).alias("session_id"),
                canonical_text(strip_tags(F.col("html"))).alias("full_text"),
            )
        )
    if kind == "conversations":
        turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
        return _screens(
            table.groupBy(F.col("conv_id").alias("screen_id"))
            .agg(F.transform(turns, lambda t: t["text"]).alias("texts"))
            .select(
                "screen_id",
                F.col("screen_id").alias("session_id"),
                canonical_text(F.array_join("texts", "\n")).alias("full_text"),
            )
        )
    raise ValueError(f"unknown kind of screens: {kind}")


# Devanagari digits read by the text recogniser, and a rupee sign it misreads.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
MISREAD_RUPEE = r"(?:^|[\s\x1c-\x1f\x85\p{Z}])(?:\.+={1,2}|={1,2})[\s\x1c-\x1f\x85\p{Z}]*(?=\p{Nd}+(?:[ ,.]\p{Nd}+)*(?![\p{L}\p{N}_]))"


def repaired_text(text: Column) -> Column:
    text = F.translate(text, DEVANAGARI_DIGITS, "0123456789")
    return F.btrim(F.regexp_replace(text, MISREAD_RUPEE, " ₹ "), F.lit(WHITESPACE))


def read_blocks(raw: DataFrame) -> DataFrame:
    """Normalised blocks; rows that lack text, box or confidence are dropped."""
    points_ok = F.forall(
        "bbox", lambda p: p.isNotNull() & (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()
    )
    kept = raw.filter(
        F.col("text").isNotNull()
        & F.col("confidence").isNotNull()
        & F.col("bbox").isNotNull()
        & points_ok
    )
    return kept.select(
        "screen_id",
        "block_index",
        repaired_text(F.col("text")).alias("text"),
        rounded(F.col("confidence"), 4).alias("confidence"),
        F.transform("bbox", lambda p: F.transform(F.slice(p, 1, 2), lambda v: rounded(v, 1))).alias("bbox"),
    )


def scoped_listing(screens: DataFrame, user_id: str, ids: list[int] | None = None) -> DataFrame:
    """One user's screens, newest first, optionally only some ids."""
    mine = screens.filter(F.col("user_id") == user_id)
    if ids is not None:
        mine = mine.filter(F.col("screen_id").isin(ids))
    return mine.orderBy(F.col("uploaded_at").desc(), F.col("screen_id"))


def retention_split(screens: DataFrame, asof: dt.datetime | Column, minutes: int = 15) -> DataFrame:
    """Every screen with ``expired`` set when it is older than the limit."""
    asof = asof if isinstance(asof, Column) else F.lit(asof)
    limit = asof - F.make_dt_interval(mins=F.lit(minutes))
    return screens.withColumn("expired", F.col("uploaded_at") < limit)


def retention_filter(
    screens: DataFrame, asof: dt.datetime | Column, minutes: int = 15
) -> tuple[DataFrame, DataFrame]:
    """(screens kept, one row with ``deleted_count``)."""
    split = retention_split(screens, asof, minutes)
    kept = split.filter(~F.col("expired")).drop("expired")
    deleted = split.agg(F.count(F.when(F.col("expired"), 1)).alias("deleted_count"))
    return kept, deleted


def purge_scanned(screens: DataFrame, scanned: DataFrame) -> DataFrame:
    """Screens not yet scanned."""
    return screens.join(scanned.select("screen_id"), "screen_id", "left_anti")


def avg_confidence(blocks: DataFrame, screens: DataFrame | None = None) -> DataFrame:
    """Mean block confidence per screen, 4 places; 0 for screens without blocks."""
    # Confidences have four places, so their sum as decimals is exact in any order.
    exact = F.sum(F.col("confidence").cast("decimal(10,4)")).cast("double") / F.count("confidence")
    means = blocks.groupBy("screen_id").agg(rounded(exact).alias("avg_confidence"))
    if screens is None:
        return means
    return (
        screens.select("screen_id")
        .join(means, "screen_id", "left")
        .select("screen_id", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))
    )
