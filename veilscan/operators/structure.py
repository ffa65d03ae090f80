"""Reading order: from blocks with boxes to lines, columns and cells.

Both groupings of the layout are order dependent, but a gap wider than the
threshold always separates.  A screen is therefore first cut at such gaps with a
window; the folds then only see one short run of blocks each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.numbers import rounded
from veilscan.functions.regex import let
from veilscan.functions.tables import bound
from veilscan.functions.text import normalised_value, strip

# Slack for rounding when cutting at gaps; the fold decides what is left.
SLACK = 0.02
# Partitions of the layout for each core, at least; any number gives the same result.
PARTITIONS_A_CORE = 8
# Blocks of a partition of the layout, about; a few thousand screens.
BLOCKS_A_PARTITION = 100_000
GLUE = "^[/\\-:.]"
GLUE_END = "[/\\-:.]$"


def with_geometry(blocks: DataFrame) -> DataFrame:
    """Bounds, centre, width and height of each block."""
    xs = F.transform("bbox", lambda p: p[0])
    ys = F.transform("bbox", lambda p: p[1])
    bounds = blocks.select(
        "*",
        F.coalesce(F.array_min(xs), F.lit(0.0)).alias("x1"),
        F.coalesce(F.array_min(ys), F.lit(0.0)).alias("y1"),
        F.coalesce(F.array_max(xs), F.lit(0.0)).alias("x2"),
        F.coalesce(F.array_max(ys), F.lit(0.0)).alias("y2"),
    )
    return bounds.select(
        "*",
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
        ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")).alias("width"),
        F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")).alias("height"),
    )


def spread_screens(blocks: DataFrame) -> DataFrame:
    """Blocks by screen, over enough partitions for what becomes of them.

    A screen's lines, runs and pairs are many times its blocks, and all of that is sorted where the
    blocks lie.  Left alone, the engine merges partitions by the size of the blocks.  Blocks are
    counted first, so that a partition's share, and with it what a task holds, does not grow with
    the input; a stream's are not known.
    """
    session = blocks.sparkSession
    least = max(PARTITIONS_A_CORE * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    share = 0 if blocks.isStreaming else -(-blocks.count() // BLOCKS_A_PARTITION)
    return blocks.repartition(max(least, share), "screen_id")


def with_medians(blocks: DataFrame, **first: Column) -> DataFrame:
    """Upper medians of height and width of each block's screen (exact, not interpolated).

    ``first``: columns over ordered windows of a screen; worked out before, their sort serves the medians too.
    """
    placed = spread_screens(with_geometry(blocks)).withColumns(first)
    upper = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {0} DESC) OVER (PARTITION BY screen_id)"
    return placed.select(
        "*",
        F.expr(upper.format("height")).alias("median_height"),
        F.expr(upper.format("width")).alias("median_width"),
    )


BLOCK_FIELDS = ["x1", "cy", "block_index", "text", "confidence", "y1", "x2", "y2", "cx", "width", "height"]


def _runs(blocks: DataFrame, order: list[str], value: str, threshold: Column) -> DataFrame:
    """Blocks with medians; runs between gaps wider than the threshold are numbered."""
    place = Window.partitionBy("screen_id").orderBy(*order)
    measured = with_medians(blocks, _gap=F.col(value) - F.lag(value).over(place))
    return (
        measured.withColumn("_threshold", threshold)
        .withColumn("_opens", F.when(F.col("_gap") > F.col("_threshold") + SLACK, 1).otherwise(0))
        .withColumn("_run", F.sum("_opens").over(place))
        .drop("_gap", "_opens")
    )


def line_groups(blocks: DataFrame) -> DataFrame:
    """Blocks of each visual line, left to right: ``screen_id, run, place, median_height, members``.

    Blocks are taken top to bottom; one joins the current line when its centre is
    within the threshold of the line's mean centre.
    """
    threshold = F.greatest(F.lit(10.0), F.col("median_height") * 0.65)
    runs = _runs(blocks, ["cy", "x1", "block_index"], "cy", threshold)
    reading = F.struct("cy", "x1", "block_index", F.struct(*BLOCK_FIELDS).alias("b"))
    grouped = runs.groupBy("screen_id", "_run").agg(
        F.sort_array(F.collect_list(reading)).alias("items"),
        F.first("_threshold").alias("threshold"),
        F.first("median_height").alias("median_height"),
    )
    block = F.transform("items", lambda i: i["b"])

    def step(lines, b):
        current = F.element_at(lines, -1)
        mean = F.aggregate(current, F.lit(0.0), lambda a, m: a + m["cy"]) / F.size(current)
        joins = F.abs(b["cy"] - mean) <= F.col("threshold")
        return F.when(
            joins,
            F.concat(
                F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(current, F.array(b)))
            ),
        ).otherwise(F.concat(lines, F.array(F.array(b))))

    rest = F.slice(block, 2, F.size("items"))
    lines = F.when(
        F.size("items") > 1, F.aggregate(rest, F.array(F.slice(block, 1, 1)), step)
    ).otherwise(F.array(block))
    exploded = grouped.select("screen_id", "_run", "median_height", F.posexplode(lines).alias("place", "members"))
    # BLOCK_FIELDS starts with x1, so the natural order of the structs is left to right.
    return exploded.select(
        "screen_id", F.col("_run").alias("run"), "place", "median_height",
        F.sort_array("members").alias("members"),
    )


def line_text(members: Column, median_height: Column) -> Column:
    """Text of a line: pieces are glued at ``/ - : .`` or when they almost touch."""
    tokens = F.filter(
        F.transform(
            members,
            lambda m: F.struct(strip(m["text"]).alias("token"), m["x1"].alias("x1"), m["x2"].alias("x2")),
        ),
        lambda t: t["token"] != "",
    )
    zero = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("x2"))

    def step(state, t):
        gap = F.greatest(F.lit(0.0), t["x1"] - state["x2"])
        glued = (
            state["text"].rlike(GLUE_END)
            | t["token"].rlike(GLUE)
            | (gap <= F.greatest(F.lit(6.0), median_height * 0.18))
        )
        text = (
            F.when(state["text"] == "", t["token"])
            .when(glued, F.concat(state["text"], t["token"]))
            .otherwise(F.concat(state["text"], F.lit(" "), t["token"]))
        )
        return F.struct(text.alias("text"), t["x2"].alias("x2"))

    return F.aggregate(tokens, zero, step, lambda s: s["text"])


def group_lines(blocks: DataFrame) -> DataFrame:
    """``screen_id, line_index, block_indices`` of every visual line, empty ones included."""
    place = Window.partitionBy("screen_id").orderBy("run", "place")
    return line_groups(blocks).select(
        "screen_id",
        (F.row_number().over(place) - 1).alias("line_index"),
        F.transform("members", lambda m: m["block_index"]).alias("block_indices"),
    )


def line_table(blocks: DataFrame) -> DataFrame:
    """Non-empty lines with offsets into the screen's text, bounds and confidence."""
    composed = bound(line_groups(blocks), line_text(F.col("members"), F.col("median_height")), "text").filter(F.col("text") != "")
    place = Window.partitionBy("screen_id").orderBy("run", "place")
    before = place.rowsBetween(Window.unboundedPreceding, -1)

    def edge(field, pick):
        return rounded(pick(F.transform("members", lambda m: m[field])), 1)

    total = F.aggregate("members", F.lit(0.0), lambda a, m: a + m["confidence"])
    rows = composed.select(
        "screen_id",
        (F.row_number().over(place) - 1).alias("line_index"),
        "text",
        F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int").alias("start"),
        F.transform("members", lambda m: m["block_index"]).alias("block_indices"),
        edge("x1", F.array_min).alias("x1"),
        edge("y1", F.array_min).alias("y1"),
        edge("x2", F.array_max).alias("x2"),
        edge("y2", F.array_max).alias("y2"),
        total.alias("confidence_total"),
        "members",
    )
    return rows.select(
        "*",
        (F.col("start") + F.length("text")).alias("end"),
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
        ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        rounded(F.col("confidence_total") / F.size("members"), 4).alias("avg_confidence"),
    )


def text_line_table(screens: DataFrame) -> DataFrame:
    """Lines of text-only screens: the newline-separated pieces, with offsets."""
    pieces = screens.select(
        "screen_id", F.posexplode(F.split("full_text", "\n", -1)).alias("line_index", "text"),
        "avg_confidence",
    )
    before = Window.partitionBy("screen_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn(
        "start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    )
    return placed.select(
        "screen_id", "line_index", "text", "start",
        (F.col("start") + F.length("text")).alias("end"), "avg_confidence",
    )


def with_line_context(lines: DataFrame) -> DataFrame:
    """Text of the line before, the line and the line after."""
    place = Window.partitionBy("screen_id").orderBy("line_index")
    return lines.withColumn(
        "context_text",
        F.concat_ws("\n", F.lag("text").over(place), F.col("text"), F.lead("text").over(place)),
    )


def structured_screens(lines: DataFrame) -> DataFrame:
    """Screens as the text stages expect them: full text and confidence per line."""
    rows = F.array_sort(
        F.collect_list(
            F.struct(
                "line_index", "text", F.col("confidence_total").alias("total"),
                F.size("members").alias("blocks"),
            )
        )
    )
    grouped = lines.groupBy("screen_id").agg(
        rows.alias("ls"),
        (F.sum("confidence_total") / F.sum(F.size("members"))).alias("mean_confidence"),
    )
    return grouped.select(
        "screen_id",
        F.array_join(F.transform("ls", lambda r: r["text"]), "\n").alias("full_text"),
        F.transform("ls", lambda r: F.struct(r["total"].alias("total"), r["blocks"].alias("blocks"))).alias("line_conf"),
        rounded(F.col("mean_confidence"), 4).alias("avg_confidence"),
    )


def cluster_columns(blocks: DataFrame) -> DataFrame:
    """Columns of each screen: nearest running mean of the left edges, left to right."""
    threshold = F.greatest(F.lit(45.0), F.col("median_width") * 0.85)
    runs = _runs(blocks, ["x1", "cy", "block_index"], "x1", threshold)
    grouped = runs.groupBy("screen_id", "_run").agg(
        F.array_sort(F.collect_list(F.struct("x1", "cy", "block_index", "x2", "cx"))).alias("bs"),
        F.first("_threshold").alias("threshold"),
    )

    def column_struct(x1, x2, cx, x1_sum, cx_sum, members):
        return F.struct(
            x1.alias("x1"), x2.alias("x2"), cx.alias("cx"), x1_sum.alias("x1_sum"),
            cx_sum.alias("cx_sum"), members.alias("block_indices"),
        )

    def opened(b):
        return column_struct(b["x1"], b["x2"], b["cx"], b["x1"], b["cx"], F.array(b["block_index"]))

    def joined(c, b):
        members = F.concat(c["block_indices"], F.array(b["block_index"]))
        x1_sum, cx_sum = c["x1_sum"] + b["x1"], c["cx_sum"] + b["cx"]
        return column_struct(
            rounded(x1_sum / F.size(members), 2), F.greatest(c["x2"], b["x2"]),
            rounded(cx_sum / F.size(members), 2), x1_sum, cx_sum, members,
        )

    def step(columns, b):
        near = F.filter(
            F.transform(
                columns,
                lambda c, i: F.struct(F.abs(b["x1"] - c["x1"]).alias("distance"), i.alias("i")),
            ),
            lambda d: d["distance"] <= F.col("threshold"),
        )
        best = F.array_min(near)["i"]
        return F.when(best.isNull(), F.concat(columns, F.array(opened(b)))).otherwise(
            F.transform(columns, lambda c, i: F.when(i == best, joined(c, b)).otherwise(c))
        )

    first = F.element_at("bs", 1)
    rest = F.slice("bs", 2, F.size("bs"))
    columns = F.aggregate(rest, F.array(opened(first)), step)
    exploded = grouped.select("screen_id", "_run", F.posexplode(columns).alias("place", "c"))
    order = Window.partitionBy("screen_id").orderBy("c.x1", "_run", "place")
    return exploded.select(
        "screen_id", (F.row_number().over(order) - 1).alias("column_index"),
        "c.x1", "c.x2", "c.cx", "c.block_indices",
    )


def row_cells(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per block of a line, with its column."""
    cells = lines.select("screen_id", "line_index", F.posexplode("members").alias("cell_index", "m"))
    members = columns.select("screen_id", "column_index", F.explode("block_indices").alias("block_index"))
    flat = cells.select(
        "screen_id", "line_index", "cell_index", "m.block_index", "m.text",
        rounded(F.col("m.confidence"), 4).alias("confidence"), "m.x1", "m.y1", "m.x2", "m.y2",
    )
    return flat.join(members, ["screen_id", "block_index"], "left")


def span_to_lines(matches: DataFrame, lines: DataFrame, window: int = 1) -> DataFrame:
    """Lines a match touches, widened by ``window``: context text, blocks, box of the touched lines.

    A match knows its first and last line, so this is an equi-join on line numbers.
    """
    key = [c for c in ("screen_id", "ord", "pii_type", "value", "start", "end") if c in matches.columns]
    near = matches.select(
        *key, "line", "last_line",
        F.explode(
            F.sequence(F.greatest(F.col("line") - window, F.lit(0)), F.col("last_line") + window)
        ).alias("line_index"),
    )
    has_boxes = "x1" in lines.columns
    extra = ["block_indices", "x1", "y1", "x2", "y2"] if has_boxes else []
    joined = near.join(
        lines.select("screen_id", "line_index", F.col("text").alias("line_text"), *[F.col(c).alias(f"l_{c}") for c in extra]),
        ["screen_id", "line_index"],
    )
    touched = (F.col("line_index") >= F.col("line")) & (F.col("line_index") <= F.col("last_line"))
    texts = F.array_sort(F.collect_list(F.struct("line_index", "line_text")))
    aggregates = [
        F.array_join(F.transform(texts, lambda t: t["line_text"]), "\n").alias("context_text"),
        F.min(F.when(touched, F.col("line_index"))).alias("first_line"),
        F.max(F.when(touched, F.col("line_index"))).alias("final_line"),
    ]
    if has_boxes:
        aggregates += [
            F.array_sort(F.flatten(F.collect_list("l_block_indices"))).alias("block_indices"),
            F.min(F.when(touched, F.col("l_x1"))).alias("x1"),
            F.min(F.when(touched, F.col("l_y1"))).alias("y1"),
            F.max(F.when(touched, F.col("l_x2"))).alias("x2"),
            F.max(F.when(touched, F.col("l_y2"))).alias("y2"),
        ]
    return joined.groupBy(*key).agg(*aggregates)


def match_to_blocks(matches: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that hold a value or are held by it; else those with one of its longer words.

    The blocks of a screen travel as one array, so no row is made per pair.
    """
    per_screen = (
        with_geometry(blocks)
        .select(
            "screen_id",
            F.struct(
                "block_index", normalised_value(F.col("text")).alias("key"),
                F.lower("text").alias("lower"), "confidence", "x1", "y1", "x2", "y2",
            ).alias("b"),
        )
        .groupBy("screen_id")
        .agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    )
    value_key = normalised_value(F.col("value"))
    long_words = F.filter(F.split(F.lower(strip(F.col("value"))), r"\s+"), lambda w: F.length(w) >= 4)
    joined = matches.join(per_screen, "screen_id").withColumn("_key", value_key).withColumn("_words", long_words)
    direct = F.filter(
        "blocks",
        lambda b: (F.col("_key") != "") & (F.contains(b["key"], F.col("_key")) | F.contains(F.col("_key"), b["key"])),
    )
    loose = let(
        F.col("_words"),
        lambda ws: F.filter("blocks", lambda b: F.exists(ws, lambda w: F.contains(b["lower"], w))),
    )
    staged = joined.withColumn("_direct", direct).withColumn(
        "_found", F.when(F.size("_direct") > 0, F.col("_direct")).otherwise(loose)
    )

    def pick(field, function):
        return rounded(function(F.transform("_found", lambda b: b[field])), 1)

    mean = F.aggregate("_found", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size("_found")
    return staged.select(
        *matches.columns,
        F.transform("_found", lambda b: b["block_index"]).alias("block_indices"),
        pick("x1", F.array_min).alias("x1"), pick("y1", F.array_min).alias("y1"),
        pick("x2", F.array_max).alias("x2"), pick("y2", F.array_max).alias("y2"),
        F.coalesce(F.when(F.size("_found") > 0, rounded(mean, 4)), F.lit(0.0)).alias("block_confidence"),
    )
