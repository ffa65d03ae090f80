"""Line grouping and column clustering against a plain reading of their definition."""

import random

from helpers import block_table
from pyspark.sql import functions as F

from veilscan.operators import structure


def random_screens(seed, screens=25):
    rng = random.Random(seed)
    out = {}
    for s in range(screens):
        items = []
        for _ in range(rng.randint(1, 40)):
            x, y, w, h = rng.randint(0, 600), rng.randint(0, 300), rng.randint(1, 120), rng.randint(1, 40)
            items.append((rng.choice(["ab", "/", "x:", " ", "Rs 1", "-z"]), x, y, x + w, y + h))
        out[s] = items
    return out


def naive_columns(items):
    rows = [dict(i=i, x1=float(x1), x2=float(x2), cy=(y1 + y2) / 2, w=max(1.0, x2 - x1)) for i, (_, x1, y1, x2, y2) in enumerate(items)]
    limit = max(45.0, sorted(r["w"] for r in rows)[len(rows) // 2] * 0.85)
    columns = []
    for r in sorted(rows, key=lambda r: (r["x1"], r["cy"], r["i"])):
        near = [(abs(r["x1"] - col["x1"]), n) for n, col in enumerate(columns) if abs(r["x1"] - col["x1"]) <= limit]
        if not near:
            columns.append(dict(x1=r["x1"], total=r["x1"], ids=[r["i"]]))
            continue
        col = columns[min(near)[1]]
        col["ids"].append(r["i"])
        col["total"] += r["x1"]
        col["x1"] = round(col["total"] / len(col["ids"]), 2)
    return sorted(sorted(col["ids"]) for col in columns)


def naive_lines(items):
    rows = [dict(i=i, x1=x1, cy=(y1 + y2) / 2, h=max(1.0, y2 - y1)) for i, (_, x1, y1, x2, y2) in enumerate(items)]
    limit = max(10.0, sorted(r["h"] for r in rows)[len(rows) // 2] * 0.65)
    lines = []
    for r in sorted(rows, key=lambda r: (r["cy"], r["x1"], r["i"])):
        if lines and abs(r["cy"] - sum(m["cy"] for m in lines[-1]) / len(lines[-1])) <= limit:
            lines[-1].append(r)
        else:
            lines.append([r])
    return [[m["i"] for m in sorted(line, key=lambda m: (m["x1"], m["cy"], m["i"]))] for line in lines]


def test_columns_and_lines(spark):
    screens = random_screens(7)
    blocks = block_table(spark, screens).persist()
    columns, lines = {}, {}
    for r in structure.cluster_columns(blocks).collect():
        columns.setdefault(r.screen_id, []).append(sorted(r.block_indices))
    for r in structure.group_lines(blocks).orderBy("screen_id", "line_index").collect():
        lines.setdefault(r.screen_id, []).append(list(r.block_indices))
    for s, items in screens.items():
        assert sorted(columns[s]) == naive_columns(items), s
        assert lines[s] == naive_lines(items), s


def test_line_offsets_fit_the_text(spark):
    table = structure.line_table(block_table(spark, random_screens(11)))
    text = structure.structured_screens(table).select("screen_id", "full_text")
    wrong = table.join(text, "screen_id").filter(
        F.expr("substring(full_text, start + 1, end - start) <> text")
    )
    assert wrong.count() == 0


def test_value_blocks(spark):
    blocks = block_table(spark, {1: [("Rs 1,200", 0, 0, 10, 10), ("other", 20, 0, 30, 10), ("Lakeview Road", 0, 30, 9, 40)]})
    values = spark.createDataFrame([(1, "1200"), (1, "Old Lakeview"), (1, "zzz")], "screen_id long, value string")
    got = {r.value: (list(r.block_indices), r.block_confidence) for r in structure.match_to_blocks(values, blocks).collect()}
    assert got == {"1200": ([0], 0.96), "Old Lakeview": ([2], 0.96), "zzz": ([], 0.0)}


def test_screens_are_spread_by_what_becomes_of_their_blocks(spark):
    lines = structure.line_table(block_table(spark, {i: [("Cust ID", 0, 0, 50, 20)] for i in range(40)}))
    lines.collect()
    assert lines.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_partitions_follow_the_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(structure, "BLOCKS_A_PARTITION", 2)
    items = [("Cust ID", 0, 0, 50, 20), ("C12345", 90, 0, 150, 20), ("Branch", 0, 60, 50, 80), ("x", 90, 60, 150, 80)]
    blocks = block_table(spark, {i: items for i in range(200)})
    assert structure.spread_screens(blocks).rdd.getNumPartitions() == 400
    assert structure.line_table(blocks).count() == 400


def test_text_of_a_line_is_composed_once(spark):
    table = structure.line_table(block_table(spark, {1: [("Cust ID", 0, 0, 50, 20)]}))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(structure.GLUE_END) == 1
