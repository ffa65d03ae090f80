"""Small tables for tests."""

import datetime as dt

BLOCK_SCHEMA = "screen_id long, block_index int, text string, confidence double, bbox array<array<double>>"


def block_rows(screen_id, items, confidence=0.96):
    return [
        (screen_id, i, text, confidence, [[float(x1), float(y1)], [float(x2), float(y1)], [float(x2), float(y2)], [float(x1), float(y2)]])
        for i, (text, x1, y1, x2, y2) in enumerate(items)
    ]


def block_table(spark, screens):
    rows = [row for screen_id, items in screens.items() for row in block_rows(screen_id, items)]
    return spark.createDataFrame(rows, BLOCK_SCHEMA)


def text_screens(spark, texts, confidence=0.95, session=None):
    rows = [
        (i, session(i) if session else 1, "u", f"f{i}", dt.datetime(2024, 1, 1), text, confidence)
        for i, text in texts.items()
    ]
    return spark.createDataFrame(
        rows,
        "screen_id long, session_id long, user_id string, filename string, uploaded_at timestamp, full_text string, avg_confidence double",
    )
