"""The registered queries keep their promises; a few are compared with their SQL."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of


def test_flagship(spark):
    assert {r.pii_type for r in entry.entry(spark).collect()} >= {"EMAIL", "PAN", "BANK_ACCOUNT"}


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["pat_all_detect_all", "res_7_resolve_entities", "ver_6_evaluate_screens", "assoc_11_layout_entities", "rop_4_ropa_entry"])
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
