"""The pipeline: its stages in order, each on what the one before kept, and the rows it ends with."""

import importlib

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from veilscan.llm import base, jaccard, langid, packing, quality, registry

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "exact dedup", "n-gram Jaccard join", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    bad = {r.doc_id for r in labels.where("label = 0").collect()}
    good = [i for i in rows if scores[i] >= 0.7]
    assert not bad & set(good) and len(good) > 0.7 * len(rows)
    kept = docs.where(F.col("doc_id").isin(good))
    found = {r.doc_id: r for r in langid.identify(kept, langid.train(kept), corpus_pipeline.LANGUAGE_KEPT).collect()}
    named = [i for i in good if found[i].lang_pred != "und" and not found[i].ambiguous]
    first = {}
    for i in sorted(named):
        first.setdefault(" ".join(rows[i].text.replace("\x0b", " ").replace("\x0c", " ").split()), i)
    unique = sorted(first.values())
    sets = {i: set(zip(*[rows[i].text.lower().split()[k:] for k in range(5)])) or {rows[i].text.lower()} for i in unique}
    root = {i: i for i in unique}
    for a in unique:
        for b in unique:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    want = {i for i in unique if root[i] == i}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "the cat sat on the mat", "en", None, 3, None), (3, "la la la", None, "s", None, "c")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, SF).columns == docs.columns
            stage(spark, rows, SF).collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert jaccard.prefix_size(20, 85, 100) == 4 and packing.WINDOW == 2048


def test_a_stage_lets_go_of_the_tables_of_the_one_before(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "la la la", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    model, languages, path = quality.train(docs, labels), langid.train(docs), packing.tokenizer_path("word_bpe_49k.json")
    batch, tasks = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()]), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: tasks.append(task) or self)
    quality.score(docs, model)
    langid.identify(docs, languages, corpus_pipeline.LANGUAGE_KEPT)
    jaccard._map_sets(docs, 5, "n long", lambda part, sets: [part])
    assert len(tasks) == 3
    for task in tasks:
        packing._word_table(path)
        assert base.worker_tables
        assert list(task(iter([batch])))
        assert not base.worker_tables
