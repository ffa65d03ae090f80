"""Byte-level BPE and the alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm import align, bytepairs, pieces, registry
from veilscan.llm.idtable import IdTable

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b ", "▁x ▁", "a▁b", "a b c\x1cd\x85e", "ﬁn é ́", "a\x00b", "Don't, DON'T! it's 'll l'l", "x<|endoftext|>y<s></s>",
       "<|endoftext|>", "½!a½? ²", "word " * 4000, "z" * 9000, "ab" * 700, "日本語 テスト。", "\n\n\t", " \n a\n\n  b \t", "🙂🙂 a🙂b", "a b　　c",
       "  \n  x   y", "\r\n\r\nz", "1234567 ٣٤ x²", "ǅ ʰ ֿ ः", " " * 300 + "q"]


def documents(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bytepairs.tokenizer_path())


def test_byte_pairs_equal_the_library(spark):
    model = library()
    noise = random.Random(5)
    letters = [" ", "\n", "\t", "a", "B", "'", "s", "1", "é", "日", "́", " ", "²", "!", "🙂", "​", "\x85", "\x1c"]
    made = ["".join(noise.choices(letters, k=noise.randrange(1, 40))) for _ in range(3000)]
    given = [*ODD, *made, *documents(spark)]
    rows = spark.createDataFrame([*enumerate(given), (-1, None), (-1, None)], "doc_id long, text string")
    rows = rows.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)).withColumn("kept", F.lit(7))
    got = bytepairs.decode(bytepairs.encode(rows)).collect()
    assert len(got) == len(given) + 2 and all(r.kept == 7 for r in got)
    found = {r.doc_id: (r.ids, r.decoded) for r in got}
    for i, text in [*enumerate(given), (-1, "")]:
        ids = model.encode(text or "", add_special_tokens=False).ids
        assert found[i] == (ids, model.decode(ids, skip_special_tokens=False)), (i, text)
    assert bytepairs.decode(bytepairs.encode(spark.createDataFrame([], rows.schema))).collect() == []


def test_decode_ids_of_no_text(spark):
    model = library()
    lists = [[50256, 0, 199], [188, 220], [222], [7, 99999], []]
    rows = spark.createDataFrame([*enumerate(lists), (9, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bytepairs.decode(rows).collect()}
    assert got == {i: model.decode([k for k in ids if k < 50257], skip_special_tokens=False) for i, ids in enumerate(lists)} | {9: ""}


def leftmost_lowest(ids, ranks):
    """Merges by looking over all pairs every time."""
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        if not found:
            return ids
        _, i = min(found)
        ids = [*ids[:i], ranks[ids[i], ids[i + 1]][1], *ids[i + 2:]]


def test_segment_trees_equal_a_plain_scan():
    noise = random.Random(3)
    pairs = [(0, 1), (1, 0), (0, 0), (4, 2), (3, 3), (6, 1), (5, 5)]
    results = [3, 4, 5, 6, 7, 8, 9]
    ranks = {p: (k, r) for k, (p, r) in enumerate(zip(pairs, results))}
    model = bytepairs.PairRanks(np.asarray(pairs), np.asarray(results), 10)
    given = [[noise.randrange(3) for _ in range(noise.randrange(1, 17))] for _ in range(400)]
    wanted = [leftmost_lowest(ids, ranks) for ids in given]
    assert [bytepairs.merge_one(ids, model) for ids in given] == wanted
    rows = np.zeros((len(given), 16), dtype="i4")
    for row, ids in zip(rows, given):
        row[:len(ids)] = ids
    ids, lengths = bytepairs.merge_many(rows, np.asarray([len(g) for g in given]), model)
    assert [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])] == wanted


def test_table_that_overflows():
    def spelled(strings):
        return np.asarray([ord(c) for s in strings for c in s], dtype="i4"), np.asarray([len(s) for s in strings], dtype="i8")

    for entries, size in ((5, 1 << 20), (1000, 64)):
        table = IdTable(spelled, entries, size)
        noise = random.Random(entries)
        for _ in range(200):
            lists = [["".join(noise.choices("abc", k=noise.randrange(4))) for _ in range(noise.randrange(4))] for _ in range(3)]
            ids, offsets = table.join(lists)
            got = ["".join(map(chr, ids[a:b])) for a, b in zip(offsets, offsets[1:])]
            assert got == ["".join(words) for words in lists]


def plain_tokens(texts):
    """Ids and bytes of both sides by the libraries; no tokens where the bytes differ."""
    import sentencepiece

    first, second = library(), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    first.encode_special_tokens = True
    value = {c: b for b, c in enumerate(bytepairs.byte_letters())}

    def bytes_b(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    for text in texts:
        a = [(i, bytes(value[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes_b(i)) for i in second.encode(text)] if text else []
        same = text and all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b))
        yield (a, b) if same else ([], [])


def ends(tokens):
    at = 0
    for _, raw in tokens:
        at += len(raw)
        yield at


def plain_alignment(texts):
    sides = list(plain_tokens(texts))
    links, shown = [], []
    for a, b in sides:
        at_b = {end: k for k, end in enumerate(ends(b))}
        found = [(i, at_b[end]) for i, end in enumerate(ends(a)) if end in at_b]
        links.append([(a[i][0], b[k][0]) for i, k in found])
        parts, last = [], (-1, -1)
        for i, k in found:
            parts.append(",".join(str(x) for x, _ in a[last[0] + 1:i + 1]) + "|" + ",".join(str(x) for x, _ in b[last[1] + 1:k + 1]))
            last = i, k
        shown.append(parts)
    counts = Counter(pair for found in links for pair in found)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (a, b), found, parts in zip(sides, links, shown):
        yield (len(a), len(b), len(parts), len(found), sum(counts[p] == most[p[1]] for p in found), sum(counts[p] for p in found),
               hashlib.sha256(";".join(parts).encode()).hexdigest() if a else "")


FOUND = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("often", [1, 300, align.OFTEN])
def test_alignment_equals_plain_loops(spark, tmp_path, monkeypatch, often):
    monkeypatch.setattr(align, "OFTEN", often)
    given = [*ODD, *ODD, *documents(spark)]
    rows = [*enumerate(given), (-1, None), (3, given[3]), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op12_token_alignment(spark, str(tmp_path)).collect()
    wanted = [(i, *found) for (i, _), found in zip(rows, plain_alignment([t or "" for _, t in rows]))]
    order = lambda row: (row[0] is None, *(row[0] or 0, *row[1:]))
    assert sorted(((r.doc_id, *(r[c] for c in FOUND)) for r in got), key=order) == sorted(wanted, key=order)
    assert any(w[1] == 0 and rows[k][1] for k, w in enumerate(wanted)) and sum(w[1] > 0 for w in wanted) > 200


def test_overlaps_equal_all_pairs(spark):
    given = [*ODD, *documents(spark)[:40]]
    rows = spark.createDataFrame([*enumerate(given), (-1, None)], "doc_id long, text string").withColumn("overlaps", F.lit(0)).withColumn("links", F.lit("kept"))
    got = {r.doc_id: r for r in align.align(rows).collect()}
    for k, (a, b) in enumerate(plain_tokens(given)):
        row = got[k]
        assert (row.a_ids, row.b_ids, row.links) == ([i for i, _ in a], [i for i, _ in b], "kept")
        spans = [[(end - len(raw), end) for (_, raw), end in zip(side, ends(side))] for side in (a, b)]
        if len(a) * len(b) < 400_000:
            meets = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
            assert [(o.a, o.b) for o in row.overlaps] == meets
    assert got[-1].overlaps == [] and got[-1].n_groups == 0


def test_queries_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.op11_bpe(spark, str(tmp_path)).collect() == []
    assert registry.op12_token_alignment(spark, str(tmp_path)).collect() == []
