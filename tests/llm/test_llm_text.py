"""Encoding, extraction, scoring, packing, classifiers and neighbours against brute force or held-out rows."""

import html
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.llm import extract, langid, neighbours, packing, pieces, pseudo, quality, registry
from veilscan.llm.words import distinct_words, ngram_features

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b ", "▁x ▁", "a b c\x1cd\x85e", "ﬁn é ́", "a\x00b", "Don't, DON'T! it's 'll l'l", "x<|endoftext|>y", "½!a½? ²",
       "ΑΣ ΑΣ. ΑΣΑ", "İstanbul, ŠŤ!", "word " * 4000, "z" * 9000, "日本語 テスト。", "\n\n\t", "🙂🙂 a🙂b", "<s></s>", "the,, the.the;"]


def texts(spark, column="text", name="documents"):
    return [r[0] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(column).collect()]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    given = [*ODD, *texts(spark)]
    rows = frame(spark, [*enumerate(given), (-1, None)]).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.decode(pieces.encode(rows)).collect()}
    for i, text in [*enumerate(given), (-1, "")]:
        ids = model.encode(text, add_eos=True)
        assert got[i] == (ids, model.decode(ids))
    assert pieces.encode(frame(spark, [])).collect() == []


def test_pieces_with_a_table_that_overflows(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    monkeypatch.setattr(pieces, "CHUNKS_KEPT", 3)
    for _ in range(2):
        got = pieces.encode_texts(pieces.model_path(), ODD)
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == model.encode(ODD)


def test_repeated_rows_are_packed_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_WINDOWS", 2)
    rows = spark.createDataFrame([(None, 100, "x")] * 3000, "doc_id long, length long, group string").repartition(8)
    found = packing.pack(rows).collect()
    assert len(found) == 3000 and {r.group for r in found} == {"x"}
    filled = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(f)] == list(range(0, 100 * len(f), 100)) and len(f) <= 20 for f in filled.values())
    assert len({s >> 32 for s in filled}) > 50


def test_packing_holds_every_id_once(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_WINDOWS", 8)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    given = [*ODD, *texts(spark)]
    full = {i: np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(given)} | {-1: np.asarray([1], "<u4")}
    rows = packing.packed(frame(spark, [*enumerate(given), (-1, None)])).collect()
    covered, used = {i: [] for i in full}, {}
    for r in rows:
        assert zlib.crc32(full[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(full[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, size in ((covered[i], len(full[i])) for i in full):
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) == size
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 2048
    assert sum(map(len, full.values())) > 0.95 * 2048 * len(used)
    assert packing.packed(frame(spark, [])).collect() == []


def test_latin_texts_are_parted_as_the_tokenizer_does(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(11)
    letters = np.asarray([*map(chr, range(0x180)), *"\n'''stremvld.,!AZaz09 " * 12])
    given = [*ODD, None, "\"'s '' 'S", "x<|endoftext|>y", "a\x00b\x1cc\x85d\xa0e", "İ ŉ ſ ß Æ ª½²", "Σας", "a_b __", "<| <|x", "it’s"]
    given += ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 3000)]
    monkeypatch.setattr(packing, "LATIN_KEPT", 50)
    packing.worker_tables.clear()
    for part in (given, given[:5], ["only latin"], [None], []):
        ids, ends = packing._token_ids(part, path)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
    # The tokenizer's own words are remembered: case and marks make no further entries.
    packing.worker_tables.clear()
    packing._token_ids(["The the THE, the. the! Straße straße, don't"], path)
    assert set(packing._word_table(path, latin=True).codes) == {"the", ",", ".", "!", "straße", "don", "'t"}
    packing.worker_tables.clear()


def test_packing_keeps_other_columns(spark):
    rows = frame(spark, [(1, "a b c", {"k": "v"}), (2, None, None)], "doc_id long, text string, offset map<string,string>")
    assert packing.pieces(rows.withColumnRenamed("offset", "m"), packing.tokenizer_path("word_bpe_49k.json")).columns == [
        "doc_id", "m", "start", "length", "ids", "doc_tokens"]


def test_differencing_evens_out_and_raises_the_count():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 513, 700)
    found = packing.share_out(sizes, 2048)
    sums = np.bincount(found, weights=sizes)
    assert sums.max() <= 2048 and sums.max() - sums.min() < 40 and len(sums) <= -(-sizes.sum() // 2048) + 1
    assert len(np.unique(packing.share_out(np.full(5, 1500), 2048))) == 5
    assert packing.share_out(np.asarray([7]), 2048).tolist() == [0]


def reading(page):
    """The article by its own tags: what a plain parser makes of the given pages."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"<[^>]*>", re.sub(r"</?b>", "", found[1]))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_extraction_equals_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = registry.op3_html_extraction(spark, "/root/testdata/sf0.01").collect()
    want = {r.page_id: reading(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><header><h1>Site</h1></header><nav>one two</nav>
<div class="cookie-notice">We use cookies</div>%s<aside>side bar</aside><section id="comments"><p>nice post</p></section>
<script>var a = "<p>no</p>";</script><footer>foot &copy;</footer></body></html>"""
INNER = """<h1>Head line</h1><div class="ad">buy now</div><p>Para one &amp; more <b>bo</b>ld
text&nbsp;here.</p><ul><li>item one two three four five six</li></ul><form>mail <input name=x><button>go</button></form>
<p>Last para of text with enough words to win.</p><!-- gone <p>x</p> -->"""
TEXT = "Head line Para one & more bold text here. item one two three four five six Last para of text with enough words to win."


@pytest.mark.parametrize("inner", [f"<article>{INNER}</article>", f"<main>{INNER}</main>", f'<div id="content">{INNER}</div>'])
def test_extraction_leaves_out_what_stands_beside(inner, spark):
    weights = extract.learn(texts(spark, "html", "pages"))
    assert extract.main_text(PAGE % inner, weights) == TEXT


@pytest.mark.parametrize("page", [
    '<body><div title="The hidden cost of rent" class="a hidden b">%s</div></body>', "<html><head><title>T</title><meta charset=u><body><div>%s</div>",
    '<head><style>p{}</style><div><svg width="1"/>%s</div>', '<div class="content-sidebar-wrap has-sidebar"><article class="post comments-open">%s</article></div>',
    '<form id=aspnet><div class="sidebar"><main>%s</main></div></form>', '<div class="widget"><div>%s</div></div><div class="sidebar-box">more to see</div>'])
def test_extraction_keeps_what_only_looks_beside(page):
    text = "one two three four five six seven eight nine ten eleven twelve"
    assert extract.main_text(page % f"<p>{text}</p>", extract.Weights()) == text


def test_extraction_drops_the_hidden():
    page = '<p>one two three four five six</p><p hidden>gone</p><div aria-hidden="true">gone</div><i style="display: none">gone</i><p>seven eight nine</p>'
    assert extract.main_text(page, extract.Weights()) == "one two three four five six seven eight nine"


def test_extraction_of_odd_pages(spark):
    weights = extract.Weights()
    for page, want in (("", ""), ("<", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("<article>x <b>y</b>z<br>w", "x yz w"),
                       ("a < b and c > d", "a < b and c > d"), ("<nav>only menu</nav>", ""), ("<p>q <a title='x>y'>r</a></p>", "q r"), ("<!-- x", "")):
        assert extract.main_text(page, weights) == want or want == "" and extract.main_text(page, weights).strip("< ") == ""
    rows = frame(spark, [(1, "u", None), (2, None, "<p>" + "word " * 50000), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = {r.page_id: r.n_chars for r in extract.extract(rows, extract.learned_weights(rows)).collect()}
    assert got == {1: 0, 2: 249999, None: 0}
    assert extract.extract(rows.limit(0), weights).collect() == []


def test_best_region_is_the_best_of_all_regions():
    rng = random.Random(4)
    for _ in range(60):
        parts = ["<div>" if rng.random() < 0.5 else "w " * rng.randrange(1, 6) for _ in range(rng.randrange(1, 14))]
        page = "".join(parts)
        gains = [-1.5 if k == "open" else float(len(v.split())) for k, v, _ in extract.tokens(page)]
        best = max((sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)), default=0)
        words = len(extract.main_text(page, extract.Weights()).split())
        assert words >= best > -2 or words == 0


def plain_neighbours(rows, k):
    ids, v = [i for i, _ in rows], np.asarray([x for _, x in rows], dtype="f8")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    score = unit @ unit.T
    return {q: sorted(((-score[a, b], ids[b]) for b in range(len(ids)) if ids[b] != q))[:k] for a, q in enumerate(ids) if q % 50 == 0}


def test_neighbours_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, hits = plain_neighbours(rows, 5), 0
    got = registry.op2_nearest_neighbours(spark, sf).collect()
    vectors = dict(rows)
    for r in got:
        a, b = (np.asarray(vectors[i], dtype="f8") for i in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        hits += r.vec_id in {i for _, i in want[r.query_id]}
    assert len(got) == 5 * len(want) and hits >= 0.9 * len(got)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (100, [0.0, 0.0]), (5, None),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (150, [-1.0, 0.0]), (1, [1.0, 0.0]), (9, []), (200, [1.0])]
    df = frame(spark, rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=3).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3], 50: [0, 1, 2], 150: [4, 50, 0]}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_perturbations_come_in_order_of_cost():
    sets = neighbours.perturbations(4, 40)
    cost = [j * (j + 1) / 120 if j <= 4 else 1 - (9 - j) / 5 + (9 - j) * (10 - j) / 120 for j in range(1, 9)]
    totals = [sum(cost[p] for p in s) for s in sets]
    assert sets[0] == [] and np.allclose(totals, sorted(totals)) and len({tuple(s) for s in sets}) == 40
    assert all(7 - p not in s for s in sets for p in s)


def test_pseudo_likelihood_equals_a_plain_sum(spark):
    rows = [*enumerate(texts(spark)[:60]), (900, None), (901, ""), (902, "one"), (903, "w " * 3000)]
    docs = frame(spark, rows)
    model = pseudo.train(docs)
    assert np.allclose(np.exp(model.given.astype("f8")).sum(2), 1, atol=1e-4)
    assert np.allclose(np.bincount(model.of, weights=np.exp(model.within.astype("f8")), minlength=pseudo.CLASSES)[np.unique(model.of)], 1, atol=1e-3)
    for r in pseudo.score(docs, model).collect():
        bucket = pseudo.buckets_of((r.text or "").lower().split())
        sides = [pseudo.CLASSES, *model.of[bucket], pseudo.CLASSES]
        want = sum(float(model.given[sides[i], sides[i + 2], sides[i + 1]]) + float(model.within[b]) for i, b in enumerate(bucket))
        assert r.n_tokens == len(bucket) and r.log_likelihood == pytest.approx(want, abs=1e-6 + 1e-9 * len(bucket))
    shuffled = random.Random(1)
    natural = [t for _, t in rows[:60] if len(t.split()) > 100][:20]
    mixed = [" ".join(shuffled.sample(t.split(), len(t.split()))) for t in natural]
    scored = {r.doc_id: r.per_token for r in pseudo.score(frame(spark, [*enumerate(natural), *((100 + i, t) for i, t in enumerate(mixed))]), model).collect()}
    assert np.mean([scored[i] for i in range(len(natural))]) > np.mean([scored[100 + i] for i in range(len(natural))])
    assert pseudo.score(docs.limit(0), pseudo.train(docs.limit(0))).collect() == []


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op8_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.97
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_of_odd_rows(spark):
    model = quality.fit(["la la la la", "a fine day it is", "so so so", "rain falls on hills"] * 20, [0, 1, 0, 1] * 20, epochs=20)
    rows = [(1, None), (2, ""), (3, "la la la"), (None, "a fine day on hills"), (4, "é" * 50000)]
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows).withColumn("score", F.lit("x")), model).collect()}
    assert got[1] == got[2] and got[3] < 0.5 < got[None] and 0 <= got[4] <= 1
    assert quality.score(frame(spark, []), quality.fit([], [])).collect() == []
    assert quality.fit(["a"], [1]).bias[1] > quality.fit(["a"], [1]).bias[0]
    nobody = quality.train(frame(spark, rows), frame(spark, [], "doc_id long, label int"))
    assert quality.score(frame(spark, rows), nobody).count() == 5


def test_quality_learns_rare_labels_and_long_texts(spark):
    rows = [(i, "a fine day it is on hills " * 3) for i in range(2000)] + [(5000 + i, "la la so so " * 9000) for i in range(10)]
    labels = frame(spark, [(i, 0 if i >= 5000 else 1) for i, _ in rows], "doc_id long, label int")
    sample = quality.labelled_sample(frame(spark, rows), labels, 100).collect()
    assert len(sample) == 100 and [r.label for r in sample].count(0) == 10
    model = quality.train(frame(spark, rows), labels, max_docs=100)
    got = {r.doc_id: r.score for r in quality.score(frame(spark, [(1, "so so la la"), (2, "a fine day")]), model).collect()}
    assert got[1] < 0.5 < got[2]
    few = quality.train(frame(spark, rows), labels, total_bytes=1)
    assert few.bias.tolist() != [0, 0]


def test_language_sample_is_bounded_and_learns_long_texts(spark):
    rows = [(None, f"the cat and the dog {i}", "en") for i in range(500)] + [(7, "der hund und die katze", "de")] * 300 + [(8, "le chat et le chien " * 9000, "fr")]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    sample, languages = langid.labelled_sample(docs, 50)
    assert languages == 3 and {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 50, "de": 50, "fr": 1}
    assert langid.train(docs, per_language=50).languages == ("de", "en", "fr")


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_of_odd_rows(spark):
    model = langid.fit(["the cat and the dog"] * 5 + ["der hund und die katze"] * 5 + ["le chat et le chien"] * 5, ["en"] * 5 + ["de"] * 5 + ["fr"] * 5)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "und die"), (None, "le chien " * 9000)]
    got = {r.doc_id: (r.lang_pred, r.ambiguous) for r in langid.identify(frame(spark, rows), model).collect()}
    assert got == {1: ("und", True), 2: ("und", True), 3: ("und", True), 4: ("en", False), 5: ("de", False), None: ("fr", False)}
    none = langid.train(frame(spark, [(1, "a", None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(frame(spark, rows), none).collect()} == {"und"}
    one = langid.fit(["abc"], ["xx"])
    assert {r.lang_pred for r in langid.identify(frame(spark, rows[3:]), one).collect()} == {"xx"}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_differ_and_columns_split(n):
    codes = langid.codewords(n).astype(int)
    assert len({tuple(c) for c in codes}) == n
    assert all(abs(c.sum()) < n for c in codes.T)


def test_word_tables():
    words, codes, starts = distinct_words(pa.array(["A b a", None, "", "b\tc\n"]))
    assert [words[c] for c in codes] == ["a", "b", "a", "b", "c"] and starts.tolist() == [0, 3, 3, 3, 5]
    features, at = ngram_features(["ab", "", "é"], (1, 2), 1 << 20, whole=True)
    assert np.diff(at).tolist() == [4 + 3 + 1, 2 + 1 + 1, 3 + 2 + 1] and len(features) == at[-1]
    again, _ = ngram_features(["zz", "ab"], (1, 2), 1 << 20, whole=True)
    assert sorted(features[:8]) == sorted(again[8:])
    assert json.dumps(features.tolist())
