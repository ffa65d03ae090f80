"""Exact dedup, n-gram Jaccard join and line dedup against brute force, with the odd inputs of each."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.llm import base, exact, jaccard, lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(60)) for _ in range(n)]


def near_copies(seed=1):
    """Texts with groups of copies, groups of near copies at all similarities, a shared passage and short texts."""
    rng, out = random.Random(seed), []
    passage = words(rng, 60)
    for group in range(6):
        base_text = words(rng, 40 + 30 * group)
        for _ in range(12):
            text = list(base_text)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = "x" + str(rng.randrange(999))
            out.append(" ".join(text))
        out += [out[-1], out[-1].upper(), out[-2].replace(" ", "\n \t")]
    for _ in range(15):
        own = words(rng, 40)
        out.append(" ".join(own[:20] + passage + own[20:]))
    out += ["", " \n", "one two", "One  two", "one two three four", None, "é ü ß", "é ü ß ", "a" * 9000, "a " * 5000, "a " * 5000 + "b"]
    rng.shuffle(out)
    return list(enumerate(out))


def shingles(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[found[i:] for i in range(k)], strict=False)) if len(found) >= k else ({tuple(found)} if found else set())


def expected_classes(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = roots(len(sets), pairs)
    return {rows[i][0]: (len(sets[i]), rows[root[i]][0]) for i in range(len(sets))}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5), (1, 1, 2), (3, 1, 1)])
def test_jaccard_matches_brute_force(spark, k, num, den):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows), k, num, den).collect()}
    assert got == expected_classes(rows, k, num, den)


def test_jaccard_with_tiny_tiles(spark, monkeypatch):
    # Every tile is cut in blocks, so the links across blocks come from the second round alone.
    monkeypatch.setattr(jaccard, "TILE_SETS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    rows = near_copies(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows), 4, 85, 100).collect()}
    assert got == expected_classes(rows, 4, 85, 100)


def test_jaccard_keeps_one_of_each_group(spark):
    rows = near_copies(3)
    wanted = {c for _, c in expected_classes(rows, 5, 4, 5).values()}
    kept = jaccard.deduplicated(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_tiles_of_the_same_rows_are_one(spark):
    # Keys 1 and 2 hold the same rows with other reaches, key 3 one row more, key 4 the same nodes in another band.
    rows = [(1, 5, True, 10, 30, 0, 31), (1, 5, False, 11, 28, 1, 33), (2, 5, True, 10, 30, 0, 34), (2, 5, False, 11, 28, 1, 29),
            (3, 5, True, 10, 30, 0, 31), (3, 5, False, 11, 28, 1, 31), (3, 5, True, 12, 30, 2, 31),
            (4, 6, True, 10, 30, 0, 31), (4, 6, False, 11, 28, 1, 31)]
    tiles = spark.createDataFrame(rows, "key long, band int, own boolean, node long, n long, class long, most long")
    found = {}
    for r in jaccard._merged(tiles).collect():
        found.setdefault((r.key, r.band), set()).add((r.own, r.node, r.n, r["class"], r.most))
    first, second = (True, 10, 30, 0), (False, 11, 28, 1)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, [
        {(*first, 34), (*second, 33)}, {(*first, 31), (*second, 31), (True, 12, 30, 2, 31)}, {(*first, 31), (*second, 31)}]))


def test_rows_nobody_wants_stay_behind(spark):
    rows = spark.range(-500, 500).select(F.xxhash64("id").alias("node"), F.lit(b"x").alias("members"))
    wanted = rows.select("node").limit(3)
    kept = jaccard._sieved(rows, "node", wanted)
    assert kept.schema == rows.schema and kept.count() < 10 and kept.join(wanted, "node").count() == 3


def test_jaccard_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (5, text + " end"), (None, None), (None, "alone here"), (9, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 26, 5), (7, 26, 5), (7, 26, 5), (5, 27, 5), (None, 0, None), (None, 1, None), (9, 0, 9)], key=str)
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = pa.array(["alpha beta gamma delta " * 50, "ALPHA  beta\tgamma\ndelta " * 50, None, "x" * 500 + " y"])
    whole = jaccard.shingle_sets(texts, 3)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 16)
    assert all(np.array_equal(a, b) for a, b in zip(whole, jaccard.shingle_sets(texts, 3), strict=True))
    assert np.array_equal(whole[0], whole[1]) and len(whole[0]) == 4


def test_bitmap_bound_never_cuts_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype("u8")
        a, b = (np.unique(rng.choice(pool, rng.integers(5, 300), replace=False)) for _ in range(2))
        maps = jaccard._fold([jaccard.bitmap(a), jaccard.bitmap(b)])
        linked = jaccard._linked(a, [b], 1, 2)[0]
        assert not linked or len(jaccard._may_link(0, np.array([1]), maps, np.array([len(a), len(b)]), 1, 2))
        assert linked == (2 * len(set(a) & set(b)) >= len(set(a) | set(b)))


def expected_copies(rows):
    out, groups = [], {}
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), p in zip(rows, plain, strict=True):
        groups.setdefault(p, []).append(i)
    for (i, _), p in zip(rows, plain, strict=True):
        ids = [x for x in groups[p] if x is not None]
        out.append((i, min(ids, default=None), len(groups[p]), hashlib.sha256(p.encode()).hexdigest()))
    return out, groups


@pytest.mark.parametrize("half", [True, False])
def test_exact_dedup_matches_brute_force(spark, half, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 16)
    rows = near_copies(4) + [(1000, "a  b"), (1001, "a b"), (1002, "a\x0bb"), (None, "a b"), (None, "only null"), (1003, "q"), (1003, "q")]
    located = exact.locate(frame(spark, rows))
    got = exact.dedup(located, exact.first_half(located) if half else located.doc_id.isNull()).collect()
    want, groups = expected_copies(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.deduplicated(frame(spark, rows)).collect()
    assert len(kept) == len(groups) and {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept} == set(groups)


def test_exact_dedup_of_nothing(spark):
    located = exact.locate(frame(spark, []))
    assert exact.dedup(located, exact.first_half(located)).collect() == []


def test_minimal_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(2)
    held = rng.integers(0, 1 << 63, (5000, 4)).astype("u8")
    sizes, bits, slots = exact.build_hash(held)
    assert sorted(slots) == list(range(5000))
    by_slot = held[np.argsort(slots)]
    assert np.array_equal(exact.find_slots(held, sizes, bits, by_slot), slots)
    strangers = held.copy()
    strangers[:, 3] ^= np.uint64(1)
    assert (exact.find_slots(strangers, sizes, bits, by_slot) == -1).all()


def test_attach_splits_hot_groups(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 0 else id end as k")
    groups = rows.groupBy("k").count().selectExpr("k", "count as size")
    out = base.attach(rows, groups, "k", "size", least=100)
    assert out.count() == 5000 and out.where("size is null").count() == 0
    assert out.where("k = 0").first()["size"] == 1667


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as a", "id - 1 as b").unionByName(spark.createDataFrame([(1000, 999), (5, 5)], "a long, b long"))
    got = {r.node: r.component for r in base.components(edges, "chain").collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 1000: 999}


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELL_LINES", 3)
    rng, rows = random.Random(6), []
    stock = [" ".join(words(rng, 30)) for _ in range(12)]
    for i in range(60):
        body = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(stock))
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = rng.choice("abcxyz ")
            body.append("".join(line))
        rows.append((i, "\n".join([*body, "", "Short 12", "***", rng.choice(["short, 99!", "SHORT 1"])])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, stock[0]), (103, "y" * 30000)]
    seen = [(i, n, lines.normalised(x)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = list(dict.fromkeys(x for *_, x in seen))
    sims = lines.simhashes(distinct)
    pairs = [(a, b) for a in range(len(distinct)) for b in range(a)
             if min(len(distinct[a]), len(distinct[b])) >= lines.SHORTEST and np.bitwise_count(sims[a] ^ sims[b]) <= lines.DISTANCE
             and 1 - lines.edit_distance(distinct[a], distinct[b]) / max(len(distinct[a]), len(distinct[b])) >= 0.9 - 1e-12]
    root = roots(len(distinct), pairs)
    assert len(pairs) > 20
    group = {x: root[i] for i, x in enumerate(distinct)}
    first = {}
    for i, n, x in sorted(seen, key=lambda s: (s[0] is None, s[0] or 0, s[1])):
        first.setdefault(group[x], (i, n))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in lines.decide(frame(spark, rows)).collect()}
    assert got == {(i, n): (*first[group[x]], first[group[x]] == (i, n)) for i, n, x in seen}


def edited(rng, line, edits):
    """``line`` after that many edits at different places: half substitutions, and as many deletions as insertions."""
    out = list(line)
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice([rng.choice("abcxyz"), rng.choice("abcxyz"), "", out[at] + rng.choice("abcxyz")])
    return " ".join("".join(out).split())


def test_line_dedup_recall_against_edit_similarity(spark):
    rng, rows, want = random.Random(8), [], {}
    for length in (10, 12, 19, 20, 29, 40, 80, 120, 200, 600):
        for share in (0.02, 0.05, 0.1):
            for _ in range(12):
                line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(3 * length))
                line = " ".join(line.split())[:length].strip()
                other = edited(rng, line, max(1, int(share * len(line) + 1e-9)))
                a, b = lines.normalised(line), lines.normalised(other)
                if a != b and 1 - lines.edit_distance(a, b) / max(len(a), len(b)) >= 0.9:
                    want[len(rows) + 1] = length
                    rows += [(len(rows), line), (len(rows) + 1, other)]
    got = {r.doc_id: r.first_doc_id == r.doc_id - 1 for r in lines.decide(frame(spark, rows)).collect() if r.doc_id in want}
    short, long = [got[i] for i, n in want.items() if n < 29], [got[i] for i, n in want.items() if n >= 29]
    assert len(short) > 100 and all(short)
    assert len(long) > 150 and sum(long) >= 0.98 * len(long)


def test_short_lines_share_a_key():
    rng = random.Random(9)
    for _ in range(4000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(9, 30)))
        b = edited(rng, a, rng.randrange(1, 3))
        if max(len(a), len(b)) <= lines.EXACT and lines.similar(a, b, 0.9):
            keys = lines.line_keys([a, b], 0.9)
            assert set(keys[0].tolist()) & set(keys[1].tolist()), (a, b)


def test_line_dedup_cleans_texts(spark):
    line = "this very line stands in every one of these texts"
    got = {r.doc_id: r.text for r in lines.cleaned(frame(spark, [(1, f"a\n{line}\n\nb"), (2, f"{line}.\nc"), (3, None)])).collect()}
    assert got == {1: f"a\n{line}\n\nb", 2: "c", 3: None}
    assert lines.decide(frame(spark, [])).collect() == []


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randrange(90))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_line_dedup_lines_meet_in_few_cells(spark, monkeypatch):
    rng, rows, sizes = random.Random(11), [], {}
    for i in range(150):
        line = " ".join(words(rng, 60))
        rows += [(2 * i, line), (2 * i + 1, edited(rng, line, 3))]

    def counted(df, name):
        out = base.staged(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(lines, "staged", counted)
    got = {r.doc_id: r.first_doc_id for r in lines.decide(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}
    assert 0 < sizes["cells"] <= 3 * len(rows)


def test_distances_of_many_pairs():
    rng, pairs = random.Random(12), []
    for _ in range(400):
        a = "".join(rng.choice("abé\U0001d538 ") for _ in range(rng.randrange(1, 60)))
        pairs.append((a, edited(rng, a, min(len(a), rng.randrange(9)))))
    for most in (0, 1, 4, 7):
        some = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= most]
        want = [lines.edit_distance(a, b) for a, b in some]
        assert [min(d, most + 1) for d in lines._distances(some, most).tolist()] == [min(d, most + 1) for d in want]
    both = [(a, b) for a, b in pairs if b]
    assert lines._similar_all(both, 0.9) == [lines.similar(a, b, 0.9) for a, b in both]


def test_normal_lines_are_normalised_lines():
    texts = ["İ_a\n__\n  \n12 3_4\x00b\nΑΣ\nΣ", "a\x0bb\x1cc\n\x85\n²³1 2", "K K\n٣٤5", "A  B.c\t1,000\n---"]
    for text in texts:
        assert lines._normal_lines(text) == ["" if not x or x.isspace() else lines.normalised(x) for x in text.split("\n")]
