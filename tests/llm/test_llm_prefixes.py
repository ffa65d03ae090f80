"""The trie of rebuilt conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from veilscan.llm import prefixes, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, key string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    """Rows of the contract from ``(conv_id, turn, role, text)`` without equal turns of different content."""
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [t[2:] for t in sorted(turns)] for c, turns in given.items()}
    nodes = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))  # the remainder has the sign of the id, as in SQL
        made = tuple(given.get(base, [])[:h] + turns[h:])
        for d in range(len(made) + 1):
            nodes.setdefault(made[:d], []).append((c, d == len(made)))
    children, leaves, saved = {}, {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        n = len(nodes[node])
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + ((n - 1) * len(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    out = []
    for node, members in nodes.items():
        ended = ",".join(map(str, sorted(c for c, end in members if end)))
        parent = min(c for c, _ in nodes[node[:-1]]) if node else None
        out.append((min(c for c, _ in members), len(node), parent, len(members), children.get(node, 0), leaves[node], saved[node],
                    hashlib.sha256(ended.encode()).hexdigest()))
    return out


def order(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def check(spark, folder, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = registry.op13_conversation_trie(spark, str(folder)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == sorted(plain_trie(rows), key=order)


def made(seed, convs, words, longest=7):
    noise = random.Random(seed)
    rows = []
    for c in convs:
        for turn in noise.sample(range(40), noise.randrange(1, longest)):
            rows.append((c, turn, noise.choice(["user", "", None]), noise.choice(words)))
    noise.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_a_dictionary(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(prefixes, "PART_BYTES", 1500)
    monkeypatch.setattr(prefixes, "PIECE", 3)
    convs = [*range(-250, -150), *range(0, 120), *range(350, 420), 10**12, 10**12 + 7]
    check(spark, tmp_path, made(seed, convs, ["a", "bb", "", None, "é🙂"][: 2 + seed]))


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "x"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (2, 5, None, None),
            (300, 1, "user", "y" * 50_000), (301, 1, "user", "y" * 50_000), (302, 1, "user", "y"), (200, 3, "", "a"), (201, 3, "a", "")]
    check(spark, tmp_path, rows + [(400, t, "user", f"turn {t}") for t in range(3000)] + [(405, t, "user", f"turn {t}") for t in range(2999)])


def test_many_equal_conversations_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefixes, "PART_BYTES", 4000)
    rows = [(c, t, "user", "same " * t) for c in range(1000, 1600) for t in range(4)]
    check(spark, tmp_path, rows + [(c, 4, "user", "more") for c in range(1000, 1600, 7)] + [(50, 1, "user", "alone")])


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registry.op13_conversation_trie(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == sorted(plain_trie(rows), key=order)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.op13_conversation_trie(spark, str(tmp_path))
    assert found.columns == list(COLUMNS) and found.collect() == []
