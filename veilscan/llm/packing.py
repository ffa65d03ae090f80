"""Packing: documents cut into pieces, pieces packed by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.base import ship, slices, staged, worker_tables
from veilscan.llm.idtable import IdTable, runs

WINDOW = 2048
#: What a document leaves beyond full windows is cut at this length: small items even out windows.
REST = 512
#: Windows that one group of pieces fills; the work of a task grows with pieces x windows of a group.
GROUP_WINDOWS = 192
#: What a worker remembers at most: distinct tokenizer words of Latin texts; distinct words, and parts of words, of others;
#: bytes of each of the three.
LATIN_KEPT, WORDS_KEPT, PARTS_KEPT, KEPT_BYTES = 500_000, 300_000, 200_000, 48 << 20
#: Bytes of text worked on at once; as words they take about ten times that.
SLICE_BYTES = 2 << 20
#: Words handed to the tokenizer at once.
WORD_BATCH = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space of the tokenizer's patterns; it has four separators less than ``str.split``.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LETTERS = re.compile(r"([^\W\d_]+)([.,!?;:#$%&*]+)")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Texts of these characters only are the same when composed, and lower-cased here as by the tokenizer.
_BEYOND_LATIN = re.compile(r"[^\x00-\u017f]")
_L, _N = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's own pattern over such texts in lower case: each match is coded on its own.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+")
#: How the tokenizer's special tokens begin.
_SPECIAL = "<|"
#: The mark of the last token of a tokenizer word.
_LAST = "</w>"


def _words(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def _halves(word: str) -> tuple[str, str]:
    """A word as letters and the marks behind them, where the tokenizer parts the two anyway, else the word alone.

    It lower-cases, which for ASCII is the same here, so words that differ in case or marks share their letters' ids.
    """
    found = _LETTERS.fullmatch(word)
    letters, marks = (found[1], found[2]) if found else (word, "")
    return letters.lower() if letters.isascii() and letters.isalpha() else letters, marks


def _is_latin(text: str) -> bool:
    return (text.isascii() or not _BEYOND_LATIN.search(text)) and _SPECIAL not in text


def _word_table(path: str, latin: bool = False) -> IdTable:
    """This worker's table from words to ids, made of a table of their parts, each of which is tokenized once.

    With ``latin`` its words are the tokenizer's own ones of Latin texts, normalised and parted already.
    """
    name = f"{path} latin" if latin else path
    if name not in worker_tables:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        worker_tables[name] = (_latin_table if latin else _any_table)(Tokenizer.from_file(path))
    return worker_tables[name]


def _latin_table(tokenizer) -> IdTable:
    from tokenizers import normalizers, pre_tokenizers

    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = [i for token, i in tokenizer.get_vocab().items() if token.endswith(_LAST)]
    last = np.zeros(max(ends) + 1, dtype=bool)
    last[ends] = True

    def merged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Words are handed over as one text; a word has as many ids as there are up to the next that ends one.
        joined = (" ".join(words[i:i + WORD_BATCH]) for i in range(0, len(words), WORD_BATCH))
        ids = np.concatenate([np.asarray(tokenizer.encode(x, add_special_tokens=False).ids, dtype="i4") for x in joined])
        return ids, np.diff(np.flatnonzero(last[np.minimum(ids, len(last) - 1)]), prepend=-1)

    return IdTable(merged, LATIN_KEPT, KEPT_BYTES)


def _any_table(tokenizer) -> IdTable:
    def tokenized(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for i in range(0, len(parts), WORD_BATCH)
                 for e in tokenizer.encode_batch_fast(parts[i:i + WORD_BATCH], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), dtype="i4"), np.fromiter(map(len, lists), dtype="i8", count=len(lists))

    halves = IdTable(tokenized, PARTS_KEPT, KEPT_BYTES)

    def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = halves.join([[letters, marks] if marks else [letters] for letters, marks in map(_halves, words)])
        return ids, np.diff(ends)

    return IdTable(joined, WORDS_KEPT, KEPT_BYTES)


def _token_ids(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, offsets)``: the tokenizer's ids of all texts, without special ones; null counts as empty."""
    texts = [t or "" for t in texts]
    latin = np.fromiter(map(_is_latin, texts), dtype=bool, count=len(texts))
    one, one_ends = two, two_ends = np.zeros(0, dtype="i4"), np.zeros(1, dtype="i8")
    if latin.any():
        one, one_ends = _word_table(path, latin=True).join([_LATIN.findall(t.lower()) for t, own in zip(texts, latin, strict=True) if own])
    if latin.all():
        return one, one_ends
    two, two_ends = _word_table(path).join([_words(t) for t, own in zip(texts, latin, strict=True) if not own])
    starts, lengths = np.empty(len(texts), dtype="i8"), np.empty(len(texts), dtype="i8")
    starts[latin], lengths[latin] = one_ends[:-1], np.diff(one_ends)
    starts[~latin], lengths[~latin] = two_ends[:-1] + len(one), np.diff(two_ends)
    return np.concatenate([one, two])[runs(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, rest: int = REST) -> DataFrame:
    """``docs`` without ``text``, a row per piece: ``start, length, ids`` (binary, little-endian 32-bit), ``doc_tokens``.

    The ids of a text are the tokenizer's without special tokens, then ``end_id``; null counts as empty, so every
    row has a piece. A piece is a full window, or up to ``rest`` ids of what is left of the document. The tokenizer's words never cross white
    space (it composes, lower-cases and splits inside words), so each distinct word is
    tokenized once; texts of Latin letters are parted into the tokenizer's own words.
    Columns of these names are replaced.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "start", "length", "ids", "doc_tokens")]
    docs = docs.select(*others, F.col("text"))
    extra = "start long, length long, ids binary, doc_tokens long"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*fields, extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, ends = _token_ids(part.column("text").to_pylist(), path)
                ids, total = np.insert(ids, ends[1:], end_id).astype("<u4"), np.diff(ends) + 1
                full, many = total // window, total // window + -(-(total % window) // rest)
                row = np.repeat(np.arange(len(total)), many)
                # The number of each piece in its document; full windows come first.
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                whole = number < full[row]
                start = np.where(whole, number * window, full[row] * window + (number - full[row]) * rest)
                length = np.minimum(np.where(whole, window, rest), total[row] - start)
                at = np.concatenate([[0], np.cumsum(length)]).astype("i4") * 4
                raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.tobytes())])
                kept = part.select(others).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(start, pa.int64()), pa.array(length, pa.int64()), raw, pa.array(total[row], pa.int64())],
                    [*others, "start", "length", "ids", "doc_tokens"])

    return docs.mapInArrow(run, schema)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Karmarkar-Karp: the window of each item, items shared out near-equally.

    Every partial partition is its window sums, largest first, less its smallest sum. The two of the widest
    spread are merged, the largest sums of one with the smallest of the other, until one is left. Merges keep
    only how they ordered the windows; walking them backwards names the window of every item.
    """
    n = len(sizes)
    heap = [(-int(x), i) for i, x in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def take() -> tuple[int, np.ndarray]:
        top, node = heapq.heappop(heap)
        if node < n:
            alone = np.zeros(windows, dtype="i8")
            alone[0] = -top
            return node, alone
        return node, sums.pop(node)

    while len(heap) > 1:
        (a, mine), (b, theirs) = take(), take()
        both = mine + theirs[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    places = {n + len(merges) - 1 if merges else 0: np.arange(windows)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        mine = np.empty(windows, dtype="i8")
        mine[order] = places.pop(n + at)
        places[a], places[b] = (x if x_node >= n else x[:1].copy() for x_node, x in ((a, mine), (b, mine[::-1])))
    return np.asarray([places[i][0] for i in range(n)], dtype="i8")


def share_out(sizes: np.ndarray, window: int) -> np.ndarray:
    """The window of each item, none above ``window``: the number of windows rises until none overflows."""
    windows = max(1, -(-int(sizes.sum()) // window))
    while True:
        found = difference(sizes, windows)
        if np.bincount(found, weights=sizes).max() <= window:
            return found
        windows += 1


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (rows with ``length`` from 1 to ``window``) with ``sequence_id`` and ``offset``.

    Full windows are sequences of their own. The rest is dealt at random into groups of about
    ``GROUP_WINDOWS`` windows, each shared out on its own, so no task holds more than a group. Offsets are
    gapless from 0. An empty input gives an empty result. Columns of these names are replaced.
    """
    cut = cut.drop("sequence_id", "offset")
    group = "group"
    while group in cut.columns:
        group += "_"
    total = cut.where(F.col("length") < window).agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (GROUP_WINDOWS * window)))
    schema = cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def assign(rows: pa.Table) -> pa.Table:
        sizes, base = rows["length"].to_numpy().astype("i8"), rows[group][0].as_py() << 32
        rows = rows.drop_columns([group])
        found = share_out(sizes, window)
        order = np.argsort(found, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(found[order]) > 0])
        offset = np.empty(len(sizes), dtype="i8")
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return rows.append_column("sequence_id", pa.array(base + found)).append_column("offset", pa.array(offset))

    full = cut.where(F.col("length") == window).select(
        "*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Rows of null ids may repeat at will; by their number they do not share a group. Of other ids, equal rows do.
    values = [c for c, t in cut.dtypes if not t.startswith("map")]
    some_null = F.array_contains(F.array(*(F.col(c).isNull() for c in values)), True)
    number = F.when(some_null, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(*values))
    dealt = cut.where(F.col("length") < window).withColumn(group, F.pmod(number, F.lit(groups)).cast("long"))
    return full.unionByName(dealt.groupBy(group).applyInArrow(assign, schema))


def packed(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``docs``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    cut = pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path or tokenizer_path("word_bpe_49k.json"), end_id, window)
    return pack(staged(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), window)
