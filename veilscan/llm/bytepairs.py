"""Byte-level BPE encoding and decoding: a segment tree over the ranks of adjacent pairs names every merge."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.base import ship, slices
from veilscan.llm.idtable import IdTable, runs

#: No pair: above every key of a tree.
NONE = np.int64(1) << 60
#: Words of one padded length that are merged together at least; fewer, and longer ones, go one by one.
TOGETHER, LONGEST = 8, 256
#: Tree nodes held at once.
NODES = 1 << 21
#: Bytes of text worked on at once.
SLICE_BYTES = 2 << 20
_THREE_SPACES = re.compile(r"\s\s\s")
_WHITE = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_models: dict[tuple[str, bool], ByteBpe] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one of the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PairRanks:
    """Rank and result of merging two ids; pairs that do not merge have rank -1."""

    def __init__(self, pairs: np.ndarray, results: np.ndarray, size: int):
        keys = pairs[:, 0].astype("i8") * size + pairs[:, 1]
        self.size, self.results = size, results.astype("i4")
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.known = dict(zip(keys.tolist(), range(len(keys))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), -1)
        wanted = left.astype("i8") * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


def merge_one(ids: list[int], pairs: PairRanks) -> list[int]:
    """One sequence merged by a segment tree whose leaf i holds the rank of the pair at i; its root is the smallest
    ``(rank, i)``, thus the leftmost pair of lowest rank. A merge changes three leaves and their ancestors."""
    n = len(ids)
    if n < 2:
        return ids
    width = 1 << (n - 1).bit_length()
    none, known, size, results = int(NONE), pairs.known, pairs.size, pairs.results
    ids, follow, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> int:
        if i < 0 or follow[i] >= n:
            return none
        rank = known.get(ids[i] * size + ids[follow[i]])
        return none if rank is None else rank * width + i

    tree = [none] * width + [key(i) for i in range(n)] + [none] * (width - n)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = follow[i]
        ids[i], follow[i] = int(results[rank]), follow[j]
        if follow[j] < n:
            before[follow[j]] = i
        for leaf, value in ((j, none), (i, key(i)), (before[i], key(before[i]))):
            if leaf < 0:
                continue
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = follow[i]
    return out


def merge_many(rows: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, lengths)`` of all sequences, each merged by its own segment tree; the trees advance side by side.

    ``rows`` is padded to a power of two. Every round takes the root of each tree that still has a mergeable pair.
    """
    count, width = rows.shape
    place = np.arange(width)
    ids = rows.astype("i4").ravel()
    follow = np.tile(place + 1, count).astype("i4")
    before = np.tile(place - 1, count).astype("i4")
    tree = np.full((count, 2 * width), NONE)
    row, at = np.nonzero(place[None, :] + 1 < lengths[:, None])
    rank = pairs.ranks(ids[row * width + at], ids[row * width + at + 1])
    found = rank >= 0
    tree[row[found], width + at[found]] = rank[found] * width + at[found]
    for level in range(width.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
    tree = tree.ravel()
    alive = np.ones(count * width, dtype=bool)
    active = np.flatnonzero(tree[1::2 * width] < NONE)
    while len(active):
        rank, i = np.divmod(tree[active * (2 * width) + 1], width)
        base, end = active * width, lengths[active]
        j = follow[base + i].astype("i8")
        after = follow[base + j].astype("i8")
        ids[base + i], follow[base + i], alive[base + j] = pairs.results[rank], after, False
        inner = after < end
        before[base[inner] + after[inner]] = i[inner]
        left = before[base + i].astype("i8")
        # The three leaves that change: the pair at i, the one that ends there, and j, which is gone.
        own = np.full(len(active), NONE)
        new = pairs.ranks(ids[base[inner] + i[inner]], ids[base[inner] + after[inner]])
        own[inner] = np.where(new >= 0, new * width + i[inner], NONE)
        led = left >= 0
        new = pairs.ranks(ids[base[led] + left[led]], ids[base[led] + i[led]])
        roots = active * (2 * width)
        nodes = np.concatenate([j, i, left[led]]) + width
        trees = np.concatenate([roots, roots, roots[led]])
        tree[trees + nodes] = np.concatenate([np.full(len(j), NONE), own, np.where(new >= 0, new * width + left[led], NONE)])
        for _ in range(width.bit_length() - 1):
            nodes >>= 1
            twice = trees + 2 * nodes
            tree[trees + nodes] = np.minimum(tree[twice], tree[twice + 1])
        active = active[tree[roots + 1] < NONE]
    alive &= (place[None, :] < lengths[:, None]).ravel()
    return ids[alive], alive.reshape(count, width).sum(axis=1)


class ByteBpe:
    """A byte-level BPE of a tokenizer file. ``plain``: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        given = json.loads(Path(path).read_text())
        model = given["model"]
        splitter = given["pre_tokenizer"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or splitter != {**splitter, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or given["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.letters = byte_letters()
        self.byte_ids = np.asarray([vocabulary[c] for c in self.letters], dtype="i4")
        pairs = np.asarray([(vocabulary[a], vocabulary[b]) for a, b in merges], dtype="i8").reshape(-1, 2)
        results = np.asarray([vocabulary[a + b] for a, b in merges], dtype="i4")
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        size = max([*vocabulary.values(), *self.added.values()]) + 1
        self.pairs = PairRanks(pairs, results, size)
        value = {c: b for b, c in enumerate(self.letters)}
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.special = None if plain or not self.added else re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.split_odd = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.value = value
        self.table = IdTable(self.encode_chunks)

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk as bytes. Letters outside ASCII are told from other signs by the library's own tables."""
        if chunk.isascii():
            return [w.encode() for w in self.find(chunk)]
        return [bytes(map(self.value.__getitem__, w)) for w, _ in self.split_odd(chunk)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of distinct words."""
        sizes = np.fromiter(map(len, words), dtype="i8", count=len(words))
        starts = np.cumsum(sizes) - sizes
        raw = self.byte_ids[np.frombuffer(b"".join(words), dtype="u1")]
        lengths, found = np.zeros(len(words), dtype="i8"), []
        for exponent in range(0, int(sizes.max(initial=1) - 1).bit_length() + 1):
            width = 1 << exponent
            chosen = np.flatnonzero((sizes <= width) & (sizes > width // 2)) if exponent else np.flatnonzero(sizes <= 1)
            if exponent == 0:
                found.append((chosen, raw[runs(starts[chosen], sizes[chosen])], sizes[chosen]))
            elif width > LONGEST or len(chosen) < TOGETHER:
                for w in chosen.tolist():
                    ids = merge_one(raw[starts[w]:starts[w] + sizes[w]].tolist(), self.pairs)
                    found.append((np.asarray([w]), np.asarray(ids, dtype="i4"), np.asarray([len(ids)])))
            else:
                step = max(TOGETHER, NODES // (2 * width))
                for some in (chosen[k:k + step] for k in range(0, len(chosen), step)):
                    rows = np.zeros((len(some), width), dtype="i4")
                    inside = np.arange(width)[None, :] < sizes[some][:, None]
                    rows[inside] = raw[runs(starts[some], sizes[some])]
                    found.append((some, *merge_many(rows, sizes[some], self.pairs)))
        for some, _, length in found:
            lengths[some] = length
        begins = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), dtype="i4")
        for some, ids, length in found:
            out[runs(begins[some], length)] = ids
        return out, lengths

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of chunks as ``chunks()`` writes them; each distinct word is merged once."""
        lists = [self.words(c[1:] if c[0] == "\x00" or c[1:2] == "\n" else c) for c in chunks]
        codes: dict[bytes, int] = {}
        flat = [codes.setdefault(w, len(codes)) for words in lists for w in words]
        ids, lengths = self.encode_words(list(codes))
        begins = np.cumsum(lengths) - lengths
        flat = np.asarray(flat, dtype="i8")
        counts = np.fromiter(map(len, lists), dtype="i8", count=len(lists))
        ends = np.concatenate([[0], np.cumsum(lengths[flat])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids[runs(begins[flat], lengths[flat])], np.diff(ends[bounds])

    def chunks(self, text: str) -> list[str]:
        """``text`` cut where white space follows other signs, which no word crosses.

        A chunk opens with a space that belongs to the text, or with a space or U+0000 that does not (before a line feed; before all else).
        """
        if not text:
            return []
        if text[-1].isspace() or _THREE_SPACES.search(text):
            return ["\x00" + c for c in _CHUNK.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return ["\x00" + first, *(" " + c for c in rest)] if first else [" " + c for c in rest]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of whole texts."""
        if self.special is None or not any(map(self.special.search, texts)):
            return self.table.join([self.chunks(t) for t in texts])
        pieces = [self.special.split(t) for t in texts]
        ids, offsets = self.table.join([self.chunks(p) for parts in pieces for p in parts[::2]])
        out, ends, at = [], [0], 0
        for parts in pieces:
            end = ends[-1]
            for number, part in enumerate(parts):
                if number % 2:
                    out.append(np.asarray([self.added[part]], dtype="i4"))
                else:
                    out.append(ids[offsets[at]:offsets[at + 1]])
                    at += 1
                end += len(out[-1])
            ends.append(end)
        return np.concatenate(out), np.asarray(ends)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        size = len(self.bytes)
        return b"".join([self.bytes[i] for i in ids if i is not None and 0 <= i < size]).decode("utf-8", "replace")


def model(path: str, plain: bool = False) -> ByteBpe:
    """This worker's model of a tokenizer file."""
    if (path, plain) not in _models:
        _models[path, plain] = ByteBpe(path, plain)
    return _models[path, plain]


def encode(docs: DataFrame, path: str | None = None, plain: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of every whole text, without special tokens unless they stand in the text.

    Same ids as the library gives. Null counts as empty, an empty text has no ids, repeated rows stay, an empty table
    gives an empty one, a column named ``ids`` is replaced. No shuffle; a worker holds a slice of texts and a table
    bounded by entries and bytes.
    """
    ship(docs.sparkSession)
    path, docs = path or tokenizer_path(), docs.drop("ids")
    schema = docs.select("*", F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = model(path, plain).encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the library's text of ``ids``, special tokens included; null or no ids give the
    empty text. A column of that name is replaced; rows, ties and other columns stay as they are."""
    ship(encoded.sparkSession)
    path, encoded = path or tokenizer_path(), encoded.drop("decoded")
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [model(path).decode(ids) if ids else "" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
