"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked in a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import bytepairs, pieces
from veilscan.llm.base import ship, slices, staged
from veilscan.llm.idtable import IdTable

#: Bytes of text worked on at once; the frames of a slice take about sixty times that.
SLICE_BYTES = 1 << 20
#: A pair that makes up at least this part of all links is broadcast: there are no more such pairs than its inverse.
OFTEN = 200_000
FIELDS = {
    "a_ids": "array<int>", "b_ids": "array<int>", "overlaps": "array<struct<a:int,b:int>>",
    "groups": "array<struct<a_end:int,b_end:int>>", "links": "array<struct<a:int,b:int,n:int>>", "written": "string",
}
_sides: dict[tuple[str, str], tuple] = {}


def piece_bytes(processor) -> list[bytes]:
    """The bytes of each piece: marks are spaces, byte pieces their byte."""
    out = []
    for i in range(processor.get_piece_size()):
        name = processor.id_to_piece(i)
        out.append(bytes([int(name[3:5], 16)]) if processor.is_byte(i) else name.replace(pieces.MARK, " ").encode())
    return out


class Pieces:
    """SentencePiece of this worker with a table of distinct chunks, which knows the chunks whose bytes it changes."""

    def __init__(self, path: str):
        self.path = path
        self.processor, _, self.apart = pieces._model(path)
        self.bytes = piece_bytes(self.processor)
        self.table = IdTable(self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each chunk and its mark; -1 behind those of a chunk that is written otherwise."""
        mark = self.processor.piece_to_id(pieces.MARK)
        lists = [ids or [mark] for ids in self.processor.encode(chunks, num_threads=1)]
        for chunk, ids in zip(chunks, lists):
            if b"".join(map(self.bytes.__getitem__, ids)) != (" " + chunk).encode():
                ids.append(-1)
        return np.fromiter(chain.from_iterable(lists), dtype="i4"), np.fromiter(map(len, lists), dtype="i8", count=len(lists))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, counts, same)``: the ids of all texts, how many each has, and whether their bytes are a space and the text."""
        if not self.apart:
            lists = [np.asarray(ids, dtype="i4") for ids in self.processor.encode(texts, num_threads=1)]
            ids, doubtful = np.concatenate([np.zeros(0, "i4"), *lists]), range(len(texts))
            counts = np.fromiter(map(len, lists), dtype="i8", count=len(texts))
        else:
            ids, ends = self.table.join([pieces.chunks(t) if t else [] for t in texts])
            odd = np.concatenate([[0], np.cumsum(ids < 0)])[ends]
            # Chunks are cut at U+2581 as at spaces, so only a text with that sign or an odd chunk is looked at whole.
            marked = np.fromiter((pieces.MARK in t for t in texts), dtype=bool, count=len(texts))
            doubtful, counts = np.flatnonzero(marked | (np.diff(odd) > 0)).tolist(), np.diff(ends - odd)
            ids = ids[ids >= 0]
        same, ends = np.asarray([bool(t) for t in texts], dtype=bool), np.cumsum(counts)
        for i in doubtful:
            found = ids[ends[i] - counts[i]:ends[i]].tolist()
            same[i] &= b"".join(map(self.bytes.__getitem__, found)) == (" " + texts[i]).encode()
        return ids, counts, same


def sides(path_a: str, path_b: str) -> tuple:
    """This worker's model of each side, with the length in bytes of every id."""
    if (path_a, path_b) not in _sides:
        models = bytepairs.model(path_a, plain=True), Pieces(path_b)
        _sides[path_a, path_b] = *models, *(np.asarray(list(map(len, m.bytes)), dtype="i8") for m in models)
    return _sides[path_a, path_b]


def spans(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> pd.DataFrame:
    """A row per token: its document, number in the document, and bytes from ``start`` to ``end``, counted over the
    documents one after the other (``base``: where each begins)."""
    docs = np.repeat(np.arange(len(counts)), counts)
    lengths = sizes[ids]
    ends = np.cumsum(lengths)
    firsts = np.cumsum(counts) - counts
    before = np.concatenate([[0], ends])[firsts]
    ends = ends + np.repeat(base - before, counts)
    return pd.DataFrame({"doc": docs, "token": np.arange(len(ids)), "start": ends - lengths, "end": ends})


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``a`` and ``b`` whose bytes meet, in order. Each token start finds the token of the other
    side that covers it; two tokens that meet are found from the one that starts last."""
    columns = ["doc", "token", "start"]
    ours = pd.merge_asof(a[columns], b[columns], on="start", by="doc", suffixes=("_a", "_b"))
    theirs = pd.merge_asof(b[columns], a[columns], on="start", by="doc", suffixes=("_b", "_a"))
    width = len(b) + 1
    # Both directions come in order of bytes, so sorting their union is a merge.
    keys = np.concatenate([f["token_a"].to_numpy("i8") * width + f["token_b"].to_numpy("i8") for f in (ours, theirs)])
    keys.sort(kind="stable")
    return np.divmod(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys, width)


def aligned_slice(texts: list[str], path_a: str, path_b: str, wanted: tuple[str, ...]) -> dict[str, pa.Array]:
    """The columns ``wanted`` and ``n_a, n_b, n_groups`` of some texts."""
    first, second, sizes_a, sizes_b = sides(path_a, path_b)
    # Words of side A are cut from the text's bytes and merging joins bytes, so they always give the text back.
    ids_a, ends = first.encode([" " + t if t else "" for t in texts])
    ids_b, counts_b, kept = second.encode(texts)
    counts_a = np.diff(ends)
    ids_a, ids_b = ids_a[np.repeat(kept, counts_a)], ids_b[np.repeat(kept, counts_b)]
    counts_a, counts_b = counts_a * kept, counts_b * kept
    lengths = np.asarray([len(t.encode()) + 1 if k else 0 for t, k in zip(texts, kept)], dtype="i8")
    base = np.cumsum(lengths) - lengths
    a, b = spans(ids_a, counts_a, sizes_a, base), spans(ids_b, counts_b, sizes_b, base)
    over_a, over_b = overlapping(a, b)
    # Of the overlapping pairs, those that end together close a group.
    closing = a["end"].to_numpy()[over_a] == b["end"].to_numpy()[over_b]
    last_a, last_b = over_a[closing], over_b[closing]
    docs = a["doc"].to_numpy()[last_a]
    groups = np.bincount(docs, minlength=len(texts))

    def listed(counts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    def inner(tokens: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> pa.Array:
        return pa.array(tokens - (np.cumsum(counts) - counts)[owner], pa.int32())

    out = {"n_a": pa.array(counts_a), "n_b": pa.array(counts_b), "n_groups": pa.array(groups)}
    if "a_ids" in wanted:
        out["a_ids"] = listed(counts_a, pa.array(ids_a, pa.int32()))
    if "b_ids" in wanted:
        out["b_ids"] = listed(counts_b, pa.array(ids_b, pa.int32()))
    if "overlaps" in wanted:
        owner = a["doc"].to_numpy()[over_a]
        pairs = pa.StructArray.from_arrays([inner(over_a, counts_a, owner), inner(over_b, counts_b, owner)], ["a", "b"])
        out["overlaps"] = listed(np.bincount(owner, minlength=len(texts)), pairs)
    if "groups" in wanted:
        pairs = pa.StructArray.from_arrays([inner(last_a + 1, counts_a, docs), inner(last_b + 1, counts_b, docs)], ["a_end", "b_end"])
        out["groups"] = listed(groups, pairs)
    if "links" in wanted:
        key = (docs * len(sizes_a) + ids_a[last_a]) * len(sizes_b) + ids_b[last_b]
        key, times = np.unique(key, return_counts=True)
        key, linked_b = np.divmod(key, len(sizes_b))
        owner, linked_a = np.divmod(key, len(sizes_a))
        pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (linked_a, linked_b, times)], ["a", "b", "n"])
        out["links"] = listed(np.bincount(owner, minlength=len(texts)), pairs)
    if "written" in wanted:
        texts_of = []
        for ids, last in ((ids_a, last_a), (ids_b, last_b)):
            bounds = np.concatenate([[0], last + 1])
            texts_of.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids).cast(pa.string())), ","))
        out["written"] = pc.binary_join(listed(groups, pc.binary_join_element_wise(*texts_of, "|")), ";")
    return out


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, wanted: tuple[str, ...] = ("a_ids", "b_ids", "overlaps", "groups")) -> DataFrame:
    """``docs`` without ``text``, with ``n_a, n_b, n_groups`` and the columns ``wanted`` of ``FIELDS``.

    Side A is a byte-level BPE of space and text, side B SentencePiece of the text, which puts a space in front; special
    tokens' strings are ordinary text. ``overlaps`` are the numbers of tokens whose bytes meet; ``groups`` says how many
    tokens of each side end with each common end; ``links`` are the ids that end together, with how often in this
    document; ``written`` is the groups as text, ``a1,a2|b1;a3|b2,b3``. A text that is null or empty, or whose bytes
    either side does not give back, has no tokens: zeros and empty values. Repeated rows stay rows, an empty table gives
    an empty one, columns of these names are replaced. No shuffle; a worker holds a slice of texts.
    """
    ship(docs.sparkSession)
    path_a, path_b = path_a or bytepairs.tokenizer_path(), path_b or pieces.model_path()
    made = {"n_a": "long", "n_b": "long", "n_groups": "long"} | {c: FIELDS[c] for c in wanted}
    others = [c for c in docs.columns if c not in ("text", *made)]
    docs = docs.select(*others, "text")
    schema = docs.drop("text").select("*", *(F.lit(None).cast(t).alias(c) for c, t in made.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = aligned_slice([t or "" for t in part.column("text").to_pylist()], path_a, path_b, wanted)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(found[c] for c in made)], [*others, *made])

    return docs.mapInArrow(run, schema)


def linked(aligned: DataFrame, *keys: str) -> DataFrame:
    """A row per pair of ids that a row of ``aligned`` links: ``keys``, ``a, b, n``."""
    return aligned.select(*keys, F.explode("links").alias("link")).select(*keys, "link.a", "link.b", "link.n")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, count, best`` per pair of ids: its links in the corpus, and whether no pair with this ``b`` has more."""
    counts = linked(aligned).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = staged(counts, "links")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key, n_links, n_best, count_sum`` of every row of ``aligned`` that has links; ``key`` is unique there.

    Pairs that make up at least one in ``OFTEN`` of all links are no more than ``OFTEN``, so they are broadcast; the
    others meet their count in a join in which no pair is frequent.
    """
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * OFTEN >= total
    pair = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair")
    rows = linked(aligned, key).select(key, pair, "n")
    counts = counts.select(pair, "count", "best")
    known = rows.join(F.broadcast(counts.where(often)), "pair", "left")

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy(key).agg(
            F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    rare = known.where(F.col("count").isNull()).drop("count", "best").join(counts.where(~often), "pair")
    parts = summed(known.where(F.col("count").isNotNull())).unionByName(summed(rare))
    return parts.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
