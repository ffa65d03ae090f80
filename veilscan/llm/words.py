"""Distinct words of a batch of texts, and hashed character n-grams of words, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import mix64, release_tables, ship


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(words, codes, starts)``: the distinct lower-case words of all texts, the word of each position, and
    where each text begins in ``codes`` (one entry more than texts). Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = lists.offsets.to_numpy().astype("i8")
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    keep = pc.not_equal(flat, "")
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    encoded = flat.filter(keep).dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(), kept[offsets - offsets[0]]


def parts(texts: list[str] | pa.Array, step: int = 64) -> list[pa.Array]:
    """``texts`` as arrays of ``step`` texts, so that what is worked out per word stays small."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return [texts.slice(i, step) for i in range(0, len(texts), step)]


def ngram_features(words: list[str], orders: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(features, starts)``: hashed n-grams of every ``<word>`` and, if asked, the word itself as one more."""
    starts = np.zeros(len(words) + 1, dtype="i8")
    if not words:
        return np.zeros(0, dtype="i8"), starts
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("u8")
    lengths = np.fromiter((len(w) + 2 for w in words), dtype="i8", count=len(words))
    word_of = np.repeat(np.arange(len(words), dtype="i4"), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(points))
    rolled, owners, found = np.zeros(len(points), dtype="u8"), [], []
    kind = "i4" if buckets <= 1 << 31 else "i8"
    for n in range(1, max(orders) + 1):
        inside = at + n <= ends
        shifted = np.zeros(len(points), dtype="u8")
        shifted[: len(points) - n + 1] = points[n - 1:]
        rolled = (rolled ^ shifted) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        if n in orders:
            found.append((mix64(rolled[inside]) % np.uint64(buckets)).astype(kind))
            owners.append(word_of[inside])
    if whole:
        # A word's own feature: the sum of its mixed points by place, which differs from all its n-grams.
        place = (at - (ends - np.repeat(lengths, lengths))).astype("u8")
        own = mix64(points * np.uint64(0xD6E8FEB86659FD93) + place * np.uint64(0xA0761D6478BD642F))
        own = np.add.reduceat(own, np.cumsum(lengths) - lengths)
        found.append((mix64(own) % np.uint64(buckets)).astype(kind))
        owners.append(np.arange(len(words), dtype="i4"))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    np.cumsum(np.bincount(owner, minlength=len(words)), out=starts[1:])
    return np.concatenate(found)[order], starts


def training_rows(sample: DataFrame, kind: str, shares, total_bytes: int, kinds: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list]:
    """``(rows, kinds)`` of ``sample(text, h, kind)``: what ``shares`` makes of every text, worked out in Spark tasks.

    Only these rows reach the driver, long texts among them. Each of ``kinds`` values of ``kind`` has an equal part of
    ``total_bytes``; its rows count in order of ``h`` until that is used up, and the first one always does.
    """
    ship(sample.sparkSession)
    schema = sample.select("h", kind).withColumns({"ids": F.array().cast("array<int>"), "shares": F.array().cast("array<float>")}).schema

    def run(batches):
        release_tables()
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                ids, share = shares(one.column("text"))[0]
                yield pa.RecordBatch.from_arrays(
                    [one.column("h"), one.column(kind), pa.array([ids], pa.list_(pa.int32())), pa.array([share], pa.list_(pa.float32()))],
                    ["h", kind, "ids", "shares"])

    before = Window.partitionBy(kind).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(8 * F.size("ids")).over(before), F.lit(0))
    part = total_bytes // max(1, kinds)
    # The bytes of a row count too, but for the first of its kind.
    fits = (used == 0) | (used + 8 * F.size("ids") <= part)
    found = sample.mapInArrow(run, schema).withColumn("fits", fits).where("fits").drop("fits").orderBy(kind, "h").toArrow()
    rows = []
    for ids, share in zip(found["ids"], found["shares"], strict=True):
        rows.append((ids.values.to_numpy(zero_copy_only=False).astype("i4"), share.values.to_numpy(zero_copy_only=False).astype("f4")))
    return rows, found[kind].to_pylist()


def segment_sums(values: np.ndarray, starts: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Sum of ``values`` (as ``kind``) in each segment ``starts[i]:starts[i + 1]``; empty segments give zero."""
    shape = (len(starts) - 1, *values.shape[1:])
    out = np.zeros(shape, dtype=kind or values.dtype)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out
