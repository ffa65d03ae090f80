"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import release_tables, ship, slices
from veilscan.llm.words import distinct_words, ngram_features, parts, segment_sums, training_rows

ORDERS = (1, 3, 4)
BUCKETS = 1 << 16
#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class QualityModel:
    """``vectors``: one row per bucket, and a last row for "the same word again"; ``output``: dim x 2."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _repeats(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: at how many places a word follows itself (the word bigrams that share one vector)."""
    same = np.zeros(len(codes), dtype="f4")
    if len(codes):
        same[1:] = codes[1:] == codes[:-1]
        same[starts[:-1][np.diff(starts) > 0]] = 0
    return segment_sums(same, starts)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """``(text, h, label)`` of at most ``max_docs`` labelled documents of any length, drawn by the hash of the id.

    Both labels get half of the places, or what the other leaves. The ids are drawn from the labels alone; only that
    bounded list is broadcast to the documents. Of a repeated id one text counts.
    """
    known = (labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
             .withColumn("at", F.xxhash64("doc_id")))
    first = [known.where(F.col("label") == c).orderBy("at", "doc_id").limit(max_docs) for c in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
    drawn = first[0].unionByName(first[1]).withColumn("turn", turn).orderBy("turn", "label").limit(max_docs).select("doc_id", "label")
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))).where("n = 1").select("text", "h", "label")


def _feature_shares(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(vectors, shares)`` of each text: what its mean over words is made of."""
    words, codes, starts = distinct_words(texts)
    features, at = ngram_features(words, ORDERS, buckets, whole=True)
    again = _repeats(codes, starts)
    rows = []
    for i in range(len(texts)):
        used, times = np.unique(codes[starts[i]:starts[i + 1]], return_counts=True)
        own = [features[at[w]:at[w + 1]] for w in used]
        if not own:
            rows.append((np.zeros(0, dtype="i4"), np.zeros(0, dtype="f4")))
            continue
        weight = np.repeat(times / np.maximum(1, [len(f) for f in own]), [len(f) for f in own])
        ids, where = np.unique(np.concatenate(own), return_inverse=True)
        share = np.bincount(where, weights=weight) / times.sum()
        rows.append((np.append(ids, buckets).astype("i4"), np.append(share, again[i] / times.sum()).astype("f4")))
    return rows


def fit(texts: list[str] | pa.Array, labels: list[int], buckets: int = BUCKETS, **how) -> QualityModel:
    """``fit_rows`` on the texts themselves."""
    return fit_rows([row for part in parts(texts) for row in _feature_shares(part, buckets)], labels, buckets, **how)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, dim: int = 8, epochs: int = 5,
             rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent, one document a step, in plain numpy. Classes are weighted alike.

    Without documents, or with one class only, the model answers that class's share for every text.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((buckets + 1, dim)) - 0.5) / dim).astype("f4")
    output, bias = np.zeros((dim, 2), dtype="f4"), np.zeros(2, dtype="f4")
    y = np.asarray(labels, dtype="i8")
    counts = np.bincount(y, minlength=2)
    if counts.min() == 0:
        bias[:] = np.log((counts + 0.5) / (counts.sum() + 1))
        return QualityModel(vectors, output, bias)
    weight = (counts.sum() / (2.0 * counts)).astype("f4")
    total, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            hidden = share @ vectors[ids]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = np.float32(rate * (1 - step / total)) * weight[y[i]]
            back = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            # The share of one feature is small, so its vector takes a step as large as the document's.
            vectors[ids] -= lr * 10 * np.outer(share, back)
            step += 1
    return QualityModel(vectors, output, bias)


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of label 1; whole texts, null counts as empty.

    Each distinct word of a batch is turned into its vector once; a document is the mean over its words.
    A column of that name is replaced. Python only, no shuffle; the model is a fixed few MB.
    """
    docs = docs.drop(name)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, codes, starts = distinct_words(part.column("text"))
                features, at = ngram_features(words, ORDERS, len(m.vectors) - 1, whole=True)
                vectors = segment_sums(m.vectors[features], at) / np.maximum(1, np.diff(at))[:, None]
                n = np.maximum(1, np.diff(starts))[:, None]
                again = _repeats(codes, starts)[:, None] * m.vectors[-1]
                hidden = (segment_sums(vectors[codes].astype("f8"), starts) + again) / n
                z = hidden @ m.output + m.bias
                p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, total_bytes: int = 128 << 20) -> QualityModel:
    """A model from ``labels(doc_id, label)``; at most ``max_docs`` documents, whose features take ``total_bytes`` at most."""
    rows, y = training_rows(labelled_sample(docs, labels, max_docs), "label", lambda t: _feature_shares(t, BUCKETS), total_bytes, 2)
    return fit_rows(rows, y)
