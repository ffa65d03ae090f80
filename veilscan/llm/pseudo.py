"""LM scoring by masked pseudo-likelihood: a network on both neighbours predicts every token of a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.base import ship, slices, staged
from veilscan.llm.words import distinct_words, segment_sums

#: Token buckets; the low bits of a bucket are those of its words' endings.
BUCKETS, ENDINGS = 1 << 18, 32
#: Classes that the network tells apart: the most frequent buckets one each, the rest by ending.
HEAD = 96
CLASSES = HEAD + ENDINGS
SIDES = CLASSES + 1  # with the text's edge


@dataclass(frozen=True)
class PseudoModel:
    """``of``: class of each bucket; ``within``: log-probability of a bucket in its class; ``given``: log-probability
    of each class between two neighbours, worked out by the network for all pairs of neighbours."""

    of: np.ndarray
    within: np.ndarray
    given: np.ndarray


def buckets_of(words: list[str]) -> np.ndarray:
    """Bucket of each word; words with the same last two letters share the low bits."""
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype="i8", count=len(words))
    ends = np.fromiter((zlib.crc32(w[-2:].encode("utf-8", "surrogatepass")) for w in words), dtype="i8", count=len(words))
    return (codes % (BUCKETS // ENDINGS)) * ENDINGS + ends % ENDINGS


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, codes, starts = distinct_words(texts)
    return buckets_of(words)[codes] if len(words) else np.zeros(0, dtype="i8"), starts


def _sides(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the left and the right neighbour of every token; the edge's at both ends of a text."""
    left, right = np.full(len(classes), CLASSES), np.full(len(classes), CLASSES)
    left[1:], right[:-1] = classes[:-1], classes[1:]
    full = np.diff(starts) > 0
    left[starts[:-1][full]] = CLASSES
    right[starts[1:][full] - 1] = CLASSES
    return left, right


def _counts(docs: DataFrame, size: int, places) -> np.ndarray:
    """Sums over all documents of how often ``places(texts)`` names each of ``size`` places.

    A task counts in one array and sends what is not zero; the driver gets at most ``size`` rows, a bound that
    does not depend on the input.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype="i8")
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(places(part.column("text")), minlength=size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + (1 << 16)]), pa.array(total[at[i:i + (1 << 16)]])], ["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = staged(rows, "counts").toArrow()
    out = np.zeros(size, dtype="i8")
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(counts: np.ndarray, width: int = 32, epochs: int = 12, rate: float = 0.01, seed: int = 1) -> np.ndarray:
    """Log-probabilities ``[left, right, class]`` of a network fitted to ``counts[left, right, class]``.

    An embedding for each side, added, a tanh layer and a softmax; weighted cross-entropy, Adam steps in numpy.
    """
    rng = np.random.default_rng(seed)
    flat = counts.reshape(SIDES * SIDES, CLASSES).astype("f8")
    weight = flat.sum(1)
    rows = np.flatnonzero(weight)
    share = (flat.sum(0) + 1) / (flat.sum() + CLASSES)
    p = {"l": rng.normal(0, 0.1, (SIDES, width)), "r": rng.normal(0, 0.1, (SIDES, width)), "b": np.zeros(width),
         "w": rng.normal(0, 0.1, (width, CLASSES)), "c": np.log(share)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def forward(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(p["l"][left] + p["r"][right] + p["b"])
        z = hidden @ p["w"] + p["c"]
        z -= z.max(1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(1, keepdims=True))

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 512)) if len(rows) else []:
            left, right = part // SIDES, part % SIDES
            hidden, logs = forward(left, right)
            dz = (np.exp(logs) * weight[part, None] - flat[part]) / weight[part].mean() / len(part)
            dh = (dz @ p["w"].T) * (1 - hidden ** 2)
            grad = {"w": hidden.T @ dz, "c": dz.sum(0), "b": dh.sum(0), "l": np.zeros_like(p["l"]), "r": np.zeros_like(p["r"])}
            np.add.at(grad["l"], left, dh)
            np.add.at(grad["r"], right, dh)
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    every = np.arange(SIDES * SIDES)
    out = np.concatenate([forward(e // SIDES, e % SIDES)[1] for e in np.array_split(every, 16)])
    return out.reshape(SIDES, SIDES, CLASSES)


def train(docs: DataFrame) -> PseudoModel:
    """A model of all documents: two passes count tokens, then classes between their neighbours, over all texts."""
    tokens = _counts(docs, BUCKETS, lambda texts: _tokens(texts)[0])
    of = HEAD + np.arange(BUCKETS) % ENDINGS
    head = np.argsort(-tokens, kind="stable")[:HEAD]
    head = head[tokens[head] > 0]
    of[head] = np.arange(len(head))
    total = np.bincount(of, weights=tokens + 0.5, minlength=CLASSES)
    within = np.log((tokens + 0.5) / total[of])
    of = of.astype("i4")

    def places(texts: pa.Array) -> np.ndarray:
        found, starts = _tokens(texts)
        classes = of[found].astype("i8")
        left, right = _sides(classes, starts)
        return (left * SIDES + right) * CLASSES + classes

    counts = _counts(docs, SIDES * SIDES * CLASSES, places).reshape(SIDES, SIDES, CLASSES)
    return PseudoModel(of, within.astype("f4"), fit(counts).astype("f4"))


def score(docs: DataFrame, model: PseudoModel) -> DataFrame:
    """``docs`` with ``n_tokens``, ``log_likelihood`` and ``per_token``; whole texts, no shuffle.

    The log-likelihood is the sum over all tokens of the log-probability of the token between its two neighbours;
    texts without tokens (or null) get 0 and 0. Columns of these names are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_tokens", "log_likelihood", "per_token")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_likelihood"), F.lit(0.0).alias("per_token")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, starts = _tokens(part.column("text"))
                classes = m.of[tokens].astype("i8")
                left, right = _sides(classes, starts)
                logs = m.given[left, right, classes].astype("f8") + m.within[tokens]
                total, n = segment_sums(logs, starts), np.diff(starts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n.astype("i8")), pa.array(total), pa.array(total / np.maximum(n, 1))],
                    [*part.schema.names, "n_tokens", "log_likelihood", "per_token"])

    return docs.mapInArrow(run, schema)
