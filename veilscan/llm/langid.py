"""Language identification with error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import release_tables, ship, slices, staged
from veilscan.llm.words import distinct_words, ngram_features, parts, segment_sums, training_rows

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"
#: A document's n-gram shares add up to this.
SCALE = 8.0


@dataclass(frozen=True)
class LanguageModel:
    """``codes``: language x bit of -1 and 1; ``weights``: bucket x bit; ``bias``: bit."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` rows of -1 and 1: the exhaustive code up to 7 languages, beyond that the best of drawn ones.

    Columns split the languages, and no two rows are alike; the least distance between rows is what
    the decoder can correct by half.
    """
    if n <= 1:
        return np.ones((n, 1), dtype="i1")
    if n <= 7:
        bits = [[1 if (c >> r) & 1 else -1 for c in range(1, 1 << (n - 1))] for r in range(n)]
        return np.asarray(bits, dtype="i1")
    rng = np.random.default_rng(seed)
    width, best, least = 12 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        code = np.where(rng.random((n, width)) < 0.5, -1, 1).astype("i1")
        code[0, np.abs(code.sum(0)) == n] *= -1
        gram = code.astype("i4") @ code.T.astype("i4")
        distance = ((width - gram) // 2 + width * np.eye(n, dtype="i4")).min()
        if distance > least:
            best, least = code, distance
    return best


def labelled_sample(docs: DataFrame, per_language: int) -> tuple[DataFrame, int]:
    """``(text, h, lang)``: at most ``per_language`` documents of each language, of any length, and the number of languages.

    They are drawn by the hash of id and text. Rows are counted per language and step of the hash, in steps that grow
    with it, so the last step that is needed holds few rows more than asked for and only those are ranked. Equal rows
    have equal hashes: null or repeated ids don't exceed the bound.
    """
    # The hash from 0 on, in sixteenths of its logarithm: about a thousand steps.
    step = F.floor(16 * F.log2(F.col("h").cast("double") + F.lit(2.0**63 + 1))).cast("int")
    named = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    below = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = named.select("lang", step.alias("step")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    last = (counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).where(F.col("before") < per_language)
            .groupBy("lang").agg(F.max("step").alias("last")))
    last = staged(last, "last-drawn")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = named.join(F.broadcast(last), "lang").where(step <= F.col("last")).withColumn("n", turn).where(F.col("n") <= per_language)
    return drawn.select("text", "h", "lang"), last.count()


def _ngram_shares(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, shares)`` of the n-grams of each text; shares add up to ``SCALE``."""
    words, word_codes, starts = distinct_words(texts)
    features, at = ngram_features(words, ORDERS, buckets, whole=False)
    rows = []
    for i in range(len(texts)):
        used, times = np.unique(word_codes[starts[i]:starts[i + 1]], return_counts=True)
        own = [features[at[w]:at[w + 1]] for w in used]
        size = [len(f) for f in own]
        if not sum(size):
            rows.append((np.zeros(0, dtype="i4"), np.zeros(0, dtype="f4")))
            continue
        ids, where = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.bincount(where, weights=np.repeat(times, size))
        rows.append((ids.astype("i4"), (SCALE * counts / counts.sum()).astype("f4")))
    return rows


def fit(texts: list[str] | pa.Array, langs: list[str], buckets: int = BUCKETS, **how) -> LanguageModel:
    """``fit_rows`` on the texts themselves."""
    return fit_rows([row for part in parts(texts) for row in _ngram_shares(part, buckets)], langs, buckets, **how)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS, epochs: int = 5, rate: float = 2.0,
             seed: int = 3) -> LanguageModel:
    """One logistic classifier per bit of the codewords, all bits at once, by gradient steps in numpy."""
    languages = tuple(sorted(set(langs)))
    codes = codewords(len(languages))
    weights = np.zeros((buckets, codes.shape[1]), dtype="f4")
    bias = np.zeros(codes.shape[1], dtype="f4")
    if len(languages) < 2:
        return LanguageModel(languages, codes, weights, bias)
    label = np.searchsorted(languages, langs)
    balance = (len(label) / (len(languages) * np.bincount(label))).astype("f4")
    rng, step, total = np.random.default_rng(seed), 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, value = rows[i]
            sign = codes[label[i]].astype("f4")
            margin = sign * (value @ weights[ids] + bias)
            pull = sign / (1 + np.exp(np.clip(margin, -30, 30)))
            lr = np.float32(rate * (1 - step / total)) * balance[label[i]]
            weights[ids] += lr * np.outer(value, pull)
            bias += lr * np.float32(0.01) * pull
            step += 1
    return LanguageModel(languages, codes, weights, bias)


def identify(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.6, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, after ``prefix``; whole texts, no shuffle.

    The bits of a document are linear in the shares of its n-grams, so they are sums over its distinct words. Decoding takes the codeword with the least logistic loss, each bit weighted by its
    margin; the score is the share of that codeword's likelihood, and a share below ``ambiguous_below``
    is flagged. Null texts, texts without a letter, and all texts if no language was learned get ``und``
    with score 0, flagged. Columns of these names are replaced.
    """
    names_out = [prefix + n for n in ("lang_pred", "score", "ambiguous")]
    docs = docs.drop(*names_out)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(names_out[0]), F.lit(0.0).alias(names_out[1]), F.lit(True).alias(names_out[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        m = shared.value
        names = np.asarray([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, codes, starts = distinct_words(part.column("text"))
                letter = np.fromiter((any(map(str.isalpha, w)) for w in words), dtype="f4", count=len(words))
                known = segment_sums(letter[codes], starts) > 0
                best, share = np.full(len(part), len(m.languages)), np.zeros(len(part))
                if len(m.languages) and known.any():
                    features, at = ngram_features(words, ORDERS, len(m.weights), whole=False)
                    bits = segment_sums(m.weights[features], at)
                    grams = segment_sums(np.diff(at)[codes], starts)
                    z = SCALE * segment_sums(bits[codes].astype("f8"), starts) / np.maximum(grams, 1)[:, None] + m.bias
                    loss = np.logaddexp(0, -z[:, None, :] * m.codes[None]).sum(2)
                    p = np.exp(loss.min(1, keepdims=True) - loss)
                    p /= p.sum(1, keepdims=True)
                    best = np.where(known, p.argmax(1), best)
                    share = np.where(known, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best], pa.string()), pa.array(share, pa.float64()),
                     pa.array(share < ambiguous_below)],
                    [*part.schema.names, *names_out])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, per_language: int = 800, total_bytes: int = 64 << 20) -> LanguageModel:
    """A model from ``docs(doc_id, text, lang)``; at most ``per_language`` texts each, whose n-grams take ``total_bytes`` at most."""
    sample, languages = labelled_sample(docs, per_language)
    rows, langs = training_rows(sample, "lang", lambda t: _ngram_shares(t, BUCKETS), total_bytes, languages)
    return fit_rows(rows, langs)
