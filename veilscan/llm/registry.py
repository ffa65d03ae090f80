"""The operators as registered queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import align, bytepairs, exact, extract, jaccard, langid, lines, neighbours, packing, pieces, prefixes, pseudo, quality
from veilscan.llm.base import crc_mod, staged, table

QUALITY_KEPT = 0.7


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.learned_weights(pages)).drop("html")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.locate(table(spark, sf_dir, "documents"))
    return exact.dedup(rows, exact.first_half(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo.score(docs, pseudo.train(docs)).drop("text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= QUALITY_KEPT).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.decide(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by byte-level BPE, and the text they decode to, as digests. A row per row; null is empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bytepairs.decode(bytepairs.encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers' tokens of every text. A row per row, repeated ones too; texts that are
    null, empty or not given back by a tokenizer have zeros and an empty digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    aligned = staged(align.align(docs, wanted=("links", "written")).select(
        "row", "doc_id", "n_a", "n_b", "n_groups", "links",
        F.when(F.col("n_a") > 0, F.sha2("written", 256)).otherwise("").alias("groups_sha256")), "aligned")
    sums = align.link_sums(aligned, align.link_counts(aligned), "row")
    found = ("n_links", "n_best", "count_sum")
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in found), "groups_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations. Rows without ``conv_id`` take no part; no conversations, no nodes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixes.prefix_trie(prefixes.rebuilt(prefixes.sequences(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_html_extraction": op3_html_extraction,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_bpe": op11_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
