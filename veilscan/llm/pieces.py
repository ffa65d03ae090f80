"""SentencePiece encoding and decoding with a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.base import ship, slices

MARK = "▁"
#: Distinct chunks whose ids a worker remembers; the table starts anew beyond that.
CHUNKS_KEPT = 500_000
#: A chunk without its first mark: further marks, then everything up to the next mark.
_CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")
_tables: dict[str, tuple] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def separable(processor) -> bool:
    """Whether chunks can be segmented alone: no piece has a mark behind other characters, and the normaliser
    neither joins, drops nor rewrites characters around white space (probed on texts with runs and edges)."""
    names = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(MARK in name.lstrip(MARK) for name in names):
        return False
    probes = ["a", " a", "a  b", "  a ", "a\tb\nc", "ﬁ é é", "①　x"]
    return all(processor.decode(processor.encode(p)) == p for p in probes)


def _model(path: str) -> tuple:
    """The processor of this worker, its table from chunks to ids, and whether the table may be used."""
    if path not in _tables:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        _tables[path] = (processor, {}, separable(processor))
    return _tables[path]


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without the mark that opens it: the text gets one in front, every space is one."""
    if "  " in text or MARK in text or text[:1] == " ":
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return text.split(" ")


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text (little-endian 32-bit), no special ids. Each distinct chunk is segmented once."""
    processor, table, apart = _model(path)
    if not apart:
        return [np.asarray(ids, dtype="<i4").tobytes() for ids in processor.encode(texts, num_threads=1)]
    lists = [chunks(t) if t else [] for t in texts]
    new = list(set().union(*lists).difference(table))
    if len(table) + len(new) > CHUNKS_KEPT:
        table.clear()
        new = list(set().union(*lists))
    for chunk, ids in zip(new, processor.encode(new, num_threads=1) if new else [], strict=True):
        # The processor puts a mark in front of what it is given, which is the one that chunks() took off.
        table[chunk] = np.asarray(ids or [processor.piece_to_id(MARK)], dtype="<i4").tobytes()
    return [b"".join(map(table.__getitem__, words)) for words in lists]


def encode(docs: DataFrame, path: str | None = None, add_end: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int): whole texts, null counts as empty, the end id last if asked.

    Same ids as the library gives for the whole text. Models whose pieces may cross marks are run on whole texts.
    No shuffle; a worker holds one slice of texts and a bounded table. A column of that name is replaced.
    """
    ship(docs.sparkSession)
    path, docs = path or model_path(), docs.drop("ids")
    schema = docs.select("*", F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([_model(path)[0].eos_id()] if add_end else [], dtype="<i4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [r + end for r in encode_texts(path, [t or "" for t in part.column("text").to_pylist()])]
                offsets = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the library's text for ``ids``; null or no ids give the empty text."""
    ship(encoded.sparkSession)
    path, encoded = path or model_path(), encoded.drop("decoded")
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _model(path)[0]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [processor.decode(ids) if ids else "" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
