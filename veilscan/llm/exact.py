"""Exact dedup with a minimal perfect hash over the distinct digests of earlier documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import attach, mix64, staged

#: Distinct digests of one shard of the index: what a task holds at once.
SHARD_DIGESTS = 1 << 16
LEVELS = 64
INDEX_SCHEMA = ("shard int, sizes array<int>, bits binary, slots binary, winner_id array<long>, winner_at array<long>, "
                "size array<long>")
GROUP_SCHEMA = "digest binary, winner_id long, winner_at long, size long"


def normalised(text: Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def locate(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, at`` per row, staged: the digest of the normalised text, and a number of the row's own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("at"))
    return staged(rows, "digests")


def group(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner (smallest id, nulls last; then the first row) and its size."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    return rows.groupBy("digest").agg(first, F.count("*").alias("size")).select(
        "digest", F.col("first.doc_id").alias("winner_id"), F.col("first.at").alias("winner_at"), "size")


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest (rows of four 64-bit words) falls at a level of ``size`` places."""
    with np.errstate(over="ignore"):
        return (mix64(digests[:, 0] + np.uint64(level + 1) * (digests[:, 1] | np.uint64(1))) % np.uint64(size)).astype("i8")


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct digests: ``(sizes, bits, slot of each)``.

    At every level the digests still left fall on twice as many places; those alone on a place take it, and
    the slot is the number of places taken before it. Digests left after all levels take the last slots.
    """
    left, slots = np.arange(len(digests)), np.full(len(digests), -1, dtype="i8")
    sizes, bits, taken = [], [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = 2 * len(left) + 1
        place = _places(digests[left], level, size)
        alone = np.bincount(place, minlength=size) == 1
        rank = taken + np.cumsum(alone) - 1
        won = alone[place]
        slots[left[won]] = rank[place[won]]
        taken += int(won.sum())
        left = left[~won]
        sizes.append(size)
        bits.append(alone)
    slots[left] = np.arange(taken, taken + len(left))
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool), slots


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1: what the hash names is believed only if all 32 bytes in the slot agree."""
    rank = np.cumsum(bits) - 1
    left, out, base = np.arange(len(digests)), np.full(len(digests), -1, dtype="i8"), 0
    for level, size in enumerate(sizes):
        place = base + _places(digests[left], level, size)
        hit = bits[place]
        slot = rank[place[hit]]
        same = (held[slot] == digests[left[hit]]).all(1)
        out[left[hit][same]] = slot[same]
        left = left[~hit]
        base += size
    taken = int(bits.sum())
    for slot in range(taken, len(held)):
        out[left[(digests[left] == held[slot]).all(1)]] = slot
    return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)


def _shards(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(groups: DataFrame) -> tuple[DataFrame, int]:
    """The index of ``group``'s rows, a row per shard, staged; and the number of shards."""
    shards = max(1, -(-groups.count() // SHARD_DIGESTS))

    def build(rows: pa.Table) -> pa.Table:
        digests = _words(rows["digest"])
        sizes, bits, slots = build_hash(digests)
        order = np.argsort(slots)
        rows = rows.take(pa.array(order))
        return pa.table({
            "shard": pa.array([rows["shard"][0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "slots": pa.array([digests[order].tobytes()], pa.binary()),
            **{c: pa.array([rows[c].to_pylist()], pa.list_(pa.int64())) for c in ("winner_id", "winner_at", "size")}})

    return staged(_shards(groups, shards).groupBy("shard").applyInArrow(build, INDEX_SCHEMA), "index"), shards


def merge(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of the earlier rows and of new ones together, a row per digest.

    New groups are already one row per digest, so a shard meets at most as many rows as distinct digests.
    Members of the index add to their slot's size; non-members stay groups of their own.
    """

    def join(held: pa.Table, new: pa.Table) -> pa.Table:
        names = ["digest", "winner_id", "winner_at", "size"]
        new = new.select(names)
        if not held.num_rows:
            return new
        row = held.to_pylist()[0]
        slots = np.frombuffer(row["slots"], dtype="<u8").reshape(-1, 4)
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype="u1"), count=sum(row["sizes"])).astype(bool)
        at = find_slots(_words(new["digest"]), row["sizes"], bits, slots)
        winners, places, size = list(row["winner_id"]), list(row["winner_at"]), list(row["size"])
        found = new.filter(pa.array(at >= 0)).to_pydict()
        for slot, *group in zip(at[at >= 0].tolist(), found["winner_id"], found["winner_at"], found["size"], strict=True):
            mine, theirs = (winners[slot], places[slot]), (group[0], group[1])
            winners[slot], places[slot] = min(mine, theirs, key=lambda w: (w[0] is None, w[0] or 0, w[1]))
            size[slot] += group[2]
        raw = slots.tobytes()
        kept = pa.table({"digest": pa.array([raw[i:i + 32] for i in range(0, len(raw), 32)], pa.binary()),
                         "winner_id": pa.array(winners, pa.int64()), "winner_at": pa.array(places, pa.int64()),
                         "size": pa.array(size, pa.int64())})
        return pa.concat_tables([kept, new.filter(pa.array(at < 0)).cast(kept.schema)])

    return index.groupBy("shard").cogroup(_shards(groups, shards).groupBy("shard")).applyInArrow(join, GROUP_SCHEMA)


def dedup(rows: DataFrame, earlier: Column) -> DataFrame:
    """``rows`` of ``locate`` with ``keep_id``, ``group_size`` and ``kept``.

    Rows where ``earlier`` holds are the history that the index is built from; the others are looked up
    in it. Null texts count as empty. Of equal texts the smallest id stays, of equal ids one row; rows
    without an id stay only if the whole group has none. An empty table gives an empty result.
    """
    rows = rows.withColumn("earlier", F.coalesce(earlier, F.lit(False)))
    index, shards = build_index(group(rows.where("earlier")))
    groups = staged(merge(group(rows.where("not earlier")), index, shards), "groups")
    out = attach(rows.drop("earlier"), groups.where("size > 1"), "digest", "size")
    alone = F.col("size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("winner_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("winner_at") == F.col("at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "at", "digest")


def first_half(rows: DataFrame) -> Column:
    """The condition that splits rows into history and newcomers at the middle of the id range."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= F.lit(None if low is None else low + (high - low) // 2).cast("long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    rows = locate(docs)
    gone = staged(dedup(rows, first_half(rows)).where("not kept").select(
        F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__again")).distinct(), "gone")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn(
        "__hash", F.unhex(F.sha2(normalised(F.col("text")), 256)))
    same = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__hash") == F.col("__digest"))
    left = keyed.join(gone.where("not __again"), same, "left_anti")
    again = gone.where("__again")
    if not again.isEmpty():
        # Rows repeated with id and text: the first of each stays; ranks are cut before the shuffle.
        place = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__id"))
        repeated = left.join(again, same, "left_semi").withColumn("__place", place).where("__place = 1")
        left = left.join(again, same, "left_anti").unionByName(repeated.drop("__place"))
    return left.select(*docs.columns)
