"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import ship, staged

#: Index rows that a task compares at once; larger buckets are dealt over several tasks.
BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Tables:
    """``tables`` hash tables of ``hashes`` projections each, ``probes`` buckets visited per table and query.

    A projection ``h(v) = floor((a . v + b) / width)`` has Gaussian ``a`` (stable under addition: near vectors
    have near projections) and uniform ``b``. Vectors are scaled to length one, so the nearest by distance is the one
    with the largest cosine.
    """

    tables: int = 8
    hashes: int = 6
    width: float = 1.6
    probes: int = 64
    seed: int = 5

    def draw(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.tables * self.hashes
        return rng.standard_normal((dim, n)), rng.random(n) * self.width


def perturbations(hashes: int, probes: int) -> list[list[int]]:
    """Sets of places in the list of the ``2 * hashes`` boundaries (nearest first), in the order of expected success.

    The j-th nearest boundary is expected at a squared distance that depends on j only, so the order is one and
    the same for all queries. Sets grow from a heap by shifting their last place or adding the next one; those
    holding both sides of one projection are left out. The first set is empty: the query's own bucket.
    """
    n = 2 * hashes
    cost = [j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) if j <= hashes else
            1 - (n + 1 - j) / (hashes + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, n + 1)]
    heap, out = [(cost[0], [0])], [[]]
    while heap and len(out) < probes:
        total, places = heapq.heappop(heap)
        last = places[-1]
        if all(n - 1 - p not in places for p in places):
            out.append(places)
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], places[:-1] + [last + 1]))
            heapq.heappush(heap, (total + cost[last + 1], places + [last + 1]))
    return out


def buckets(units: np.ndarray, spec: Tables) -> tuple[np.ndarray, np.ndarray]:
    """``(cells, rest)``: integer cell of every projection, and where in its cell (0 to 1) a vector falls."""
    a, b = spec.draw(units.shape[1])
    at = (units @ a + b) / spec.width
    cells = np.floor(at)
    shape = (len(units), spec.tables, spec.hashes)
    return cells.astype("i8").reshape(shape), (at - cells).reshape(shape)


def _key(cells: np.ndarray) -> np.ndarray:
    """One 64-bit number per bucket: its cells mixed in order."""
    out = np.zeros(cells.shape[:-1], dtype="u8")
    with np.errstate(over="ignore"):
        for j in range(cells.shape[-1]):
            out = (out ^ cells[..., j].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view("i8")


def probe(units: np.ndarray, spec: Tables, sets: list[list[int]]) -> np.ndarray:
    """Bucket of every query (first axis) in every table (second) at every perturbation (third)."""
    cells, rest = buckets(units, spec)
    # Boundaries of each query and table, nearest first; the first half steps down, the second up.
    order = np.argsort(np.concatenate([rest, 1 - rest], axis=2), axis=2, kind="stable")
    out = []
    for places in sets:
        moved = cells.copy()
        for p in places:
            side = order[:, :, p:p + 1]
            step = np.where(side < spec.hashes, -1, 1)
            at = side % spec.hashes
            np.put_along_axis(moved, at, np.take_along_axis(moved, at, 2) + step, 2)
        out.append(_key(moved))
    return np.stack(out, axis=2)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype("f8")


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose id and vector are not null and whose vector is finite and not zero."""
    v = F.col(column).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).where(
        ok & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries, k: int = 5, spec: Tables = Tables()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``queries`` holds, the ``k`` found with the largest cosine.

    Equal vectors are one class that carries its ``k + 1`` smallest ids: more can't be among the nearest of any
    query, so nothing is lost. Classes meet probes by table and bucket, large buckets dealt over several tasks; a
    task reranks by the exact cosine in double precision and passes on the best of each query, which are merged.
    A query whose buckets hold fewer than ``k`` others is compared with all classes, in blocks. Ties go to
    the smaller id. Vectors that are null, zero or not finite take no part; repeated ids count once per
    vector; vectors of another length than the most common one are compared among their own kind.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    # Hashed per class; ids of a class gather as its k + 1 smallest, by rank, so a hot class stays small.
    place = F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))
    named = staged(rows.withColumn("class", F.xxhash64("v")), "vectors")
    first = named.groupBy("class").agg(F.min("vec_id").alias("vec_id"))
    ids = (named.select("class", "vec_id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
           .groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    classes = staged(named.select("class", "v", "vec_id").join(first, ["class", "vec_id"], "left_semi")
                     .dropDuplicates(["class"]).drop("vec_id").join(ids, "class"), "classes")
    asked = named.where("q").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    sets = perturbations(spec.hashes, spec.probes)

    def place_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, units in _units(batch):
                yield _spread(part, _key(buckets(units, spec)[0])[:, :, None], ["class", "v", "ids"])

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, units in _units(batch):
                yield _spread(part, probe(units, spec, sets), ["query_id"])

    spot = "table int, bucket long"
    held = staged(classes.mapInArrow(place_classes, f"class long, v array<double>, ids array<long>, {spot}"), "buckets")
    probes = asked.mapInArrow(place_queries, f"query_id long, {spot}")
    # Buckets share tasks: a spot holds about BUCKET_ROWS rows of a table, whole buckets or parts of a large one,
    # and a query comes to it once with the list of its buckets there.
    spots = max(1, -(-classes.count() // BUCKET_ROWS))
    parts = held.groupBy("table", "bucket").agg(F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).cast("int").alias("parts"))
    to_spot = F.pmod(F.xxhash64("bucket", "part"), F.lit(spots)).cast("int").alias("spot")
    held = (held.join(parts.where("parts > 1"), ["table", "bucket"], "left")
            .withColumn("part", F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1))).cast("int"))
            .select("class", "v", "ids", "table", "bucket", to_spot))
    visits = (probes.join(parts, ["table", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("query_id", "table", "bucket", to_spot)
              .groupBy("query_id", "table", "spot").agg(F.collect_set("bucket").alias("buckets")).join(asked, "query_id"))
    best = visits.groupBy("table", "spot").cogroup(held.groupBy("table", "spot")).applyInArrow(
        lambda a, b: _rerank(a, b, k), "query_id long, vec_id long, score double")
    found = staged(_top(best, k), "found")
    # Too few candidates in all its buckets: all classes, in blocks, for those queries only.
    short = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n")
    short = staged(short, "short")
    if not short.isEmpty():
        blocks = max(1, -(-classes.count() // BUCKET_ROWS))
        all_parts = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = classes.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
        rest = all_parts.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(
            lambda a, b: _rerank(a, b, k), "query_id long, vec_id long, score double")
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(_top(rest, k))
    return found.select("query_id", "rank", "vec_id", "score")


def _top(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of each query, ranked."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with vectors of one length, and those vectors scaled to length one."""
    lengths = np.asarray(batch.column("v").value_lengths())
    for length in np.unique(lengths):
        part = batch.filter(pa.array(lengths == length))
        v = _vectors(part.column("v"))
        v = v / np.abs(v).max(1, keepdims=True)
        yield part, v / np.linalg.norm(v, axis=1, keepdims=True)


def _spread(part: pa.RecordBatch, keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Each row once per table and visited bucket."""
    n, tables, probes = keys.shape
    row = np.repeat(np.arange(n), tables * probes)
    table = np.tile(np.repeat(np.arange(tables, dtype="i4"), probes), n)
    flat = keys.reshape(-1)
    kept = part.select(names).take(pa.array(row))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(table), pa.array(flat)], [*names, "table", "bucket"])


def _rerank(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of ``held`` for every query, by exact cosine; a query's own id is left out.

    With a list ``buckets`` a query sees only the rows in those.
    """
    out: tuple[list, list, list] = ([], [], [])
    if asked.num_rows and held.num_rows:
        for length in np.unique(np.asarray(pc.list_value_length(asked["v"]))):
            mine, theirs = (t.filter(pc.equal(pc.list_value_length(t["v"]), int(length))) for t in (asked, held))
            if not theirs.num_rows:
                continue
            if "bucket" in theirs.column_names:
                theirs = theirs.sort_by("bucket")
            a, b = (_vectors(t["v"].combine_chunks()) for t in (mine, theirs))
            norms, ids, rows = np.linalg.norm(b, axis=1), theirs["ids"].to_pylist(), np.arange(len(b))
            for i, query in enumerate(mine["query_id"].to_pylist()):
                if "buckets" in mine.column_names:
                    bucket, wanted = theirs["bucket"].to_numpy(), np.asarray(mine["buckets"][i].as_py())
                    ends = zip(np.searchsorted(bucket, wanted), np.searchsorted(bucket, wanted, side="right"), strict=True)
                    rows = np.concatenate([np.arange(s, e) for s, e in ends])
                if not len(rows):
                    continue
                score = (b[rows] @ a[i]) / (norms[rows] * np.linalg.norm(a[i]))
                # Candidates down to the k + 1-th score, ties included; then by score and id.
                last = min(k + 1, len(rows))
                least = np.partition(score, -last)[-last]
                near = sorted(((-score[j], v) for j in np.flatnonzero(score >= least) for v in ids[rows[j]] if v != query))[:k]
                out[0].extend([query] * len(near))
                out[1].extend(v for _, v in near)
                out[2].extend(-s for s, _ in near)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})
