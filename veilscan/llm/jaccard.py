"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection of sorted arrays.

Two sets of similarity ``num / den`` or more share a member among the first ``n - ceil(n * num / den) + 1``
of each, whatever the order of members. Ordered rare first, those members are the keys under which sets meet.
A key's sets form tiles by size band; bitmaps bound the overlap of a pair from above, and only pairs that
pass are intersected. Links inside one connected class are not looked for again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import attach, components, mix64, release_tables, slices, staged

#: Counters of the frequency sketch: 4 bytes each, the only thing that is broadcast, whatever the input.
SKETCH = 1 << 20
CHUNK = 1 << 14
BITMAP_LEAST, BITMAP_MOST = 256, 4096
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20
#: Sets, and members of sets, that one tile of the first round holds; sets of one tile of the second.
TILE_SETS, TILE_MEMBERS, BLOCK_SETS = 2000, 4_000_000, 4000
#: What one call works through: members of sets in the first round, rows of tiles in the second.
SLOT_MEMBERS, SLOT_SETS = 2_000_000, 20_000
BLOCK_BYTES = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
#: Per byte: whether it is white space, and its value with A-Z lower-cased.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = (np.arange(256) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0) + 1).astype("u8")


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, start)`` of every word in ``data`` (bytes that end with a space), A-Z lower-cased."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    hashes, at = np.zeros(len(starts), dtype="u8"), 0
    while at < len(starts):
        # Blocks of whole words: a polynomial over the block's bytes gives each word's value by two look-ups.
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
        first, last = starts[at], ends[stop - 1]
        with np.errstate(over="ignore"):
            power = np.ones(last - first + 1, dtype="u8")
            power[1:] = FACTOR
            power = np.cumprod(power)
            total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[data[first:last]] * power[:-1])])
            s, e = starts[at:stop] - first, ends[at:stop] - first
            # Words are compared at a common place: each is moved up to the end of its block.
            value = (total[e] - total[s]) * power[len(power) - 1 - s]
            hashes[at:stop] = mix64(value * _inverse_power(len(power) - 1) + (e - s).astype("u8") * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return hashes, starts


def _inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(pow(FACTOR, -1, 1 << 64), n, 1 << 64))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the ``k``-word shingles of each text; null counts as empty.

    A text of fewer words has its whole sequence as its one shingle, one without words none.
    """
    raw = [t.encode() if t else b"" for t in texts.to_pylist()]
    data = np.frombuffer(b" ".join([*raw, b""]) or b" ", dtype="u1")
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    words, starts = _word_hashes(data)
    at = np.searchsorted(starts, bounds)
    with np.errstate(over="ignore"):
        places = max(0, len(words) - k + 1)
        rolled = np.zeros(places, dtype="u8")
        for j in range(k):
            rolled = mix64(rolled * np.uint64(FACTOR) + words[j:j + places] + np.uint64(j + 1))
        out = []
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s >= k:
                out.append(np.unique(rolled[s:e - k + 1]))
            else:
                short = np.uint64(e - s)
                for w in words[s:e]:
                    short = mix64(np.asarray(short * np.uint64(FACTOR) + w))[()]
                out.append(np.asarray([short] if e > s else [], dtype="u8"))
    return out


def _node(members: np.ndarray) -> int:
    """A signed 64-bit digest of a set: equal sets are one node; collisions are as unlikely as of the members."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(members) + 1, dtype="u8")
        total = mix64(members ^ mix64(place)).sum(dtype="u8")
        return int(mix64(np.asarray(total ^ np.uint64(len(members))))[()].astype("i8"))


def _map_sets(docs: DataFrame, k: int, schema: str, make) -> DataFrame:
    """``make(rows, sets)`` over slices of ``docs``, as Arrow record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield from make(part, shingle_sets(part.column("text"), k))

    return docs.mapInArrow(run, schema)


def _gather(rows: DataFrame, places) -> np.ndarray:
    """Sums over all rows of how often ``places(batch)`` names each of ``SKETCH`` counters, saturating at 65,535.

    Tasks count on their own and send their counters in chunks; chunks are summed in a stream, so the largest
    thing that any task or the driver holds is one sketch.
    """
    chunks, schema = range(0, SKETCH, CHUNK), "chunk int, counts binary"

    def sent(numbers: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        raw = [np.minimum(c, 65535).astype("<u2").tobytes() for c in sums]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(raw, pa.binary())], ["chunk", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype="i8")
        for batch in batches:
            for found in places(batch):
                total += np.bincount((found % np.uint64(SKETCH)).astype("i8"), minlength=SKETCH)
        used = [i for i, at in enumerate(chunks) if total[at:at + CHUNK].any()]
        yield sent(used, [total[i * CHUNK:(i + 1) * CHUNK] for i in used])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, dtype="<u2").astype("i8")
        yield sent(list(sums), list(sums.values()))

    out = np.zeros(SKETCH, dtype="u2")
    for row in rows.mapInArrow(count, schema).repartition(len(chunks), "chunk").mapInArrow(add, schema).collect():
        out[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, dtype="<u2")
    return out


def _sieved(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` (a 64-bit hash) is not in the one column of ``wanted``.

    A bitmap of the wanted hashes, as large for any input, spares most rows a shuffle; a join that follows is exact.
    """
    marked = rows.sparkSession.sparkContext.broadcast(
        _gather(wanted, lambda batch: [batch.column(0).to_numpy().view("u8")]) > 0)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked.value[(batch.column(column).to_numpy().view("u8") % np.uint64(SKETCH)).astype("i8")]))

    return rows.mapInArrow(sieve, rows.schema)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """About how many sets hold the members that fall on each counter; only the order of members depends on it."""

    def members(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, "text", SLICE_BYTES):
            yield np.concatenate([np.zeros(0, dtype="u8"), *shingle_sets(part.column("text"), k)])

    return _gather(docs.select("text"), members)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def bitmap(members: np.ndarray) -> np.ndarray:
    """A bitmap whose width follows the set's size; a wider one folds to a narrower by halves."""
    width = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << max(0, 2 * len(members) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(members % np.uint64(width)).astype("i8")] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def _fold(maps: list[np.ndarray]) -> np.ndarray:
    """All bitmaps of a tile at the width of its narrowest."""
    width = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def _may_link(i: int, others: np.ndarray, maps: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of ``others`` the size bound and the bitmap bound on the overlap leave for ``i``."""
    n, m = sizes[i], sizes[others]
    fit = np.minimum(n, m) * den >= num * np.maximum(n, m)
    others, m = others[fit], m[fit]
    mine = n - np.bitwise_count(maps[i] & ~maps[others]).sum(1)
    theirs = m - np.bitwise_count(maps[others] & ~maps[i]).sum(1)
    return others[np.minimum(mine, theirs) * (num + den) >= num * (n + m)]


def _linked(members: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of ``others`` reach the similarity with ``members``: exact intersections of sorted arrays."""
    sizes = np.asarray([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(members, flat), len(members) - 1)
    shared = np.add.reduceat((members[at] == flat).astype("i8"), np.cumsum(sizes) - sizes)
    return shared * den >= num * (len(members) + sizes - shared)


def _tiles(rows: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of each tile (key, band and block) of a slot."""
    columns = [rows[c].to_numpy() for c in ("block", "band", "key")]
    order = np.lexsort(columns)
    new = np.zeros(max(0, len(order) - 1), dtype=bool)
    for c in columns:
        new |= np.diff(c[order]) != 0
    yield from np.split(order, np.flatnonzero(new) + 1) if len(order) else []


def _pairs(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _home_tiles(rows: pa.Table, num: int, den: int) -> pa.Table:
    """Spanning links of tiles whose sets are at hand: each pair is compared, linked already, or out of bounds."""
    nodes, own_all, raw = rows["node"].to_numpy(), rows["own"].to_numpy(), rows["members"]
    left, right = [], []
    for tile in _tiles(rows):
        tile = tile[np.unique(nodes[tile], return_index=True)[1]]
        sets = [np.frombuffer(raw[int(i)].as_py(), dtype="<u8") for i in tile]
        own, sizes = own_all[tile], np.asarray([len(s) for s in sets])
        maps, root = _fold([bitmap(s) for s in sets]), np.arange(len(sets))
        for i in range(len(sets) - 1):
            others = np.arange(i + 1, len(sets))
            others = others[(root[others] != root[i]) & (own[others] | own[i])]
            if len(others):
                others = _may_link(i, others, maps, sizes, num, den)
            if len(others):
                for j in others[_linked(sets[i], [sets[o] for o in others], num, den)]:
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        left.append(nodes[tile[i]])
                        right.append(nodes[tile[j]])
    return _pairs(left, right)


def _cross_tiles(rows: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of different classes that the bounds leave. ``at_home``: outside the main class and in its own block."""
    nodes, classes, own, sizes, most, main, home = (
        rows[c].to_numpy() for c in ("node", "class", "own", "n", "most", "main", "at_home"))
    bits, left, right = rows["bits"], [], []
    for tile in _tiles(rows):
        n = sizes[tile]
        maps = None
        for i in np.flatnonzero(~main[tile]):
            # An outsider meets the block's rows of the main class, and in its own block the outsiders after it.
            x = tile[i]
            meets = (classes[tile] != classes[x]) & (own[tile] | own[x]) & (main[tile] | ((nodes[tile] > nodes[x]) & home[x]))
            others = np.flatnonzero(meets & (n <= most[x]) & (n[i] <= most[tile]))
            if len(others):
                if maps is None:
                    maps = _fold([np.frombuffer(bits[int(t)].as_py(), dtype="<u8") for t in tile])
                others = nodes[tile[_may_link(i, others, maps, n, num, den)]]
                left.extend(np.minimum(nodes[x], others))
                right.extend(np.maximum(nodes[x], others))
    found = np.unique(np.asarray([left, right], dtype="i8"), axis=1)
    return _pairs(found[0], found[1])


def _slotted(tiles: DataFrame, total: int | None, room: int) -> DataFrame:
    """Tiles dealt at random into slots of about ``room`` of ``total``: a task call works through many small tiles."""
    slots = max(1, -(-(total or 0) // room))
    return tiles.withColumn("slot", F.pmod(F.xxhash64("key", "band", "block"), F.lit(slots)))


def _banded(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Every row in the tile of its size band and, as the smaller partner, in the next (``own`` false)."""
    # A little wider than the ratio of sizes that can link, so that rounding parts no pair by two bands.
    width = math.log(den / num) * (1 + 1e-9) + 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    return rows.withColumn("tile", F.explode(both)).select("*", "tile.band", "tile.own").drop("tile")


def _merged(tiles: DataFrame) -> DataFrame:
    """``key, band, own, node, n, class, most``: tiles of the same rows, met under several keys, as one.

    Its key is a digest of its rows and each row has its largest reach, so no pair of any key is lost; tiles that
    fall on one digest by chance become one larger tile.
    """
    same = F.bit_xor(F.xxhash64("node", "own")).over(Window.partitionBy("key", "band"))
    return (tiles.withColumn("same", same).groupBy(F.col("same").alias("key"), "band", "own", "node", "n", "class")
            .agg(F.max("most").alias("most")))


def links(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: ``doc_id, n, node`` per row of ``docs``, and ``node, component`` of linked nodes.

    A node is a distinct set; node is null for empty sets. ``num / den`` is the least similarity. ``classes``
    holds every node with a link, its component being its smallest node.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def narrow(part: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), part.column("row")], ["doc_id", "n", "node", "row"])

    rows = staged(_map_sets(words.withColumn("row", F.xxhash64("text")), k, "doc_id long, n long, node long, row long", narrow), "sets")
    counts = docs.sparkSession.sparkContext.broadcast(sketch(words, k))

    def keys(part: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        done, found, owner, size = set(), [], [], []
        for members in sets:
            node = _node(members)
            if not len(members) or node in done:
                continue
            done.add(node)
            p = prefix_size(len(members), num, den)
            found.append(members[np.argsort(counts.value[(members % np.uint64(SKETCH)).astype("i8")], kind="stable")[:p]])
            owner.append(np.full(p, node, dtype="i8"))
            size.append((len(members) << 32) + np.arange(p))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view("i8")), pa.array(np.concatenate(owner)), pa.array(np.concatenate(size))],
                ["key", "node", "place"])

    # The first key that a linked pair has in common stands so early in both that what follows can still hold the
    # overlap: a set of n members with the key at position p meets sets of up to ``most`` members there. A row stays
    # if some smaller set reaches up to it, or the next larger one is within its own reach.
    by_size = Window.partitionBy("key").orderBy("n", "node")
    met = (
        _map_sets(words, k, "key long, node long, place long", keys)
        .select("key", "node", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))
        .withColumn("last", F.lag("node").over(by_size)).where("last is null or last <> node")
        .withColumn("most", F.expr(f"((n - pos) * {num + den}L) div {num}L - n"))
        .withColumn("reach", F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("next", F.lead("n").over(by_size)).where("reach >= n or next <= most")
        .select("key", "node", "n", "most")
        .withColumn("shared", F.count("*").over(Window.partitionBy("key"))).where("shared > 1"))
    met = staged(met, "keys")

    # A set's home is the key that it shares with the most others.
    home = staged(met.groupBy("node").agg(F.max_by("key", F.struct("shared", "key")).alias("key"), F.first("n").alias("n")), "homes")
    # Home tiles, blocks by hash where a tile is large. A set is in one tile or, as a smaller partner, in two.
    tiles = _banded(home, num, den)
    weight = tiles.groupBy("key", "band").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(TILE_SETS), F.sum("n") / F.lit(TILE_MEMBERS))).cast("int").alias("blocks"),
        F.count("*").alias("many"), F.max("own").alias("owned"))
    tiles = (tiles.join(weight.where("many > 1 and owned"), ["key", "band"])
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("key", "band", "own", "node", "block"))
    tiles = _slotted(tiles, home.agg(F.sum("n")).first()[0], SLOT_MEMBERS)
    tiles = tiles.groupBy("node").agg(F.collect_list(F.struct("slot", "key", "band", "own", "block")).alias("tiles"))
    chosen = (rows.where("node is not null").select("node", "doc_id", "row")
              .join(home.select("node"), "node", "left_semi")
              .groupBy("node").agg(F.min(F.struct("row", "doc_id")).alias("r"))
              .join(tiles, "node", "left")
              .select(F.col("r.row").alias("row"), F.coalesce("r.doc_id", F.lit(-1)).alias("id"), "tiles"))

    def carry(part: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
             pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), part.column("tiles")], ["node", "members", "bits", "tiles"])

    chosen = staged(chosen, "chosen")
    texts = words.select("text", F.xxhash64("text").alias("row"), F.coalesce("doc_id", F.lit(-1)).alias("id"))
    texts = _sieved(texts, "row", chosen.select("row"))
    held = staged(_map_sets(
        texts.join(chosen, ["row", "id"]).select("text", "tiles"), k,
        f"node long, members binary, bits binary, tiles {chosen.schema['tiles'].dataType.simpleString()}", carry), "members")

    # First round: each set comes to its home tile with its members.
    first = staged(
        held.select("node", "members", F.explode("tiles").alias("tile")).select("node", "members", "tile.*")
        .groupBy("slot").applyInArrow(lambda t: _home_tiles(t, num, den), "a long, b long"), "links")
    classes = components(first, "classes")

    # Second round: pairs of different classes that share any key; tiles of one class are dropped unread.
    cross = (met.join(classes.withColumnRenamed("component", "class"), "node", "left")
             .withColumn("class", F.coalesce("class", "node")))
    cross = _banded(cross, num, den)
    by_tile = Window.partitionBy("key", "band")
    cross = staged(_merged(cross.withColumn("low", F.min("class").over(by_tile)).withColumn("high", F.max("class").over(by_tile))
                           .withColumn("owned", F.max("own").over(by_tile)).where("low <> high and owned")), "tiles")
    rows_crossing = cross.count()
    parts = cross.groupBy("key", "band", "class").agg(F.count("*").alias("c")).groupBy("key", "band").agg(
        F.max_by("class", "c").alias("largest"), F.ceil(F.sum("c") / F.lit(BLOCK_SETS)).cast("int").alias("blocks"))
    cross = (cross.join(parts, ["key", "band"]).withColumn("main", F.col("class") == F.col("largest"))
             .withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("block", F.explode(F.when(F.col("main"), F.array("at")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
             .withColumn("at_home", F.col("block") == F.col("at")))
    cross = cross.select("key", "band", "block", "node", "n", "most", "class", "own", "main", "at_home")
    pairs = staged(
        _slotted(cross, rows_crossing, SLOT_SETS).join(held.select("node", "bits"), "node")
        .groupBy("slot").applyInArrow(lambda t: _cross_tiles(t, num, den), "a long, b long").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [bool(_linked(np.frombuffer(x, dtype="<u8"), [np.frombuffer(y, dtype="<u8")], num, den)[0])
                    for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = _sieved(held.select("node", "members"), "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    second = (pairs.join(one.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
              .join(one.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
              .select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))
    return rows, components(first.unionByName(second), "classes")


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, n, row, first`` per row of ``docs``: ``first`` is the ``(none, doc_id, row)`` that leads its group.

    ``row`` is a hash of the text. Groups are connected by links; the smallest id leads, null ids come last.
    A text without words (or null) has no set and leads itself.
    """
    rows, classes = links(docs, k, num, den)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    rows = rows.withColumn("self", key)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("self").alias("least"), F.count("*").alias("size"))
    named = staged(nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    leaders = named.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("members"))
    # Only nodes of more than one row, or with links, need a leader other than the row itself.
    named = named.join(leaders, "component").where("size > 1 or members > 1").select("node", "first", "size")
    out = attach(rows.where("node is not null"), named, "node", "size").select("doc_id", "n", "row", F.coalesce("first", "self").alias("first"))
    return out.unionByName(rows.where("node is null").select("doc_id", "n", "row", F.col("self").alias("first")))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the size of its set and the smallest id it reaches by links.

    Equal sets are linked. Texts without words, and null texts, are linked with nothing. Null ids take part; they name
    a group only if it has no other. Rows that repeat an id each get the answer of their own text.
    """
    return grouped(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that lead their groups, with all their columns (rows equal in id and text stay together)."""
    lost = (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row") == F.col("row")))
    gone = staged(grouped(docs, k, num, den).where(~lost).select(
        F.col("doc_id").alias("__gone"), F.col("row").alias("__row")).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__row"))
    return docs.join(gone, same, "left_anti")
