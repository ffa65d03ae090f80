"""The trie of conversation prefixes, by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.base import ship, staged

#: Bytes of a turn's digest; a conversation's key is the digests of its turns, so keys sort and share prefixes as turns do.
WIDTH = 16
#: Bytes of keys that one sorted part holds at most, about.
PART_BYTES = 8 << 20
#: Members whose ids are written in one piece.
PIECE = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
TURN_ORDER = "turn", "digest"

NODE = (
    "part long, depth int, node binary, above binary, open boolean, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long, ends binary, place long, ends_sha256 string")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, key, sizes`` per conversation of ``turns(conv_id, turn, role, text)``.

    Turns go in order of ``turn``, null first, equal ones by their digest. ``key`` is the digests (16 bytes) of role and
    text of all turns, ``sizes`` the code points of their texts (little-endian 32-bit); null role or text counts as
    empty. Rows without ``conv_id`` belong to no conversation. Only digests are shuffled, sorted by Spark and joined as
    they stream by: 20 bytes a turn of the longest conversation are what a task must hold.
    """
    ship(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(named, 256), 1, 2 * WIDTH)).alias("digest"), F.length(text).alias("size"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, keys: list, sizes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.binary())], ["conv_id", "key", "sizes"])

        last, key, size = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("conv_id").to_numpy()
            digests = b"".join(batch.column("digest").to_pylist())
            sizes = batch.column("size").to_numpy().astype("<i4").tobytes()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            done = [], [], []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if last is not None and ids[start] != last:
                    for out, value in zip(done, (last, b"".join(key), b"".join(size))):
                        out.append(value)
                    key, size = [], []
                last = int(ids[start])
                key.append(digests[WIDTH * start:WIDTH * end])
                size.append(sizes[4 * start:4 * end])
            yield made(*done)
        if last is not None:
            yield made([last], [b"".join(key)], [b"".join(size)])

    return rows.mapInArrow(run, "conv_id long, key binary, sizes binary")


def rebuilt(found: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``found`` (of ``sequences``) with the first ``h`` turns of each conversation replaced by those of the conversation
    ``conv_id - conv_id % every``: all it has if fewer, none if it is absent; ``h`` is the crc32 of the id's digits modulo
    ``most``; the remainder has the sign of the id. At most ``every`` conversations share a head, and only ``most - 1`` turns of it move."""
    found = staged(found, "sequences")
    heads = found.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("key", 1, WIDTH * (most - 1)).alias("head_key"),
        F.substring("sizes", 1, 4 * (most - 1)).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = found.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")

    def headed(column: str, width: int):
        head = F.coalesce(F.substring(F.col(f"head_{column}"), F.lit(1), F.col("h") * width), F.lit(b""))
        # Byte counts fit an int; what lies behind the end is empty.
        return F.concat(head, F.substring(F.col(column), F.col("h") * width + 1, F.length(column))).alias(column)

    return joined.select("conv_id", headed("key", WIDTH), headed("sizes", 4))


def common(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    if a[:n] == b[:n]:
        return n // WIDTH
    left, right = np.frombuffer(a, "u1", n), np.frombuffer(b, "u1", n)
    return int(np.argmax(left != right)) // WIDTH


def spine(key: bytes) -> list[bytes]:
    """The names of a conversation's nodes from the root on: each is a digest of the one above and the turn."""
    out = [b"\0" * WIDTH]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at:at + WIDTH], digest_size=WIDTH).digest())
    return out


class Forest:
    """The trie of one sorted part. Nodes that hold its first or last conversation stay open: neighbours may share them.

    All numbers of a node are sums over its conversations and over the edges between sorted neighbours among them, so
    open nodes of different parts add up once each part has counted its own edges and the one to the part before.
    """

    def __init__(self, part: int, ids: list[int], keys: list[bytes], sizes: list[bytes], before: int, after: int):
        """``before`` and ``after``: turns shared with the part before and behind; -1 where there is none."""
        n = len(ids)
        self.part, self.ids, self.before = part, ids, before
        self.lengths = [len(k) // WIDTH for k in keys]
        #: Code points of the first d texts; place d + 1 holds those of d turns, place 0 stands above the root.
        self.totals = [np.concatenate([[0, 0], np.cumsum(np.frombuffer(s, "<i4"), dtype="i8")]) for s in sizes]
        shared = [common(keys[i - 1], keys[i]) for i in range(1, n)]
        following = [*shared, after]
        self.spines = spine(keys[0]), spine(keys[-1])
        # Per component, kept at its first row: last row, depth of its node, children, leaves, code points over its edges, nodes that wait for it.
        self.parent, self.last, self.depth = list(range(n)), list(range(n)), list(self.lengths)
        self.children, self.points = [0] * n, [0] * n
        self.leaves = [int(following[i] < self.lengths[i]) for i in range(n)]
        self.least, self.waiting = list(ids), [[] for _ in range(n)]
        self.rows: list[tuple] = []
        self.pieces: list[tuple] = []
        order = sorted(range(n - 1), key=shared.__getitem__, reverse=True)
        for edge in order:
            self.merge(edge, edge + 1, shared[edge])
        self.chain(self.find(0), -1)

    def find(self, row: int) -> int:
        while self.parent[row] != row:
            self.parent[row] = self.parent[self.parent[row]]
            row = self.parent[row]
        return row

    def merge(self, left: int, right: int, depth: int) -> None:
        """Joins two neighbouring components at the node they share at ``depth``. Edges come by falling depth, so a
        component whose node lies deeper is whole below it: its nodes down from there are written."""
        left, right = self.find(left), self.find(right)
        waiting = []
        for root in (left, right):
            if self.depth[root] > depth:
                self.waiting[root] = [self.chain(root, depth)]
                self.children[root] = 1
            waiting.append(self.waiting[root])
        few, many = sorted(waiting, key=len)
        many.extend(few)
        self.points[left] += self.points[right] + int(self.totals[right][depth + 1])
        self.parent[right], self.last[left], self.depth[left] = left, self.last[right], depth
        self.children[left] += self.children[right]
        self.leaves[left] += self.leaves[right]
        self.least[left] = min(self.least[left], self.least[right])
        self.waiting[left], self.waiting[right] = many, []

    def chain(self, root: int, above: int) -> int:
        """Writes the nodes of a component from its own depth up to ``above + 1``; the number of the highest one's row."""
        first, last, depth = root, self.last[root], self.depth[root]
        number = len(self.rows)
        ended = first
        while ended <= last and self.lengths[ended] == depth:
            ended += 1
        for kid in self.waiting[root]:
            self.rows[kid] = (*self.rows[kid][:2], self.least[root], (first, last), *self.rows[kid][4:])
        totals, n = self.totals[root], last - first + 1
        for d in range(depth, above, -1):
            inner = d == depth
            # The row: component, depth, parent's smallest member and component (the same below the top of a chain), then sums.
            points = self.points[root] - (n - 1) * int(totals[d])
            children = self.children[root] if inner else 1
            if first == 0 and self.before >= d:
                points += int(totals[self.before + 1] - totals[d])
                children -= self.before > d
            self.rows.append(((first, last), d, self.least[root] if d - 1 > above else None, (first, last), self.least[root], n, children,
                              self.leaves[root], points, (first, ended) if inner and ended > first else None))
        return len(self.rows) - 1

    def table(self) -> pa.Table:
        """The rows of ``NODE``: nodes that lie within the part are whole, of open ones the part's share."""
        end = len(self.ids) - 1
        out: list[list] = [[] for _ in range(14)]

        def named(span: tuple[int, int], depth: int) -> bytes | None:
            """The name of a node that holds the first or last row."""
            return self.spines[0][depth] if span[0] == 0 else self.spines[1][depth] if span[1] == end else None

        def put(*values) -> None:
            for column, value in zip(out, values, strict=True):
                column.append(value)

        for span, depth, parent, parent_span, least, n, children, leaves, points, ends in self.rows:
            is_open = span[0] == 0 or span[1] == end
            above = named(parent_span, depth - 1) if depth else None
            text = digest = None
            if ends and not is_open:
                digest = hashlib.sha256(",".join(map(str, self.ids[slice(*ends)])).encode()).hexdigest()
            put(self.part, depth, named(span, depth), above, is_open, least, parent if depth and above is None else None, n, children, leaves, points, text, 0,
                digest or NO_IDS)
            for start in range(*ends, PIECE) if ends and is_open else ():
                text = ",".join(map(str, self.ids[start:min(start + PIECE, ends[1])])).encode()
                put(self.part, depth, named(span, depth), None, True, None, None, None, None, None, None, text, start, None)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 6, pa.binary(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in NODE.split(", ")])


def prefix_trie(found: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``found(conv_id, key, sizes)``, the empty one (root) included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``; without conversations no rows. Equal conversations are members of
    the same nodes. Conversations are sorted by key and id in parts, so equal ones do not share a task; each part builds
    its forest alone, and only its open nodes, those of its two outermost conversations, meet others in a shuffle. The
    ids that end at an open node stream through one task in order, as a digest must read them so; no list of them is built.
    """
    spark = found.sparkSession
    ship(spark)
    found = staged(found, "rebuilt")
    total = found.agg(F.sum(F.length("key") + 64)).first()[0]
    if total is None:
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], empty)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    dealt = staged(found.repartitionByRange(parts, "key", "conv_id").withColumn("part", F.spark_partition_id().cast("long")), "sorted")
    edges = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # One row per part; the driver gets a number for each.
    edges = edges.withColumn("before", F.lag("last").over(Window.orderBy("part")))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [-1 if b is None else common(b, f) for f, b in zip(batch.column("first").to_pylist(), batch.column("before").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(turns, pa.int32())], ["part", "turns"])

    meets = sorted((r.part, r.turns) for r in edges.mapInArrow(shared, "part long, turns int").collect())
    before = dict(meets)
    after = {part: turns for (part, _), (_, turns) in zip(meets, meets[1:])}

    def build(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        # Ids sort as numbers behind their keys, here as there.
        rows = rows.sort_by([("key", "ascending"), ("conv_id", "ascending")])
        return Forest(part, rows["conv_id"].to_pylist(), rows["key"].to_pylist(), rows["sizes"].to_pylist(), before[part], after.get(part, -1)).table()

    nodes = staged(dealt.groupBy("part").applyInArrow(build, NODE), "nodes")
    sums = ("n_convs", "n_children", "n_leaves", "saved")
    shares = nodes.where("open and ends is null")
    whole = staged(shares.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), *(F.sum(c).alias(c) for c in sums)), "open")
    names = whole.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("conv_id").alias("parent"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(depth: int, node: bytes, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([depth], pa.int32()), pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["depth", "node", "digest"])

        last, state = None, None
        for batch in batches:
            for depth, node, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ends"))):
                if (depth, node) == last:
                    state.update(b"," + text)
                    continue
                if last is not None:
                    yield made(*last, state)
                last, state = (depth, node), hashlib.sha256(text)
        if last is not None:
            yield made(*last, state)

    written = nodes.where("ends is not null").select("depth", "node", "part", "place", "ends")
    written = written.repartition("depth", "node").sortWithinPartitions("depth", "node", "part", "place").select("depth", "node", "ends")
    digest = written.mapInArrow(digests, "depth int, node binary, digest string")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    shared_nodes = whole.join(names, ["depth", "above"], "left").join(digest, ["depth", "node"], "left").select(
        *(F.col("parent").alias(c) if c == "parent_conv_id" else F.coalesce("digest", F.lit(NO_IDS)).alias(c) if c == "ends_sha256" else c for c in columns))
    # A closed node under an open one takes its parent's member from the open nodes of its own part, so no key is hot.
    closed = nodes.where("not open")
    local = shares.select("part", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above")).join(names, ["depth", "above"])
    under = closed.where("above is not null").drop("parent_conv_id").join(local.withColumnRenamed("parent", "parent_conv_id"), ["part", "depth", "above"])
    out = closed.where("above is null").select(*columns).unionByName(under.select(*columns)).unionByName(shared_nodes.select(*columns))
    return out.select(F.col("conv_id"), F.col("depth").cast("long").alias("depth"), *columns[2:6], F.col("saved").alias("saved_tokens"), "ends_sha256")
