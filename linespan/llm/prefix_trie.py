"""Operator 11: the trie of rebuilt conversations, summed up by time-forward processing.

A turn is its md5 (of role and text) and its number of code points, so texts are read once and never
shuffled.  Turns are numbered, conversations rebuilt, and every rebuilt prefix gets a 128-bit hash: the exclusive or
of the hashes of (depth, turn) over its turns, a running value that is kept by ranges of rows and carried
over them, so one conversation may lie in many tasks.  Prefixes of equal depth and hash are one node,
counted by a grouping that Spark combines before it shuffles.

A node is named by its smallest member and its depth; its parent's name is smaller in that order.  Totals of
subtrees are passed up by time-forward processing: nodes lie in shards, ranges of names; in
a shard they are sorted by Spark in reverse level order, each takes from a priority queue what its children sent and
sends its total to its parent through the queue, which spills sorted runs to local disk.  A node whose parent
is in another shard is the root of its component; these roots form a tree of components.  Components below which
nothing hangs are added to their parents by a grouping; the rest is a smaller tree of the same form,
dealt with in the same way, and in one task once it has at most FEW components (or doesn't become smaller;
the queue spills, so its memory is bounded).  Then the roots' totals are sent to the shards that they hang from, and a second
pass gives every node its total.

The digest of a node's ends needs them in one order: sorted ranges pack them to pieces of up to PIECE bytes and
one streaming task a node digests the pieces, holding one at a time.

Defined cases: rows without conv_id belong to no conversation; null roles and texts are empty; null turns come first,
turns of equal number in the order of md5(length of role in bytes ':' role text), repeated rows are turns of
their own; the remainder of a negative conv_id has its sign; a conversation that has fewer turns than it gives up is
turnless and ends at the root; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

GROUP, HEADS, FEW, IN_MEMORY, PIECE = 100, 6, 50_000, 1_000_000, 1 << 20
KEY = ["depth", "ha", "hb"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def running(rows: DataFrame, order: list, values: dict[str, Column], fold: Callable, both: Callable, scratch: Scratch, name: str) -> DataFrame:
    """rows with each value folded over the rows of its conv_id up to its own, in an order.

    Rows lie in ranges; a range folds its own rows and takes what the ranges before have of the same conversation.
    Those are at most one conversation a range."""
    ranged = rows.repartitionByRange("conv_id", *order).select("*", F.spark_partition_id().alias("range"), *[c.alias(f"of_{n}") for n, c in values.items()])
    ranged = scratch.keep(ranged, name)
    parts = ranged.groupBy("conv_id", "range").agg(*[fold(f"of_{n}").alias(f"all_{n}") for n in values])
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "range", *[fold(f"all_{n}").over(ahead).alias(f"before_{n}") for n in values], F.row_number().over(Window.partitionBy("conv_id").orderBy("range")).alias("range_no"))
    upto = Window.partitionBy("range", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({n: fold(f"of_{n}").over(upto) for n in values}).join(F.broadcast(parts.where("range_no > 1")), ["conv_id", "range"], "left")
    return out.select(*rows.columns, *[both(F.col(n), F.coalesce(f"before_{n}", F.lit(0))).cast("long").alias(n) for n in values])


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and its turns: conv_id, depth, key, size, last."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("size"))
    own = running(turns, [F.col("turn").asc_nulls_first(), F.col("key")], {"nth": F.lit(1)}, F.sum, lambda a, b: a + b, scratch, "turns").drop("turn")
    own = scratch.keep(own, "numbered")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = own.groupBy("conv_id").agg(F.max("nth").alias("turns")).withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    bases = convs.where("conv_id = base").select("base", F.col("turns").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = scratch.keep(convs.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")), "convs")
    rest = own.join(convs, "conv_id").where("nth > h").withColumn("depth", F.col("given") + F.col("nth") - F.col("h"))
    heads = own.where(f"nth < {HEADS} and conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), "nth", "key", "size")
    heads = convs.where("given > 0").join(heads, "base").where("nth <= given").withColumn("depth", F.col("nth"))
    columns = ["conv_id", "depth", "key", "size", (F.col("depth") == F.col("length")).alias("last")]
    return convs.select("conv_id", "length"), rest.select(*columns).unionByName(heads.select(*columns))


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, size, last, the prefix's hash (ha, hb) and its parent's (pa, pb)."""
    one = {"ha": F.xxhash64("depth", "key"), "hb": F.xxhash64(F.lit("second"), "key", "depth")}
    out = running(turns.withColumns({f"t{n[1]}": c for n, c in one.items()}), ["depth"], {"ha": F.col("ta"), "hb": F.col("tb")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b), scratch, "rebuilt")
    return out.select("conv_id", "depth", "size", "last", "ha", "hb", F.col("ha").bitwiseXOR(F.col("ta")).alias("pa"), F.col("hb").bitwiseXOR(F.col("tb")).alias("pb"))


class SpillingQueue:
    """A priority queue of (order, conv_id, leaves, saved); what exceeds `most` items goes to sorted runs on disk."""

    ROW = struct.Struct("<4q")

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.heap, self.runs, self.fronts = max(2, most), [], [], []

    def __len__(self) -> int:
        return len(self.heap) + len(self.fronts)

    def push(self, item: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            later = self.heap[self.most // 2 :]
            del self.heap[self.most // 2 :]
            file = tempfile.TemporaryFile()
            file.writelines(self.ROW.pack(*x) for x in later)
            file.seek(0)
            self.runs.append(self._read(file))
            self._front(len(self.runs) - 1)

    def _read(self, file) -> Iterator[tuple[int, int, int, int]]:
        with file:
            while block := file.read(self.ROW.size * 4096):
                yield from self.ROW.iter_unpack(block)

    def _front(self, run: int) -> None:
        if (item := next(self.runs[run], None)) is not None:
            heapq.heappush(self.fronts, (item, run))

    def take(self, order: int, conv: int) -> tuple[int, int]:
        """The sums of what was sent to (order, conv)."""
        leaves = saved = 0
        while self.heap and self.heap[0][:2] == (order, conv):
            _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.fronts and self.fronts[0][0][:2] == (order, conv):
            (_, _, a, b), run = heapq.heappop(self.fronts)
            self._front(run)
            leaves, saved = leaves + a, saved + b
        return leaves, saved


_SUMS = "conv_id bigint, depth bigint, leaves bigint, saved bigint"
_TOPS = "conv_id bigint, depth bigint, p_conv bigint, p_depth bigint, p_shard int, leaves bigint, saved bigint"


def _batches(rows: Iterator[tuple], schema: str, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    some: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    for r in rows:
        some.append(r)
        if len(some) == size:
            yield out()
            some = []
    yield out()


def _forward(rows: DataFrame, firsts: list[tuple[int, int]], tops: bool) -> DataFrame:
    """Time-forward processing of every shard of rows (shard, depth, conv_id, p_conv, p_depth, leaves, saved, sent).

    A row with `sent` is a total that comes from another shard.  tops: the components' roots and where they hang; else all nodes' totals."""
    shared, most = rows.sparkSession.sparkContext.broadcast(firsts), IN_MEMORY

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first, queue = shared.value, SpillingQueue(most)
        for batch in batches:
            for shard, depth, conv, p_conv, p_depth, leaves, saved, sent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sent:
                    queue.push((-depth, conv, leaves, saved))
                    continue
                a, b = queue.take(-depth, conv)
                leaves, saved = leaves + a, saved + b
                inside = p_conv is not None and (p_conv, p_depth) >= first[shard]
                if inside:
                    queue.push((-p_depth, p_conv, leaves, saved))
                if not tops:
                    yield conv, depth, leaves, saved
                elif not inside:
                    yield conv, depth, p_conv, p_depth, None if p_conv is None else bisect_right(first, (p_conv, p_depth)) - 1, leaves, saved

    columns = ["shard", "depth", "conv_id", "p_conv", "p_depth", "leaves", "saved", "sent"]
    sorted_ = rows.select(*columns).repartitionById(len(firsts), F.col("shard")).sortWithinPartitions("shard", F.col("depth").desc(), "conv_id", F.col("sent").desc())
    schema = _TOPS if tops else _SUMS
    return sorted_.mapInArrow(lambda batches: _batches(totals(batches), schema), schema)


def _components(sharded: DataFrame, firsts: list[tuple[int, int]]) -> DataFrame:
    """(shard, conv_id, c_conv, c_depth): the component's root of a shard's nodes of one smallest member.

    Such nodes follow each other in depth, so they are in one component, that of the first one's parent."""
    shared = sharded.sparkSession.sparkContext.broadcast(firsts)
    schema = "shard int, conv_id bigint, c_conv bigint, c_depth bigint"

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first, now, of = shared.value, None, {}
        for batch in batches:
            for shard, conv, depth, p_conv, p_depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    now, of = shard, {}  # as large as a shard's number of paths
                inside = p_conv is not None and (p_conv, p_depth) >= first[shard]
                of[conv] = of[p_conv] if inside else (conv, depth)
                yield shard, conv, *of[conv]

    top = F.min_by(F.struct("depth", "p_conv", "p_depth"), "depth").alias("t")
    paths = sharded.groupBy("shard", "conv_id").agg(top).select("shard", "conv_id", "t.*")
    paths = paths.repartitionById(len(firsts), F.col("shard")).sortWithinPartitions("shard", "conv_id")
    return paths.mapInArrow(lambda batches: _batches(roots(batches), schema), schema)


def subtree_sums(nodes: DataFrame, scratch: Scratch, name: str = "sums", few: int = FEW) -> DataFrame:
    """conv_id, depth and the sums of leaves and saved over the subtree of every node
    (conv_id, depth, p_conv, p_depth, leaves, saved); a node's parent has the smaller depth and no larger conv_id."""
    own = ["conv_id", "depth", "p_conv", "p_depth", "leaves", "saved"]
    sharded = scratch.keep(nodes.select(*own).repartitionByRange("conv_id", "depth").withColumn("part", F.spark_partition_id()), f"{name}-nodes")
    found = sharded.groupBy("part").agg(F.min(F.struct("conv_id", "depth")).alias("first")).orderBy("part").collect()  # a row a range
    if not found:
        return nodes.select("conv_id", "depth", "leaves", "saved")
    firsts = [tuple(r["first"]) for r in found]
    numbers = F.broadcast(sharded.sparkSession.createDataFrame([(r["part"], k) for k, r in enumerate(found)], "part int, shard int"))
    sharded = sharded.join(numbers, "part").withColumn("sent", F.lit(False))
    if len(firsts) == 1:
        return _forward(sharded, firsts, tops=False)
    tops = scratch.keep(_forward(sharded, firsts, tops=True), f"{name}-tops")
    parts = _components(sharded, firsts).select(F.col("shard").alias("p_shard"), F.col("conv_id").alias("p_conv"), "c_conv", "c_depth")
    tops = scratch.keep(tops.join(parts, ["p_shard", "p_conv"], "left"), f"{name}-hung")
    inner = tops.where("c_conv is not null").select(F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth")).distinct()
    ends, inner = tops.join(inner, ["conv_id", "depth"], "left_anti"), tops.join(inner, ["conv_id", "depth"], "left_semi")
    added = ends.where("c_conv is not null").groupBy("c_conv", "c_depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    with_ends = inner.join(added.select(F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth"), "l", "s"), ["conv_id", "depth"], "left")
    tree = with_ends.select(
        "conv_id", "depth", F.col("c_conv").alias("p_conv"), F.col("c_depth").alias("p_depth"), *[(F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("leaves", "l"), ("saved", "s"))]
    )
    tree = scratch.keep(tree, f"{name}-tree")
    size = tree.count()
    if size <= few or 2 * size > nodes.count():
        top = tree.agg(F.min(F.struct("conv_id", "depth"))).first()[0]
        done = _forward(tree.withColumns({"shard": F.lit(0), "sent": F.lit(False)}), [tuple(top)], tops=False) if top else tree
    else:
        done = subtree_sums(tree, scratch, f"{name}+", few)
    sums = done.select("conv_id", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    hung = inner.join(sums, ["conv_id", "depth"]).select("p_shard", "p_conv", "p_depth", F.col("l").alias("leaves"), F.col("s").alias("saved"))
    hung = hung.unionByName(ends.select("p_shard", "p_conv", "p_depth", "leaves", "saved")).where("p_shard is not null")
    sent = hung.groupBy(F.col("p_shard").alias("shard"), F.col("p_conv").alias("conv_id"), F.col("p_depth").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sent = sent.withColumns({"p_conv": F.lit(None).cast("long"), "p_depth": F.lit(None).cast("long"), "sent": F.lit(True)})
    return _forward(sharded.drop("part").unionByName(sent), firsts, tops=False)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined, ascending conv_ids of each key (depth, ha, hb)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, some, size, out = None, 0, [], 0, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(4)), pa.array([r[4] for r in out], pa.string())], [*KEY, "first", "ids"])

        held = 0
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key or size >= PIECE:
                    if some:
                        out.append((*key, first, ",".join(some)))
                        held += size
                    key, first, some, size = now, conv, [], 0
                    if len(out) >= 10_000 or held >= 4 * PIECE:
                        yield batch_of()
                        out, held = [], 0
                some.append(str(conv))
                size += len(some[-1]) + 1
        if some:
            out.append((*key, first, ",".join(some)))
        yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            for *now, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(ids.encode())
                    if len(out) >= 10_000:
                        yield batch_of()
                        out = []
                else:
                    sha.update(b"," + ids.encode())
        if key is not None:
            out.append((*key, sha.hexdigest()))
        yield batch_of()

    order = [*KEY, "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "depth bigint, ha bigint, hb bigint, first bigint, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth bigint, ha bigint, hb bigint, ends_sha256 string")


def trie(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations, scratch)
    paths = scratch.keep(prefixes(turns, scratch), "prefixes")
    scratch.drop("turns", "numbered", "rebuilt")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = scratch.keep(nodes, "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb")]
    children = nodes.select(*parent).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("p_conv"))
    linked = nodes.join(children, KEY, "left").join(above, ["depth", "pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    linked = scratch.keep(linked.drop("pa", "pb"), "linked")
    leaf = (F.col("n_children") == 0).cast("long").alias("leaves")
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    sums = subtree_sums(linked.select("conv_id", "depth", "p_conv", F.when(F.col("p_conv").isNotNull(), F.col("depth") - 1).alias("p_depth"), leaf, saved), scratch)
    sums = scratch.keep(sums.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "totals")
    zero = {n: F.lit(0).cast("long") for n in KEY}
    turnless = convs.where("length = 0").select("conv_id", *[c.alias(n) for n, c in zero.items()])
    digests = end_digests(paths.where("last").select(*KEY, "conv_id").unionByName(turnless))
    # The root is every conversation's; the nodes of depth 1 hang from it.
    smallest, n_convs = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not n_convs:
        return linked.sparkSession.createDataFrame([], NODE)
    n_children, n_leaves, saved_tokens = sums.where("depth = 1").agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    one = (smallest, 0, 0, 0, None, n_convs, n_children, n_leaves or 1, saved_tokens or 0)
    root = linked.sparkSession.createDataFrame([one], "conv_id long, depth long, ha long, hb long, p_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    low = F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).otherwise(F.col("p_conv"))
    every = linked.join(sums, ["conv_id", "depth"]).withColumn("p_conv", low).drop("size").unionByName(root)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(digests, KEY, "left").select(
        "conv_id", "depth", F.col("p_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), Scratch(spark, "op11"))
