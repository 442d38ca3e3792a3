"""The prefix trie of conversations, by burst tries.

A conversation is its turns in order; each distinct sequence of its first d turns is a node of depth d, and the
conversations that begin with it are the node's members.

A turn is written as RECORD bytes: a 128-bit digest of role and text, and the length of the text. Turns are sorted
across the cluster by conversation and place, so that no conversation has to fit into one task, and cut into blocks
of BLOCK turns; equal blocks behind equal beginnings are one row with the number of its conversations. What stands
behind one beginning of a multiple of BLOCK turns is a trie of its own, and the beginnings are joined to the
blocks behind them.

Burst tries: the suffixes below one head of the trie are a container. A container with more than CONTAINER_ROWS
rows bursts: what all its suffixes share becomes nodes of the head, and the suffixes are dealt by their next turn
into new containers below it, until none is too large. The remaining containers are sorted, and a sweep with a
stack of the open nodes turns each into nodes. The totals of each container (children, leaves, tokens saved) are
then added up along the heads, last burst first.

Members are never gathered: the conversations that end at a node are sorted across the cluster and written in
pieces, and their digest reads the pieces in order.

Defined results: turns come by ``turn``, null first, equal ones by the digest of role and text; null role or text
is empty; rows with a null conv_id belong to no conversation and are left out; repeated rows are turns like any
other; a text may have 2^31 bytes; conversations without turns end at the root; an empty table gives no node, not
even a root. Only the four columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tallyweave.llm.joins import join_counted
from tallyweave.session import configure, settle

RECORD = 20
#: Turns of one block, rows of a container that are swept, and bytes of them.
BLOCK = 4_096
CONTAINER_ROWS = 4_096
CONTAINER_BYTES = 32 << 20
#: Conversations of one piece of a list of members.
PIECE_IDS = 2_000

_OUT = (
    "cid string, parent string, is_total boolean, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, end_id string"
)


def turn_record(role: Column, text: Column) -> Column:
    """A turn as RECORD bytes; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def _turns(data: Column) -> Column:
    return (F.octet_length(data) / RECORD).cast("long")


def cut(data: Column, first: Column, count: Column | None = None) -> Column:
    """Turns of a sequence from ``first``, counted from 0."""
    size = F.octet_length(data) if count is None else count * RECORD
    return F.substring(data, (first * RECORD + 1).cast("int"), size.cast("int"))


def join_strings(parts: Column) -> Column:
    """One sequence of an array of (start, data)."""
    ordered = F.sort_array(parts)
    many = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["data"])), ""))
    return F.when(F.size(parts) == 1, ordered[0]["data"]).otherwise(many)


def _strings(batches):
    """Sorted turns as pieces: the turns of one conversation within one batch."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        data = b"".join(batch.column("record").to_pylist())
        offsets = np.concatenate([cuts, [len(ids)]]).astype(np.int32) * RECORD
        records = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        order = np.arange(number, number + len(cuts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[cuts], pa.int64()), pa.array(np.full(len(cuts), part), pa.int32()), pa.array(order, pa.int64()), records],
            ["conv_id", "part", "number", "data"],
        )
        number += len(cuts)


def ordered_pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, start, data): the turns of each conversation in order, as pieces that begin at turn ``start``.

    ``turns`` has conv_id, turn, role, text.
    """
    configure(turns.sparkSession)
    record = turn_record(F.col("role"), F.col("text")).alias("record")
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", record)
    keys = ["conv_id", "turn", "record"]
    ordered = settle(rows, "records").repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "record")
    pieces = settle(ordered.mapInArrow(_strings, "conv_id bigint, part int, number bigint, data binary"), "pieces")
    # a window over pieces, not over turns
    earlier = Window.partitionBy("conv_id").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("conv_id", F.coalesce(F.sum(_turns(F.col("data"))).over(earlier), F.lit(0)).alias("start"), "data")


def _blocks(pieces: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, data, cid, after, last): blocks with names of what stands before them, and with them."""
    end = F.col("start") + _turns(F.col("data"))
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest(F.col("start"), end - 1) / block))
    dealt = pieces.select("conv_id", "start", "data", end.alias("end"), F.explode(numbers).alias("block"))
    first, last = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    part = F.struct(first.alias("start"), cut(F.col("data"), first - F.col("start"), last - first).alias("data"))
    whole = dealt.groupBy("conv_id", "block").agg(join_strings(F.collect_list(part)).alias("data"))
    whole = whole.withColumns({f"h{i}": F.xxhash64(F.lit(i), "block", "data") for i in (1, 2)})
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = whole.withColumns({f"x{i}": F.coalesce(F.bit_xor(f"h{i}").over(before), F.lit(0)) for i in (1, 2)})

    def name(number: Column, x1: Column, x2: Column) -> Column:
        return F.md5(F.concat_ws(":", *[c.cast("string") for c in (number, x1, x2)]))

    return known.select(
        "conv_id", "block", "data", name(F.col("block"), F.col("x1"), F.col("x2")).alias("cid"),
        name(F.col("block") + 1, F.col("x1").bitwiseXOR(F.col("h1")), F.col("x2").bitwiseXOR(F.col("h2"))).alias("after"),
        F.lead("block").over(order).isNull().alias("last"),
    )


class _Nodes:
    """Rows of nodes and of containers' totals, given out as batches."""

    names = [x.split()[0] for x in _OUT.split(", ")]
    types = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]

    def __init__(self):
        self.rows = []

    def total(self, cid, parent, depth, children, leaves, saved):
        self.rows.append((cid, parent, True, depth, None, None, None, children, leaves, saved, None))

    def node(self, cid, depth, node, parent_conv):
        conv, n, children, leaves, saved, end_id = node
        self.rows.append((cid, None, False, depth, conv, parent_conv, n, children, leaves, saved, end_id))

    def batches(self, least: int):
        if len(self.rows) > least:
            columns = [pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), self.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, self.names)
            self.rows = []


class _Open:
    """A node whose members are still coming, with its children waiting for its smallest member."""

    __slots__ = ("record", "conv", "n", "children", "leaves", "saved", "end_id", "waiting")

    def __init__(self, record: bytes):
        self.record, self.conv, self.n, self.children, self.leaves, self.saved, self.end_id, self.waiting = record, None, 0, 0, 0, 0, None, []

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


def sweep(batches):
    """Sorted containers as nodes: a stack holds the nodes that the present suffix begins with."""
    out, stack, current = _Nodes(), [], None

    def close(down_to: int):
        cid, _, depth, _ = current
        while len(stack) > down_to:
            node, above = stack.pop(), stack[-1]
            for child in node.waiting:
                out.node(cid, depth + len(stack) + 1, child, node.conv)
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * int.from_bytes(node.record[16:], "big")
            above.waiting.append((node.conv, node.n, node.children, leaves, saved, node.end_id))
            above.add(node.n, node.conv)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved

    def end():
        close(1)
        cid, parent, depth, base_conv = current
        base = stack.pop()
        for child in base.waiting:
            out.node(cid, depth + 1, child, base_conv)
        out.total(cid, parent, depth, base.children, base.leaves, base.saved)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cid", "parent", "depth", "base_conv", "data", "n", "first", "end_id", "children", "leaves", "saved")]
        for cid, parent, depth, base_conv, data, n, first, end_id, children, leaves, saved in zip(*columns, strict=True):
            if current is None or cid != current[0]:
                if current is not None:
                    end()
                current, stack[:] = (cid, parent, depth, base_conv), [_Open(b"")]
            records = [data[k : k + RECORD] for k in range(0, len(data), RECORD)]
            shared = 0
            while shared < min(len(records), len(stack) - 1) and stack[shared + 1].record == records[shared]:
                shared += 1
            close(shared + 1)
            stack += [_Open(r) for r in records[shared:]]
            top = stack[-1]
            top.add(n, first)
            top.end_id = end_id
            top.children, top.leaves, top.saved = top.children + children, top.leaves + leaves, top.saved + saved
        yield from out.batches(10_000)
    if current is not None:
        end()
    yield from out.batches(0)


def _chains(batches):
    """Heads as nodes: what all suffixes of a burst container share, with the totals of what hangs below."""
    out = _Nodes()
    for batch in batches:
        names = ["cid", "parent", "depth", "base_conv", "common", "n", "first", "end_id", "children", "leaves", "saved"]
        for cid, parent, depth, base_conv, common, n, first, end_id, children, leaves, saved in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            length = len(common) // RECORD
            for j in range(length, 0, -1):
                leaves = leaves or 1
                saved += (n - 1) * int.from_bytes(common[j * RECORD - 4 : j * RECORD], "big")
                out.node(cid, depth + j, (first, n, children, leaves, saved, end_id), first if j > 1 else base_conv)
                children, end_id = 1, None
            out.total(cid, parent, depth, children, leaves, saved)
        yield from out.batches(10_000)
    yield from out.batches(0)


def _common(low, high):
    """The turns that the smallest and the largest suffix of a container, and so all of them, begin with."""
    k = 0
    while k < len(low) and low[k : k + RECORD] == high[k : k + RECORD]:
        k += RECORD
    return low[:k]


_MEMBER = ["cid", "parent", "depth", "base_conv", "data", "n", "first", "end_id", "children", "leaves", "saved"]


def _burst(live: DataFrame, container_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """The members of the containers that remain, and the heads of each round of bursts."""
    rest, heads = [], []
    while True:
        counts = live.groupBy("cid").agg(F.count("*").alias("rows"), F.sum(F.octet_length("data")).alias("size"))
        sized = settle(join_counted(live, settle(counts, "sizes"), ["cid"], "rows", live.count()), "sized")
        large = (F.col("rows") > 1) & ((F.col("rows") > container_rows) | (F.col("size") > CONTAINER_BYTES))
        rest.append(sized.filter(~large).select(*_MEMBER))
        inside = sized.filter(large)
        total = inside.count()
        if not total:
            return reduce(DataFrame.unionByName, rest), heads
        of = ["parent", "depth", "base_conv"]
        shared = inside.groupBy("cid").agg(
            F.min("data").alias("low"), F.max("data").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"),
            F.count("*").alias("rows"), *[F.first(c).alias(c) for c in of],
        )
        shared = settle(shared.withColumn("common", F.udf(_common, BinaryType())("low", "high")).drop("low", "high"), "shared")
        told = shared.select("cid", "rows", _turns(F.col("common")).alias("length"), F.col("first").alias("least"))
        met = settle(join_counted(inside.drop("rows", "size"), told, ["cid"], "rows", total), "met")
        whole = _turns(F.col("data")) == F.col("length")
        ended = met.filter(whole).select("cid", "end_id", "children", "leaves", "saved")
        heads.append(settle(shared.drop("rows").join(ended, "cid", "left"), "heads"))
        moved = met.filter(~whole).withColumns(
            {
                "parent": F.col("cid"),
                "cid": F.md5(F.concat_ws(":", "cid", F.hex(cut(F.col("data"), F.col("length"), F.lit(1))))),
                "depth": F.col("depth") + F.col("length"),
                "base_conv": F.when(F.col("length") > 0, F.col("least")).otherwise(F.col("base_conv")),
                "data": cut(F.col("data"), F.col("length")),
            }
        )
        live = settle(moved.select(*_MEMBER), "containers")


def _grown(members: DataFrame, container_rows: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals) of the containers of one level of blocks."""
    rest, heads = _burst(members, container_rows)
    out = settle(rest.repartition("cid").sortWithinPartitions("cid", "data").mapInArrow(sweep, _OUT), "swept")
    for head in reversed(heads):
        sums = out.filter("is_total").groupBy(F.col("parent").alias("cid")).agg(*[F.sum(a).alias(b) for a, b in zip(_SUMS, ("c", "l", "s"), strict=True)])
        added = {a: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) for a, b in (("children", "c"), ("leaves", "l"), ("saved", "s"))}
        below = head.join(sums, "cid", "left").withColumns(added)
        out = out.unionByName(settle(below.select("cid", "parent", "depth", "base_conv", "common", "n", "first", "end_id", *added).mapInArrow(_chains, _OUT), "chains"))
    return out.filter("not is_total"), out.filter("is_total and parent is null")


_SUMS = ("n_children", "n_leaves", "saved_tokens")
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", *_SUMS, "end_id"]


def prefix_trie(pieces: DataFrame, block: int = BLOCK, container_rows: int = CONTAINER_ROWS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and (end_id, conv_id) of the conversations that end at a node with an end_id.

    ``pieces`` is what ``ordered_pieces`` gives; a conversation without turns has a piece without data. Nodes have
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and end_id.
    """
    spark = configure(pieces.sparkSession)
    blocks = settle(_blocks(pieces, block), "blocks")
    ends = blocks.filter("last").select(F.col("after").alias("end_id"), "conv_id")
    strings = blocks.groupBy("block", "cid", "after", "data").agg(
        F.count("*").alias("n"), F.count_if("last").alias("n_end"), F.min("conv_id").alias("first")
    )
    strings = settle(strings.withColumn("end_id", F.when(F.col("n_end") > 0, F.col("after"))), "strings")
    root = strings.filter("block = 0").agg(F.min("first"), F.sum("n"), F.max(F.when(F.octet_length("data") == 0, F.col("end_id")))).first()
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_id string"
    if root[1] is None:
        return spark.createDataFrame([], kinds), ends
    nodes, totals = [], None
    for level in range(strings.agg(F.max("block")).first()[0], -1, -1):
        rows = strings.filter((F.col("block") == level) & (F.octet_length("data") > 0))
        rows = rows.withColumns({"parent": F.lit(None).cast("string"), "depth": F.lit(level * block).cast("long")})
        if level:
            before = strings.filter((F.col("block") == level - 1) & (F.col("n") > F.col("n_end")))
            rows = rows.join(before.select(F.col("after").alias("cid"), F.col("first").alias("base_conv")), "cid")
        else:
            rows = rows.withColumn("base_conv", F.lit(root[0]).cast("long"))
        if totals is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            below = totals.select(F.col("cid").alias("after"), *[F.col(a).alias(b) for a, b in zip(_SUMS, ("children", "leaves", "saved"), strict=True)])
            rows = rows.join(below, "after", "left").fillna(0, ["children", "leaves", "saved"])
        found, totals = _grown(settle(rows.select(*_MEMBER), "members"), container_rows)
        nodes.append(found.select(*_NODE))
    summed = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])
    top = summed.select(
        F.lit(root[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root[1]).cast("long").alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens",
        F.lit(root[2]).cast("string").alias("end_id"),
    )
    return reduce(DataFrame.unionByName, [top, *nodes]), ends


def _lists(batches):
    """Sorted members as pieces of lists: comma-joined ids of one node within one batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, ids = batch.column("end_id").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        spans = [(a, min(a + PIECE_IDS, z)) for c, z in zip(cuts, cuts[1:], strict=False) for a in range(c, z, PIECE_IDS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[a] for a, _ in spans]), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans])],
            ["end_id", "at", "ids"],
        )


def _digests(batches):
    """The digest of each node's list, read piece by piece."""
    current, sha, done = None, None, []
    for batch in batches:
        for end_id, ids in zip(batch.column("end_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if end_id != current:
                if current is not None:
                    done.append((current, sha.hexdigest()))
                current, sha = end_id, hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["end_id", "ends_sha256"])
            done = []
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([sha.hexdigest()])], ["end_id", "ends_sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """(end_id, ends_sha256): the digest of each node's conversations, numerically ascending, joined by commas."""
    keys = ["end_id", "conv_id"]
    lists = settle(ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_lists, "end_id string, at bigint, ids string"), "lists")
    return lists.repartition("end_id").sortWithinPartitions("end_id", "at").mapInArrow(_digests, "end_id string, ends_sha256 string")


def with_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ends_sha256, of the empty text where no conversation ends."""
    known = nodes.join(member_digests(ends), "end_id", "left")
    return known.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("end_id")
