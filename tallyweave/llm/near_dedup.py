"""Near-duplicate documents by BagMinHash.

A document is the multiset of its shingles of SHINGLE words; two documents are linked if their weighted Jaccard
similarity (shared copies over all copies) is THRESHOLD or more, and classes are the connected groups. Texts
with the same words stand as one.

BagMinHash: each shingle owns a Poisson process over time and weight, cut into (0, 1], (1, 2], (2, 4], (4, 8]
and so on; an interval of more than one unit that yields a point is split in half, the half with the point keeps
it and the other draws its own next one. Points at weights up to the shingle's count set the minimum of a
pseudorandom component of the signature. Points come in order of time and a process ends once its next point
is later than the largest minimum, so few points are drawn. The share of equal components is an unbiased
estimate of the similarity.

Bands of ROWS components make buckets. In a first round every bucket names a leader, which is compared with all
members of other classes; a second does so in small buckets that still hold several classes, with other leaders,
besides in buckets of two bands. The rounds join most of what belongs together; what they leave is compared in
full: in buckets that still hold several classes, all members outside the main class meet all members of other
classes. If they are few they make pairs, else the bucket is dealt into parts of bounded size and each two parts
are compared exactly as a product of matrices, which yields no more rows than classes. So every two documents that
share a bucket end in one class or have been compared, and only buckets of many classes cost the square of their size.
A pair is first judged by its signatures (an estimate below LEAST_ESTIMATE, four and a half deviations under the
threshold, ends it), then exactly by the overlap of the multisets; parts are compared without the estimate.

Defined results: a null or empty text, or one without words, is in a class of its own; a text of fewer words
than a shingle is one shingle; words are runs of letters and digits in lower case; null ids come last when the
smallest id names a class; repeated rows share a class; an empty table gives an empty result. Only id and text are
read; ``drop_near_copies`` carries all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.words import mix, word_hashes
from tallyweave.session import configure, settle

SHINGLE = 5
THRESHOLD = 0.8
COMPONENTS = 100
ROWS = 4
LEAST_ESTIMATE = 0.62
#: Leader rounds; after the first, only buckets with so many members at most name leaders.
TURNS = 2
LED_MEMBERS = 16
#: Members outside a bucket's main class that make pairs with all others; more of them are compared in parts.
OUTSIDERS = 8
#: Bounds of a part: members, and copies of shingles.
PART_ROWS = 2_048
PART_COPIES = 1 << 20
#: Signatures are drawn for runs of about this many words at once.
RUN_WORDS = 300_000

_U = np.uint64
_STEP, _LEFT, _RIGHT, _PICK = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03), _U(0xABC98388FB8FAC03), _U(0x8CB92BA72F3D8DD7)


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, copies) of the distinct shingles of each row, given its words' hashes.

    A shingle is known by 48 bits of its hash.
    """
    ends = np.cumsum(counts)
    number = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), number)
    first = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(ends - counts, number)
    value = np.zeros(len(row), np.uint64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    last = np.repeat(ends, number)
    for j in range(SHINGLE):
        word = np.where(first + j < last, padded[first + j], _U(j))
        value = mix(value * _U(31) + word)
    key = np.sort(row.astype(np.uint64) << _U(48) | value >> _U(16))
    if not len(key):
        return row, value, row
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    copies = np.diff(np.concatenate([begin, [len(key)]]))
    return (key[begin] >> _U(48)).astype(np.int64), key[begin] & _U(2**48 - 1), copies


def _wait(seed: np.ndarray, rate) -> np.ndarray:
    """Exponential waiting times drawn from seeds."""
    return -np.log(((mix(seed) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate


def _pick(seed: np.ndarray, components: int) -> np.ndarray:
    return (mix(seed ^ _PICK) % _U(components)).astype(np.int64)


def signatures(row: np.ndarray, shingle: np.ndarray, copies: np.ndarray, rows: int, components: int = COMPONENTS) -> np.ndarray:
    """The BagMinHash signature of each row: times of the components' first points, infinite without shingles."""
    least = np.full(rows * components, np.inf)
    latest = np.full(rows, np.inf)

    def mark(at, component, time):
        np.minimum.at(least, at * components + component, time)

    def refresh():
        latest[:] = least.reshape(rows, components).max(axis=1)

    # processes of one unit, (0, 1] and (1, 2] at first
    owner = np.concatenate([row, row[copies >= 2]])
    seed = np.concatenate([mix(shingle), mix(shingle[copies >= 2] ^ _LEFT)])
    time = _wait(seed, components)
    mark(owner, _pick(seed, components), time)
    refresh()
    # larger intervals, breadth first
    units = [(owner, seed, time)]
    level = 2
    nodes = None
    while (wide := copies > level).any():
        start = mix(shingle[wide] ^ _U(int(_RIGHT) * level % 2**64))
        lower = np.full(len(start), level, np.int64)
        fresh = (row[wide], start, lower, 2 * lower, copies[wide], _wait(start, components * level), _pick(start, components))
        nodes = fresh if nodes is None else tuple(np.concatenate(x) for x in zip(nodes, fresh, strict=True))
        level *= 2
    while nodes is not None and len(nodes[0]):
        at, s, lower, upper, most, t, component = nodes
        whole = upper <= most
        mark(at[whole], component[whole], t[whole])
        refresh()
        ahead = t < latest[at]
        unit = ahead & (upper - lower == 1)
        # a unit's further points follow one another
        units.append((at[unit], s[unit], t[unit]))
        split = ahead & ~(upper - lower == 1)
        at, s, lower, upper, most, t, component = (x[split] for x in (at, s, lower, upper, most, t, component))
        middle = (lower + upper) // 2
        in_left = (mix(s ^ _STEP) & _U(1)).astype(bool)
        children = []
        for seeds, low, high, holds in ((mix(s ^ _LEFT), lower, middle, in_left), (mix(s ^ _RIGHT), middle, upper, ~in_left)):
            later = t + _wait(seeds, components * (high - low))
            child = (at, seeds, low, high, most, np.where(holds, t, later), np.where(holds, component, _pick(seeds, components)))
            relevant = low < most
            children.append(tuple(x[relevant] for x in child))
        nodes = tuple(np.concatenate(x) for x in zip(*children, strict=True))
    owner, seed, time = (np.concatenate(x) for x in zip(*units, strict=True))
    done = np.uint64(0)
    while True:
        ahead = time < latest[owner]
        owner, seed, time = owner[ahead], seed[ahead], time[ahead]
        if not len(owner):
            return least.reshape(rows, components)
        many = int(np.clip(50_000 // len(owner), 1, 32))
        steps = (np.arange(many).astype(np.uint64) + done + _U(1)) * _STEP
        drawn = seed[:, None] + steps[None, :]
        times = time[:, None] + np.cumsum(_wait(drawn, components), axis=1)
        mark(np.repeat(owner, many), _pick(drawn, components).ravel(), times.ravel())
        time, done = times[:, -1], done + _U(many)
        refresh()


def _names(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each row's sequence of words; 0 without words."""
    starts = np.cumsum(counts) - counts
    position = np.arange(len(hashes)) - np.repeat(starts, counts)
    names = []
    for salt in (_LEFT, _RIGHT):
        each = mix(hashes ^ mix(position.astype(np.uint64) * _STEP + salt))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        sums = sums[starts + counts] - sums[starts]
        names.append(np.where(counts > 0, mix(sums + counts.astype(np.uint64)), _U(0)).view(np.int64))
    return names


def sign_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, node, name, size, signature): the words' 128-bit name in two halves, shingles, signature (null without words)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, hashes, counts in _runs(batch.column("text").to_pylist()):
                node, name = _names(hashes, counts)
                row, shingle, copies = shingles(hashes, counts)
                size = np.bincount(row, copies, len(counts)).astype(np.int64)
                times = signatures(row, shingle, copies, len(counts))
                # sixteen bits tell points apart well enough for an estimate, and a band has sixty-four of them
                signature = (mix(times.view(np.uint64)) >> _U(48)).astype(np.uint16).view(np.int16)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(signature.ravel()), COMPONENTS).cast(pa.list_(pa.int16()))
                lists = pa.compute.if_else(pa.array(size > 0), lists, pa.scalar(None, lists.type))
                columns = [batch.column("doc_id").slice(first, len(counts)), pa.array(node), pa.array(name), pa.array(size), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "name", "size", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, node bigint, name bigint, size bigint, signature array<smallint>")


def _runs(texts: list[str | None]):
    """Runs of rows that hold about RUN_WORDS words."""
    waiting, words = [], 0
    for first, hashes, _, counts in word_hashes(texts):
        waiting.append((first, hashes, counts))
        words += len(hashes) + len(counts)
        if words >= RUN_WORDS or sum(len(x[2]) for x in waiting) >= 30_000:
            yield waiting[0][0], np.concatenate([x[1] for x in waiting]), np.concatenate([x[2] for x in waiting])
            waiting, words = [], 0
    if waiting:
        yield waiting[0][0], np.concatenate([x[1] for x in waiting]), np.concatenate([x[2] for x in waiting])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, copies): every copy of a shingle as a number of its own, so that multisets overlap as sets do.

    ``texts`` has text and node; rows whose words have another name than node are left out.
    """

    def run(batches):
        for batch in batches:
            wanted = batch.column("node").to_numpy()
            for first, hashes, counts in _runs(batch.column("text").to_pylist()):
                node, row, shingle, copies = _names(hashes, counts)[0], *shingles(hashes, counts)
                copy = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                values = mix(np.repeat(shingle, copies) + (copy.astype(np.uint64) << _U(48))).view(np.int64)
                sizes = np.bincount(row, copies, len(counts)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                same = pa.array(node == wanted[first : first + len(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "copies"]).filter(same)

    return texts.select("text", "node").mapInArrow(run, "node bigint, copies array<bigint>")


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    """(key, pair_key, node) for each band of each node: buckets of one band and of two neighbouring ones."""
    bands = COMPONENTS // ROWS
    rows = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))

    def key(band: Column) -> Column:
        return F.xxhash64(band, *[F.element_at("signature", band * ROWS + j + 1) for j in range(ROWS)])

    both = rows.select("node", key(F.col("band")).alias("key"), key((F.col("band") + 1) % bands).alias("next"))
    return both.select("key", F.xxhash64("key", "next").alias("pair_key"), "node")


def _pairs(buckets: DataFrame, turn: int, most: int | None = None) -> DataFrame:
    """(a, b): the leader of each bucket with the members of other classes. ``buckets`` has key, node, class.

    One order of all nodes names the leaders of a round, so that a node's buckets mostly have the same few leaders.
    With ``most``, larger buckets make no pairs.
    """
    order = F.xxhash64("node", F.lit(turn))
    leaders = buckets.groupBy("key").agg(F.min_by(F.struct("node", "class"), order).alias("leader"), F.count("*").alias("n"))
    if most is not None:
        leaders = leaders.filter(F.col("n") <= most)
    leaders = leaders.select("key", F.col("leader.node").alias("a"), F.col("leader.class").alias("of"))
    led = buckets.join(leaders, "key").filter(F.col("class") != F.col("of"))
    return led.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _main(buckets: DataFrame) -> DataFrame:
    """(key, main, outside): the largest class of each bucket with several, and the number of members outside it."""
    parts = buckets.groupBy("key", "class").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    return main.filter("outside > 0")


def _outsiders(buckets: DataFrame, main: DataFrame) -> DataFrame:
    """(a, b): in buckets with few members outside the main class, those members with all of other classes.

    A bucket yields OUTSIDERS pairs per member at most; ``_crowded`` has the others.
    """
    few = main.filter(F.col("outside") <= OUTSIDERS).select("key", "main")
    outside = buckets.join(few, "key").filter(F.col("class") != F.col("main")).select("key", F.col("node").alias("a"), F.col("class").alias("of"))
    led = buckets.join(outside, "key").filter(F.col("class") != F.col("of"))
    return led.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _crowded(buckets: DataFrame, main: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join all classes of the other buckets that any of their pairs joins.

    Members are dealt into parts by their hash, and each two parts of a bucket are one group.
    """
    many = main.filter(F.col("outside") > OUTSIDERS).select("key", "main")
    held = buckets.join(many, "key").join(nodes.select("node", "size"), "node")
    needed = F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("size") / PART_COPIES)).cast("int")
    # buckets of the same members, as bands often have, are compared once
    kept = held.groupBy("key").agg(needed.alias("parts"), F.bit_xor(F.xxhash64("node")).alias("members"), F.count("*").alias("n"))
    kept = kept.groupBy("members", "n").agg(F.min(F.struct("key", "parts")).alias("k")).select("k.*")
    dealt = held.join(kept, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("key", "node", "class", (F.col("class") == F.col("main")).alias("in_main"), "part", other.alias("other"))
    dealt = dealt.select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).drop("other")
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_compare, "a bigint, b bigint").distinct()


def _compare(table: pa.Table) -> pa.Table:
    """(a, b): links between the classes of two parts of a bucket, or within one; no more than it takes to join them."""
    table = table.combine_chunks()
    node, of, in_main, part, i, j = (table.column(c).to_numpy() for c in ("node", "class", "in_main", "part", "i", "j"))
    root = np.arange(len(np.unique(of)))
    group = np.unique(of, return_inverse=True)[1]
    lists = table.column("copies").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    begin = np.cumsum(sizes) - sizes
    first, second = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sides = [(first[~in_main[first]], second)]
    if i[0] != j[0]:
        sides.append((first[in_main[first]], second[~in_main[second]]))
    for left, right in sides:
        for start in range(0, len(left), 512):
            rows = left[start : start + 512]
            shared = _shared(flat, begin, sizes, rows, right)
            alike = shared >= THRESHOLD * (sizes[rows][:, None] + sizes[right][None, :] - shared)
            alike &= group[rows][:, None] != group[right][None, :]
            for r in np.flatnonzero(alike.any(axis=1)):
                hits = right[alike[r]]
                names, at = np.unique(root[group[hits]], return_index=True)
                own = root[group[rows[r]]]
                hits, names = hits[at[names != own]], names[names != own]
                found.append((np.full(len(hits), node[rows[r]]), node[hits]))
                root[np.isin(root, names)] = own
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _shared(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of values that each row of ``left`` shares with each of ``right``."""

    def entries(rows):
        row = np.repeat(np.arange(len(rows)), sizes[rows])
        return row, flat[np.arange(len(row)) + np.repeat(begin[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows])]

    (row_a, value_a), (row_b, value_b) = entries(left), entries(right)
    out = np.zeros((len(left), len(right)), np.float32)
    known, often = np.unique(value_a, return_counts=True)
    both = np.isin(known, value_b)
    known = known[both][np.argsort(-often[both], kind="stable")]  # frequent values first, so that late steps have few rows
    for step in range(0, len(known), 2_048):
        words = np.sort(known[step : step + 2_048])
        sides = []
        for row, value in ((row_a, value_a), (row_b, value_b)):
            at = np.minimum(np.searchsorted(words, value), len(words) - 1)
            hit = words[at] == value
            rows, place = np.unique(row[hit], return_inverse=True)
            marks = np.zeros((len(rows), len(words)), np.float32)
            marks[place, at[hit]] = 1
            sides.append((rows, marks))
        (rows_a, marks_a), (rows_b, marks_b) = sides
        out[np.ix_(rows_a, rows_b)] += marks_a @ marks_b.T
    return out


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures make it likely."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("signature").alias(f"sig_{x}"))
    fits = F.least("size_a", "size_b") >= THRESHOLD * F.greatest("size_a", "size_b")
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits)
    return joined.filter(equal >= LEAST_ESTIMATE * COMPONENTS).select("a", "b", "size_a", "size_b")


def _sets(buckets: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, copies) for every node that shares a bucket; texts are read and moved once, for all rounds."""
    involved = buckets.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    held = texts.join(involved, F.col("doc_id").eqNullSafe(F.col("first_id")))
    return settle(shingle_sets(held).dropDuplicates(["node"]), "shingles")


def _links(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose multisets are as similar as asked for."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("copies").alias(f"copies_{x}"))
    shared = F.size(F.array_intersect("copies_a", "copies_b"))
    joined = likely.join(side("a"), "a").join(side("b"), "b")
    return joined.filter(shared >= THRESHOLD * (F.col("size_a") + F.col("size_b") - shared)).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """(node, class): the smallest node of each group that ``edges`` (a, b) connect; every node of an edge is there.

    Large-star and small-star steps by turns until nothing changes; each step is written to the shared folder.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = settle(small.select("e.*").filter("a != b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, class_id (smallest id of its class), class_size, node (of its words)."""
    configure(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = settle(sign_documents(texts), "signed")
    worded = signed.filter("size > 0")
    nodes = settle(
        worded.groupBy("node", "name").agg(F.min("doc_id").alias("first_id"), F.min("size").alias("size"), F.min("signature").alias("signature")), "nodes"
    )
    rows = _bucket_rows(nodes)
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2").select("key")
    buckets = settle(rows.join(shared, "key").withColumn("class", F.col("node")), "buckets")
    sets = _sets(buckets, nodes, texts)
    links = tested = classes = None
    for turn in range(TURNS + 1):
        last = turn == TURNS
        if last:
            main = settle(_main(buckets), "main")
            pairs = _outsiders(buckets, main)
        else:
            pairs = _pairs(buckets.select("key", "node", "class"), turn, LED_MEMBERS if turn else None)
        if turn == 1:  # smaller buckets find leaders that are more alike
            pairs = pairs.union(_pairs(buckets.select(F.col("pair_key").alias("key"), "node", "class"), turn, LED_MEMBERS))
        if turn:
            pairs = pairs.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        likely = settle(_likely(pairs, nodes), "likely")
        found = _links(likely, sets)
        found = settle(found.union(_crowded(buckets, main, nodes, sets)) if last else found, "links")
        if not found.limit(1).count():
            continue
        links = found if links is None else links.union(found)
        classes = settle(connected(links), "classes")
        if last:
            break
        named = classes.withColumnsRenamed({"node": "_node", "class": "_class"})
        renamed = buckets.join(named, F.col("node") == F.col("_node"), "left").select(
            "key", "pair_key", "node", F.coalesce("_class", "node").alias("class")
        )
        open_ = renamed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("key")
        buckets = settle(renamed.join(open_, "key", "left_semi"), "buckets")
    if classes is None:
        classes = nodes.select("node", F.col("node").alias("class")).limit(0)
    per_node = worded.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    labelled = settle(per_node.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "labelled")
    sums = labelled.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    known = settle(labelled.select("node", "class").join(sums, "class").select("node", "class_id", "class_size"), "known")
    classed = signed.filter("size > 0").select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "class_size", "node")
    alone = signed.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "node")
    return classed.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; all columns stay.

    Rows of one id are one document: they stay if the id is the smallest of some class, or go.
    """
    classes = near_classes(docs, id_col, text_col)
    stays = classes.groupBy(F.col("doc_id").alias("_dropped")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))
    dropped = settle(stays.filter("not stays").select("_dropped"), "dropped")
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return plain.join(dropped, F.col(f"c{names.index(id_col)}").eqNullSafe(F.col("_dropped")), "left_anti").toDF(*names)
