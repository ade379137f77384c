"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, embedded as ``COORDS`` minwise
tokens. A tree starts with all documents in one node; a node picks one
coordinate, and now and then a second, by a hash of its path, and each
document moves to the child named by its minwise token there, so similar sets
stay together and others part. Nodes of up to ``NODE_ROWS`` documents are
compared exhaustively; larger ones branch again. A large node of similar
documents would hardly part: its members are compared with one of them first,
the pivot. Those near it are linked already, so only the others still have to
meet everyone; if these are few, the near ones are dealt into small nodes that
each hold all others. Independent trees repeat this until a pair at the
threshold is missed by none of them but for a negligible chance.

Candidates join into clusters, whose full sets are compared, large clusters
with a pivot first in the same way; only confirmed links make components. Equal
sets are one class from the start, found by a 128-bit fingerprint of the whole
set, and take part once; so do equal sketches until sets are compared.

Defined results
    null and wordless texts have the empty set and link with nothing; a text
    shorter than a shingle is one shingle; rows that share a ``doc_id`` are one
    document with several texts; a null ``doc_id`` links with nothing and is
    not kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import leaving, materialise, small_side, worker_cache
from .mixing import _mix64

COORDS = 64
TREES, NODE_ROWS = 12, 1024
#: Levels after which what still is large meets in blocks, all against all.
LEVELS = 16
#: Shingles and documents that are compared in one piece.
BLOCK_SHINGLES, BLOCK_ROWS = 600_000, 1024
#: Pivot texts, ids of clustered documents and links that may be broadcast;
#: more are joined by shuffle. Classes of more copies than HOT_COPIES are few.
PIVOT_ROWS, BROADCAST_ROWS, HOT_COPIES = 2_000, 100_000, 10_000
#: Words whose hashes a worker remembers: bounds memory only.
MEMO_WORDS = 100_000
#: Standard deviations by which a sketch may fall short of the threshold.
MARGIN = 4.4


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted. Lower-cases A-Z;
    words are what ASCII white space separates."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = worker_cache("shingle words", _Hashes)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - width + 1)
    h = np.full(n, np.uint64(min(len(w), width)))
    for k in range(min(width, len(w))):
        h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h)


def _coordinate_keys() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4)
    draw = rng.integers(0, 1 << 63, (2, COORDS), dtype=np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, s0, s1`` (fingerprint of the set), ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, turn = _coordinate_keys()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                s0, s1 = np.zeros((2, len(sets)), np.uint64)
                sig: list[bytes | None] = [None] * len(sets)
                if len(some):
                    x = np.concatenate([sets[i] for i in some])
                    starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                    s0[some] = np.add.reduceat(_mix64(x + np.uint64(1)), starts)
                    s1[some] = np.add.reduceat(_mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    low = np.empty((len(some), COORDS), np.uint32)
                    for j in range(COORDS):
                        low[:, j] = np.minimum.reduceat((x ^ flip[j]) * turn[j], starts) >> np.uint64(32)
                    for i, row in zip(some, low):
                        sig[i] = row.tobytes()
                cols = [part.column(0), pa.array(size), pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "s0", "s1", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(leaving(run), "doc_id long, n_shingles long, s0 long, s1 long, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _branch(node: np.ndarray, sig: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: one coordinate for each node, and a second one so
    often that a pair at the threshold is expected to stay together once."""
    pick = _mix64(node ^ np.uint64(0xD1B54A32D192ED03 + level))
    extra = (pick >> np.uint64(40)) % np.uint64(1000) < np.uint64(round(1000 * (1 / threshold - 1)))
    rows, kids = [], []
    for turn, who in ((0, np.arange(len(node))), (1, np.flatnonzero(extra))):
        at = ((pick[who] >> np.uint64(8 + 12 * turn)) % np.uint64(COORDS)).astype(np.int64)
        token = sig[who, at].astype(np.uint64)
        kids.append(_mix64(node[who] * np.uint64(31) + np.uint64(turn + 1) + _mix64((token << np.uint64(8)) + at.astype(np.uint64))))
        rows.append(who)
    return np.concatenate(rows), np.concatenate(kids)


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the first column changes; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.concat_batches(held)
        key = whole.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield whole.slice(0, cut)
        held, count = [whole.slice(cut)], len(key) - cut
    if held:
        yield pa.concat_batches(held)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` is connected with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def _grow(items: DataFrame, trees: int, threshold: float, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members of the nodes that are to be compared (``node, id``), and the
    links to pivots that were found on the way (``a, b``)."""
    least = _least(threshold)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = batch.column(0).to_numpy(), _signatures(batch.column(1))
            for tree in range(trees):
                root = np.full(len(ids), _mix64(np.array([tree + 1], np.uint64))[0])
                rows, kids = _branch(root, sig, 0, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(kids.view(np.int64)), pa.array(ids[rows])], ["node", "id"])

    def deeper(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                node = batch.column(0).to_numpy().view(np.uint64)
                rows, kids = _branch(node, _signatures(batch.column(2)), level, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(kids.view(np.int64)), batch.column(1).take(pa.array(rows))], ["node", "id"])

        return run

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_signatures(batch.column(3)) == _signatures(batch.column(4))).sum(1) >= least
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], ["node", "id", "pivot", "near"])

    sketches = items.select("id", "sig")
    rows, ready, links = materialise(sketches.mapInArrow(leaving(roots), "node long, id long"), "paths-1"), [], []
    for level in range(1, LEVELS + 1):
        # dealt by node once; most nodes hold one document, which goes no further
        rows = rows.repartition("node")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
        sized = materialise(rows.join(sizes, "node"), f"paths-{level}-sized")
        ready.append(sized.where(F.col("n") <= node_rows).select("node", "id"))
        large = materialise(sized.where(F.col("n") > node_rows).drop("n"), "paths-large")
        if large.isEmpty():
            break
        pivots = large.select("node", "pivot").distinct().join(sketches.withColumnsRenamed({"id": "pivot", "sig": "pivot_sig"}), "pivot")
        pivots = materialise(pivots.select("node", "pivot_sig"), "paths-pivots")
        # ids travel to the sketches where they are few, not the other way
        big = sketches.join(small_side(large), "id").join(small_side(pivots, BROADCAST_ROWS), "node").select("node", "id", "pivot", "sig", "pivot_sig")
        tested = materialise(big.mapInArrow(leaving(against), "node long, id long, pivot long, near boolean"), "paths-tested")
        links.append(tested.where("near and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        far = materialise(tested.groupBy("node").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far")).where("far > 0"), "paths-far")
        tested = tested.join(small_side(far), "node")
        ready.append(_dealt(tested.where(F.col("far") <= node_rows), "node", F.ceil(F.col("n") / F.lit(node_rows))).select("node", "id"))
        rows = tested.where(F.col("far") > node_rows)
        if level == LEVELS:
            ready.append(_in_blocks(rows.select("node", "id", "n"), "node", "id", F.ceil(F.col("n") / F.lit(node_rows))).drop("n"))
        else:
            rows = materialise(rows.select("node", "id"), "paths-open")
            again = sketches.join(small_side(rows), "id").select("node", "id", "sig")
            rows = materialise(again.mapInArrow(leaving(deeper(level)), "node long, id long"), f"paths-{level + 1}")
    empty = items.sparkSession.createDataFrame([], "a long, b long")
    return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, links, empty)


def _dealt(rows: DataFrame, key: str, parts) -> DataFrame:
    """Groups whose ``near`` rows need not meet each other: these are dealt
    into parts, and each part meets all other rows of its group."""
    rows = rows.withColumn("_parts", F.greatest(parts.cast("int"), F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_part", F.explode(F.when(F.col("near"), own).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))))
    return rows.withColumn(key, F.xxhash64(key, "_part")).drop("_parts", "_part")


def _in_blocks(rows: DataFrame, key: str, by: str, parts) -> DataFrame:
    """Groups of more than one part are dealt into that many blocks, and each
    pair of blocks becomes a group: all pairs meet, no task holds them all."""
    rows = rows.withColumn("_parts", parts.cast("int")).withColumn("_block", F.pmod(F.xxhash64(by), F.greatest("_parts", F.lit(1))).cast("int"))
    other = F.explode(F.when(F.col("_parts") > 1, F.expr("sequence(0, _parts - 1)")).otherwise(F.array(F.lit(-1))))
    rows = rows.withColumn("_other", other)
    pair = F.xxhash64(key, F.least("_block", "_other"), F.greatest("_block", "_other"))
    # a block meets itself where two others are possible, so no pair is lost
    return rows.withColumn(key, F.when(F.col("_other") >= 0, pair).otherwise(F.col(key))).drop("_parts", "_block", "_other")


def _least(threshold: float) -> int:
    """Agreeing coordinates that make a candidate."""
    return math.floor(COORDS * threshold - MARGIN * math.sqrt(COORDS * threshold * (1 - threshold)))


def _candidates(nodes: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: documents of a node joined by sketches that agree enough, as
    links to the smallest of those connected."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 4096):
            node, ids, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _signatures(batch.column(2))
            left, right, i = [], [], np.arange(len(node))
            for step in range(1, len(node)):
                i = i[i + step < len(node)]
                i = i[node[i] == node[i + step]]
                if not len(i):
                    break
                for k in range(0, len(i), 2048):
                    part = i[k : k + 2048]
                    same = (sig[part] == sig[part + step]).sum(1) >= least
                    left.append(part[same])
                    right.append(part[same] + step)
            if left:
                label = _labels(len(node), np.concatenate(left), np.concatenate(right))
                far = np.flatnonzero(ids != ids[label])
                if len(far):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])

    rows = nodes.join(items.select("id", "sig"), "id").select("node", "id", "sig")
    return rows.repartition("node").sortWithinPartitions("node", "id").mapInArrow(leaving(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of the linked ids, by
    alternating large and small stars; the driver sees counts only."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before, few = None, edges.count() <= BROADCAST_ROWS
    side = F.broadcast if few else lambda table: table
    while True:
        # each node's larger neighbours take its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node's smaller neighbours, and itself, take the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the incidence matrix, some
    thousand columns at a time; shingles of one document only are left out."""
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    col = np.cumsum(fresh) - 1
    shared = np.bincount(col)[col] > 1
    row, col = row[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int(col.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        out += part @ part.T
    return out


def _confirmed(clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links that hold on the full sets, to the smallest document
    that each is connected with inside its cluster or block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 256):
            key, ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            a, b = [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                sets = [shingles(t, width) for t in texts[lo:hi]]
                size = np.array([len(s) for s in sets])
                common = _overlaps(sets)
                linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
                linked &= (size[:, None] > 0) & (size[None, :] > 0)
                label = _labels(hi - lo, *np.nonzero(np.triu(linked, 1)))
                own = ids[lo:hi]
                far = own != own[label]
                a.append(own[far])
                b.append(own[label][far])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return clusters.select("key", "id", "text").repartition("key").sortWithinPartitions("key", "id").mapInArrow(leaving(run), "a long, b long").distinct()


def _near_pivots(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, id, near, linked`` of clusters too large for one piece: whether
    all texts of a document, or any, link with the pivot, whose id is the
    cluster's key. The pivot is near itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pivots = batch.column(1).to_numpy(), {}
            hit = []
            for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if other not in pivots:
                    pivots = {other: shingles(other, width)}
                a, b = shingles(text, width), pivots[other]
                common = len(np.intersect1d(a, b, assume_unique=True))
                hit.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids), pa.array(hit, pa.bool_())], ["key", "id", "hit"])

    pivots = materialise(texts.where("id = key").groupBy("key").agg(F.min("text").alias("pivot_text")), "dup-pivots")
    tested = texts.select("key", "id", "text").join(small_side(pivots, PIVOT_ROWS), "key").mapInArrow(leaving(run), "key long, id long, hit boolean")
    return materialise(tested.groupBy("key", "id").agg(F.min("hit").alias("near"), F.max("hit").alias("linked")), "dup-tested")


def _shared_ids(told: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: classes of the texts that share a ``doc_id``."""
    several = told.groupBy("doc_id").agg(F.count_distinct("s0", "s1", "n_shingles").alias("k")).where("k > 1").select("doc_id")
    several = materialise(several, "dup-shared")
    rows = told.join(small_side(several), "doc_id").select("doc_id", "s0", "s1", "n_shingles").distinct()
    rows = rows.join(classes.select("s0", "s1", "n_shingles", "id"), ["s0", "s1", "n_shingles"])
    first = rows.groupBy("doc_id").agg(F.min("id").alias("first"))
    return rows.join(first, "doc_id").select(F.col("id").alias("a"), F.col("first").alias("b"))


def _once(texts: DataFrame, told: DataFrame) -> DataFrame:
    """``texts`` without repeated rows: the texts of ids that several rows have
    are made distinct, before and after a shuffle of these rows alone."""
    again = materialise(told.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "dup-again")
    if again.isEmpty():
        return texts
    # null ids are in no class
    texts, again = texts.where("id is not null"), small_side(again)
    return texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id", "left_semi").distinct())


def group_near_duplicates(docs: DataFrame, width: int, percent: int, trees: int = TREES, node_rows: int = NODE_ROWS) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``. Sets link when
    ``100 * intersection >= percent * union``."""
    threshold, sets = percent / 100, ["s0", "s1", "n_shingles"]
    told = materialise(_describe(docs, width), "dup-sets")
    some = told.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy(*sets).agg(F.min(F.struct("doc_id", "sig")).alias("m"), F.count("*").alias("copies"))
    items = materialise(classes.select(*sets, "copies", F.col("m.doc_id").alias("id"), F.col("m.sig").alias("sig")), "dup-classes")

    # equal sketches, by two hashes, are linked with the first of them at once
    sketched = items.withColumns({"g0": F.xxhash64("sig"), "g1": F.xxhash64(F.lit(1), "sig")})
    twins = materialise(sketched.groupBy("g0", "g1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "dup-twins")
    alike = sketched.join(small_side(twins), ["g0", "g1"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    alike = materialise(alike, "dup-alike")
    heads = items.select("id", "sig")
    if not alike.isEmpty():
        heads = materialise(heads.join(small_side(alike.select(F.col("a").alias("id"))), "id", "left_anti"), "dup-heads")

    nodes, links = _grow(heads, trees, threshold, node_rows)
    clusters = components(_candidates(nodes, heads, threshold).unionByName(links).unionByName(alike))
    members = clusters.join(items.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id")
    weights = members.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    parts = F.greatest(F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)), F.ceil(F.col("docs") / F.lit(BLOCK_ROWS))).cast("int")
    weights = weights.select("component", parts.alias("parts"))
    members = materialise(members.join(weights, "component").select("id", F.col("component").alias("key"), "n", "parts"), "dup-members")
    wanted = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members  # four numbers a row
    texts = _once(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null"), some).join(wanted, "id")
    confirmed = [_confirmed(texts.where("parts <= 1"), width, percent)]
    if not members.where("parts > 1").isEmpty():
        large = texts.where("parts > 1")
        near = _near_pivots(large, width, percent)
        confirmed.append(near.where("linked and id <> key").select(F.col("id").alias("a"), F.col("key").alias("b")))
        far = near.where("not near").join(members.select("id", "n"), "id").groupBy("key").agg(F.sum("n").alias("far_total"), F.count("*").alias("far_docs"))
        far = materialise(far, "dup-far")
        # clusters that are near their pivot all over are done
        rest = large.join(small_side(near.join(small_side(far), "key")), ["key", "id"])
        few = (F.col("far_total") * 2 <= BLOCK_SHINGLES) & (F.col("far_docs") * 2 <= BLOCK_ROWS)
        confirmed.append(_confirmed(_dealt(rest.where(few), "key", F.col("parts") * 2), width, percent))
        confirmed.append(_confirmed(_in_blocks(rest.where(~few), "key", "id", F.col("parts")), width, percent))
    confirmed.append(_shared_ids(told.where("n_shingles > 0 and doc_id is not null"), items))
    final = components(reduce(DataFrame.unionByName, confirmed))

    lead = items.join(final, "id", "left").select(*sets, "copies", F.coalesce("component", "id").alias("component_id"))
    lead = materialise(lead, "dup-lead")
    # classes of very many copies are few: broadcast; the others by shuffle
    hot = materialise(lead.where(F.col("copies") > HOT_COPIES).drop("copies"), "dup-hot")
    out = told.select("doc_id", *sets)
    none, full = out.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")), out.where("n_shingles > 0")
    full = full.join(small_side(hot.withColumnRenamed("component_id", "_hot")), sets, "left")
    cold = full.where("_hot is null").drop("_hot").join(lead.where(F.col("copies") <= HOT_COPIES).drop("copies"), sets, "left")
    hot_rows = full.where("_hot is not null").withColumnRenamed("_hot", "component_id")
    out = none.unionByName(cold.select(none.columns)).unionByName(hot_rows.select(none.columns))
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """One document of each component: drops what ``judged`` doesn't keep, and
    of rows that share a ``doc_id`` all but the smallest by text."""
    gone = materialise(judged.where("not kept and doc_id is not null").select("doc_id").distinct(), "dup-gone")
    few = gone.count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    again = materialise(again, "dup-again")
    if again.isEmpty():
        return left
    again = small_side(again)
    # the least text of an id, then any of its rows: not every type has an order
    rows = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*[c for c in docs.columns if not _is_map(docs, c)]))).alias("_m"))
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(rows.select("_m.*"))


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()
