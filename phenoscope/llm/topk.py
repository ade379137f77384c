"""Exact top-k inner products by ball trees.

Vectors are dealt into shards by a hash of their id. Each shard builds one ball
tree, and the queries stream past it: a query descends with the upper bound
``q.c + |q| r`` of each node, drops nodes below its current k-th score and
visits leaves in order of their bounds. Shards go in waves, each four times as
large as all before, and the k-th scores known after a wave are shared with the
next.

Defined results
    vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id; a row repeated exactly counts once; vectors of
    other lengths than the query's are not scored; ties go to the smaller id;
    a query with fewer than k candidates returns all; scaled components and
    scores beyond a long count as the greatest or least long; of rows that
    share an id the least vector asks, and none is a candidate of its own id;
    an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 2048, 128


class BallTree:
    """Nodes in levels; leaves hold slices of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.lo, self.hi, self.kids = [0], [len(x)], []
        k = 0
        while k < len(self.lo):
            lo, hi = self.lo[k], self.hi[k]
            if hi - lo <= LEAF_ROWS:
                self.kids.append(-1)
            else:
                rows = x[self.order[lo:hi]]
                axis = int((rows.max(0) - rows.min(0)).argmax()) if x.shape[1] else 0
                mid = (hi - lo) // 2
                if x.shape[1]:
                    self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], mid)]
                self.kids.append(len(self.lo))
                self.lo += [lo, lo + mid]
                self.hi += [lo + mid, hi]
            k += 1
        spans = [self.order[a:b] for a, b in zip(self.lo, self.hi)]
        self.center = np.array([x[s].mean(0) for s in spans])
        self.radius = np.array([np.sqrt(((x[s] - c) ** 2).sum(1).max()) for s, c in zip(spans, self.center)])
        self.spans = spans

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's best ``k``; ``floor`` is a score that
        k rows elsewhere are known to reach."""
        best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        length = np.sqrt((q**2).sum(1))

        def bounds(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            at = np.einsum("ij,ij->i", q[rows], self.center[nodes]) + length[rows] * self.radius[nodes]
            return at + 1e-6 + 1e-9 * np.abs(at)  # rounding never hides a row

        rows, nodes = np.arange(len(q)), np.zeros(len(q), np.int64)
        kids, leaf_rows, leaf_nodes = np.array(self.kids), [], []
        while len(rows):
            ok = bounds(rows, nodes) >= floor[rows]
            rows, nodes = rows[ok], nodes[ok]
            leaf = kids[nodes] < 0
            leaf_rows.append(rows[leaf])
            leaf_nodes.append(nodes[leaf])
            rows, nodes = np.repeat(rows[~leaf], 2), np.repeat(kids[nodes[~leaf]], 2)
            nodes[1::2] += 1
        rows, nodes = np.concatenate(leaf_rows), np.concatenate(leaf_nodes)
        limit = bounds(rows, nodes)
        turn = np.lexsort((nodes, -limit, rows))
        rows, nodes, limit = rows[turn], nodes[turn], limit[turn]
        # round r: the r-th best leaf of every query that still hopes
        first = np.searchsorted(rows, np.arange(len(q)))
        count = np.searchsorted(rows, np.arange(len(q)), "right") - first
        for r in range(int(count.max(initial=0))):
            live = np.flatnonzero(count > r)
            at = first[live] + r
            hope = limit[at] >= np.maximum(best[live, k - 1], floor[live])
            count[live[~hope]] = 0  # later leaves have lower bounds still
            live, at = live[hope], at[hope]
            for node in np.unique(nodes[at]):
                ask = live[nodes[at] == node]
                span = self.spans[node]
                score = q[ask] @ self.x[span].T
                score[own[ask][:, None] == ids[span]] = -np.inf
                s = np.hstack((best[ask], score))
                i = np.hstack((who[ask], np.broadcast_to(ids[span], score.shape)))
                top = np.lexsort((i, -s))[:, :k]
                best[ask], who[ask] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return best, who


def _whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(key).cast("long").alias("id"), ints.alias("v")).distinct()


def _checked(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``search``, for integers whose products floating point can't hold:
    scores near the k-th by floating point are computed exactly."""
    top = (1 << 63) - 1
    fx, best, who = x.astype(float), np.full((len(q), k), -np.inf, object), np.full((len(q), k), np.iinfo(np.int64).max)
    reach = np.sqrt((fx**2).sum(1).max())
    for i, row in enumerate(q):
        f = row.astype(float)
        rough = np.clip(fx @ f, -float(top), float(top))
        rough[ids == own[i]] = -np.inf
        known = np.flatnonzero(rough > -np.inf)
        if not len(known):
            continue
        kth = np.sort(rough[known])[-min(k, len(known))]
        margin = len(f) * 2.0**-49 * np.sqrt((f**2).sum()) * reach + 2.0**11
        near = known[rough[known] >= kth - 2 * margin]
        exact = [max(-top - 1, min(top, sum(a * b for a, b in zip(row.tolist(), x[j].tolist())))) for j in near]
        order = sorted(range(len(near)), key=lambda n: (-exact[n], ids[near[n]]))[:k]
        best[i, : len(order)] = [exact[n] for n in order]
        who[i, : len(order)] = ids[near[order]]
    return best, who


def _results(ask: np.ndarray, scores: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    ok = scores.astype(float) > -np.inf
    ask = np.broadcast_to(ask[:, None], who.shape)[ok]
    return pa.RecordBatch.from_arrays([pa.array(ask), pa.array(who[ok]), pa.array(scores[ok].astype(np.int64))], ["query_id", "vec_id", "score"])


class _Shard:
    """The vectors of a shard by their length, and a tree for each once asked."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.trees: dict[int, tuple] = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.held.setdefault(vectors.shape[1], []).append((ids, vectors))

    def ask(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> pa.RecordBatch | None:
        w = q.shape[1]
        if w not in self.held:
            return None
        if w not in self.trees:
            own, x = (np.concatenate(a) for a in zip(*self.held[w]))
            reach = float(np.abs(x.astype(float)).max(initial=0))
            self.trees[w] = own, x, reach, BallTree(x.astype(float)) if reach < 2**50 else None
        own, x, reach, tree = self.trees[w]
        if tree is None or reach * np.abs(q.astype(float)).max(initial=0) * max(w, 1) >= 2**53:
            return _results(ids, *_checked(q, ids, x, own, k))
        scores, who = tree.search(q.astype(float), ids, own, k, floor)
        return _results(ids, scores, who)


def _by_width(batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows by the length of their vectors, with the vectors as a matrix."""
    column = batch.column(4)
    first = column.offsets.to_numpy()
    width, flat = np.diff(first), column.values.to_numpy()
    for w in np.unique(width[rows]):
        some = rows[width[rows] == w]
        yield some, flat[first[some][:, None] + np.arange(w)]


def exact_top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int, scale: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query`` (over
    ``key``) the ``k`` best others by the inner product of
    ``floor(scale * component)``."""
    rows = materialise(_whole_vectors(df, key, vector, scale), "topk-vectors")
    queries = materialise(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    kept = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by shard, vectors before queries: one tree at a time
        at, shard = None, _Shard()
        for batch in batches:
            number, query, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            floor = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            for s in np.unique(number):
                if s != at:
                    at, shard = s, _Shard()
                here = np.flatnonzero(number == s)
                for some, x in _by_width(batch, here[~query[here]]):
                    shard.add(ids[some], x)
                asked = here[query[here]]
                for lo in range(0, len(asked), QUERY_ROWS):
                    for some, q in _by_width(batch, asked[lo : lo + QUERY_ROWS]):
                        if (got := shard.ask(ids[some], q, floor[some], k)) is not None:
                            yield got

    def wave(lo: int, hi: int, known: DataFrame) -> DataFrame:
        """Answers of shards ``lo`` up to ``hi``, without the last."""
        a = kept.where(F.col("shard").between(lo, hi - 1)).select("shard", F.lit(False).alias("query"), "id", F.lit(None).cast("double").alias("floor"), "v")
        b = known.select(F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("shard"), F.lit(True).alias("query"), "id", "floor", "v")
        both = a.unionByName(b).repartition(hi - lo, "shard").sortWithinPartitions("shard", "query")
        return materialise(both.mapInArrow(search, "query_id long, vec_id long, score long"), "topk-wave")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, lo = None, 0
    while lo < shards:
        hi = min(shards, max(1, 4 * lo))
        known = queries.withColumn("floor", F.lit(None).cast("double"))
        if best is not None:
            floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
            known = queries.join(floors, queries["id"] == floors["query_id"], "left").select("id", "v", "floor")
        found = wave(lo, hi, known)
        best = found if best is None else best.unionByName(found)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        best, lo = materialise(best, "topk-best"), hi
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
