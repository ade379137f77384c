"""Best-fit packing of token pieces into fixed-length sequences.

Only the counts of each piece length matter for where pieces go, and there are
no more lengths than ``capacity``: the plan is made from that histogram. An
index from sums to single lengths, pairs and triples fills the gap beside the
longest remaining piece exactly, as often as the counts allow; what has no
exact complement takes the best fit. Pieces then look up their place by length
and rank among equals, which is a distributed join.

Defined results
    null text is empty and gives a piece with the end id alone; longer
    documents are cut, the first piece being the shorter one; repeated rows are
    packed as separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buckets_for, materialise, running_total
from .tokens import with_ids


class ComplementIndex:
    """Combinations of lengths by their sum: singles are the counts themselves,
    pairs are listed under their sum, and triples as a longest length and the
    sum of a pair below it. A combination that the counts no longer allow is
    dropped when it is met: counts only fall, so it never comes back."""

    def __init__(self, counts: np.ndarray):
        self.counts, top = counts, len(counts) - 1
        there = np.flatnonzero(counts).tolist()
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for a in there:
            for b in there:
                if b > a or a + b > top:
                    break
                self.pairs.setdefault(a + b, []).append((a, b))
        self.triples: dict[int, list[int]] = {}
        for a in there:
            for pair in self.pairs:
                if a + pair <= top and pair <= 2 * a:
                    self.triples.setdefault(a + pair, []).append(a)

    def has(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, beside: int | None = None) -> tuple[int, ...] | None:
        """The pair with the longest length that fills ``total``; with
        ``beside``, none above it and one of ``beside`` left over."""
        found = self.pairs.get(total, [])
        for k in range(len(found) - 1, -1, -1):
            if not self.has(*found[k]):
                if k == len(found) - 1:
                    found.pop()
            elif beside is None or (found[k][0] <= beside and self.has(beside, *found[k])):
                return found[k]
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``total``, longest first."""
        if total < len(self.counts) and self.counts[total]:
            return (total,)
        if found := self.pair(total):
            return found
        firsts = self.triples.get(total, [])
        while firsts:
            a = firsts[-1]
            if self.counts[a] and (rest := self.pair(total - a, a)):
                return (a, *rest)
            firsts.pop()
        return None

    def best(self, room: int) -> int | None:
        there = np.flatnonzero(self.counts[: room + 1])
        return int(there[-1]) if len(there) else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how often each is used."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    index, out = ComplementIndex(counts), []
    for head in range(capacity, 0, -1):
        while counts[head]:
            pattern, room = [head], capacity - head
            counts[head] -= 1
            while room:
                more = index.exact(room)
                if more is None:
                    fit = index.best(room)
                    more = (fit,) if fit else ()
                if not more:
                    break
                pattern += more
                room -= sum(more)
                for x in more:
                    counts[x] -= 1
            need = Counter(pattern)
            times = 1 + min(int(counts[x]) // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * (times - 1)
            out.append((tuple(pattern), times))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """By length and first rank: (key, first rank, first sequence, offset)."""
    used, sequence, rows = Counter(), 0, []
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` is scanned more than
    once: give a table. ``length`` lies between 1 and ``capacity``."""
    hist = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most capacity rows
    lengths, firsts, sequences, offsets = _places(plan(hist, capacity), capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(s), np.int64)
        for x in np.unique(s):
            here = s == x
            lo, hi = np.searchsorted(lengths, [x, x + 1])
            at[here] = lo + np.searchsorted(firsts[lo:hi], r[here], "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + r - firsts[at], "offset": offsets[at]})

    ranked = running_total(pieces, [length], order, F.lit(1), "_rank", buckets_for(max(hist.values(), default=0)))
    return ranked.withColumn("_place", place(length, "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """``docs`` without ``text``, a row for each piece: ``piece``, ``start``,
    ``length`` and ``ids`` (little-endian unsigned 32-bit)."""
    coded = with_ids(docs, path, end_id, out="ids")
    n = F.expr("octet_length(ids) div 4")
    first = F.when(n % capacity == 0, F.lit(capacity)).otherwise(n % capacity)
    keep = [c for c in coded.columns if c != "ids"]
    rows = coded.select(*keep, "ids", n.alias("_n"), first.alias("_first"))
    rows = rows.select("*", F.explode(F.expr(f"sequence(0L, (_n - _first) div {capacity})")).alias("_p"))
    start = F.when(F.col("_p") == 0, F.lit(0)).otherwise(F.col("_first") + (F.col("_p") - 1) * capacity).cast("long")
    rows = rows.withColumn("start", start).withColumn("length", F.when(F.col("_p") == 0, F.col("_first")).otherwise(F.lit(capacity)).cast("long"))
    return rows.select(*keep, F.col("_p").cast("int").alias("piece"), "start", "length", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"))


def pack_digests(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Packs whole documents; each piece with a checksum in place of its ids."""
    pieces = token_pieces(docs.select("doc_id", "text"), path, end_id, capacity)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialise(pieces, "pack-pieces"), capacity, ["doc_id", "piece", "ids_crc32"])
