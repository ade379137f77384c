"""Substring deduplication by difference-cover anchors.

A window of ``WINDOW`` words that also starts in a document of a smaller id is
removed there. Only windows of ``ANCHOR`` words at places of the difference
cover ``COVER`` modulo ``PERIOD`` are hashed at first: for any two places in two
documents some shift below ``PERIOD`` brings both onto the cover, so two equal
long windows always share an anchor at the same shift. Anchors that only one
document has end there. From the others the match is extended: every long window
around a shared anchor is hashed whole (128 bits), and the least id that has the
window decides.

How it runs
    Of texts that are equal, only that of the least id is searched; each other one
    goes whole. Anchors are made unique in each chunk of documents before they are shuffled:
    of an anchor that several documents of a chunk have, the least and the
    greatest id stand for all, the others are already known to be shared and are
    dealt evenly. The same holds for the long windows. So a passage that a third
    of all documents hold sends two rows a chunk. What is shared returns to its
    document by id; the texts are shuffled once and read from that shuffle by
    both passes.

Defined results
    Null text has no words. Documents with null id keep all words and cause no
    removal. Rows with equal ids are one document: what is removed depends on
    the id and the words. Ties don't exist: the least id keeps. An empty table
    gives an empty result. A text of any length is taken whole: a task holds
    one document and a few arrays of its length. Further columns, whatever their
    names, are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_skewed, materialise

WINDOW = 13
#: For every two remainders modulo PERIOD, some shift takes both into COVER
#: (a perfect difference set). An anchor and the largest shift fill a window.
PERIOD, COVER = 7, (0, 1, 3)
#: Words that are made unique together before a shuffle; one document may hold more.
CHUNK_WORDS = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _words(text: bytes | None) -> list[bytes]:
    """Runs of bytes that are no white space (0x20, 0x09 to 0x0D)."""
    return text.split() if text else []


def _codes(words: Iterable[bytes], count: int) -> np.ndarray:
    """Two 64-bit numbers for each word; a distinct word is hashed once."""
    number = _Numbered()
    which = np.fromiter(map(number.__getitem__, words), np.int64, count)
    digests = b"".join(map(xxhash.xxh3_128_digest, number))
    return np.frombuffer(digests, "<u8").reshape(-1, 2)[which]


def _rolled(codes: np.ndarray, width: int, half: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = max(len(codes) - width + 1, 0)
    h, m = np.zeros(n, np.uint64), _MULTIPLIERS[half]
    for j in range(width):
        h = h * m + codes[j : j + n, half]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _salted(keys: tuple[np.ndarray, ...], ids: np.ndarray, both_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of distinct ``keys`` and id, and a salt for each: 0 for the least
    id of the keys (and the greatest, if asked), else not 0."""
    order = np.lexsort((ids, *keys))
    sorted_keys, d = [k[order] for k in keys], ids[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    new_id = new_key.copy()
    new_id[1:] |= d[1:] != d[:-1]
    order, first, d = order[new_id], new_key[new_id], d[new_id]
    stands = first.copy()
    if both_ends and len(first):
        stands[:-1] |= first[1:]
        stands[-1] = True
    mixed = (sorted_keys[0][new_id] ^ d.view(np.uint64)) * _MULTIPLIERS[0] >> np.uint64(44)
    salt = np.where(stands, 0, 1 + mixed.astype(np.int64)).astype(np.int32)
    as_read = np.argsort(order)  # a document's rows stay together, which packs well in a shuffle
    return order[as_read], salt[as_read]


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows of the batches with their words in place of the text, so many at
    once that they have CHUNK_WORDS or a little more."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = _words(row[text])
            rows.append((*row[:text], words, *row[text + 1 :]))
            held += len(words)
            if held >= CHUNK_WORDS:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _laid_out(rows: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of all rows, and for each word its row, its place and
    how many words are left there; documents shorter than a window have none left."""
    n = np.array([len(r[1]) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    left = np.where(n[row] < window, 0, n[row] - place)
    return _codes((w for r in rows for w in r[1]), len(row)), row, place, left


def _anchors(codes: np.ndarray, place: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors and the words they start at."""
    width = window - PERIOD + 1
    h = _rolled(codes, width, 0)
    at = np.flatnonzero((left[: len(h)] >= width) & np.isin(place[: len(h)] % PERIOD, COVER))
    return h[at], at


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 1):
            codes, row, place, left = _laid_out(chunk, window)
            h, at = _anchors(codes, place, left, window)
            ids = np.array([r[0] for r in chunk], np.int64)[row[at]]
            keep, salt = _salted((h,), ids, True)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(salt), pa.array(ids[keep])], ["h", "salt", "id"])

    return rows


def _window_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 1):
            codes, row, place, left = _laid_out(chunk, window)
            h, at = _anchors(codes, place, left, window)
            live = np.zeros(len(codes) + PERIOD, bool)
            edges = np.searchsorted(row[at], np.arange(len(chunk) + 1))
            for i, (_, _, shared) in enumerate(chunk):
                mine = slice(edges[i], edges[i + 1])
                live[at[mine]] = np.isin(h[mine], np.array(shared, np.int64).view(np.uint64))
            around = np.logical_or.reduce([live[j : j + len(codes)] for j in range(PERIOD)])
            at = np.flatnonzero(around & (left >= window))
            a, b = _rolled(codes, window, 0)[at], _rolled(codes, window, 1)[at]
            ids = np.array([r[0] for r in chunk], np.int64)[row[at]]
            keep, salt = _salted((b, a), ids, False)
            columns = [a[keep].view(np.int64), b[keep].view(np.int64), salt, ids[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "salt", "id"])

    return rows


def _cut_rows(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 1):
            out = []
            cut = [r for r in chunk if r[2] and not r[3]]
            codes, row, _, left = _laid_out(cut, window)
            a = _rolled(codes, window, 0)
            starts = np.searchsorted(row, np.arange(len(cut) + 1))
            gone = {}
            for i, (_, words, repeated, _) in enumerate(cut):
                lo, n = starts[i], max(len(words) - window + 1, 0)
                hit = np.flatnonzero(np.isin(a[lo : lo + n], np.array(repeated, np.int64).view(np.uint64)))
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + window, -1)
                gone[i] = np.cumsum(covered)[:-1] > 0
            turn = iter(range(len(cut)))
            for doc_id, words, repeated, copy in chunk:
                if copy and len(words) >= window:
                    kept = []
                elif repeated and not copy:
                    dropped = gone[next(turn)]
                    kept = [w for w, x in zip(words, dropped.tolist(), strict=True) if not x]
                else:
                    kept = words
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out[k : k + 1000]], schema)

    return rows


def _copies(texts: DataFrame) -> DataFrame:
    """``id`` and the hashes of those of its texts that a smaller id has, too."""
    named = texts.where("text IS NOT NULL").select("id", F.md5("text").alias("name"), F.xxhash64("text").alias("hash"))
    least = named.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("most > least")
    least = materialise(least.drop("most"), "copies")
    later = join_skewed(named, least, ["name"], "n").where("id > least")
    return later.groupBy("id").agg(F.collect_set("hash").alias("copies"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left,
    joined by one space) of every row of ``docs``."""
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    known = texts.where("id IS NOT NULL").join(_copies(texts.where("id IS NOT NULL")), "id", "left")
    copy = F.coalesce(F.array_contains("copies", F.xxhash64("text")), F.lit(False))
    known, unknown = known.select("id", "text", copy.alias("copy")), texts.where("id IS NULL")

    anchors = known.where("NOT copy").select("id", "text").mapInArrow(_anchor_rows(window), "h long, salt int, id long")
    same = Window.partitionBy("h", "salt")
    shared = anchors.withColumn("other", F.max("id").over(same) > F.min("id").over(same)).where("salt <> 0 OR other")
    shared = shared.groupBy("id").agg(F.collect_list("h").alias("found"))

    long = known.where("NOT copy").join(shared, "id").select("id", "text", "found").mapInArrow(_window_rows(window), "a long, b long, salt int, id long")
    same = Window.partitionBy("a", "b", "salt")
    repeated = long.withColumn("least", F.min("id").over(same)).where("salt <> 0 OR id > least")
    repeated = repeated.groupBy("id").agg(F.collect_list("a").alias("found"))

    judged = known.join(repeated, "id", "left").select("id", "text", "found", "copy")
    nothing = unknown.select("*", F.lit(None).cast("array<long>").alias("found"), F.lit(False).alias("copy"))
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    out = judged.mapInArrow(_cut_rows(window), schema).unionByName(nothing.mapInArrow(_cut_rows(window), schema))
    return out.withColumn("kept", F.col("kept").cast("string"))
