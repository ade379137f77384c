"""Quality classifier by co-training.

Two views see each document. The content view reads the text only: its hashed
words, and the shape of its characters and lines. The page view reads metadata
only: source, language and recorded length. Each is a naive Bayes classifier
over the classes' counts, calibrated on labelled documents that neither counts.
In each round every unlabelled document of the corpus is judged by both views,
and what one view is sure of is counted as a label by the other; pseudo-labels
of a class weigh as much as its true ones at most. At the end a regression on
the held-back labels joins both views into one probability.

Texts are read once for the fit; the rounds read the places of their features,
and the driver gets one count for each class and feature. Only calibration
uses a sample: at most ``CALIBRATION_ROWS`` labels of each class (smallest
hashes of ``doc_id``).

Defined results
    null text is empty, whatever its length counts whole; null metadata is a
    value of its own; with fewer than ``MIN_LABELS`` labels of either kind every
    score is 0.5 and every document is kept; of contradicting labels of a
    document the better counts; rows without ``doc_id`` are unlabelled; rows
    that share one share its label; repeated rows are scored each; an empty
    table gives an empty result; further columns are carried along, but for
    those named like the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import leaving, materialise, small_side, worker_cache

#: Held-back labels of each class that calibrate at most, and one label in how
#: many is held back.
CALIBRATION_ROWS, HELD_BACK, MIN_LABELS = 4_000, 5, 10
#: Places for hashed words, shape figures (in BINS steps each) and metadata.
WORDS, FIGURES, BINS, VALUES = 1 << 14, 11, 24, 1 << 11
WIDTH = WORDS + FIGURES * BINS + VALUES
#: Groups of features with a score each: words and shape make the content view.
GROUPS = ((0, WORDS), (WORDS, WORDS + FIGURES * BINS), (WORDS + FIGURES * BINS, WIDTH))
ROUNDS, SURE, PRIOR = 3, 0.97, 2.0
#: Documents below this probability of being good are rejected.
THRESHOLD = 0.2
BATCH_ROWS, MEMO_WORDS = 128, 100_000


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word) & (WORDS - 1)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h


_KIND = np.full(256, 5, np.int64)  # other bytes, letters beyond ASCII among them
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"?-()")):
    _KIND[list(_chars)] = _k
_KIND[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6


def features(texts: list[str | None], sources: list, langs: list, chars: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct features of all documents end to end, and how
    many each has; a document's come in ascending order."""
    import zlib

    raw = [(t or "").encode() for t in texts]
    split = [r.split() for r in raw]
    n = len(raw)
    size = [len(w) for w in split]
    places = worker_cache("quality words", _Places)
    place = np.fromiter((p for w in split for p in map(places.__getitem__, w)), np.int64, sum(size))
    there = np.zeros((n, WORDS), bool)
    there[np.repeat(np.arange(n), size), place] = True
    row, col = np.nonzero(there)

    length = np.array([len(r) for r in raw], np.int64)
    kind = np.bincount(np.repeat(np.arange(n), length) * 7 + _KIND[np.frombuffer(b"".join(raw), np.uint8)], minlength=7 * n).reshape(-1, 7)
    shape = np.zeros((n, FIGURES))
    shape[:, :7] = np.sqrt(kind / np.maximum(length, 1)[:, None])
    page = np.zeros((n, 3), np.int64)
    base = GROUPS[2][0]
    for i, (r, words, s, lang, c) in enumerate(zip(raw, split, sources, langs, chars)):
        lines = [x for x in r.split(b"\n") if x.strip()]
        m = max(1, len(words))
        shape[i, 7:] = len(set(lines)) / max(1, len(lines)), len(set(words)) / m, min(1.0, len(r) / m / 40), min(1.0, m / max(1, len(lines)) / 400)
        # source, language and the order of magnitude of the length, each in a
        # third of the places
        bits = -1 if c is None else int(max(0, c)).bit_length()
        page[i] = [base + k * (VALUES // 3) + zlib.crc32(v.encode()) % (VALUES // 3) for k, v in enumerate(("null" if s is None else f"s{s}", "null" if lang is None else f"l{lang}", f"n{bits}"))]
    steps = WORDS + np.arange(FIGURES) * BINS + np.minimum((shape * BINS).astype(np.int64), BINS - 1)
    more = np.concatenate((steps, page), 1)
    row = np.concatenate((row, np.repeat(np.arange(n), more.shape[1])))
    col = np.concatenate((col, more.ravel()))
    order = np.argsort(row, kind="stable")
    return col[order], np.bincount(row, minlength=n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with equal weight for both classes (Adam); the last
    number is the intercept."""
    scale = np.maximum(np.abs(x).max(0, initial=0.0), 1e-9)
    x = np.column_stack((x / scale, np.ones(len(x))))
    w, m, v = np.zeros((3, x.shape[1]))
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for k in range(1, steps + 1):
        grad = x.T @ ((_sigmoid(x @ w) - y) * weight) + ridge * np.append(w[:-1], 0) / len(w)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return np.append(w[:-1] / scale, w[-1])


@dataclass
class Model:
    weights: np.ndarray  # log ratio of good to bad for each feature
    content: np.ndarray  # calibration of the words' and the shape's score
    page: np.ndarray  # calibration of the metadata's score
    mix: np.ndarray  # weights of both views, intercept

    def group_scores(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mean weight of each group of features, by document."""
        doc = np.repeat(np.arange(len(count)), count)
        group = np.searchsorted([g[1] for g in GROUPS], place, "right")
        key, cells = doc * len(GROUPS) + group, len(count) * len(GROUPS)
        return (np.bincount(key, self.weights[place], cells) / np.maximum(np.bincount(key, minlength=cells), 1)).reshape(-1, len(GROUPS))

    def views(self, scores: np.ndarray) -> np.ndarray:
        """Calibrated logits of both views."""
        both = np.column_stack((scores[:, :2] @ self.content[:-1] + self.content[-1], scores[:, 2:] @ self.page[:-1] + self.page[-1]))
        return np.clip(both, -12, 12)

    def scores(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of a good document: joined, by content, by page."""
        z = self.views(self.group_scores(place, count))
        return np.column_stack([_sigmoid(z @ self.mix[:2] + self.mix[2]), _sigmoid(z)])


def bayes_weights(true: np.ndarray, pseudo: np.ndarray) -> np.ndarray:
    """Log ratios from counts by class and feature (rows: bad, good). Pseudo
    counts of a class are scaled down to its true ones, and each class has
    prior counts in proportion to its size, so what is unseen says nothing."""
    out = np.zeros(WIDTH)
    for lo, hi in GROUPS:
        n, extra = true[:, lo:hi].astype(float), pseudo[:, lo:hi].astype(float)
        n += extra * np.minimum(1.0, n.sum(1) / np.maximum(extra.sum(1), 1))[:, None]
        size = np.maximum(n.sum(1), 1)
        prior = PRIOR * size / size.sum() * 2
        logs = np.log((n + prior[:, None]) / (size + prior * (hi - lo))[:, None])
        out[lo:hi] = logs[1] - logs[0]
    return out


def _unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    rows = batch.column(at).to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").astype(np.int64), np.array([len(r) // 2 for r in rows], np.int64)


def _counts(rows: DataFrame, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """True and pseudo counts by class and feature over all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, judge = np.zeros((2, 2, WIDTH), np.int64), shared.value
        for batch in batches:
            y, (place, count) = batch.column(0).to_numpy(), _unpacked(batch, 1)
            content = place < GROUPS[1][1]
            for c in (0, 1):
                total[0, c] += np.bincount(place[np.repeat(y == c, count)], minlength=WIDTH)
            if judge is not None and len(y):
                z = judge.views(judge.group_scores(place, count))
                edge = np.log(SURE / (1 - SURE))
                for c, sure in enumerate((z < -edge, z > edge)):
                    sure &= (y < 0)[:, None]
                    # what the page is sure of teaches the content, and the other way
                    use = np.where(content, np.repeat(sure[:, 1], count), np.repeat(sure[:, 0], count))
                    total[1, c] += np.bincount(place[use], minlength=WIDTH)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int64()) for a in at), pa.array(total[at])], ["k", "c", "b", "n"])

    parts = rows.select("y", "places").mapInArrow(leaving(run), "k long, c long, b long, n long")
    sums = parts.groupBy("k", "c", "b").agg(F.sum("n").alias("n")).toPandas()  # at most 4 WIDTH rows
    out = np.zeros((2, 2, WIDTH))
    out[sums["k"], sums["c"], sums["b"]] = sums["n"]
    return out[0], out[1]


def _calibrated(held: DataFrame, weights: np.ndarray) -> Model:
    """The model with these weights, fitted to the held-back labels."""
    model = Model(weights, np.zeros(3), np.zeros(2), np.zeros(3))
    shared = held.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.group_scores(*_unpacked(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, s.T)], ["y", "a", "b", "c"])

    # at most CALIBRATION_ROWS rows of each class; sorted, as sums depend on it
    got = held.select("y", "places").mapInArrow(leaving(run), "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    y, s = got["y"].to_numpy(float), got[["a", "b", "c"]].to_numpy(float)
    model.content, model.page = regression(s[:, :2], y), regression(s[:, 2:], y)
    model.mix = regression(model.views(s), y)
    return model


def _column(docs: DataFrame, name: str, kind: str):
    return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)


def _views(docs: DataFrame) -> list:
    """What the two views see of ``docs``."""
    return [F.col("text"), _column(docs, "source", "string"), _column(docs, "lang", "string"), _column(docs, "n_chars", "long")]


def _places_of(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return features(*(part.column(at + k).to_pylist() for k in range(4)))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Co-trains on all of ``docs``; None without labels of both kinds."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                place, count = _places_of(part, 1)
                cut = np.concatenate(([0], np.cumsum(count)))
                flat = place.astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["doc_id", "places"])

    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    turn = F.xxhash64("doc_id")
    kinds = [known.where((F.col("y") == c) & (F.pmod(turn, F.lit(HELD_BACK)) == 0)).orderBy(turn, "doc_id").limit(CALIBRATION_ROWS) for c in (0, 1)]
    held = kinds[0].unionByName(kinds[1]).select("doc_id", F.lit(True).alias("held"))
    known = materialise(known.join(held, "doc_id", "left").select("doc_id", "y", F.coalesce("held", F.lit(False)).alias("held")), "quality-labels")
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_views(docs)).mapInArrow(leaving(describe), "doc_id long, places binary")
    rows = seen.join(small_side(known), "doc_id", "left")
    rows = materialise(rows.select(F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("held", F.lit(False)).alias("held"), "places"), "quality-features")

    sizes = {(r["y"], r["held"]): r["n"] for r in rows.where("y >= 0").groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    enough = all(sizes.get((c, False), 0) + sizes.get((c, True), 0) >= MIN_LABELS and sizes.get((c, False)) and sizes.get((c, True)) for c in (0, 1))
    if not enough:
        return None
    held = materialise(rows.where("held"), "quality-held")
    free = rows.where("not held")
    true, pseudo = _counts(free.where("y >= 0"), None)
    model = _calibrated(held, bayes_weights(true, pseudo))
    for _ in range(ROUNDS):
        true, more = _counts(free, model)
        if (more == pseudo).all():
            break  # neither view has anything new to say
        pseudo = more
        model = _calibrated(held, bayes_weights(true, pseudo))
    return model


def with_scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score``, ``text_score``, ``page_score`` and ``kept``."""
    names = ["score", "text_score", "page_score"]
    own = [f for f in docs.schema.fields if f.name not in (*names, "kept")]
    docs = docs.select(*docs.columns)
    if model is None:
        return docs.select(*[f.name for f in own], *[F.lit(0.5).alias(n) for n in names], F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                s = shared.value.scores(*_places_of(part, len(own)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *map(pa.array, s.T)], [*(f.name for f in own), *names])

    # own columns by place, so their names don't matter
    seen = docs.select(*[f.name for f in own], *[c.alias(f"_view_{len(own)}_{k}") for k, c in enumerate(_views(docs))])
    schema = T.StructType([*own, *(T.StructField(n, T.DoubleType()) for n in names)])
    return seen.mapInArrow(leaving(run), schema).withColumn("kept", F.col("score") >= threshold)


def kept_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach ``threshold``, whatever other columns
    they have."""
    if model is None:
        return docs
    shared, width = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns)  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                good = shared.value.scores(*_places_of(part, width))[:, 0] >= threshold
                yield pa.RecordBatch.from_arrays(part.columns[:width], part.schema.names[:width]).filter(pa.array(good))

    seen = docs.select(*docs.columns, *[c.alias(f"_view_{width}_{k}") for k, c in enumerate(_views(docs))])
    return seen.mapInArrow(leaving(run), docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    told = with_scores(docs.select("doc_id", "text", *[c for c in ("source", "lang", "n_chars") if c in docs.columns]), learn(docs, labels))
    return told.select("doc_id", "score", "text_score", "page_score", "kept")
