"""Language identification by multilingual mixtures.

Each language is a multinomial over hashed byte trigrams, counted over all
training documents. A document is a mixture of languages: expectation
maximisation estimates the proportions from the trigram likelihoods. The set of
languages starts with the single most likely one and grows by the language
with the steepest gain as long as the likelihood, less a penalty for each
language, rises.

Defined results
    null texts and texts without a letter are ``und`` with score 0, as is
    everything if nothing could be learned; of equally likely languages the
    first in code point order is taken; repeated rows are predicted each; an
    empty table gives an empty result. Any number of languages is learned; the
    model takes 64 KB for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

BUCKETS = 1 << 14
#: Documents that are counted or fitted together.
BATCH_ROWS = 128
#: Pseudo-count of a trigram, log-likelihood a further language must gain for
#: each of the log of the text's trigrams, and steps of a fit.
ALPHA, PENALTY, STEPS = 0.5, 3.0, 12
#: Numbers (n-grams of the documents times languages) that a fit holds at
#: once, and languages whose counts travel together.
FIT_CELLS, BLOCK_LANGS = 8_000_000, 64


def _trigrams(texts: list[str]) -> np.ndarray:
    """Counts by document and bucket."""
    raw = [f" {t.lower()} ".encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    code = flat[:-2] | (flat[1:-1] << np.uint32(8)) | (flat[2:] << np.uint32(16))
    place = (code * np.uint32(2654435761)) >> np.uint32(18)
    doc = np.repeat(np.arange(len(raw)), size)
    inside = doc[:-2] == doc[2:]
    key = doc[:-2][inside] * BUCKETS + place[inside].astype(np.int64)
    return np.bincount(key, minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities from ``text`` and ``lang``.
    Tasks add up their documents and send one count a language and bucket."""
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row a language
    index = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            langs = np.array([*total], np.int64)
            which, bucket = np.nonzero(np.stack([*total.values()]))
            n = np.concatenate([t[t > 0] for t in total.values()])
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs[which]), pa.array(bucket, pa.int64()), pa.array(n)], ["l", "b", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                grams = _trigrams(part.column(0).to_pylist())
                which = np.array([index[x] for x in part.column(1).to_pylist()])
                for lang in np.unique(which).tolist():
                    add = grams[which == lang].sum(0)
                    total[lang] = total[lang] + add if lang in total else add
                if len(total) > BLOCK_LANGS:
                    yield told()
        if total:
            yield told()

    counts = np.full((len(names), BUCKETS), ALPHA, np.float32)
    if names:
        parts = rows.select("text", "lang").mapInArrow(count, "l long, b long, n long")
        sums = materialise(parts.groupBy("l", "b").agg(F.sum("n").alias("n")), "lang-counts")
        for lo in range(0, len(names), BLOCK_LANGS):
            some = sums.where(F.col("l").between(lo, lo + BLOCK_LANGS - 1)).toPandas()  # BLOCK_LANGS x BUCKETS at most
            counts[some["l"], some["b"]] += some["n"]
    counts /= counts.sum(1, keepdims=True, dtype=np.float64)
    return names, counts


def fit(counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Proportions of the languages (columns) in each document (rows)."""
    n_docs, n_langs = len(counts), len(probs)
    doc, bucket = np.nonzero(counts)
    c = counts[doc, bucket].astype(float)
    p = probs[:, bucket].T.astype(float)
    total = counts.sum(1).astype(float)

    def add(values: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros((n_docs, *values.shape[1:]))
        if len(d):
            starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            out[d[starts]] = np.add.reduceat(values, starts)
        return out

    single = add(c[:, None] * np.log(p), doc)
    best = single.argmax(1)
    weights = np.eye(n_langs)[best]
    loglik = single[np.arange(n_docs), best]
    active = np.ones(n_docs, bool)
    for _ in range(n_langs - 1):
        rows = np.flatnonzero(active[doc])
        if not len(rows):
            break
        d, cc, pp = doc[rows], c[rows], p[rows]
        mix = np.einsum("ij,ij->i", pp, weights[d])
        gain = add(cc[:, None] * pp / mix[:, None], d)
        gain[weights > 0] = -np.inf
        more = gain.argmax(1)
        # a language whose gradient is no steeper than the mixture's can't help
        active &= gain[np.arange(n_docs), more] > total * (1 + 1e-6)
        rows = np.flatnonzero(active[doc])
        d, cc, pp = doc[rows], c[rows], p[rows]
        trial = np.where((weights > 0) | (np.arange(n_langs) == more[:, None]), 1.0, 0.0)
        trial /= trial.sum(1, keepdims=True)
        for _ in range(STEPS):
            r = pp * trial[d]
            r *= (cc / r.sum(1))[:, None]
            new = add(r, d)
            size = new.sum(1, keepdims=True)
            trial = np.where(size > 0, new / np.where(size > 0, size, 1), trial)
        value = add(cc * np.log(np.einsum("ij,ij->i", pp, trial[d])), d)
        active &= value - loglik > PENALTY * np.log(np.maximum(total, 2))
        weights[active], loglik[active] = trial[active], value[active]
    return weights


def predict(docs: DataFrame, names: list[str], probs: np.ndarray) -> DataFrame:
    """``docs`` with ``text`` replaced by ``lang_pred``, ``score`` (the
    proportion of that language) and ``n_langs``, the size of the set."""
    import regex

    fields = [f for f in docs.schema.fields if f.name != "text"]
    letter = r"\p{L}"
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(probs)  # BUCKETS numbers of four bytes for each language

    def of(texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        has = regex.compile(letter).search
        out = [("und", 0.0, 0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and names and has(t)]
        if known:
            grams = _trigrams([texts[i] for i in known])
            cells = np.cumsum((grams > 0).sum(1) * len(names)) // FIT_CELLS
            for turn in np.unique(cells):
                here = np.flatnonzero(cells == turn)
                for i, w in zip(here, fit(grams[here], shared.value)):
                    k = int(w.argmax())
                    out[known[i]] = (names[k], min(1.0, float(w[k])), int((w > 0).sum()))
        return tuple(map(list, zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got: tuple[list, ...] = ([], [], [])
            for k in range(0, batch.num_rows, BATCH_ROWS):
                for a, b in zip(got, of(batch.column(at).slice(k, BATCH_ROWS).to_pylist())):
                    a += b
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.int32())], [*(f.name for f in fields), "lang_pred", "score", "n_langs"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_langs", T.IntegerType())])
    return docs.select(*[f.name for f in fields], "text").mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out, predicts all."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    names, probs = learn(train)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), names, probs)
