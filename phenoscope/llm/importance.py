"""Importance resampling towards a target distribution.

A dictionary of the distinct features (runs of words) of all documents is
counted; each distinct string is hashed once, into one of ``buckets``; bucket
totals of the corpus and of the target give each bucket's gain, and so each
entry's. The gains are joined to the features of every document by the string.
A document's weight is the mean gain of its features; with Gumbel noise from its
id, the highest scores are a draw without replacement by weight.

How it runs
    Features are counted in each task before they are shuffled. The join with
    the dictionary has two parts: entries above a count that at most
    ``FREQUENT`` entries reach are broadcast, so that no word that many
    documents hold is one task's work; the rest is joined by shuffle, where no
    entry holds more than its share of 1 / FREQUENT of all features. Ranks come
    from a sort by ranges, rows in each range and the sums before it.

Defined results
    Null and wordless texts have no features and weight 0. A null id is hashed
    as an empty one and comes last among equal scores. Repeated rows are scored
    and drawn each for itself. No document is drawn of an empty table, or of
    fewer than ``100 / percent`` long enough documents. An empty target leaves
    only the corpus's own rarity. A text of any length is taken whole. Further
    columns of ``docs``, whatever their names, are left out of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, ranked

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
#: Entries of the dictionary that are broadcast at most.
FREQUENT = 1 << 18
#: Distinct features that a task holds before it passes its counts on.
HELD = 1 << 18
#: Rows handed to Spark at once.
OUT_ROWS = 1 << 17
# Upper-case ASCII letters become lower-case ones; other ASCII but digits and
# letters separates words; all other bytes belong to characters beyond ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _runs(text: bytes | None, low: int, high: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of ``low`` to ``high`` of them."""
    words = text.translate(_TABLE).split() if text else []
    out = words if low == 1 else []
    for n in range(max(low, 2), high + 1):
        out = out + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), out


def _counted(low: int, high: int):
    """Features of a task's texts with their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(_runs(text, low, high)[1])
                if len(held) >= HELD:
                    yield from _batches(held)
                    held.clear()
        yield from _batches(held)

    def _batches(counts: Counter) -> Iterator[pa.RecordBatch]:
        names, n = [*counts], [*counts.values()]
        for k in range(0, len(names), OUT_ROWS):
            columns = [pa.array(names[k : k + OUT_ROWS], pa.binary()).cast(pa.string()), pa.array(n[k : k + OUT_ROWS], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "n"])

    return rows


def _listed(low: int, high: int):
    """A row for each distinct feature of each text: ``key, id, words, first,
    feature, n``. ``first`` is 1 once a text; a text without features has one
    row with a null."""
    names = ["key", "id", "words", "first", "feature", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for text, key, doc in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, runs = _runs(text, low, high)
                counts = Counter(runs) if runs else {None: 0}
                n = len(counts)
                for column, values in zip(out, ([key] * n, [doc] * n, [words] * n, [1] + [0] * (n - 1), counts, counts.values()), strict=True):
                    column += values
                if len(out[0]) >= OUT_ROWS:
                    yield _batch(out)
                    out = [[] for _ in names]
        if out[0]:
            yield _batch(out)

    def _batch(columns: list[list]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    return rows


def dictionary(docs: DataFrame, buckets: int, low: int, high: int) -> DataFrame:
    """``feature, n, bucket`` of every distinct feature, written."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_counted(low, high), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return materialise(counted.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int")), "features")


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of the buckets that the corpus fills (``buckets`` rows
    at most, written)."""
    s = corpus.groupBy("bucket").agg(F.sum("n").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    all_s, all_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (corpus, target))
    ratio = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return materialise(s.join(t, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), "gains")


def _least_frequent(entries: DataFrame) -> int:
    """The least count above which at most FREQUENT entries lie."""
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = entries.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect()  # 512 rows at most
    total, low = 0, (1 << 63) - 1
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["k"]
        if total > FREQUENT:
            break
        low = r["low"]
    return low


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, low: int = 1, high: int = 1) -> DataFrame:
    """``doc_id, words, n_features, weight, copy`` of every row of ``docs``;
    ``copy`` numbers rows that are equal."""
    entries = dictionary(docs, buckets, low, high)
    gains = bucket_gains(entries, dictionary(target, buckets, low, high), buckets)
    priced = entries.join(F.broadcast(gains), "bucket")
    least = _least_frequent(entries)
    often, seldom = (priced.where(F.col("n") >= least), priced.where(F.col("n") < least))
    often, seldom = (x.select(F.col("feature").alias("entry"), "gain") for x in (often, seldom))

    texts = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("id"))
    listed = texts.mapInArrow(_listed(low, high), "key long, id long, words long, first long, feature string, n long")
    here = F.col("feature") == F.col("entry")
    told = ["key", "id", "words", "first", "n", "gain"]
    frequent = listed.join(F.broadcast(often), here).select(*told)
    rare = listed.join(F.broadcast(often), here, "left_anti").where("feature IS NOT NULL").join(seldom, here).select(*told)
    empty = listed.where("feature IS NULL").withColumn("gain", F.lit(0).cast("long")).select(*told)
    sums = frequent.unionByName(rare).unionByName(empty).groupBy("key", "id", "words")
    sums = sums.agg(F.sum("first").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gain")).alias("g"))
    # equal rows were summed together: their mean is that of each
    weight = F.when(F.col("n") > 0, F.expr("(g - pmod(g, n)) div n")).otherwise(0)
    each = sums.select(F.col("id").alias("doc_id"), "key", "words", F.expr("n div rows").alias("n_features"), weight.alias("weight"), "rows")
    lows = each.withColumn("lo", F.explode(F.expr("sequence(0L, rows - 1, 4096L)")))
    return lows.withColumn("copy", F.explode(F.expr("sequence(lo, least(lo + 4095L, rows - 1))"))).drop("rows", "lo")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    low: int = 1,
    high: int = 1,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; a
    null ``rank`` means that it isn't drawn."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weigh(docs, target, buckets, low, high).withColumn("score", F.col("weight") + noise), "scores")
    enough = F.col("words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"), F.asc("copy")]
    places = ranked(scored.where(enough), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
