"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS``. Two multinomials are counted,
one over every document and one over every trusted document (labelled good),
both smoothed by matching pseudo-counts.
A document's score is the mean of ``log(trusted / raw)`` over its n-grams, and
it is kept if that reaches ``THRESHOLD``. Everything is DataFrame expressions;
the two passes over the texts shuffle no more than bucket counts.

Defined results
    null text has no words and fails the base rules; documents without labels
    are raw text only; without any trusted document every ratio is 0; a trusted
    id on repeated rows counts each of them; an empty table gives an empty
    result; further columns are carried along (internal names start with
    ``_q_``).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, materialise, small_side, text_or_empty

BUCKETS = 1 << 16
#: Raw pseudo-count of each bucket; the trusted one is in proportion, so an
#: n-gram that is seen seldom says little either way.
PRIOR = 50.0
THRESHOLD = -0.15
#: Window of the repetition rule, its limit in percent, and the least words.
WINDOW, REPEAT_PERCENT, MIN_WORDS = 5, 20, 10
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur at least twice: the windows sorted by
    hash show which have an equal neighbour; their starts, in order, cover up
    to ``WINDOW`` words each."""
    n = F.size(windows)
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def start(p: Column, k: Column) -> Column:
        h = F.get(p, k)["h"]
        twice = h.eqNullSafe(F.get(p, k - 1)["h"]) | h.eqNullSafe(F.get(p, k + 1)["h"])
        return F.when(twice, F.get(p, k)["i"])

    # binding the sorted pairs to a variable keeps them from being sorted again
    starts = F.element_at(F.transform(F.array(pairs), lambda p: F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), lambda k: start(p, k))))), 1)
    covered = F.element_at(
        F.transform(
            F.array(starts),
            lambda s: F.aggregate(
                F.zip_with(F.slice(s, 2, F.size(s)), F.slice(s, 1, F.size(s) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW))),
                F.lit(WINDOW),
                lambda total, x: total + x,
            ),
        ),
        1,
    )
    return F.when(F.size(F.array_distinct(windows)) < n, covered).otherwise(F.lit(0)).cast("long")


def with_hashes(docs: DataFrame) -> DataFrame:
    """Adds ``_q_text``, ``_q_words`` and ``_q_hashes``, the words' hashes."""
    return (
        docs.withColumn("_q_text", text_or_empty())
        .withColumn("_q_words", _words(F.col("_q_text")))
        .withColumn("_q_hashes", F.transform("_q_words", lambda w: F.xxhash64(w)))
    )


def base_columns(hashed: DataFrame) -> DataFrame:
    """Adds the base counts and ``base_failed``."""
    h, n, text = F.col("_q_hashes"), F.size("_q_hashes"), F.col("_q_text")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = (
        hashed.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("_q_lines", lines)
        .withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
        .withColumn("_q_windows", windows)
        .withColumn("n_repeat_words", _repeat_words(F.col("_q_windows")))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _ngrams() -> Column:
    """Hashes of words and of pairs of neighbours."""
    h, n = F.col("_q_hashes"), F.size("_q_hashes")
    pairs = F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.concat(h, pairs)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return materialise(good.select(F.col("doc_id").alias("_q_id")).distinct(), "trusted-ids")


def ratio_table(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """``log(trusted / raw)`` for each bucket; the driver gets the counts of
    ``BUCKETS`` buckets, whatever the corpus."""
    ids = small_side(trusted)
    marked = with_hashes(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_q_id"), "left"))
    grams = marked.select(F.col("_q_id").isNotNull().cast("long").alias("t"), F.explode(_ngrams()).alias("h"))
    counts = grams.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()
    raw_all, good_all = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    table = [0.0] * BUCKETS
    if good_all:
        prior = PRIOR * good_all / raw_all
        scale = (raw_all + PRIOR * BUCKETS) / (good_all + prior * BUCKETS)
        for r in counts:
            table[r["b"]] = math.log((r["good"] + prior) / (r["raw"] + PRIOR) * scale)
    return table


def with_verdict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``llr`` and ``kept``."""
    table = ratio_table(docs, trusted_ids(labels))
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # a constant of BUCKETS numbers
    marked = base_columns(with_hashes(docs)).withColumn("_q_grams", _ngrams())
    total = F.aggregate("_q_grams", F.lit(0.0), lambda s, h: s + F.get(ratios, _bucket(h)))
    scored = marked.withColumn("llr", F.coalesce(total / F.nullif(F.size("_q_grams"), F.lit(0)), F.lit(0.0)))
    # a generator keeps filters on the verdict from being pushed below, where
    # every expression would be worked out again for each mention
    told = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr"]
    once = scored.select(*docs.columns, F.inline(F.array(F.struct(*told))))
    return once.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_verdict(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
