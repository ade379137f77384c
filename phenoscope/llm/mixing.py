"""Mixing sources to target weights.

Each source is a stream of words cut into fixed-length blocks. Every output
shard draws how many slots each source gets (multinomial, out of what the
source still has to give, so the totals are exact), the slots of a source are
numbered through, and a pseudorandom permutation of the block numbers, another
one for each pass, says which block a slot holds. Blocks and slots are joined
by block number.

Defined results
    null text has no words; a null source is a source of its own, last in
    order; documents without words are never taken; repeated rows are separate
    rows; an empty table gives an empty result; reruns give equal rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_ROWS, SPACE, WORD, buckets_for, materialise, running_total, text_or_empty

BLOCK_WORDS = 256
OUT_SHARDS = 64
_ROUNDS = 4


def targets_for(sizes: list[int], weights: list[float], share: float = 1.5, limit: float = 2.0) -> list[float]:
    """Words for each source: ``share`` of all words by weight, none above
    ``limit`` times the source; what is cut off goes to the others by weight."""
    out = [0.0] * len(sizes)
    left, active = share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while active:
        unit = left / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > limit * sizes[i]]
        for i in over or active:
            out[i] = float(limit * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """The place of ``i`` in a keyed permutation of ``range(n)``: a Feistel
    network over the next even number of bits, walked until it falls inside."""
    i, n, key = (np.asarray(a).astype(np.uint64) for a in (i, n, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), i.copy(), np.ones(len(i), bool)
    order = range(_ROUNDS)[::-1] if back else range(_ROUNDS)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo]
            a, b = out[todo] >> h, out[todo] & m
            for r in order:
                salt = k * np.uint64(2 * _ROUNDS + 1) + np.uint64(r)
                if back:
                    a, b = b ^ (_mix64(a + (salt << np.uint64(32))) & m), a
                else:
                    a, b = b, a ^ (_mix64(b + (salt << np.uint64(32))) & m)
            out[todo] = (a << h) | b
            todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _block_of(place: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(place.to_numpy(), blocks.to_numpy(), key.to_numpy()))


def _slots(size: int, words: int, block: int, code: int, seed: int) -> tuple[int, int]:
    """Slots a source needs for ``words``, and how many words of the last slot
    count."""
    if not size or not words:
        return 0, 0
    blocks = -(-size // block)
    full, rest = divmod(words, size)
    if not rest:
        return full * blocks, block
    short = block * blocks - size
    at = int(permute([blocks - 1], [blocks], [pass_key(seed, code, full)], back=True)[0])
    upto = lambda m: m * block - (short if at < m else 0)
    m = -(-rest // block)
    if upto(m) < rest:
        m += 1
    return full * blocks + m, rest - upto(m - 1)


def pass_key(seed: int, code: int, turn: int) -> int:
    return (seed * 1_000_003 + code) * 8 + turn


def _draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots by shard and source: a multinomial draw for each shard out of what
    is left, so that the columns add up to ``slots``."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    each, over = divmod(int(left.sum()), shards)
    sizes = [each + (k < over) for k in range(shards)]
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k, room in enumerate(sizes):
        while room:
            got = np.minimum(rng.multinomial(room, left / left.sum()), left)
            out[k] += got
            left -= got
            room -= int(got.sum())
    return out


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words, a hash of the text, a row
    number and ``more``, written together: ids may be null or repeated, so
    only the row number says which row is meant."""
    size = F.coalesce(F.regexp_count(text_or_empty(), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"), *more)
    return materialise(rows, "mix-docs" if more else "mix-sizes")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words, ``_hash`` of the text and a
    row number."""
    return _keyed(docs)


def mix(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = BLOCK_WORDS, shards: int = OUT_SHARDS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Mixes ``rows`` (from ``sized``).

    Returns the sources (``source``, ``source_size``, ``target``) and the mix:
    ``shard, slot, source, _row, doc_start, n_words``, one row for each run of
    words of a document in a block.
    """
    spark = rows.sparkSession
    # the driver holds a few numbers for each source
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    aims = targets_for(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, limit)
    need = [_slots(n, round(t), block, i, seed) for i, (n, t) in enumerate(zip(sizes, aims))]
    draws = _draws([m for m, _ in need], shards, seed)
    upto = np.cumsum(draws, 0)
    shard, code = np.nonzero(draws)
    plan = pa.table({"shard": pa.array(shard, pa.int32()), "code": pa.array(code, pa.int32()), "lo": (upto - draws)[shard, code], "hi": upto[shard, code]})
    table = [(r["source"], i, n, t, m, last, max(1, -(-n // block))) for i, (r, n, t, (m, last)) in enumerate(zip(found, sizes, aims, need))]
    sources = spark.createDataFrame(table, "source string, code int, source_size long, target double, slots long, last_words long, blocks long")
    few = F.broadcast if len(table) <= BROADCAST_ROWS else lambda side: side

    # a row for each slot: first runs of 4096 slots, dealt evenly, then each
    runs = spark.createDataFrame(plan, "shard int, code int, lo long, hi long")
    runs = runs.select("shard", "code", "hi", F.explode(F.expr("sequence(lo, hi - 1, 4096L)")).alias("lo")).repartition("shard", "code", "lo")
    slots = runs.select("shard", "code", F.explode(F.expr("sequence(lo, least(lo + 4095L, hi - 1))")).alias("slot"))
    info = sources.select("code", "slots", "last_words", "blocks")
    slots = slots.join(few(info), "code")
    turn = F.floor(F.col("slot") / F.col("blocks"))
    key = (F.lit(seed * 1_000_003) + F.col("code")) * 8 + turn
    slots = slots.select(
        "shard", "code", "slot",
        _block_of(F.col("slot") % F.col("blocks"), F.col("blocks"), key.cast("long")).alias("block"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block)).alias("words"),
    )

    coded = rows.where("size > 0").join(few(sources.select("source", "code").alias("s")), F.col("s.source").eqNullSafe(rows["source"])).select(rows["*"], "code")
    biggest = max((r["rows"] for r in found), default=0)
    placed = running_total(coded, ["code"], ["doc_id", "size", "_hash", "_row"], F.col("size"), "at", buckets_for(biggest), ["doc_id", "size"])
    parts = placed.select("code", "source", "_row", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    begin = F.col("block") * block
    parts = parts.select(
        "code", "source", "_row", "block",
        F.greatest(F.col("at"), begin).alias("p0"),
        F.least(F.col("at") + F.col("size"), begin + block).alias("p1"), "at",
    )
    taken = F.least(F.col("p1"), begin + F.col("words")) - F.col("p0")
    mixed = slots.join(parts, ["code", "block"]).select("shard", "slot", "source", "_row", (F.col("p0") - F.col("at")).alias("doc_start"), taken.alias("n_words")).where("n_words > 0")
    return sources.select("source", "source_size", "target"), mixed


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, taken``."""
    rows = sized(docs)
    sources, mixed = mix(rows, **options)
    taken = mixed.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    known = sources.alias("s")
    if sources.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return (
        rows.join(taken, "_row", "left")
        .join(known, F.col("s.source").eqNullSafe(rows["source"]))
        .select("doc_id", rows["source"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: words of a row taken
    once make a row, words taken again another one, also where ``doc_id`` is
    null or repeated. A row whose words are all taken keeps its text as it is;
    of others the runs of words that the mix takes stay, one to a line.
    ``n_chars`` is counted anew.
    """
    kept = _keyed(docs, F.struct("*").alias("_doc"))
    rows = kept.drop("_doc")
    _, mixed = mix(rows, **options)
    keys = rows.select("_row", "size")
    # a run of words that is taken m times belongs to copies 1 to m
    runs = mixed.groupBy("_row", "doc_start").agg(F.sort_array(F.collect_list("n_words"), False).alias("took"))
    runs = runs.select("_row", "doc_start", F.posexplode("took").alias("copy", "n"))
    copies = runs.groupBy("_row", "copy").agg(F.sort_array(F.collect_list(F.struct("doc_start", "n"))).alias("runs"), F.sum("n").alias("words"))
    copies = copies.join(keys, "_row").select("_row", "runs", (F.col("words") == F.col("size")).alias("_whole"))
    texts = kept.select("_row", "_doc", F.col("_doc")["text"].alias("text")).join(copies, "_row")
    words = F.array_remove(F.split("text", f"[{SPACE}]+"), "")
    pick = F.transform("runs", lambda r: F.array_join(F.slice(F.col("_words"), r["doc_start"].cast("int") + 1, r["n"].cast("int")), " "))
    cut = texts.withColumn("_words", F.when(~F.col("_whole"), words))
    cut = cut.withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(F.array_join(pick, "\n")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns])
