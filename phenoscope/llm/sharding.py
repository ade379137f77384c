"""Sharding by a k-d tree over document metadata.

``kd_shards`` recursively splits the documents at weighted medians along the
widest metadata dimension until every leaf carries its share of the bytes.
The medians come from distributed histograms: per level one pass for the
ranges and a few for the bins around the cut; the driver sees one row a node.
Documents can't be divided: where a heavy one lies across a cut, it goes right,
and light ones from beyond the cut go left in its place.

Defined results
    null text counts as no bytes; null metadata sorts first; rows with equal
    text stay in one shard unless the group weighs more than both the heaviest
    document and ``GROUP_SHARE`` of a leaf, in which case it is dealt in pieces
    of about that weight, equal rows included; an empty table gives
    an empty result; further columns are carried along, and internal names
    start with ``_kd_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import buckets_for, each_copy, join_skewed, materialise, ranked, running_total, small_side, text_or_empty

#: Bytes that each document costs besides its text.
ROW_BYTES = 16
#: A group of equal texts up to this share of a leaf stays whole.
GROUP_SHARE = 0.05
#: Groups up to this share of a leaf may pass a cut to even out its sides.
LIGHT = 0.04
#: Bins of one histogram, and the share of a leaf by which a cut may miss.
BINS, SLACK = 512, 0.004


def with_rank(df: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with ``out``: the place of column ``name`` among its distinct
    values in order, -1 for null."""
    # distinct values are sorted by ranges, not rows
    values = materialise(df.select(name).where(F.col(name).isNotNull()).distinct(), f"kd-values-{name}")
    ranks = ranked(values, [F.asc(name)], out)
    return df.join(small_side(ranks), name, "left").withColumn(out, F.coalesce(F.col(out).cast("double"), F.lit(-1.0))).select(*df.columns, out)


def _search(points: DataFrame, state: dict[int, dict], dims: list[str], slack: float) -> list[tuple]:
    """Places where the weights along each node's dimension reach ``want``:
    ``(node, dim, value, tie, short)``. Rows strictly below lie left; ``short``
    is what a document that can't be divided leaves missing there."""
    spark, done = points.sparkSession, []
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    while state:
        todo = spark.createDataFrame(
            [(n, s["dim"], float(s["lo"]), float(s["hi"]), int(s["below"]), float(s["want"]), s["eq"]) for n, s in state.items()],
            "_kd_node int, dim int, lo double, hi double, below long, want double, eq double",
        )
        x = F.when(F.col("eq").isNull(), value).otherwise(F.col("_kd_tie"))
        inside = (
            points.join(F.broadcast(todo), "_kd_node")  # one row a node
            .withColumn("x", x)
            .where(F.col("x").between(F.col("lo"), F.col("hi")) & (F.col("eq").isNull() | (value == F.col("eq"))))
        )
        place = (F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * BINS
        bins = (
            inside.withColumn("bin", F.coalesce(F.least(F.floor(place), F.lit(BINS - 1)), F.lit(0)))
            .groupBy("_kd_node", "bin", "below", "want")
            .agg(F.sum("_kd_w").alias("w"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
        )
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("_kd_node").orderBy("bin"))
        last = Window.partitionBy("_kd_node").orderBy("bin")
        found = (
            bins.withColumn("upto", upto)
            .withColumn("next", F.lead("x_lo").over(last))
            .where(F.col("upto") >= F.col("want"))
            .withColumn("n", F.row_number().over(last))
            .where("n = 1")
            .collect()  # one row a node
        )
        for n in state.keys() - {r["_kd_node"] for r in found}:  # all of it is too little
            done.append((n, state[n]["dim"], math.inf, -math.inf, 0.0))
            del state[n]
        for r in found:
            n, s = r["_kd_node"], state[r["_kd_node"]]
            before = r["upto"] - r["w"]
            low, high = s["want"] - before, r["upto"] - s["want"]
            single = r["x_lo"] == r["x_hi"]
            if min(low, high) <= slack or (single and s["eq"] is not None):
                after = high <= slack and high < low
                edge = (math.inf if r["next"] is None else r["next"]) if after else r["x_lo"]
                short = 0.0 if after else max(0.0, low)
                done.append((n, s["dim"], s["eq"], edge, short) if s["eq"] is not None else (n, s["dim"], edge, -math.inf, short))
                del state[n]
            elif single:  # equal values: cut by their tie numbers
                s.update(eq=r["x_lo"], lo=0.0, hi=1.0, below=before)
            else:
                s.update(lo=r["x_lo"], hi=r["x_hi"], below=before)
    return done


def _cuts(points: DataFrame, open_nodes: dict[int, int], dims: list[str], spans: dict[str, float], leaf: float) -> list[tuple]:
    """For every open node (id to leaves below it) its cut: ``(node, dim,
    value, tie, light_value, light_tie)``. Rows below the first place go left,
    and light ones below the second, which make up for a document too heavy to
    be divided at the first."""
    stats = points.groupBy("_kd_node").agg(
        F.sum("_kd_w").alias("w"),
        *[F.min(d).alias(f"{d}_lo") for d in dims],
        *[F.max(d).alias(f"{d}_hi") for d in dims],
    )
    state = {}
    for r in stats.collect():  # one row a node
        k = open_nodes.get(r["_kd_node"])
        if k is None:
            continue
        widths = [((r[f"{d}_hi"] - r[f"{d}_lo"]) / spans[d], -i) for i, d in enumerate(dims)]
        i = -max(widths)[1]
        state[r["_kd_node"]] = {"dim": i, "lo": r[f"{dims[i]}_lo"], "hi": r[f"{dims[i]}_hi"], "below": 0, "want": r["w"] * (k // 2) / k, "eq": None}
    tops = {n: s["hi"] for n, s in state.items()}
    first = {c[0]: c for c in _search(points, state, dims, SLACK * leaf)}
    missing = {n: c for n, c in first.items() if c[4] > SLACK * leaf}
    second = {}
    if missing:
        at = points.sparkSession.createDataFrame([(n, c[1], float(c[2]), float(c[3])) for n, c in missing.items()], "_kd_node int, _d int, _v double, _t double")
        x = F.element_at(F.array(*dims), F.col("_d") + 1)
        right = (x > F.col("_v")) | ((x == F.col("_v")) & (F.col("_kd_tie") >= F.col("_t")))
        light = points.where(F.col("_kd_w") <= LIGHT * leaf).join(F.broadcast(at), "_kd_node").where(right).select(*points.columns)
        state = {n: {"dim": c[1], "lo": c[2], "hi": max(tops[n], c[2]), "below": 0, "want": c[4], "eq": None} for n, c in missing.items()}
        second = {c[0]: c for c in _search(light, state, dims, SLACK * leaf)}
    return [(n, d, v, t, *(second[n][2:4] if n in second else (-math.inf, -math.inf))) for n, (_, d, v, t, _) in first.items()]


def kd_shards(df: DataFrame, weight: str, dims: dict[str, Column], group: list[str], leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Adds ``shard`` (0 up to the number of leaves less one).

    ``weight``: a long column. ``dims``: numeric metadata. ``group``: columns
    that are equal on rows which should share a shard. Give ``leaves``, or
    ``target_bytes`` for as many leaves as that needs. The number of leaves
    bounds what the driver holds and what is broadcast.
    """
    names = [f"_kd_d{i}" for i in range(len(dims))]
    base = df.withColumns({n: c.cast("double") for n, c in zip(names, dims.values())} | {"_kd_w0": F.col(weight).cast("long")})
    whole = base.agg(F.sum("_kd_w0"), F.max("_kd_w0"), *[F.max(n) - F.min(n) for n in names]).first()
    total, heaviest = whole[0] or 0, whole[1] or 0
    spans = {n: (whole[2 + i] or 0) or 1.0 for i, n in enumerate(names)}
    leaves = leaves or max(1, math.ceil(total / target_bytes))
    leaf = total / leaves
    limit = max(heaviest, GROUP_SHARE * leaf, 1)

    # at most 1 / GROUP_SHARE * leaves groups can be heavier than the limit
    heavy = base.groupBy(*group).agg(F.sum("_kd_w0").alias("_kd_gw")).where(F.col("_kd_gw") > limit)
    heavy = heavy.select(*group, F.ceil(F.col("_kd_gw") / limit).cast("int").alias("_kd_n"))
    heavy = materialise(heavy, "kd-heavy")
    light = base.join(F.broadcast(heavy), group, "left_anti").select(*base.columns, F.lit(0).alias("_kd_piece"))
    copies = each_copy(base.join(F.broadcast(heavy), group).select(*base.columns, "_kd_n"), "_kd_copy")
    dealt = F.pmod(F.hash(*[c for c in df.columns if c not in group], "_kd_copy"), "_kd_n")  # equal rows part by their copy number
    rows = materialise(light.unionByName(copies.select(*base.columns, dealt.alias("_kd_piece"))), "kd-rows")

    tie = F.shiftrightunsigned(F.xxhash64(*group, "_kd_piece"), 12).cast("double") / float(1 << 52)
    points = rows.groupBy(*group, "_kd_piece").agg(F.sum("_kd_w0").alias("_kd_w"), F.count("*").alias("_kd_rows"), *[F.min(n).alias(n) for n in names])
    points = materialise(points.withColumn("_kd_tie", tie), "kd-points").withColumn("_kd_node", F.lit(0))

    spark = df.sparkSession
    below, first, fresh = {0: leaves}, {0: 0}, 1  # leaves under a node, its first shard
    while True:
        open_nodes = {n: k for n, k in below.items() if k > 1}
        cuts = _cuts(points, open_nodes, names, spans, leaf) if open_nodes and total else []
        if not cuts:
            break
        rows_ = []
        for n, dim, v, t, v2, t2 in cuts:
            k, f = below.pop(n), first.pop(n)
            below |= {fresh: k // 2, fresh + 1: k - k // 2}
            first |= {fresh: f, fresh + 1: f + k // 2}
            rows_.append((n, dim, float(v), float(t), float(v2), float(t2), fresh))
            fresh += 2
        step = spark.createDataFrame(rows_, "_kd_node int, dim int, v double, t double, v2 double, t2 double, next int")
        x = F.element_at(F.array(*names), F.col("dim") + 1)
        under = lambda v, t: (x < F.col(v)) | ((x == F.col(v)) & (F.col("_kd_tie") < F.col(t)))
        left = under("v", "t") | ((F.col("_kd_w") <= LIGHT * leaf) & under("v2", "t2"))
        points = (
            points.join(F.broadcast(step), "_kd_node", "left")  # one row a node
            .withColumn("_kd_node", F.when(F.col("next").isNull(), F.col("_kd_node")).when(left, F.col("next")).otherwise(F.col("next") + 1))
            .drop("dim", "v", "t", "v2", "t2", "next")
        )
        points = materialise(points, "kd-level")
    places = spark.createDataFrame(list(first.items()), "_kd_node int, shard int")
    placed = points.join(F.broadcast(places), "_kd_node").select(*group, "_kd_piece", "shard", "_kd_rows")
    return join_skewed(rows, placed, [*group, "_kd_piece"], "_kd_rows").select(*df.columns, "shard")


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Documents with ``size``, ``text_crc32``, ``shard`` and ``slot``, the
    gapless place inside the shard. Works on identifiers and metadata only, so
    the texts are read once and not shuffled."""
    text = text_or_empty()
    meta = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"),
        F.col("source").alias("_source_name"),
        F.col("lang").alias("_lang_name"),
    )
    meta = materialise(meta, "kd-meta")
    meta = with_rank(with_rank(meta, "_source_name", "_source"), "_lang_name", "_lang").drop("_source_name", "_lang_name")
    # not the size: every leaf needs light documents to come out even
    dims = {"source": F.col("_source"), "lang": F.col("_lang"), "id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}
    placed = kd_shards(meta, "size", dims, ["text_crc32", "_text_hash", "size"], leaves=shards)
    per_shard = buckets_for(meta.count() // shards)
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    return running_total(placed, ["shard"], ["doc_id", "text_crc32"], F.lit(1), "slot", per_shard)
