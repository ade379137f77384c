"""Ordered series per key: lags, time-range windows, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronological(df: DataFrame, keys: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """Numbers the rows of each key in time order, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def intervals(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "delta") -> DataFrame:
    """Difference to the row before; null on the first."""
    return df.withColumn(out, value - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def trailing(keys: list[str], micros: str, width_us: int) -> Window:
    """Rows in the ``width_us`` before the current row's time, itself not."""
    return Window.partitionBy(*keys).orderBy(micros).rangeBetween(-width_us, -1)


def elastic(df: DataFrame, keys: list[str], micros: str, value: str, width_us: int, least: int, span_us: int) -> DataFrame:
    """Mean over the trailing window; where that holds fewer than ``least``
    rows, over the ``least`` rows before, if they reach back no further than
    ``span_us``. Adds ``w_n``, ``w_mean``."""
    near = trailing(keys, micros, width_us)
    last = Window.partitionBy(*keys).orderBy(micros).rowsBetween(-least, -1)
    enough = F.count(value).over(near) >= least
    reach = (F.count(value).over(last) == least) & (F.col(micros) - F.min(micros).over(last) <= span_us)
    return df.withColumn(
        "w_n", F.when(enough, F.count(value).over(near)).when(reach, F.lit(least)).otherwise(F.lit(0)).cast("long")
    ).withColumn("w_mean", F.when(enough, F.avg(value).over(near)).when(reach, F.avg(value).over(last)))


def last_sequence(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, pad: float = 0.0, out: str = "sequence") -> DataFrame:
    """The latest ``length`` values up to each row, padded on the left."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-length + 1, 0)
    got = F.collect_list(value).over(w)
    return df.withColumn(out, F.concat(F.array_repeat(F.lit(pad), F.lit(length) - F.size(got)), got))


def count_windows(df: DataFrame, keys: list[str], order: list[str], length: int, stride: int) -> DataFrame:
    """A row for each window that a row belongs to (``win``, from 0, and
    ``pos`` in it); windows that aren't full are left out."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - (length - 1)) / stride))
    high = F.least(F.floor(F.col("_i") / stride), F.floor((F.col("_n") - length) / stride))
    wins = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select("*", F.explode(wins).alias("win")).withColumn("pos", F.col("_i") - F.col("win") * stride).drop("_i", "_n")


def sessions(df: DataFrame, keys: list[str], micros: str, gap_us: int, order: list[str] | None = None, out: str = "session") -> DataFrame:
    """Numbers runs whose neighbours are at most ``gap_us`` apart, from 0."""
    w = Window.partitionBy(*keys).orderBy(*(order or [micros]))
    split = F.coalesce((F.col(micros) - F.lag(micros).over(w) > gap_us).cast("int"), F.lit(0))
    return df.withColumn("_split", split).withColumn(out, F.sum("_split").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_split")


def streaks(df: DataFrame, keys: list[str], order: list[str], flag: Column, valid: Column | None = None, on_invalid: str = "reset") -> DataFrame:
    """Adds ``streak``: how many flagged rows in a row end here.

    ``on_invalid``: ``reset`` ends the streak at an invalid row; ``skip`` and
    ``hold`` look through it (``skip`` shows 0 there, ``hold`` the streak so
    far).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    hit = ok & F.coalesce(flag, F.lit(False))
    breaks = ~hit if on_invalid == "reset" else ok & ~hit
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_hit", hit.cast("int")).withColumn("_ok", ok).withColumn("_island", F.sum(breaks.cast("int")).over(upto))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("_hit").over(inside)
    shown = run if on_invalid == "hold" else F.when(F.col("_hit") == 1, run).otherwise(F.lit(0))
    return rows.withColumn("streak", shown.cast("long")).drop("_hit", "_ok", "_island")


def first_change(df: DataFrame, keys: list[str], order: str, least: int) -> DataFrame:
    """Per key: start of the first streak that reached ``least`` rows, and the
    number of rows on which a streak was that long."""
    w = Window.partitionBy(*keys).orderBy(order)
    start = F.when(F.col("streak") == 1, F.col(order))
    begun = df.withColumn("_start", F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.col("streak") >= least
    return begun.groupBy(*keys).agg(F.min(F.when(reached, F.col("_start"))).alias("change_at"), F.count_if(reached).alias("change_count"))
