"""Runs, trailing rates and context carried along a time line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RUN_GAP_SECONDS


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _slot(ts: str, seconds: int) -> Column:
    """Number of the time's slot of that many seconds."""
    width = F.lit(seconds * 1_000_000).cast("bigint")
    return ((_micros(ts) - F.pmod(_micros(ts), width)) / width).cast("bigint")


def runs(df: DataFrame, ts: str, gap_seconds: int = RUN_GAP_SECONDS, key: Sequence[str] = ()) -> DataFrame:
    """Runs of rows no more than the gap apart: key, start, end, rows.

    Two rows in the same slot of gap length are always in the same run, so each
    slot shrinks, map-side, to its first time, last time and count. What is
    ordered afterwards is one row per key and active slot (at 15 minutes, at
    most 96 a day), however many rows a key has.
    """
    key = list(key)
    slots = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*key, _slot(ts, gap_seconds).alias("_slot"))
        .agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("n"))
    )
    w = Window.partitionBy(*key).orderBy("_slot")
    gap = _micros("run_start") - F.lag(_micros("run_end")).over(w)
    return (
        slots.withColumn("_open", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0))
        .withColumn("_run", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*key, "_run")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n"))
        .drop("_run")
    )


def latest_run(df: DataFrame, ts: str, gap_seconds: int = RUN_GAP_SECONDS) -> DataFrame:
    """The last run over all rows, as one row."""
    found = runs(df, ts, gap_seconds)
    return found.agg(F.max_by(F.struct("run_start", "run_end", "n"), "run_start").alias("r")).select("r.*")


def trailing_counts(df: DataFrame, ts: str, seconds: int = 60, cap: int | None = None) -> DataFrame:
    """Rows in the ``seconds`` up to each distinct time, ends included; ``at_cap`` where they reach ``cap``.

    Every time is counted in its own time slot and carried into the next one,
    so slots are independent and no single task sees the whole line.
    """
    per_time = df.groupBy(ts).agg(F.count("*").alias("at_time"))
    slot = _slot(ts, seconds)
    spread = per_time.withColumn("_own", slot).withColumn(
        "_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1))
    )
    w = Window.partitionBy("_slot").orderBy(_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    counted = (
        spread.withColumn("trailing", F.sum("at_time").over(w))
        .filter("_slot = _own")
        .select(ts, "at_time", "trailing")
    )
    return counted if cap is None else counted.withColumn("at_cap", F.col("trailing") >= cap)


def hourly_thresholds(df: DataFrame, ts: str, thresholds: Sequence[int]) -> DataFrame:
    """Calls per hour with the thresholds they passed."""
    hourly = df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count("*").alias("calls"))
    levels = F.array(*[F.lit(t).cast("bigint") for t in thresholds])
    return hourly.withColumn("passed", F.filter(levels, lambda t: t <= F.col("calls")))


def carry_context(turns: DataFrame, conversation: str, order: str, context: str, out: str = "carried",
                  block: int = 1000) -> DataFrame:
    """Last context seen before or at a turn.

    Turns are filled inside blocks of consecutive turn numbers; a block's start
    takes the last context of the blocks before it, from one row per block.
    """
    slot = turns.withColumn("_block", F.floor(F.col(order) / block))
    w = Window.partitionBy(conversation, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = slot.withColumn("_local", F.last(context, ignorenulls=True).over(w))
    ends = slot.filter(F.col(context).isNotNull()).groupBy(conversation, "_block").agg(
        F.max_by(context, order).alias("_end")
    )
    blocks = slot.select(conversation, "_block").distinct().join(ends, [conversation, "_block"], "left")
    before = Window.partitionBy(conversation).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lead = blocks.withColumn("_lead", F.last("_end", ignorenulls=True).over(before)).drop("_end").filter("_lead is not null")
    return (
        inside.join(lead, [conversation, "_block"], "left")
        .withColumn(out, F.coalesce("_local", "_lead"))
        .drop("_block", "_local", "_lead")
    )
