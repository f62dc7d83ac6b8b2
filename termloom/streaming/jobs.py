"""Incremental jobs: the batch functions on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there and stop; a rerun with the same checkpoint goes on where it ended."""
    q = df.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()


def standardise_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> DataFrame:
    """Inputs are standardised as they come: each micro-batch goes through the batch chain, and becomes a folder of its own (written again after a failure)."""

    def save(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return source.sparkSession.read.parquet(sink).drop("batch")


def upsert_batches(df: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """The latest state of an updating aggregate, a folder per batch."""

    def save(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    q = df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    every = df.sparkSession.read.parquet(sink)
    newest = every.agg(F.max("batch").alias("_b"))
    return every.crossJoin(F.broadcast(newest)).filter("batch = _b").drop("batch", "_b")


def progress_stream(events: DataFrame, by: str, totals: DataFrame | None = None) -> DataFrame:
    """Running counters of a batch of work: processed, success, errors; with `totals` (by, total) also percentage (to one place, 0 without work) and status."""
    bad = F.col("event_type") == "error"
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("processed"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("errors"))
    if totals is None:
        return counts
    share = F.when(F.col("total") > 0, F.round(100 * F.col("processed") / F.col("total"), 1)).otherwise(0.0)
    return counts.join(totals, by).withColumn("percentage", share).withColumn("status", F.when(F.col("processed") < F.col("total"), "processing").otherwise("completed"))


def with_live_decisions(source: DataFrame, decisions: Callable[[SparkSession], DataFrame], key: str, sink: str, checkpoint: str) -> DataFrame:
    """Each micro-batch is joined with the decisions as they are then."""

    def save(batch: DataFrame, n: int) -> None:
        d = decisions(batch.sparkSession)
        batch.join(d, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending"))).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    q = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return source.sparkSession.read.parquet(sink).drop("batch")


def metrics_stream(events: DataFrame, hours: int, late: str = "2 hours") -> DataFrame:
    """Counts and means per window; windows are final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def dedup_stream(events: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the delay; state is dropped behind the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def spaced_stream(events: DataFrame, key: list[str], seconds: int, late: str = "1 hour") -> DataFrame:
    """Of each key's rows, in order of `ts`, the first and then each that lies over `seconds` after the last one kept.

    The state of a key is the time of its last kept row, held until the watermark has passed it by `seconds`; rows that come later than `late` are lost to it.
    `events` has the key's columns and ts; rows of a batch are taken in order, of equal times the first.
    """
    names = [*key, "ts"]
    kinds = events.select(*names).schema

    def keep(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        kept = []
        for ts in sorted(t for part in rows for t in part["ts"]):
            if last is None or (ts - last).total_seconds() > seconds:
                kept.append(ts)
                last = ts
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int(last.value // 1_000_000) + 1000 * seconds, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({**{c: [v] * len(kept) for c, v in zip(key, k, strict=True)}, "ts": kept})

    timed = events.select(*names).withWatermark("ts", late)
    return timed.groupBy(*key).applyInPandasWithState(keep, kinds, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def decided_stream(events: DataFrame, decisions: DataFrame, key: str, hold: int, late: str = "1 hour") -> DataFrame:
    """Each event with the newest decision on its key that came before it: (key, event_id, ts, decision), "pending" without one.

    Both are streams, `events` of (key, event_id, ts), `decisions` of (key, decision, ts). The newest decision of a key is held in state, from batch to batch,
    until the watermark is `hold` seconds past it; rows of one batch are taken by time, decisions first. So an event after a decision differs
    from one before it, whichever micro-batches bring them.
    """
    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.col("event_id").cast("long").alias("event_id"), "ts", F.lit(None).cast("string").alias("decision"))
    marks = decisions.select(key, F.lit(None).cast("long").alias("event_id"), "ts", "decision")

    def decide(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, at = state.get if state.exists else (None, 0)
        found = []
        for row in sorted((r for part in parts for r in part.itertuples()), key=lambda r: (r.ts, r.decision is None, r.event_id)):
            moment = int(row.ts.value // 1000)
            if row.decision is not None:
                newest, at = (row.decision, moment) if moment >= at else (newest, at)
            else:
                known = newest if newest is not None and at <= moment else None
                found.append((k[0], row.event_id, row.ts, known or "pending"))
        if newest is not None:
            state.update((newest, at))
            state.setTimeoutTimestamp(max(at // 1000 + 1000 * hold, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(found, columns=[key, "event_id", "ts", "decision"])

    both = rows.unionByName(marks).withWatermark("ts", late)
    schema = f"{key} {kind}, event_id long, ts timestamp, decision string"
    return both.groupBy(key).applyInPandasWithState(decide, schema, "decision string, at long", "append", GroupStateTimeout.EventTimeTimeout)
