"""Optional Structured Streaming forms: re-indexing, service aggregates, budget stops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrain.operators import chunking
from lexigrain.sources import documents as src


def reindex_stream(docs: DataFrame, folder: str, checkpoint: str, limits: chunking.ChunkLimits = chunking.ChunkLimits()):
    """Indexes new and changed documents of a stream of (document_id, text), batch by batch."""

    def batch(new: DataFrame, _: int) -> None:
        spark = new.sparkSession
        latest = new.select("document_id", "text", chunking.content_hash("text").alias("content_hash")).dropDuplicates(["document_id"])
        stored = src.current(spark, folder, "documents")
        if stored is not None:
            stale = chunking.unindexed(latest, stored)
            latest = latest.join(stale, "document_id", "left_semi")
        latest = latest.cache()
        if not latest.isEmpty():
            src.index_documents(spark, folder, latest, chunking.chunk_documents(latest, limits))
        latest.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type in tumbling windows; later events are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def budget_stops(turns: DataFrame, max_turns: int, max_cost: float) -> DataFrame:
    """(run_id, turn, stop_reason) once per run, as soon as a limit is reached."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, cost, stopped = state.get if state.exists else (0, 0.0, False)
        out = []
        for b in batches:
            for t in b.sort_values("turn").itertuples():
                if stopped:
                    break
                n, cost = n + 1, cost + (0.0 if pd.isna(t.cost_usd) else t.cost_usd)
                reason = "max_turns" if n >= max_turns else "max_cost" if cost >= max_cost else None
                if reason:
                    out.append((key[0], t.turn, reason))
                    stopped = True
        state.update((n, cost, stopped))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "turn", "stop_reason"])

    return turns.select("run_id", "turn", "cost_usd").groupBy("run_id").applyInPandasWithState(
        step, "run_id long, turn long, stop_reason string", "n int, cost double, stopped boolean", "append", GroupStateTimeout.NoTimeout)
