"""Status feeds, retries, leases and assembly of utterances as streams.

Every transformation here works on a stream and on a table alike, but for ``leases``, whose
stream keeps state of its own; ``lease_table`` folds a table by the same rule.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

TERMINAL = ("done", "error", "cancelled")
#: Fixed value: seconds between heartbeats of a lease.
HEARTBEAT_S = 60.0


def status_changes(events: DataFrame) -> DataFrame:
    """For each job and status how often it came; works on streams in update mode and on tables."""
    return events.groupBy("job_id", "status").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def progress(events: DataFrame) -> DataFrame:
    """S3: rows (job_id, done) of progress events that a worker sends, the largest so far."""
    return events.groupBy("job_id").agg(F.max("done").alias("done"))


def until_terminal(batch: DataFrame, seen: Callable[[DataFrame], None]) -> None:
    """Hands rows up to each job's first terminal status to a sink; for ``foreachBatch``."""
    first = batch.where(F.col("status").isin(*TERMINAL)).groupBy("job_id").agg(F.min("event_id").alias("stop"))
    seen(batch.join(first, "job_id", "left").where(F.col("stop").isNull() | (F.col("event_id") <= F.col("stop"))).drop("stop"))


def file_states(events: DataFrame) -> DataFrame:
    """The state of each file of a job from its events (job_id, filename, event_id, kind, at, category, retry_at).

    Kinds are ``processing``, ``attempt``, ``done``, ``error`` and ``retry``.  The last event sets the state; a retry waits
    until ``retry_at``, and a new attempt clears what the one before left.  ``attempts`` counts the attempts begun.
    """
    begun = F.col("kind").isin("processing", "attempt")
    last = F.max_by(F.struct("kind", "at", "category", "retry_at"), "event_id")
    out = events.groupBy("job_id", "filename").agg(last.alias("e"), F.max_by(F.when(begun, F.col("at")), F.when(begun, F.col("event_id"))).alias("started_at"), F.count_if(F.col("kind") == "attempt").alias("attempts"))
    kind = F.col("e.kind")
    failed = kind.isin("error", "retry")
    return out.select(
        "job_id", "filename", F.when(kind.isin("done", "error"), kind).otherwise("processing").alias("status"), F.when(failed, F.col("e.category")).alias("category"), "started_at",
        F.when(failed | (kind == "done"), F.col("e.at")).alias("finished_at"), F.when(kind == "retry", F.col("e.retry_at")).alias("next_eligible_at"),
        F.when(kind == "retry", "retry_scheduled").alias("stage"), "attempts",
    )


Lease = tuple[str | None, float | None, float | None]


def lease_after(lease: Lease, kind: str, node: str, at: float, ttl_s: float) -> Lease:
    """A job's lease (node, heartbeat, expiry) after an event: a claim takes only what is free or expired, a renewal or release only one's own."""
    holder, _, expires = lease
    live = holder is not None and expires is not None and expires > at
    if kind == "claim" and not live or kind == "renew" and holder == node:
        return node, at, at + ttl_s
    if kind == "release" and holder == node or kind == "terminal":
        return None, None, None
    return lease


_LEASE = "job_id long, leased_by string, heartbeat_at double, expires_at double"


def _folded(lease: Lease, rows: pd.DataFrame, ttl_s: float) -> Lease:
    for kind, node, at in rows.sort_values(["at", "event_id"])[["kind", "node", "at"]].itertuples(index=False):
        lease = lease_after(lease, kind, node, at, ttl_s)
    return lease


def lease_table(events: DataFrame, ttl_s: float = 2 * HEARTBEAT_S) -> DataFrame:
    """Rows (job_id, leased_by, heartbeat_at, expires_at) after all events (job_id, event_id, kind, node, at)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *_folded((None, None, None), rows, ttl_s))], columns=["job_id", "leased_by", "heartbeat_at", "expires_at"])

    return events.groupBy("job_id").applyInPandas(run, _LEASE)


def leases(events: DataFrame, ttl_s: float = 2 * HEARTBEAT_S, expire: bool = True) -> DataFrame:
    """As ``lease_table``, over a stream in update mode; with ``expire`` a lease without a heartbeat for ``ttl_s`` of processing time is given up."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            lease: Lease = (None, None, None)
        else:
            lease = state.get if state.exists else (None, None, None)
            rows = pd.concat(list(batches))
            lease = _folded(tuple(lease), rows, ttl_s)
        if lease[0] is None:
            state.remove()
        else:
            state.update(lease)
            if expire:
                state.setTimeoutDuration(max(1, int(ttl_s * 1000)))
        yield pd.DataFrame([(key[0], *lease)], columns=["job_id", "leased_by", "heartbeat_at", "expires_at"])

    return events.groupBy("job_id").applyInPandasWithState(run, _LEASE, "leased_by string, heartbeat_at double, expires_at double", "update", "ProcessingTimeTimeout" if expire else "NoTimeout")


def assembled(tokens: DataFrame, gap_ms: int = 800, late: str = "10 seconds") -> DataFrame:
    """Rows (f, start, end, words): tokens (f, at, word) of each file with less than a gap between them, as sessions.

    This is the streaming relative of the split at long pauses; the exact rule (E9, E10) needs whole turns.
    """
    marked = tokens.withWatermark("at", late) if tokens.isStreaming else tokens
    out = marked.groupBy("f", F.session_window("at", f"{gap_ms} milliseconds").alias("s")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("t"))
    return out.select("f", F.element_at("t", 1)["at"].alias("start"), F.element_at("t", -1)["at"].alias("end"), F.array_join(F.transform("t", lambda x: x["word"]), " ").alias("words"))


def rerun(after: DataFrame, deltas: DataFrame, old: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (f, after_idx, result): utterances whose words are as before keep their results, and only the others are processed.

    ``after`` has rows (f, after_idx, text), ``deltas`` those of a diff (C19), ``old`` rows (f, before_idx, result); ``process``
    turns rows (f, after_idx, text) into rows (f, after_idx, result).  An old result that is missing is made anew.
    """
    same = deltas.where(F.col("kind").isin("unchanged", "speaker_changed", "timing_only")).select("f", "after_idx", "before_idx")
    kept = same.join(old.select("f", "before_idx", "result"), ["f", "before_idx"]).select("f", "after_idx", "result")
    return kept.unionByName(process(after.join(kept.select("f", "after_idx"), ["f", "after_idx"], "left_anti")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session runs locally and names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return os.path.join(tempfile.gettempdir(), f"parlance-{uuid.uuid4().hex}")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that its source has now, and reads the result: each batch is a Parquet table in the shared folder.

    In complete mode the last batch is the result, otherwise all batches together.
    """
    path = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    written: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not written:
        return spark.createDataFrame([], stream.schema)
    parts = [max(written)] if mode == "complete" else sorted(set(written))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in parts])
