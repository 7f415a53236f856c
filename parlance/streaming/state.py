"""Streams that keep state of their own for each key: ends of jobs, retries that fall due, leases that lapse.

Each is a stateful processor with a value for each key and, where time alone changes that value,
one timer for it.  Clocks are ``processing`` (wall time; for live feeds) or ``event`` (the
watermark of the events' own times; replays give the same rows every time, and end).  State lies in the
query's checkpoint, so a query that is started again goes on where it stopped, and executors
may be lost.  With the ``event`` clock an event at or before the watermark is late and left out,
as Spark does it; ``late`` says how long the watermark waits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.words import ENDINGS, LONG_PAUSE_MS, LONG_TURN, RTL_MARKS, SEPARATORS, STARTERS
from parlance.sources.keyed import KeyedTable
from parlance.streaming.feed import TERMINAL, lease_after

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long an ended job is remembered, in milliseconds of wall time: events of it that come later begin a new stream.
REMEMBERED_MS = 7 * 24 * 3600 * 1000


def keep_state(spark: SparkSession) -> None:
    """State with timers and expiry needs the provider that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable", ignore_index=True)


class _UntilTerminal(StatefulProcessor):
    def __init__(self, remembered_ms: int | None):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "event_id long", self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.ended.exists():
            return
        got = _sorted(rows, "event_id")
        stop = got.index[got["status"].isin(TERMINAL)]
        if len(stop):
            got = got.iloc[: stop[0] + 1]
            self.ended.update((int(got["event_id"].iloc[-1]),))
        yield got

    def close(self) -> None:
        pass


def until_terminal(events: DataFrame, remembered_ms: int | None = None) -> DataFrame:
    """A stream's rows (job_id, event_id, status, ...) up to each job's first terminal status, over any number of batches.

    Rows of a job that come after its end, in the same batch or a later one, are left out.  With ``remembered_ms`` (live
    feeds: ``REMEMBERED_MS``) ended jobs are forgotten after so long; a query that stops when its source is read has none,
    as wall time never lets it run out of batches.
    """
    keep_state(events.sparkSession)
    return events.groupBy("job_id").transformWithStateInPandas(_UntilTerminal(remembered_ms), events.schema, "Append", "None" if remembered_ms is None else "ProcessingTime")


class _Timed(StatefulProcessor):
    """A processor with one timer for each key, which is set anew or dropped with each value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at_s: float | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_s is not None:
            self.handle.registerTimer(int(at_s * 1000))

    def close(self) -> None:
        pass


_FILE = "last long, status string, category string, started_at double, finished_at double, next_eligible_at double, stage string, attempts long, started long"
FILE_STATE = "job_id long, filename string, status string, category string, started_at double, finished_at double, next_eligible_at double, stage string, attempts long"
NEW_FILE = (-1, "processing", None, None, None, None, None, 0, -1)


def _or_none(x):
    return None if x is None or pd.isna(x) else x


def file_after(state: tuple, event_id: int, kind: str, at: float, category: str | None, retry_at: float | None) -> tuple:
    """A file's state after an event; one that comes late is counted but does not undo what later ones set."""
    last, status, kept, started_at, finished_at, eligible, stage, attempts, started = state
    attempts += kind == "attempt"
    if kind in ("processing", "attempt") and event_id > started:
        started_at, started = at, event_id
    if event_id > last:
        failed = kind in ("error", "retry")
        last, status = event_id, kind if kind in ("done", "error") else "processing"
        kept, finished_at = category if failed else None, at if failed or kind == "done" else None
        eligible, stage = (retry_at, "retry_scheduled") if kind == "retry" else (None, None)
    return last, status, kept, started_at, finished_at, eligible, stage, attempts, started


class _Files(_Timed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("file", _FILE)

    def _row(self, key, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, *state[1:8])], columns=[c.split()[0] for c in FILE_STATE.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else NEW_FILE
        for e in _sorted(rows, "event_id").itertuples(index=False):
            state = file_after(state, int(e.event_id), e.kind, float(e.at), _or_none(e.category), _or_none(e.retry_at))
        self.state.update(state)
        self.wake(state[5])
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get())
        state = (*state[:5], None, "retry_due", *state[7:])
        self.state.update(state)
        yield self._row(key, state)


def _clocked(events: DataFrame, clock: str, late: str) -> tuple[DataFrame, str]:
    if clock == "processing":
        return events, "ProcessingTime"
    return events.withColumn("_time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("_time", late), "EventTime"


def file_states(events: DataFrame, clock: str = "processing", late: str = "0 seconds") -> DataFrame:
    """``feed.file_states`` as a stream in update mode, with retries that fall due: stage ``retry_due`` once ``retry_at`` has passed, without a new event."""
    keep_state(events.sparkSession)
    rows, mode = _clocked(events, clock, late)
    return rows.groupBy("job_id", "filename").transformWithStateInPandas(_Files(), FILE_STATE, "Update", mode)


LEASE = "job_id long, leased_by string, heartbeat_at double, expires_at double"


class _Leases(_Timed):
    def __init__(self, ttl_s: float):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("lease", "leased_by string, heartbeat_at double, expires_at double")

    def _row(self, key, lease: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *lease)], columns=[c.split()[0] for c in LEASE.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lease = tuple(self.state.get()) if self.state.exists() else (None, None, None)
        for e in _sorted(rows, "at", "event_id").itertuples(index=False):
            lapsed = lease[2] is not None and lease[2] <= e.at  # before this event, whether or not a timer has said so
            lease = lease_after((None, None, None) if lapsed else lease, e.kind, e.node, float(e.at), self.ttl_s)
        if lease[0] is None:
            self.state.clear()
        else:
            self.state.update(lease)
        self.wake(lease[2])
        yield self._row(key, lease)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield self._row(key, (None, None, None))


def leases(events: DataFrame, ttl_s: float, clock: str = "processing", late: str = "0 seconds") -> DataFrame:
    """``feed.lease_table`` as a stream in update mode; a lease that nobody renews lapses when it expires, without a new event,
    and can't be renewed after that."""
    keep_state(events.sparkSession)
    rows, mode = _clocked(events, clock, late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Leases(ttl_s), LEASE, "Update", mode)


# --- assembly of utterances (S6) ----------------------------------------------------------------


OPEN = "tokens array<string>, in_chunk int, in_part int, last_end long, utt long"
UTTERANCE = "f long, utt long, words array<string>"
NOTHING_OPEN = ([], 0, 0, None, 0)
_RTL = str.maketrans("؟۔،؛", "?.,;")


def word_after(state: tuple, word: str | None, a: int | None, b: int | None, most: int = LONG_TURN) -> tuple[tuple, list[tuple[int, list[str]]]]:
    """The state after a word (null: the turn is over), and the utterances (utt, words) that it closes.

    An utterance ends with an ending mark, after ``most`` words of a turn, and before a starter word that follows a long
    pause and at least two words; one that ends without a mark loses trailing separators and gets a period.
    """
    tokens, in_chunk, in_part, last_end, utt = state
    tokens, closed = list(tokens), []

    def close() -> None:
        nonlocal tokens, utt
        while tokens and tokens[-1] in SEPARATORS:
            tokens.pop()
        if tokens:
            closed.append((utt, [*tokens, "."]))
            utt += 1
        tokens = []

    if word is None or in_chunk == most:
        close()
        in_chunk, in_part, last_end = 0, 0, None
    if word is None:
        return (tokens, in_chunk, in_part, last_end, utt), closed
    starts = re.sub(r"^\W+|\W+$", "", word).lower() in STARTERS
    if in_part >= 2 and last_end is not None and a is not None and a - last_end >= LONG_PAUSE_MS and starts:
        close()
        in_part = 0
    if a is not None and b is not None:
        last_end = b
    in_chunk, in_part = in_chunk + 1, in_part + 1
    plain = word.replace("。", ".").replace("¿", " ").replace("¡", " ")
    if word in ENDINGS or word in RTL_MARKS:
        tokens.append(plain.translate(_RTL))
        ended = True
    else:
        ended = bool(plain) and word[-1:] in (".", "?", "!", *RTL_MARKS)
        tokens += [plain[:-1], plain[-1].translate(_RTL)] if ended else [plain]
    if ended:
        closed.append((utt, tokens))
        tokens, utt = [], utt + 1
    return (tokens, in_chunk, in_part, last_end, utt), closed


class _Assembly(_Timed):
    def __init__(self, most: int, idle_s: float | None):
        self.most, self.idle_s = most, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("open", OPEN)

    def _take(self, key, state: tuple, words: list[tuple]) -> pd.DataFrame:
        out: list[tuple] = []
        for word, a, b in words:
            state, closed = word_after(state, word, a, b, self.most)
            out += [(key[0], utt, tokens) for utt, tokens in closed]
        self.state.update(state)
        return pd.DataFrame(out, columns=["f", "utt", "words"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = _sorted(rows, "p")
        state = tuple(self.state.get()) if self.state.exists() else NOTHING_OPEN
        words = [(_or_none(w), None if (x := _or_none(a)) is None else int(x), None if (y := _or_none(b)) is None else int(y)) for w, a, b in got[["word", "a", "b"]].itertuples(index=False)]
        if self.idle_s is not None:
            self.wake(timerValues.getCurrentProcessingTimeInMs() / 1000 + self.idle_s)
        yield self._take(key, state, words)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._take(key, tuple(self.state.get()), [(None, None, None)])


def utterances(tokens: DataFrame, most: int = LONG_TURN, idle_s: float | None = None) -> DataFrame:
    """Utterances (f, utt, words) of a stream of words (f, p, word, a, b), by the rules of E8, E9 and E10.

    A speaker's words come in the order of ``p`` from batch to batch; a null word ends the turn.  With ``idle_s`` a turn
    without words for so many seconds of wall time ends as well.
    """
    keep_state(tokens.sparkSession)
    return tokens.select("f", "p", "word", "a", "b").groupBy("f").transformWithStateInPandas(_Assembly(most, idle_s), UTTERANCE, "Append", "None" if idle_s is None else "ProcessingTime")


# --- sinks --------------------------------------------------------------------------------------


def into_table(stream: DataFrame, table: KeyedTable, checkpoint: str, newest: str | None = None) -> None:
    """Runs a stream in update mode over what its source has now; each batch replaces the rows of its keys and no others."""

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()  # a put reads its rows twice, but a batch's state and timers may be worked through only once
        try:
            table.put(batch, newest)
        finally:
            batch.unpersist()

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def into_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream in append mode over what its source has now; a batch that is run again writes the same folder."""
    query = stream.writeStream.outputMode("append").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
