"""Queries of streams with state and of keyed tables, with their SQL.

A table is dealt into parts in the order of its events; each part is written and the stream
started again from its checkpoint, so that every query runs over several batches and restarts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.plans.catalog import CACHE, _duck, _read, query
from parlance.plans.transcripts import _EVENTS, _S4
from parlance.sources.keyed import KeyedTable
from parlance.streaming import feed, state

PARTS = 3


def _replayed(s: SparkSession, rows: DataFrame, order: str, run: Callable[[DataFrame, str], None], name: str) -> str:
    """Writes the rows part by part and runs a stream over each; returns the folder of the replay."""
    base = f"{feed.shared_folder(s)}/replays/{name}-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    schema = rows.schema
    for part in range(PARTS if low is not None else 0):
        own = F.floor((F.col(order) - low) * PARTS / (high - low + 1))
        rows.where(own == part).write.mode("append").parquet(f"{base}/in")
        run(s.readStream.schema(schema).parquet(f"{base}/in"), base)
    return base


def _upserted(s: SparkSession, rows: DataFrame, order: str, stream_of: Callable[[DataFrame], DataFrame], keys: list[str], schema: str, name: str) -> DataFrame:
    tables: list[KeyedTable] = []

    def run(stream: DataFrame, base: str) -> None:
        if not tables:
            tables.append(KeyedTable.create(s.createDataFrame([], schema), f"{base}/table", keys, 8))
        state.into_table(stream_of(stream), tables[0], f"{base}/state")

    _replayed(s, rows, order, run, name)
    return tables[0].read() if tables else s.createDataFrame([], schema)


query("s1_status_upserts", "SELECT user_id % 100 AS job_id, event_type AS status, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1, 2")(
    lambda s, d: _upserted(s, _read(s, d, "SELECT user_id % 100 AS job_id, event_type AS status, event_id FROM {events}"), "event_id", feed.status_changes, ["job_id", "status"], "job_id long, status string, n long, last_event long", "status")
)
query("s3_progress_upserts", "SELECT user_id % 100 AS job_id, max(event_id % 77) AS done FROM events GROUP BY 1")(
    lambda s, d: _upserted(s, _read(s, d, "SELECT user_id % 100 AS job_id, event_id, event_id % 77 AS done FROM {events}"), "event_id", feed.progress, ["job_id"], "job_id long, done long", "progress")
)


@query(
    "s2_until_terminal_batches",
    """SELECT job_id, event_id FROM (SELECT user_id % 400 AS job_id, event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id % 400) AS stop FROM events) t
    WHERE stop IS NULL OR event_id <= stop""",
)
def _ended(s: SparkSession, d: str) -> DataFrame:
    rows = _read(s, d, "SELECT user_id % 400 AS job_id, event_id, event_type AS status FROM {events}")
    base = _replayed(s, rows, "event_id", lambda stream, base: state.into_folder(state.until_terminal(stream), f"{base}/out", f"{base}/state"), "ended")
    return s.read.schema(rows.schema).parquet(f"{base}/out/*").select("job_id", "event_id")


#: As S4, and retries whose time has come before the last event of all.
_DUE = f"""SELECT job_id, filename, status, category, started_at, finished_at, CASE WHEN next_eligible_at < last THEN NULL ELSE next_eligible_at END AS next_eligible_at,
  CASE WHEN next_eligible_at < last THEN 'retry_due' ELSE stage END AS stage, attempts FROM ({_S4}) f, (SELECT max(event_id) AS last FROM events) m"""
query("s4_retries_due", _DUE)(lambda s, d: _upserted(s, _read(s, d, _EVENTS), "event_id", lambda r: state.file_states(r, "event"), ["job_id", "filename"], state.FILE_STATE, "files"))

_CLAIMS = """SELECT user_id % 100 AS job_id, event_id, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'release' ELSE 'renew' END AS kind,
  concat('n', event_id % 3) AS node, CAST(event_id AS DOUBLE) AS at FROM {events}"""
_TTL = 150.5
#: A lease as node and time of the last heartbeat; what each kind of event does to one that is live or not.
query(
    "s5_leases_lapse",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS k FROM {_duck(_CLAIMS).replace(" AS at", ' AS "at"')} q),
    r AS (SELECT job_id, 0::BIGINT AS k, NULL::VARCHAR AS node, NULL::DOUBLE AS beat FROM (SELECT DISTINCT job_id FROM e) j UNION ALL
    SELECT e.job_id, e.k, CASE WHEN e.kind = 'claim' AND NOT live OR e.kind = 'renew' AND live AND e.node = o.node THEN e.node WHEN e.kind = 'release' AND live AND e.node = o.node OR NOT live THEN NULL ELSE o.node END,
    CASE WHEN e.kind = 'claim' AND NOT live OR e.kind = 'renew' AND live AND e.node = o.node THEN e."at" WHEN e.kind = 'release' AND live AND e.node = o.node OR NOT live THEN NULL ELSE o.beat END
    FROM (SELECT r.*, r.job_id AS j FROM r) o JOIN e ON e.job_id = o.j AND e.k = o.k + 1, LATERAL (SELECT coalesce(o.beat + {_TTL} > e."at", false) AS live) l),
    z AS (SELECT job_id, arg_max(struct_pack(n := node, b := beat), k) AS l FROM r GROUP BY job_id), m AS (SELECT max(event_id) AS last FROM events)
    SELECT job_id, CASE WHEN l.b + {_TTL} > last THEN l.n END AS leased_by, CASE WHEN l.b + {_TTL} > last THEN l.b END AS heartbeat_at, CASE WHEN l.b + {_TTL} > last THEN l.b + {_TTL} END AS expires_at FROM z, m""",
)(lambda s, d: _upserted(s, _read(s, d, _CLAIMS), "event_id", lambda r: state.leases(r, _TTL, "event"), ["job_id"], state.LEASE, "leases"))


@query("g4_cache_buckets", f"SELECT key, task, max(created_at) AS created_at, arg_max(engine_version, (created_at, engine_version)) AS engine_version FROM {_duck(CACHE)} c GROUP BY key, task")
def _cache(s: SparkSession, d: str) -> DataFrame:
    rows = _read(s, d, CACHE)
    cache = KeyedTable.create(rows.where("engine_version = 'v1'"), f"{feed.shared_folder(s)}/tables/cache-{uuid.uuid4().hex}", ["key", "task"], 16, newest="created_at")
    cache.put(rows.where("engine_version = 'v2'"), newest="created_at")
    return cache.read()
