"""Streams with state over several batches and restarts, and keyed tables."""

import random

from pyspark.sql import functions as F

from parlance.operators import store, words
from parlance.sources.keyed import KeyedTable
from parlance.streaming import feed, state


def replay(spark, tmp_path, parts, schema, run):
    """Writes one part after another; the stream is started again from its checkpoint after each."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))


def test_jobs_end_once_over_three_batches(spark, tmp_path):
    parts = [
        [(1, 1, "queued"), (1, 2, "done"), (1, 3, "running"), (2, 4, "running")],
        [(1, 5, "running"), (1, 6, "done"), (2, 7, "running"), (3, 8, "queued")],
        [(2, 10, "running"), (2, 9, "cancelled"), (3, 11, "error"), (1, 12, "error")],
    ]
    schema = "job_id long, event_id long, status string"
    replay(spark, tmp_path, parts, schema, lambda s: state.into_folder(state.until_terminal(s), f"{tmp_path}/out", f"{tmp_path}/state"))
    got = {(r.job_id, r.event_id) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/*").collect()}
    assert got == {(1, 1), (1, 2), (2, 4), (2, 7), (2, 9), (3, 8), (3, 11)}


def test_retries_fall_due_without_a_new_event(spark, tmp_path):
    schema = "job_id long, filename string, event_id long, kind string, at double, category string, retry_at double"
    parts = [
        [(1, "a", 1, "attempt", 10.0, None, None), (1, "a", 2, "retry", 20.0, "timeout", 50.0), (1, "b", 3, "retry", 20.0, "crash", 500.0)],
        [(2, "c", 4, "attempt", 45.0, None, None)],
        [(2, "c", 5, "done", 60.0, None, None)],
        [(1, "b", 6, "attempt", 70.0, None, None)],
    ]
    table = KeyedTable.create(spark.createDataFrame([], state.FILE_STATE), f"{tmp_path}/table", ["job_id", "filename"], 4)
    seen = []

    def run(stream):
        state.into_table(state.file_states(stream, "event"), table, f"{tmp_path}/state")
        seen.append({(r.job_id, r.filename): (r.status, r.category, r.next_eligible_at, r.stage, r.attempts) for r in table.read().collect()})

    replay(spark, tmp_path, parts, schema, run)
    assert seen[1][1, "a"] == ("processing", "timeout", 50.0, "retry_scheduled", 1)
    assert seen[2][1, "a"] == ("processing", "timeout", None, "retry_due", 1)
    assert seen[3][1, "b"] == ("processing", None, None, None, 1) and seen[3][2, "c"] == ("done", None, None, None, 1)


def test_file_states_equal_the_table_whatever_the_order():
    r = random.Random(4)
    events = [(k, r.choice(["processing", "attempt", "done", "error", "retry"]), float(k), f"c{k % 3}", k + 30.0) for k in range(40)]
    whole = state.NEW_FILE
    for e in events:
        whole = state.file_after(whole, *e)
    mixed = state.NEW_FILE
    for e in r.sample(events, len(events)):
        mixed = state.file_after(mixed, *e)
    assert mixed == whole


def test_leases_lapse_without_a_new_event(spark, tmp_path):
    schema = "job_id long, event_id long, kind string, node string, at double"
    parts = [[(1, 1, "claim", "n1", 1.0), (2, 2, "claim", "n2", 5.0)], [(2, 3, "renew", "n2", 12.0)], [(3, 4, "claim", "n3", 21.0)], [(1, 5, "renew", "n1", 22.0), (3, 6, "renew", "n1", 22.0)]]
    table = KeyedTable.create(spark.createDataFrame([], state.LEASE), f"{tmp_path}/table", ["job_id"], 2)
    seen = []

    def run(stream):
        state.into_table(state.leases(stream, 10.5, "event"), table, f"{tmp_path}/state")
        seen.append({r.job_id: r.leased_by for r in table.read().collect()})

    replay(spark, tmp_path, parts, schema, run)
    assert seen == [{1: "n1", 2: "n2"}, {1: None, 2: "n2"}, {1: None, 2: "n2", 3: "n3"}, {1: None, 2: "n2", 3: "n3"}]


def spoken(seed, n):
    r = random.Random(seed)
    at, out = 0, []
    for p in range(n):
        at += r.choice([100, 200, 900, 1500])
        word = r.choice(["so", "and", "cat", "dog.", "ran", "„", ",", "why?", "well", "¿que", "he", "شكرا؟", ".", "you"])
        timed = r.random() > 0.15
        out.append((p, word, at if timed else None, at + 150 if timed and r.random() > 0.1 else None))
    return out


def table_utterances(spark, f, rows, most):
    """E8, E9 and E10 over the whole table."""
    df = spark.createDataFrame([(f, 0, *r) for r in rows], "f long, u long, p long, word string, a long, b long")
    chunks = words.long_turns(df, most).select("f", "chunk", F.col("p").alias("i"), "word", "a", "b")
    parts = words.long_pauses(chunks).withColumn("g", F.format_string("%06d-%06d", F.col("chunk").cast("int"), "part"))
    got = words.into_utterances(parts.select(F.col("g").alias("f"), F.col("i").alias("p"), "word")).orderBy("f", "utt", "tok").collect()
    out = {}
    for r in got:
        out.setdefault((r.f, r.utt), []).append(r.word)
    return list(out.values())


def test_stream_of_words_gives_the_utterances_of_whole_turns(spark, tmp_path):
    rows = spoken(1, 160)
    state_now, got = state.NOTHING_OPEN, []
    for _, w, a, b in [*rows, (0, None, None, None)]:
        state_now, closed = state.word_after(state_now, w, a, b, 30)
        got += [t for _, t in closed]
    assert got == table_utterances(spark, 7, rows, 30)
    schema = "f long, p long, word string, a long, b long"
    parts = [[(7, *r) for r in rows[k : k + 60]] for k in range(0, 160, 60)] + [[(7, 999, None, None, None)]]
    replay(spark, tmp_path, parts, schema, lambda s: state.into_folder(state.utterances(s, 30), f"{tmp_path}/out", f"{tmp_path}/state"))
    streamed = spark.read.schema(state.UTTERANCE).parquet(f"{tmp_path}/out/*").orderBy("utt").collect()
    assert [r.utt for r in streamed] == list(range(len(streamed))) and [r.words for r in streamed] == got


def test_keyed_table_writes_only_the_buckets_it_touches(spark, tmp_path):
    schema = "key string, task string, at long, data string"
    old = [(f"k{k}", "t", 5, "old") for k in range(200)]
    table = KeyedTable.create(spark.createDataFrame(old, schema), f"{tmp_path}/c", ["key", "task"], 32, newest="at")
    before = table._current()
    touched = table.put(spark.createDataFrame([("k3", "t", 5, "new"), ("k4", "t", 4, "late"), ("new", "t", 1, "a"), ("new", "t", 1, "b")], schema), newest="at")
    after = table._current()
    assert len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(touched)
    got = {r.key: r.data for r in table.read().collect()}
    assert got == {**{f"k{k}": "old" for k in range(200)}, "k3": "new", "new": "b"}
    wanted = spark.createDataFrame([("k3", "t"), ("none", "t"), ("k9", "t")], "key string, task string")
    assert {(r.key, r.data) for r in table.get(wanted).collect()} == {("k3", "new"), ("k9", "old")}
    assert table.put(spark.createDataFrame([], schema)) == []


def test_an_unfinished_put_is_not_read_and_a_repeated_one_changes_nothing(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([(1, "a")], "k long, v string"), f"{tmp_path}/t", ["k"], 2)
    spark.createDataFrame([(1, "lost", 0)], "k long, v string, _bucket int").write.partitionBy("_bucket").parquet(f"{tmp_path}/t/data/000000000099-lost")
    assert [tuple(r) for r in table.read().collect()] == [(1, "a")]
    for _ in range(2):
        table.put(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"))
        assert sorted(tuple(r) for r in table.read().collect()) == [(1, "b"), (2, "c")]
    again = KeyedTable(spark, f"{tmp_path}/t", table.schema, ("k",), 2)
    assert again.read().count() == 2
    empty = KeyedTable.create(spark.createDataFrame([], "k long, v string"), f"{tmp_path}/e", ["k"])
    assert empty.read().count() == 0


def test_a_new_entry_wins_over_an_old_one_of_the_same_time(spark):
    s = "key string, task string, created_at long, data string"
    old = spark.createDataFrame([("k", "t", 1, "old"), ("m", "t", 3, "kept")], s)
    new = spark.createDataFrame([("k", "t", 1, "new"), ("m", "t", 2, "older")], s)
    assert {(r.key, r.data) for r in store.cache_put(old, new).collect()} == {("k", "new"), ("m", "kept")}


def test_a_batch_with_state_is_worked_through_once(spark, tmp_path):
    """A put reads its rows more than once; were each time a run of the batch, its timers and state would be worked through again."""
    schema = "job_id long, status string, event_id long"
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(status):
        seen.add(1)
        return status

    table = KeyedTable.create(spark.createDataFrame([], "job_id long, status string, n long, last_event long"), f"{tmp_path}/table", ["job_id", "status"], 4)
    parts = [[(k % 3, "queued", k) for k in range(20)], [(k % 3, "queued", k) for k in range(20, 30)]]
    replay(spark, tmp_path, parts, schema, lambda s: state.into_table(feed.status_changes(s).withColumn("status", counted("status")), table, f"{tmp_path}/state"))
    assert sorted(map(tuple, table.read().collect())) == [(0, "queued", 10, 27), (1, "queued", 10, 28), (2, "queued", 10, 29)]
    assert seen.value == 6
