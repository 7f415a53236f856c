"""Job, attempt and result-cache bookkeeping over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ACTIVE = ("queued", "running")
TERMINAL = ("done", "error", "cancelled")
DAY_S = 86_400


def cache_hits(wanted: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Adds ``hit``: the key is cached for its task by this engine version."""
    known = cache.where(F.col("engine_version") == version).select("key", "task").distinct().withColumn("hit", F.lit(True))
    return wanted.join(known, ["key", "task"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each (key, task); of equal times a new entry wins, and of several such the largest."""
    rest = [F.desc(c) for c in cache.columns if c not in ("key", "task", "created_at")]
    w = Window.partitionBy("key", "task").orderBy(F.desc("created_at"), F.desc("_new"), *rest)
    every = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "_new")


def cache_delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries whose keys are not among those deleted."""
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries of each task, and of all under a null task."""
    return cache.rollup("task").agg(F.count("*").alias("entries"))


def merged_results(hits: DataFrame, inferred: DataFrame) -> DataFrame:
    """Cached and new results together."""
    return hits.unionByName(inferred)


def job_conflicts(files: DataFrame, new: DataFrame) -> DataFrame:
    """Active files (submitted_by, path, job_id, status) that a new submission names as well."""
    active = files.where(F.col("status").isin(*ACTIVE)).select("submitted_by", "path", "job_id")
    return active.join(new.select("submitted_by", "path").distinct(), ["submitted_by", "path"], "left_semi")


def job_listing(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the number of their files, newest first."""
    n = files.groupBy("job_id").agg(F.count("*").alias("n_files"))
    return jobs.join(n, "job_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0))).orderBy(F.desc("submitted_at"), "job_id")


def operational_counters(jobs: DataFrame, capacity: int) -> DataFrame:
    """Queued, running and free slots."""
    active = F.count_if(F.col("status").isin(*ACTIVE))
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.greatest(F.lit(0), F.lit(capacity) - active).alias("slots"))


def job_status(files: DataFrame) -> DataFrame:
    """Rows (job_id, all_failed): every terminal file failed, and there is one."""
    term = F.col("status").isin(*TERMINAL)
    bad = F.count_if(F.col("status") == "error")
    return files.groupBy("job_id").agg(((F.count_if(term) > 0) & (F.count_if(term) == bad)).alias("all_failed"))


def batch_progress(files: DataFrame) -> DataFrame:
    """Done and all utterances of each language."""
    return files.groupBy("lang").agg(F.sum("done").alias("done"), F.sum("total").alias("total"), (F.sum("done") / F.sum("total")).alias("fraction"))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs that a crash left queued or running become interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "interrupted").otherwise(F.col("status")))


def pruned(jobs: DataFrame, files: DataFrame, now_s: float, days: int) -> tuple[DataFrame, DataFrame]:
    """Jobs not older than ``days``, and the files of those."""
    kept = jobs.where(F.col("submitted_at") >= now_s - days * DAY_S)
    return kept, files.join(kept.select("job_id"), "job_id", "left_semi")


def lease_state(jobs: DataFrame, now_s: float) -> DataFrame:
    """Adds ``ready`` (no live lease, and eligible) and ``wake``, when a job that is not ready may be."""
    leased = F.coalesce(F.col("lease_expires_at") > now_s, F.lit(False))
    early = F.coalesce(F.col("next_eligible_at") > now_s, F.lit(False))
    wake = F.greatest(F.when(leased, F.col("lease_expires_at")), F.when(early, F.col("next_eligible_at")))
    return jobs.withColumns({"ready": ~leased & ~early, "wake": wake})


def attempts_in_order(attempts: DataFrame) -> DataFrame:
    """attempts (job_id, started_at, attempt) of each job by their start, with their ``rank``."""
    w = Window.partitionBy("job_id").orderBy("started_at", "attempt")
    return attempts.withColumn("rank", F.row_number().over(w))


def next_wake(jobs: DataFrame, now_s: float) -> DataFrame:
    """one row (wake): the soonest that a queued job that is not ready may be."""
    return lease_state(jobs.where("status = 'queued'"), now_s).where("not ready").agg(F.min("wake").alias("wake"))


def ready_queue(jobs: DataFrame, now_s: float) -> DataFrame:
    """ready queued jobs by time of submission."""
    return lease_state(jobs.where("status = 'queued'"), now_s).where("ready").orderBy("submitted_at", "job_id")


def retained(traces: DataFrame, now_s: float, most: int = 50, ttl_s: int = 3600) -> DataFrame:
    """the newest ``most`` traces that are not older than ``ttl_s``."""
    return traces.where(F.col("at") >= now_s - ttl_s).orderBy(F.desc("at"), F.desc("id")).limit(most)


def by_size(files: DataFrame) -> DataFrame:
    """Files by size, largest first."""
    return files.orderBy(F.desc("size"), "path")


def speakers_in_order(segments: DataFrame) -> DataFrame:
    """Rows (f, n, speaker): each speaker once, in the order first seen."""
    first = segments.groupBy("f", "speaker").agg(F.min("seg_idx").alias("at"))
    return first.select("f", (F.row_number().over(Window.partitionBy("f").orderBy("at")) - 1).alias("n"), "speaker")


def speaker_count(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each file."""
    return segments.groupBy("f").agg(F.count_distinct("speaker").alias("speakers"))


def paired_files(main: DataFrame, other: DataFrame, suffix: str = ".gold") -> DataFrame:
    """A10: rows (path, partner): ``X.cha`` with ``X.gold.cha``; partner is null where there is none."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    gold = other.select(F.col("path").alias("partner"), F.regexp_replace(stem, F.lit(suffix.replace(".", "\\.") + "$"), F.lit("")).alias("stem"))
    return main.select("path", stem.alias("stem")).join(gold, "stem", "left").select("path", "partner")


#: Entries that the hot part of a cache has at most, and seconds after which an idle one goes.
HOT_ENTRIES, HOT_IDLE_S = 10_000, 86_400


def tiered_get(wanted: DataFrame, hot: DataFrame, cold: DataFrame, version: str) -> DataFrame:
    """Wanted keys (key, task) with ``data`` and ``tier``: ``hot``, ``cold``, or null for a miss.

    The hot part is bounded (``hot_entries``), so it is broadcast; only keys that it lacks, or has for another
    task or version, reach the cold part.
    """
    fit = lambda c: c.where(F.col("engine_version") == version).select("key", "task", "data")
    first = wanted.join(F.broadcast(fit(hot).withColumn("tier", F.lit("hot"))), ["key", "task"], "left")
    rest = first.where("tier is null").select("key", "task").join(fit(cold).withColumn("tier", F.lit("cold")), ["key", "task"], "left")
    return first.where("tier is not null").unionByName(rest)


def hot_entries(hot: DataFrame, used: DataFrame, now_s: float, most: int = HOT_ENTRIES, idle_s: int = HOT_IDLE_S) -> DataFrame:
    """The hot part after use: entries (key, task, engine_version, data, used_at) used within ``idle_s``, the ``most`` latest; one for each key."""
    every = hot.unionByName(used).where(F.col("used_at") >= now_s - idle_s)
    w = Window.partitionBy("key").orderBy(F.desc("used_at"))
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(F.desc("used_at"), "key").limit(most)
