"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

A source's documents are dealt by a hash of their id and text into blocks, more of them the
more words it has.  Its target gives a quota of whole passes over all blocks and of one
part pass over permuted blocks.  A binary tree splits the quotas of all sources over the
output shards: at each node the left half's share of every source is drawn from the
multivariate hypergeometric distribution, so that quotas stay exact.  A shard then draws the
next blocks of each source's permutation (no two shards share one) and its rows are
ordered by a hash of their own.

All draws come from hashes and seeds, so reruns agree.  Only sums per source reach the
driver, and the upper ``TOP_SHARDS`` of the tree; what is below grows on executors.  Running
sums over a source's blocks are taken by ranges of their hash first, so that no task
holds a source's blocks.

Results for odd input: a null text has size 0; a null source is a source of its own, the
last one; documents without words are taken as 0 words; rows that repeat an id and a text
fall into one block and are taken alike; an empty table gives an empty result; extra
columns stay with the rows of the mix, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from parlance.llm._common import cut, table, text_of, words_of

WEIGHTS = (5.0, 2.0, 1.0)
#: The mix's words over the words of all documents, and a source's most passes.
SHARE, MOST = 1.5, 2.0
#: Blocks that a source is dealt into, at least, and words that a block of a larger source holds, about.
BLOCKS, BLOCK_WORDS = 512, 1_000_000
#: Words that an output shard holds, about.
SHARD_WORDS = 4_000_000
#: Shards up to which the tree grows on the driver; ranges of hashes that running sums go by.
TOP_SHARDS, RANGES = 4096, 1024
#: Blocks up to which the table of takes is broadcast (some 50 MB).
BROADCAST_BLOCKS = 1_000_000
SEED = 20_240_229


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words due from each source, in order: shares by weight, stopped at ``most`` times a source's size, the excess shared anew."""
    rest, out, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[k % len(weights)] for k in free)
        due = {k: rest * weights[k % len(weights)] / total for k in free}
        over = [k for k in free if due[k] > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = due[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            rest -= out[k]
        free = [k for k in free if k not in set(over)]
    return out


def _split(q: np.ndarray, low: int, high: int, seed: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Parts (low, high, quotas) of at most ``width`` shards, in order: each node's draw depends on its place and the seed alone."""
    todo = [(q, low, high)]
    while todo:
        q, low, high = todo.pop()
        if high - low <= width:
            yield low, high, q
            continue
        mid = (low + high) // 2
        n = int(q.sum()) * (mid - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        todo += [(q - left, mid, high), (left, low, mid)]


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Matrix (shard, source) of block quotas: rows of about equal sums, columns that add up to ``quotas``."""
    return np.stack([q for *_, q in _split(np.asarray(quotas, dtype=np.int64), 0, shards, seed, 1)])


def _shares(spark: SparkSession, keys: list[str], quotas: list[int], shards: int, seed: int) -> DataFrame:
    """Rows (skey, shard, first, n): the run of a source's takes that each shard draws.

    The driver holds at most ``TOP_SHARDS`` nodes; executors grow the tree from these to the shards.
    """
    q = np.asarray(quotas, dtype=np.int64)
    nodes = list(_split(q, 0, shards, seed, -(-shards // TOP_SHARDS)))
    before = np.cumsum([np.zeros_like(q), *(x for *_, x in nodes)], axis=0)
    rows = [(low, high, x.tolist(), b.tolist()) for (low, high, x), b in zip(nodes, before, strict=False)]

    def grown(low: int, high: int, quota: list[int], done: list[int]) -> list[tuple[str, int, int, int]]:
        out, at = [], np.asarray(done)
        for shard, _, x in _split(np.asarray(quota, dtype=np.int64), low, high, seed, 1):
            out += [(keys[k], shard, int(at[k]), int(x[k])) for k in np.flatnonzero(x)]
            at = at + x
        return out

    schema = "skey string, shard int, first long, n long"
    if shards <= TOP_SHARDS:
        return spark.createDataFrame([r for row in rows for r in grown(*row)], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield pd.DataFrame(grown(int(row[0]), int(row[1]), list(row[2]), list(row[3])), columns=["skey", "shard", "first", "n"])

    return spark.createDataFrame(rows, "low int, high int, quota array<long>, done array<long>").repartition(min(len(rows), 200)).mapInPandas(run, schema)


def _source() -> Column:
    """The source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns, F.lit(SEED))


def _running(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the rows of a key with a lesser ``order``, a hash, in two steps."""
    ranged = df.withColumn("range", F.shiftrightunsigned(order, 64 - (RANGES - 1).bit_length()))
    sums = ranged.groupBy(key, "range").agg(F.sum(value).alias("s"))
    less = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "range", F.coalesce(F.sum("s").over(less), F.lit(0)).alias("offset"))
    inner = Window.partitionBy(key, "range").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("within", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(offsets, [key, "range"])
    return out.withColumn("before", F.col("offset") + F.col("within")).drop("range", "within", "offset")


def mix(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes (doc_id, skey, block, size), sources (skey, source_size, target, n, bits), and takes (skey, block, shards).

    ``n`` is the number of a source's documents, ``bits`` the number of a block's.  Sources are broadcast, as the driver
    holds their table anyway.
    """
    spark = docs.sparkSession
    size = F.size(words_of(text_of())).cast("long")
    sized = cut(docs.select("doc_id", _source().alias("skey"), _hash("doc_id", "text").alias("h"), size.alias("size")))
    # Sums per source; sources are the entries of a catalogue, not rows of the corpus.
    per = sorted(sized.groupBy("skey").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect(), key=lambda r: (r.skey == "n", r.skey))
    due = targets([r.words for r in per])
    bits = [(max(BLOCKS, r.words // BLOCK_WORDS) - 1).bit_length() for r in per]
    passes = [min(int(t // r.words), int(MOST)) if r.words else 0 for r, t in zip(per, due, strict=True)]
    schema = "skey string, source_size long, target double, n long, bits int, passes int, rest double"
    sources = spark.createDataFrame([(r.skey, r.words, t, r.n, b, p, t - p * r.words) for r, t, b, p in zip(per, due, bits, passes, strict=True)], schema)
    sized = cut(sized.join(F.broadcast(sources.select("skey", "bits")), "skey").select("doc_id", "skey", F.expr("h & (shiftleft(1L, bits) - 1)").alias("block"), "size"))
    blocks = sized.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    blocks = cut(blocks.where("words > 0").withColumn("order", F.xxhash64("skey", "block", F.lit(seed))).join(F.broadcast(sources.select("skey", "passes", "rest")), "skey"))
    # The part pass takes blocks in the order of their hash as far as the target goes, and one more that comes nearest to what is left.
    run = cut(_running(blocks, "skey", "order", "words").withColumn("part", F.col("before") + F.col("words") <= F.col("rest")))
    gap = run.groupBy("skey").agg((F.first("rest") - F.sum(F.when(F.col("part"), F.col("words")).otherwise(0))).alias("gap"))
    best = run.where("not part").join(F.broadcast(gap), "skey").groupBy("skey").agg(F.min_by(F.struct("block", "words", "gap"), F.struct(F.abs(F.col("gap") - F.col("words")), "order", "block")).alias("b"))
    best = best.where(F.abs(F.col("b.gap") - F.col("b.words")) < F.abs("b.gap")).select("skey", F.col("b.block").alias("extra"))
    run = run.join(F.broadcast(best), "skey", "left").withColumn("part", F.col("part") | F.coalesce(F.col("block") == F.col("extra"), F.lit(False)))
    times = F.col("passes") + F.when(F.col("part") & (F.col("passes") < int(MOST)), 1).otherwise(0)
    # A take is one pass over one block; each pass has a permutation of its own.
    taken = run.select("skey", "block", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("pass"))
    taken = cut(taken.withColumn("order", F.xxhash64("skey", "block", "pass", F.lit(seed))).withColumn("one", F.lit(1).cast("long")))
    quotas = {r.skey: r["count"] for r in taken.groupBy("skey").count().collect()}
    shards = max(1, -(-round(sum(due)) // SHARD_WORDS))
    dealt = _shares(spark, [r.skey for r in per], [quotas.get(r.skey, 0) for r in per], shards, seed)
    places = dealt.select("skey", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("before"))
    drawn = _running(taken, "skey", "order", "one").join(places, ["skey", "before"])
    return sized, sources.select("skey", "source_size", "target", "n", "bits"), cut(drawn.groupBy("skey", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards")))


def _bounded(takes: DataFrame) -> DataFrame:
    """The table of takes, marked for broadcast while it is small enough for that."""
    return F.broadcast(takes) if takes.count() <= BROADCAST_BLOCKS else takes


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources, takes = mix(table(spark, sf_dir, "documents"))
    out = sized.join(_bounded(takes), ["skey", "block"], "left").join(F.broadcast(sources), "skey")
    times = F.coalesce(F.size("shards"), F.lit(0))
    return out.select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards")
    )


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix, a row for each time that a document is taken, shard by shard in shuffled order."""
    _, sources, takes = mix(docs)
    names = docs.columns
    # Columns go under numbers, as they may have any names.
    rows = docs.select(_source().alias("skey"), _hash("doc_id", "text").alias("h"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    rows = rows.join(F.broadcast(sources.select("skey", "bits")), "skey").withColumn("block", F.expr("h & (shiftleft(1L, bits) - 1)"))
    rows = rows.join(_bounded(takes), ["skey", "block"]).withColumn("row_hash", F.col("h")).drop("skey", "block", "h", "bits")
    rows = rows.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    n = max(1, (takes.agg(F.max(F.array_max("shards"))).first()[0] or 0) + 1)
    mixed = rows.repartition(n, "shard").sortWithinPartitions("shard", F.xxhash64("row_hash", "copy"))
    return mixed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
