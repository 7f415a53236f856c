"""The trie of conversations' common beginnings, found by blocks of turns.

Turns are hashed, and every prefix of a conversation gets a key by a rolling hash of 255 bits
over its turns, whose segments compose, so that a conversation may lie in several partitions.
Conversations are cut into blocks of ``BLOCK`` turns and grouped by the keys after each block.
A block that is the only one to follow its prefix gives its turns' nodes as they are; only
where different blocks follow one prefix are their turns regrouped one by one.  What counts
conversations is summed in the blocks first, whatever their number.

Sums over subtrees need no walk: each conversation owns the nodes of which it is the smallest
member, and these are the lower end of its path.  With ``x`` the code points of the part of a
path that others own, the tokens saved below a node are the sum of ``x`` over its members but
the owner, less what stands before the node once for each of them; leaves are counted likewise.

Results for odd input: null roles and texts count as empty; turns are ordered by number, nulls
first, and equal numbers by role and text; repeated rows are turns of their own.  Rows of a null
conv_id belong to no conversation.  Other columns are ignored.  An empty table has no root and
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parlance.llm._common import cut, keyed_join, stored, table

#: Turns of a block; ids that are formatted together.
BLOCK, IDS = 4, 4096
#: Conversations of a family, which share the beginning of the first; turns that are shared at most, plus one.
FAMILY, SHARED = 100, 6
#: Rolling hash: keys are below the prime, and the root's is 0.
PRIME = 2**255 - 19
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()) % PRIME
ROOT = bytes(32)


# ---- turns ---------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, k, role, text, digest, chars): each turn with its place in the conversation, from 0 on.

    Turns are dealt by ranges of conversation and turn, so a long conversation may lie in many
    partitions; each counts its own turns, and what earlier ones hold is added.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", F.spark_partition_id().alias("part"), "role", "text", digest.alias("digest"), F.length("text").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv_id"].to_numpy()
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            k = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                k[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(k), *batch.columns], names=["k", *batch.schema.names])

    local = stored(dealt.mapInArrow(run, "k long, conv_id long, part int, role string, text string, digest binary, chars int"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = local.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier))
    carried = F.broadcast(per.where("before > 0").select("conv_id", "part", "before"))  # of each partition the first conversation at most
    return local.join(carried, ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "role", "text", "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, k, digest, chars) with the first ones taken from their family's first conversation."""
    turns = turns.select("conv_id", "k", "digest", "chars")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int").alias("h"))
    heads = turns.where(F.col("k") < SHARED - 1).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("k", "digest", "chars"))).alias("head"))
    convs = cut(convs.join(heads, "first", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<k:bigint,digest:binary,chars:int>>")), F.lit(1), F.col("h"))))
    rows = turns.count()
    own = keyed_join(turns, convs.select("conv_id", "h", F.size("head").alias("m"), "n"), ["conv_id"], rows).where("k >= h").select("conv_id", (F.col("k") - F.col("h") + F.col("m")).alias("k"), "digest", "chars")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.k", "t.digest", "t.chars")
    return convs.select("conv_id"), own.union(taken)


# ---- blocks --------------------------------------------------------------------------------

_BLOCKS = "conv_id long, part int, block long, keys array<binary>, chars array<int>, prev binary, pre long, steps long"


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of turns that come in order, with keys and sums as if each conversation began in this partition."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64()]
    names = ["conv_id", "part", "block", "keys", "chars", "prev", "pre", "steps"]
    rows: list[tuple] = []
    now, value, steps, total = None, 0, 0, 0
    for batch in batches:
        for conv, part, k, digest, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "k", "digest", "chars")), strict=True):
            if now is None or now[0] != conv:
                value, steps, total = 0, 0, 0
            if now != (conv, k // BLOCK):
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
                now = (conv, k // BLOCK)
                rows.append((conv, part, k // BLOCK, [], [], value.to_bytes(32), total, steps))
            value, steps, total = (value * BASE + int.from_bytes(digest) + 1) % PRIME, steps + 1, total + chars
            rows[-1][3].append(value.to_bytes(32))
            rows[-1][4].append(chars)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def blocks(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, block, keys, chars, prev, pre): a conversation's blocks, the keys after each turn, the key and the code points before."""
    dealt = turns.withColumn("block", F.floor(F.col("k") / BLOCK)).repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "k")
    local = stored(dealt.select("conv_id", F.spark_partition_id().alias("part"), "k", "digest", "chars").mapInArrow(_rolled, _BLOCKS), "blocks")
    # Conversations in several partitions, two for each partition at most: what earlier partitions hold is put before.
    split = local.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id")
    sum_of = F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c)
    last = F.max(F.struct("block", F.element_at("keys", -1).alias("key"), (F.col("steps") + F.size("keys")).alias("steps"), (F.col("pre") + sum_of).alias("sum"))).alias("last")
    before: dict[tuple[int, int], tuple[int, int]] = {}
    conv, value, total = None, 0, 0
    for r in local.join(F.broadcast(split), "conv_id").groupBy("conv_id", "part").agg(last).orderBy("conv_id", "part").collect():
        if r.conv_id != conv:
            conv, value, total = r.conv_id, 0, 0
        before[r.conv_id, r.part] = (value, total)
        value, total = (value * pow(BASE, r.last.steps, PRIME) + int.from_bytes(r.last.key)) % PRIME, total + r.last.sum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(zip(batch["conv_id"].to_pylist(), batch["part"].to_pylist(), strict=True))
            if not any(i in before for i in ids):
                yield batch
                continue
            rows = batch.to_pylist()
            for r, i in zip(rows, ids, strict=True):
                value, total = before.get(i, (0, 0))
                if value:
                    power = value * pow(BASE, r["steps"], PRIME) % PRIME
                    r["prev"] = ((power + int.from_bytes(r["prev"])) % PRIME).to_bytes(32)
                    for j, key in enumerate(r["keys"]):
                        power = power * BASE % PRIME
                        r["keys"][j] = ((power + int.from_bytes(key)) % PRIME).to_bytes(32)
                    r["pre"] += total
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    out = local.mapInArrow(run, _BLOCKS) if before else local
    return out.withColumn("chain", F.element_at("keys", -1)).select("conv_id", "block", "keys", "chars", "prev", "chain", "pre")


def _turns_of(groups: DataFrame, *more: str) -> DataFrame:
    """A row for each turn of each block: its key, that of its parent, its depth, its code points and those before."""
    at = groups.select("block", "keys", "chars", "prev", "pre", *more, F.posexplode("keys").alias("j", "key"))
    earlier = F.aggregate(F.slice("chars", F.lit(1), F.col("j")), F.lit(0).cast("long"), lambda a, c: a + c)
    parent = F.when(F.col("j") == 0, F.col("prev")).otherwise(F.get("keys", F.col("j") - 1))
    return at.select("key", parent.alias("parent"), (F.col("block") * BLOCK + F.col("j") + 1).alias("depth"), F.get("chars", F.col("j")).cast("long").alias("chars"), (F.col("pre") + earlier).alias("pre"), *more)


# ---- trie ----------------------------------------------------------------------------------


def _ends(tails: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256): the digest of the ids of each node's complete conversations, ascending.

    Ids are sorted and put together by ranges; a node's digest then takes their texts in order,
    holding one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def text() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

        for batch in batches:
            for key, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (key != now or len(ids) == IDS):
                    yield text()
                    ids = []
                now = key
                ids.append(conv)
        if ids:
            yield text()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if key != now:
                    if digest:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    texts = tails.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined, "key binary, first long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each different beginning of the conversations ``convs``, with the root.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; a turnless conversation is a member of the root alone.
    """
    lone = stored(blocks(turns), "chained")
    # Groups of equal blocks after equal beginnings, and how many different ones follow each beginning.
    groups = lone.groupBy("prev", "chain").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), *(F.any_value(c).alias(c) for c in ("block", "keys", "chars", "pre")))
    groups = stored(groups, "groups")
    n_groups = groups.count()
    following = groups.groupBy("prev").agg(F.count("*").alias("n")).withColumn("siblings", F.col("n"))
    groups = stored(keyed_join(groups.withColumnRenamed("n", "members"), following, ["prev"], n_groups), "siblings")
    plain, split = groups.where("siblings = 1"), groups.where("siblings > 1")
    alone = _turns_of(plain, "members", "owner")
    met = _turns_of(split, "members", "owner").groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("parent", "depth", "chars", "pre")), F.sum("members").alias("members"), F.min("owner").alias("owner"))
    nodes = stored(alone.union(met.select(alone.columns)), "nodes")

    # Children, and the owner of each node's parent.
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n"))
    nodes = nodes.join(kids, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("members")).first()
    below = kids.where(F.col("key") == ROOT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    root = {"parent": F.lit(ROOT), "above": F.lit(first.owner).cast("long"), "n": F.lit(below)}
    parents = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("above"), "n").where("n > 0")
    parents = parents.union(convs.sparkSession.range(min(1, first.members)).select(*(c.alias(k) for k, c in root.items())))
    nodes = stored(keyed_join(nodes.withColumnRenamed("n", "children"), parents, ["parent"], nodes.count()), "owned")

    # What of each conversation's path others own, and whether it ends in a leaf of its own.
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("pre").alias("x"), F.max((F.col("children") == 0).cast("long")).alias("leaf"))
    sum_of = F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c)
    tails = lone.groupBy("conv_id").agg(F.max(F.struct("block", F.col("chain").alias("key"), (F.col("pre") + sum_of).alias("total"))).alias("t"), F.count("*").alias("n"))
    each = convs.join(tails, "conv_id", "left").join(own, "conv_id", "left")
    each = stored(each.select("conv_id", F.coalesce("t.key", F.lit(ROOT)).alias("key"), F.coalesce("x", "t.total", F.lit(0)).alias("x"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("n", F.lit(0)).alias("n")), "conversations")

    # The same groups again, now with these two summed.
    least = F.min(F.struct("conv_id", "x")).alias("least")
    summed = keyed_join(lone.select("conv_id", "chain"), each.select("conv_id", "x", "leaf", "n"), ["conv_id"], lone.count())
    summed = summed.groupBy("chain").agg(F.sum("x").alias("sx"), F.sum("leaf").alias("leaves"), least)
    weighed = lambda part: _turns_of(part.join(summed, "chain"), "sx", "leaves", "least").select("key", "sx", "leaves", "least")
    met = weighed(split).groupBy("key").agg(F.sum("sx").alias("sx"), F.sum("leaves").alias("leaves"), F.min("least").alias("least"))
    sums = weighed(plain).union(met)

    saved = F.col("sx") - F.col("least.x") - (F.col("members") - 1) * F.col("pre")
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = nodes.join(sums, "key").select("key", "owner", "depth", "above", "members", "children", "leaves", saved).toDF(*columns)
    over = each.agg(F.sum("x").alias("sx"), F.sum("leaf").alias("leaves"), least).where("sx is not null")
    top = over.select(F.lit(ROOT), F.col("least.conv_id"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(first.members), F.lit(below), F.greatest("leaves", F.lit(1)), F.col("sx") - F.col("least.x")).toDF(*columns)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.union(top).join(_ends(each), "key", "left").select(*columns[1:], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations as they are, each node with its last turn's role and text (null at the root)."""
    turns = numbered(conversations)
    nodes = trie(turns.select("conv_id").distinct(), turns.select("conv_id", "k", "digest", "chars"))
    return nodes.join(turns.select("conv_id", (F.col("k") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(conv_id::VARCHAR, '')])), lambda x, y: xor(xor(x, y) >> 1, 3988292384::UBIGINT * (xor(x, y) & 1))), 4294967295::UBIGINT)"
OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, ({_CRC} % {SHARED})::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.first AND k < h UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k >= h),
p AS (SELECT conv_id, row_number() OVER w AS d, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER w) AS key FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT conv_id, d, chars, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY d), '') AS parent FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(key, d) AS key FROM a GROUP BY conv_id) GROUP BY key),
n AS (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, any_value(chars) AS chars, count(*) AS members, min(conv_id) AS conv_id FROM a GROUP BY key),
k AS (SELECT parent AS key, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT DISTINCT x.key, y.key AS below, y.members, y.chars, k.kids FROM a AS x JOIN a AS z ON z.conv_id = x.conv_id AND z.d >= x.d JOIN n AS y ON y.key = z.key LEFT JOIN k ON k.key = y.key),
s AS (SELECT key, count(*) FILTER (kids IS NULL) AS leaves, sum((members - 1) * chars) AS saved FROM u GROUP BY key)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.members::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (key) LEFT JOIN n AS m ON m.key = n.parent LEFT JOIN k ON k.key = n.key LEFT JOIN e ON e.key = n.key"""
