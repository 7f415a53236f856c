"""Quality rules from a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are estimated: one from a
trusted target (documents that ``labels`` marks as good) and one from the whole raw
corpus.  A document's score is the mean log ratio of its n-grams, so that length cancels,
and a fixed threshold decides every document.  Everything runs as built-in expressions.

Results for odd input: a null text counts as empty; an empty text has no words, fails the
base rules and has score 0.  Rows are judged one by one, so repeated rows get equal
results, and columns other than ``doc_id`` and ``text`` are ignored, whatever their names.  An empty table, or one
without trusted rows, gives ratios of 0, and only the base rules decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.llm._common import SPACES, table, text_of, words_of

#: Buckets of the hashed n-grams; the model is two arrays of this length.
BUCKETS = 1 << 16
#: Trusted rows used for the target model, those with the smallest hashed id.
TARGET_ROWS = 20_000
#: Weight of the corpus multinomial in the smoothed target, in n-grams.
PRIOR = 10.0
#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.1
MIN_WORDS = 50


#: Bits of a window's hash that are sorted, above its position; what they hold to be equal is then compared word by word.
HASH_BITS = 32

#: Hashes of the pairs of neighbouring words, from ``wh``.
PAIRS = "zip_with(slice(wh, 1, greatest(size(wh) - 1, 0)), slice(wh, 2, size(wh)), (a, b) -> xxhash64(a, b))"


def _hashed(df: DataFrame) -> DataFrame:
    """Adds ``words`` and ``wh``, the hash of each word.

    An outer explode of one element binds the words, so that later steps don't split the text anew.
    """
    df = df.withColumn("words", F.explode_outer(F.array(words_of(text_of()))))
    return df.withColumn("wh", F.expr("transform(words, w -> xxhash64(w))"))


def base_counts(df: DataFrame) -> DataFrame:
    """Rows (row, text, wh, and the counts that the base rules read) from rows (row, text).

    Windows of three words are sorted by their hashes, with their positions packed into the
    same long.  Those whose hashes meet are few and are sorted once more by their words, so
    that only equal windows count as found again; the positions that stand in such windows
    are then counted by gaps.
    """
    low = 64 - HASH_BITS
    df = _hashed(df.select("row", "text"))
    df = df.withColumn("windows", F.expr("zip_with(zip_with(slice(wh, 1, greatest(size(wh) - 2, 0)), slice(wh, 2, greatest(size(wh) - 2, 0)), (a, b) -> xxhash64(a, b)), slice(wh, 3, greatest(size(wh) - 2, 0)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("packed", F.expr(f"sort_array(transform(windows, (h, i) -> shiftleft(shiftright(h, {low}), {low}) | i))"))
    met = F.expr(
        f"""array_distinct(flatten(filter(zip_with(slice(packed, 1, greatest(size(packed) - 1, 0)), slice(packed, 2, size(packed)),
          (x, y) -> if(shiftright(x, {low}) = shiftright(y, {low}), array(cast(x & {(1 << low) - 1} as int), cast(y & {(1 << low) - 1} as int)), null)), x -> x is not null)))"""
    )
    df = df.withColumn("met", F.explode_outer(F.array(met)))  # bound, as the words are
    df = df.withColumn("spelled", F.expr("sort_array(transform(met, i -> named_struct('w', concat_ws(' ', slice(words, i + 1, 3)), 'i', i)))"))
    df = df.withColumn(
        "again",
        F.expr(
            """sort_array(array_distinct(flatten(filter(zip_with(slice(spelled, 1, greatest(size(spelled) - 1, 0)), slice(spelled, 2, size(spelled)),
              (x, y) -> if(x.w = y.w, array(x.i, y.i), null)), x -> x is not null))))"""
        ),
    )
    df = df.withColumn("lines", F.filter(F.split(text_of(), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    return df.select(
        "row", "text", "wh",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text_of(), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(zip_with(slice(again, 1, greatest(size(again) - 1, 0)), slice(again, 2, size(again)), (x, y) -> least(3, y - x)), "
            "if(size(again) = 0, 0L, 3L), (a, x) -> a + x)"
        ).alias("n_repeat_words"),
    )


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of the trusted target: good rows of ``labels``, at most ``rows`` of them, by hashed id."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with ``lr``: for each bucket the log of its target over its corpus probability.

    All documents count for the corpus.  The target is broadcast; its rows are bounded by
    ``target_ids``.  Counts are summed in each partition before they are shuffled.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(target.withColumn("trusted", F.lit(1))), "doc_id", "left")
    grams = marked.withColumn("wh", F.transform(words_of(text_of()), lambda w: F.xxhash64(w))).select(
        F.coalesce("trusted", F.lit(0)).alias("trusted"),
        F.expr(
            f"concat(transform(wh, h -> cast(pmod(h, {buckets}) as int)), transform({PAIRS}, h -> cast(pmod(h, {buckets}) as int)))"
        ).alias("grams"),
    )
    seen = grams.select("trusted", F.explode_outer("grams").alias("g")).where("g is not null").groupBy("g").agg(F.count("*").alias("raw"), F.sum("trusted").alias("hit"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("g")).join(seen, "g", "left").na.fill(0, ["raw", "hit"])
    gathered = every.agg(F.sort_array(F.collect_list(F.struct("g", "raw", "hit"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("hit").alias("n_hit"))
    return gathered.select(
        F.expr(
            f"""transform(c, x -> if(n_hit = 0, 0D, ln((x.hit + {prior}D * {buckets} * (x.raw + 1D) / (n_raw + {buckets})) / (n_hit + {prior}D * {buckets}))
              - ln((x.raw + 1D) / (n_raw + {buckets}))))"""
        ).alias("lr")
    )


def score(df: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``llr``, the mean log ratio of a row's n-grams (0 without words), to rows with ``wh``."""
    model = ratios.first()["lr"]  # of fixed length
    lr = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")  # folded into one constant
    first = F.transform("wh", lambda h: lr[F.pmod(h, F.lit(buckets)).cast("int")])
    second = F.transform(F.expr(PAIRS), lambda h: lr[F.pmod(h, F.lit(buckets)).cast("int")])
    total = F.aggregate(F.concat(first, second), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("llr", F.when(F.size("wh") == 0, 0.0).otherwise(total / (2 * F.size("wh") - 1))).drop("wh")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Rows (row, counts, llr, base_failed, kept): ``row`` is a row of ``docs`` as a struct, so that its columns may have any names."""
    ratios = log_ratios(docs, target_ids(labels), buckets)
    out = score(base_counts(docs.select(F.struct("*").alias("row"), "text")), ratios, buckets).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the counts of the base rules, ``base_failed``, ``llr`` and ``kept``; columns of ``docs`` with such names are replaced."""
    out = judged(docs, labels, threshold, buckets)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in COUNTS], *COUNTS)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with the columns they came with."""
    out = judged(docs, table(spark, sf_dir, "labels"))
    # An outer explode of one element keeps the filter above the counts, which are then made once.
    held = out.select("row", F.explode_outer(F.array("kept")).alias("kept"))
    return held.where("kept").select("row.*")
