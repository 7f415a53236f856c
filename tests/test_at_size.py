"""What must hold so that a query's memory does not grow with its tables, and results that small tables do not reach."""

import random
import re

import pandas as pd
import pyarrow as pa

import __spark_entry__
from parlance.functions import models, slices
from parlance.operators import records, sequence, words


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_timings_are_never_broadcast(spark):
    words = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], "f long, g long, u long, p int")
    timings = spark.createDataFrame([(1, 0, 0, 5, 9)], "f long, g long, n long, a long, b long")
    out = records.injected(words, timings)
    assert "Broadcast" not in plan_of(out) and sorted(map(tuple, out.collect())) == [(1, 0, 0, 5, 9), (1, 0, 1, None, None)]


def sql_rows(name: str, folder, *tables: str) -> list[tuple]:
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_files_of_all_jobs_are_submitted(spark, tmp_path):
    rows = [(101, 1, 1, 7), (7, 2, 4, 7), (33, 1, 5, 8), (33, 2, 8, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = __spark_entry__.queries()["c22_job_conflicts"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sql_rows("c22_job_conflicts", tmp_path, "lineitem") == [(7, "p4", 7), (8, "p8", 33)]


def test_long_order_numbers_are_spelled_as_the_sql_reads_them(spark, tmp_path):
    spark.range(99_690, 99_720).union(spark.range(0, 12)).union(spark.range(9_000_000, 9_000_012)).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    out = __spark_entry__.queries()["h4_chinese_numbers"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sql_rows("h4_chinese_numbers", tmp_path, "orders")
    assert sequence.chinese_number(100_000_103) == "一亿零零一百零三"  # the operator still spells whole numbers, as the reference does


def test_parts_of_batches_stay_small_whatever_the_batch():
    rows = pa.array([["word"] * (k % 7) for k in range(5000)] + [["word"] * 50_000])
    own = list(slices.parts((rows, rows)))
    assert pa.chunked_array([x for x, _ in own]).to_pylist() == rows.to_pylist()
    assert all(len(x) == 1 or len(x) <= slices.PART_ROWS and 2 * x.nbytes <= slices.PART_BYTES for x, _ in own)


def test_objects_of_a_batch_are_made_part_by_part(spark):
    """A function sees no more rows than a part before its results are turned back: what it was given earlier is gone."""
    import gc

    def alive(row: list[int]) -> int:
        return sum(isinstance(x, list) and len(x) == 11 for x in gc.get_objects()) if row[0] % 2000 == 1999 else 0

    df = spark.range(0, 8000, 1, 1).selectExpr("transform(sequence(0, 10), k -> id + k) as row")
    most = df.select(slices.by_row(alive, "int", df["row"]).alias("n")).where("n > 1000").count()
    assert most == 0


def folded_parts(rows: list[tuple]) -> list[int]:
    """E9 word by word: rows (word, a, b) of a chunk."""
    out, part, size, end = [], 0, 0, None
    for word, a, b in rows:
        if size >= 2 and end is not None and a is not None and a - end >= words.LONG_PAUSE_MS and word.lower().strip("._") in words.STARTERS:
            part, size = part + 1, 0
        end = b if a is not None and b is not None else end
        size += 1
        out.append(part)
    return out


def test_long_pauses_are_found_by_windows(spark):
    r = random.Random(9)
    chunks = []
    for _ in range(40):
        at, rows = 0, []
        for _ in range(r.randrange(1, 14)):
            at += r.choice([100, 799, 800, 2000, 2000])
            rows.append((r.choice(["and", "So.", "you", "stone"]), *r.choice([(at, at), (at, at), (at, None), (None, None)])))
        chunks.append(rows)
    df = spark.createDataFrame([(1, c, i, *x) for c, rows in enumerate(chunks) for i, x in enumerate(rows)], "f long, chunk long, i long, word string, a long, b long")
    out = words.long_pauses(df)
    assert "Pandas" not in plan_of(out) and plan_of(out).count("Sort ") == 1
    assert [x.part for x in sorted(out.collect(), key=lambda x: (x.chunk, x.i))] == [p for rows in chunks for p in folded_parts(rows)]


def test_words_of_utterances_are_sorted_once(spark):
    rows = [(1, 0, ","), (1, 1, "a."), (1, 2, "b"), (1, 3, ","), (2, 0, "‡"), (3, 0, "x"), (3, 1, "?")]
    out = words.into_utterances(spark.createDataFrame(rows, "f long, p int, word string"))
    assert plan_of(out).count("Sort ") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, ","), (1, 0, 1, "a"), (1, 0, 2, "."), (1, 1, 0, "b"), (1, 1, 1, "."), (3, 0, 0, "x"), (3, 0, 1, "?")]


def test_compounds_are_not_sorted_again_by_runs(spark):
    rows = [(1, 1, p, w) for p, w in enumerate("ice ice ice cream ice cream van".split())]
    out = words.merged_compounds(spark.createDataFrame(rows, "f long, u long, p int, word string"), spark.createDataFrame([("ice", "ice"), ("ice", "cream")], "first string, second string").hint("merge"))
    assert not re.search(r"Sort \[f#\S+ ASC NULLS FIRST, u#\S+ ASC NULLS FIRST, m#", plan_of(out))  # before: sorted again by matches, and by their runs
    assert [x.word for x in sorted(out.collect(), key=lambda x: x.p)] == ["iceice", "icecream", "icecream", "van"]


def test_models_are_given_few_rows(spark):
    sizes = list(models.few_rows(lambda bs: (len(b) for b in bs))(iter([pd.DataFrame({"x": range(1000)})])))
    assert max(sizes) <= models.MODEL_ROWS and sum(sizes) == 1000


def test_a_tagged_sentence_is_made_once(spark):
    query = __spark_entry__.queries()["h18_tagged_sentence"](spark, __spark_entry__.SMOKE_DIR)
    assert plan_of(query).count("door zogen") <= 1  # before: once for the filter and for each column


def test_words_of_text_grids_are_not_sorted_by_windows(spark):
    from parlance.sources import files

    rows = [(1, 0, 1, 'say "a"', 0, 300), (1, 0, 2, "b", 300, 500), (1, 1, 3, "c", 800, 900), (1, 0, 4, "d", None, 950), (2, 0, 5, "e", 100, 200)]
    out = files.text_grids(spark.createDataFrame(rows, "f int, speaker int, i int, word string, a int, b int"))
    assert "lag(" not in plan_of(out) and "lead(" not in plan_of(out)
    got = {r.f: re.findall(r"size = (\d+)|xmin = (\S+)\n *xmax = (\S+)\n *text = \"(.*)\"\n", r.text) for r in out.collect()}
    cells = {f: [x[1:] if x[1] else int(x[0]) for x in xs] for f, xs in got.items()}
    assert cells[1] == [2, 3, ("0.000", "0.300", 'say ""a""'), ("0.300", "0.500", "b"), ("0.500", "0.900", ""), 2, ("0.000", "0.800", ""), ("0.800", "0.900", "c")]
    assert cells[2] == [1, 2, ("0.000", "0.100", ""), ("0.100", "0.200", "e")]


def test_text_between_cantonese_entries_is_not_cut_into_characters(spark):
    entries, rng = sorted(words.CANTONESE, key=lambda k: (-len(k), k)), random.Random(5)
    texts = ["".join(rng.choice([*entries, *"".join(entries), "abc", " ", "你", "。", "\n", "𠮷", "？"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    out = rows.select("k", words.cantonese_characters(rows["t"]).alias("c"))
    assert "filter(" not in plan_of(out)

    def literal(text):
        done = ""
        while text:
            entry = next((e for e in entries if text.startswith(e)), text[0])
            done, text = done + words.CANTONESE.get(entry, entry), text[len(entry) :]
        return [c for c in done if not re.match("[\\s　、。，！？「」：；]", c)]

    got = {r.k: r.c for r in out.collect()}
    assert got.pop(len(texts)) is None and got == {k: literal(t) for k, t in enumerate(texts)}
