"""``format("chat")`` against the scan of the same files by expressions."""

import pytest
from pyspark.sql import functions as F

from parlance.sources import chat, chat_format

FILES = {
    "a.cha": "@UTF8\n@Begin\n*PAR:\thello\n\tworld .\n%mor:\tx\n\n@End\n", "b/c.cha": "@UTF8\r\n*INV:\tyes .\r\nodd line\r\n*no tab\r\n%x y\r\n@Media:\tf, audio\r\n", "b/empty.cha": "", "b/notes.txt": "*PAR:\tno\n",
    "b/long.cha": "@Begin\n" + "".join(f"*PAR:\tword {k} .\n" for k in range(9000)), "d/ü.cha": "@Comment:\té\U0001F600\n*PAR:\ta:\tb .\n",
}


@pytest.fixture()
def folder(spark, tmp_path):
    chat_format.register(spark)
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.select(F.element_at(F.split("file_id", "/"), -1).alias("f"), "line_idx", "kind", F.coalesce("key", F.lit("-")), "value").collect())


def test_lines_equal_the_scan(spark, folder):
    got = spark.read.format("chat").load(folder)
    want = chat.parse_lines(chat.read_chat(spark, folder))
    assert rows(got.where("file_id not like '%ü%'")) == rows(want.where("file_id not like '%C3%BC%' and file_id not like '%ü%'"))
    assert got.where("file_id like '%ü%'").count() == 2
    small = spark.read.format("chat").option("partitionBytes", 100).load(folder)
    assert small.rdd.getNumPartitions() == 4 and rows(small) == rows(got)
    assert chat.utterances(got.withColumn("line_idx", F.col("line_idx"))).where("file_id like '%a.cha'").first().text == "hello world"


def test_modes_and_columns(spark, folder):
    odd = spark.read.format("chat").load(folder).where("kind = 'error'")
    assert sorted(r.value for r in odd.collect()) == ["%x y", "*no tab", "odd line"]
    assert spark.read.format("chat").option("mode", "dropmalformed").load(folder).where("kind = 'error'").count() == 0
    with pytest.raises(Exception, match="not a transcript line"):
        spark.read.format("chat").option("mode", "failfast").load(folder).count()
    with pytest.raises(Exception, match="mode must be"):
        spark.read.format("chat").option("mode", "other").load(folder).count()
    some = spark.read.format("chat").schema("kind string, line_idx int").load(folder)
    assert some.columns == ["kind", "line_idx"] and some.where("kind = 'utterance'").count() == 9004 - 1
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("chat").schema("speaker string").load(folder).count()


def test_one_file_and_a_folder_without_any(spark, folder, tmp_path_factory):
    assert spark.read.format("chat").load(f"{folder}/a.cha").count() == 5
    assert spark.read.format("chat").load(str(tmp_path_factory.mktemp("none"))).count() == 0
    assert spark.read.format("chat").option("pathGlobFilter", "*.txt").load(folder).count() == 1
