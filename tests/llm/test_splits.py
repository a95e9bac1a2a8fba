"""Tables whose splits change between readings, as they do when executors come and go: results must not."""

import pytest
from pyspark.sql import functions as F

from cuelake.llm import jobfolder, linedup, neardup, repeats, tiling

SF = "/root/testdata/sf0.001"
SPLITS = ("spark.sql.files.maxPartitionBytes", ["128m", "24k", "300k", "60k"])


def jobs(docs, items):
    return {
        "line report": lambda: linedup.line_report(docs, 4),
        "lines": lambda: linedup.without_common_lines(docs, 4).select("doc_id", F.md5("text")),
        "leaks": lambda: tiling.leaks(docs, items).select("doc_id", "item_id"),
        "without leaks": lambda: tiling.without_leaks(docs, items).select("doc_id"),
        "classes": lambda: neardup.classes(docs).select("doc_id", "class_id"),
        "one of each": lambda: neardup.one_of_each(docs).select("doc_id"),
        "repeats": lambda: repeats.repeat_report(docs, 35),
        "without repeats": lambda: repeats.without_repeats(docs, 35).select("doc_id", F.md5("text")),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("splits") / "documents")
    spark.read.parquet(f"{SF}/documents.parquet").write.option("parquet.block.size", 20_000).parquet(path)
    return spark.read.parquet(path), spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.mark.parametrize("name", list(jobs(None, None)))
def test_same_rows_however_often_the_splits_change(spark, tables, monkeypatch, name):
    docs, items = tables
    want = rows(jobs(docs, items)[name]())
    setting, values = SPLITS
    before = spark.conf.get(setting)
    step = [0]
    kept = jobfolder.kept

    def changing(df, folder):
        step[0] += 1
        out = kept(df, folder)
        spark.conf.set(setting, values[step[0] % len(values)])
        return out

    for module in (jobfolder, linedup, neardup, repeats, tiling):
        monkeypatch.setattr(module, "kept", changing)
    try:
        assert rows(jobs(docs, items)[name]()) == want
        assert step[0] > 1
    finally:
        spark.conf.set(setting, before)
