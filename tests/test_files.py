"""Readers and writers return what was written."""

import pytest

from tessera.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_lines(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "business_id string, stars double")
    files.write_json_lines(table, f"{tmp_path}/out")
    assert [r for r in files.read_json_lines(spark, f"{tmp_path}/out", "business_id string, stars double").collect() if r["stars"]][0]["stars"] == 1.5
    (tmp_path / "bad.json").write_text('{"business_id": "a"\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{tmp_path}/bad.json", files.BUSINESSES).collect()


def test_csv(spark, tmp_path):
    table = spark.createDataFrame([(1, 2, 3, 2016), (4, 5, 0, 2016)], files.RATINGS)
    files.write_csv(table, f"{tmp_path}/out")
    assert rows(files.read_csv(spark, f"{tmp_path}/out", files.RATINGS)) == [(1, 2, 3, 2016), (4, 5, 0, 2016)]
    assert rows(files.read_csv(spark, f"{tmp_path}/out")) == [("1", "2", "3", "2016"), ("4", "5", "0", "2016")]
    (tmp_path / "other.csv").write_text('year,user_id,rate,business_id\n2016,7,1,8\n')
    assert rows(files.read_csv(spark, f"{tmp_path}/other.csv", files.RATINGS)) == [(7, 8, 1, 2016)]


def test_stop_words(spark, tmp_path):
    (tmp_path / "words").write_text("the of\n\n  and the")
    assert rows(files.read_stop_words(spark, f"{tmp_path}/words")) == [("and",), ("of",), ("the",)]


def test_profiles(spark, tmp_path):
    table = spark.createDataFrame([("business", 'b"1', ["x", 'y"']), ("user", "u1", [])], "kind string, id string, words array<string>")
    files.write_profiles(table, f"{tmp_path}/out")
    assert (spark.read.text(f"{tmp_path}/out").filter("value like '%user%'").first()[0]) == '{"user":["u1",[]]}'
    assert rows(files.read_profiles(spark, f"{tmp_path}/out")) == rows(table)


def test_json_document(spark, tmp_path):
    table = spark.sql("SELECT 1.5D AS mean, array('a', 'b') AS words, CAST(NULL AS STRING) AS none")
    files.write_json_document(table, f"{tmp_path}/out")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert lines == ['{"mean":1.5,"words":["a","b"],"none":null}']
    assert rows(files.read_json_document(spark, f"{tmp_path}/out", "mean double, words array<string>, none string")) == [(1.5, ["a", "b"], None)]


def test_entry_without_a_library(monkeypatch):
    """The engine's queries stay where a library of the other operators is missing."""
    import importlib

    import __spark_entry__ as contract
    from tessera import catalog

    real = importlib.import_module

    def missing(name, *rest):
        if name in ("tessera.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *rest)

    monkeypatch.setattr(contract.importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="xxhash"):
        assert {*contract.queries()} == {*catalog.QUERIES}
    with pytest.warns(UserWarning, match="xxhash"):
        assert {*contract.oracle_sql()} == {*catalog.ORACLES}


def test_spread(spark):
    from pyspark.sql import functions as F

    from tessera.session import spread

    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    few, many = spark.range(100).coalesce(1), spark.range(100, numPartitions=4)
    assert parts(spread(few)) == spark.sparkContext.defaultParallelism and spread(few).count() == 100
    assert spread(many) is many and spread(few.limit(0)).count() == 0
