import os

from pyspark.sql import functions as F

from samewise.session import lookup, materialise, once_by, release
from tests.conftest import rows


def test_lookup_with_and_without_hot_keys(spark):
    df = spark.createDataFrame([(k % 7 if k < 60 else 9, k) for k in range(200)] + [(None, 5)], "k long, v long")
    table = materialise(df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")))
    want = rows(df.join(table.drop("n"), "k"), "k", "v", "least")
    for most in (10, 50, 1000):
        assert rows(lookup(df, table, "k", most), "k", "v", "least") == want
    assert "BroadcastHashJoin" in lookup(df, table, "k", 50)._jdf.queryExecution().toString()


def test_release_deletes_what_was_written(spark):
    df = materialise(spark.range(10))
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    release(df)
    assert not os.path.isdir(path)


def test_once_by(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), ("c", 3), ("a", 1)], "k string, v long")
    assert rows(once_by(df, "k"), "k", "v") == rows(once_by(df.dropDuplicates(["k"]), "k"), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]
