from datetime import datetime

from samewise.streaming.exact import first_of_each_content


def test_copies_pass_once(spark, tmp_path):
    at = datetime(2026, 1, 1)
    data = [("a", "x\r\n", at), ("b", "x \n", at), ("c", "y", at), (None, "z", at), ("n", None, at)]
    df = spark.createDataFrame(data, "id string, content string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for normalized, expected in ((False, 3), (True, 2)):
        name = f"out_{normalized}".lower()
        q = first_of_each_content(stream, "at", normalized=normalized).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == expected
