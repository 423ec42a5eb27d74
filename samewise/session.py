"""Session helpers: where intermediate results that must outlive executors are kept, and joins that keep hot keys apart."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 100_000  # rows of one key beyond which they aren't brought together
BROADCAST_ROWS = 1_000_000  # rows of a broadcast table at most


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is refused, since a
    machine-local folder there would be lost with its machine.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.TemporaryDirectory(prefix="samewise-")
            atexit.register(own.cleanup)
            named = own.name
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*done: DataFrame) -> None:
    """Deletes what ``materialise`` wrote of tables that nothing reads any more, such as the last round of a loop."""
    for df in done:
        written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if written.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(written.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame) -> DataFrame:
    """``table``, which is materialised, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], most: int = HOT_ROWS) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which is materialised and has one row for each key and in ``n`` how many of
    the rows have it. Rows of a key that more than ``most`` of them have stay where they are: those keys, at most one in
    ``most`` rows, are broadcast while there are at most BROADCAST_ROWS of them."""
    keys = [keys] if isinstance(keys, str) else keys
    hot = table.where(F.col("n") > most).drop("n")
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(table.drop("n"), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col("n") <= most).drop("n"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def once_by(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with one row for each key, where rows of one key are alike: only those of keys that occur more than once are
    shuffled, while there are at most BROADCAST_ROWS such keys."""
    repeated = materialise(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if repeated.isEmpty():
        return rows
    repeated = small(repeated)
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key]))
