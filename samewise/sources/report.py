"""Reports as JSON: the envelope is written by the driver, list-valued sections are read back as DataFrames."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EXTRA = "array<struct<line:int,text:string>>"
SCHEMA = (
    "options struct<normalize:boolean,minSubsetLines:int,maxSizeRatio:double>, fileIds array<string>, "
    "exactDuplicateGroups array<struct<hash:string,ids:array<string>,normalizedMatch:boolean>>, "
    f"containmentPairs array<struct<subset:string,superset:string,extra:{_EXTRA},finalSupersets:array<string>>>"
)


def write_report(report: Mapping, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, ensure_ascii=False)
        out.write("\n")


def write_sections(sections: Mapping[str, DataFrame], folder: str) -> None:
    """Each section as a table of its own: the form of a report that is too large for one document."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))


def write_csv(table: DataFrame, folder: str) -> None:
    """A table as CSV files with a header, one for each partition; quotes are doubled, and a null is written as \\N."""
    table.write.mode("overwrite").csv(folder, header=True, escape='"', nullValue="\\N")


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.csv(folder, schema=schema, header=True, escape='"', nullValue="\\N", multiLine=True)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool, bool]:
    """Claimed groups (hash, id), claimed pairs (subset, superset, extra, final_supersets), whether contents were
    normalised, and whether the report lists its files."""
    report = spark.read.schema(SCHEMA).json(path, multiLine=True)
    groups = report.select(F.explode("exactDuplicateGroups").alias("g")).select("g.hash", F.explode("g.ids").alias("id"))
    pairs = report.select(F.explode("containmentPairs").alias("p")).select("p.subset", "p.superset", "p.extra", F.col("p.finalSupersets").alias("final_supersets"))
    head = report.select(F.coalesce("options.normalize", F.lit(False)), F.col("fileIds").isNotNull()).first()
    return groups, pairs, bool(head[0]), bool(head[1])
