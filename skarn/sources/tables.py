"""Reading inputs: directories of Parquet tables and single files of any format."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Formats Spark reads by itself, with options that suit plain files.
FORMATS = {"parquet": {}, "orc": {}, "json": {}, "text": {}, "csv": {"header": "true"}}


def read(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A file or directory as a DataFrame; CSV and JSON should be given a schema
    (without one Spark reads the data twice)."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.options(**{**FORMATS[format], **options})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(format).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = (), **options: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    writer = df.write.mode(mode).options(**{**FORMATS[format], **options})
    if parts := list(partition_by):
        writer = writer.partitionBy(*parts)
    writer.format(format).save(path)


def modified(spark: SparkSession, path: str) -> int:
    """When a file, or the list of files of a folder, last changed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return read(spark, f"{directory}/{name}.parquet")


def views(spark: SparkSession, directory: str, names: Iterable[str]) -> None:
    """Register tables of a directory as temporary views."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
