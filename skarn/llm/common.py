"""Shared plumbing of the text operators: reading inputs, materialising
intermediates in the cluster's shared folder, shipping this package."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words and is stripped from lines.
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skarn-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/skarn-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives
    the loss of executors, and keeps upstream work from running twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    free_shuffles(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables; all that was read from them must be written."""
    for df in tables:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._skarn_path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished query when the driver's garbage
    collector finds that nothing refers to it; with a large heap that is too late
    for the executors' disks."""
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers import it wherever they run; keep batches of whole texts small."""
    if spark.conf.get(BATCH_CONF, "10000") == "10000":  # Spark's default, made for short rows
        spark.conf.set(BATCH_CONF, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    package = os.path.basename(os.path.dirname(here))
    out = os.path.join(tempfile.mkdtemp(prefix="skarn-zip-"), f"{package}_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(os.path.join(root, package)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(out)


def id_bucket(col: str, modulus: int):
    """crc32 of the id written as text, modulo modulus (null for a null id)."""
    return F.crc32(F.col(col).cast("string")) % modulus


def hash_order(col: str):
    """A fixed pseudo-random order of rows by id, for bounded samples."""
    return F.xxhash64(F.lit("sample"), F.col(col))


def trim() -> None:
    """Give free memory of a Python worker back: workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
