"""Shared working storage.

Lineage is cut by writing a table into the folder the session names in
``spark.checkpoint.dir`` and reading it back, so a lost executor costs the
files it had not yet committed and nothing else.  Where the setting is absent, a
temporary folder is used if driver and executors are one process; elsewhere that
is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI or path of the folder that driver and executors share."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _FALLBACK[0], True)
    return "file://" + _FALLBACK[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialise` that are no longer needed."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_dir(spark)
    for folder in {os.path.dirname(f) for df in tables for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() == jvm.org.apache.hadoop.fs.Path(base).toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: How Python workers get memory: from one arena, of which little stays free, as workers live on
#: into later stages, whose JVM needs the room; Arrow's own pools would keep what they once had.  Temporary arrays of a slice stay below the first
#: size, so they don't cost a new mapping each time.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows in an Arrow batch where the session keeps Spark's default, which suits numbers, not whole texts.
ARROW_ROWS, ARROW_ROWS_DEFAULT = 2_000, "10000"


#: A key is hot if it has more than this part of the rows, so at most as many keys are, and more rows than one task minds.
HOT, HOT_ROWS = 1_000, 1_000


def join_counted(rows: DataFrame, values: DataFrame, on: list[str], counts: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` with the columns of ``values``, which has each key of ``rows`` once and the number of its rows in ``n``.

    Values of hot keys, at most ``HOT``, are broadcast; the rows of the others are shuffled.  Rows whose key ``values``
    doesn't have go.  ``counts`` is the sum and the maximum of ``n``, if they are known.  Without a hot key nothing is
    broadcast, which spares the driver two relations a join.
    """
    total, most = counts or values.agg(F.sum("n"), F.max("n")).first()
    least = max((total or 0) / HOT, HOT_ROWS)
    if (most or 0) <= least:
        return rows.join(values.drop("n"), on)
    hot, cold = values.where(F.col("n") > least).drop("n"), values.where(F.col("n") <= least).drop("n")
    some = rows.join(F.broadcast(hot), on)
    return some.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound their memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == ARROW_ROWS_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, *fields: str) -> StructType:
    """The schema of ``df`` and further fields, given as ``name type``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(fields)).fields])
