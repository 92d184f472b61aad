"""Shared run-time helpers: table access and written hand-offs between the rounds of an iteration.

Rounds hand their state over as Parquet tables in the folder that the session names in
``spark.checkpoint.dir``, under the application's id. Such a table is a clean leaf for the next plan (no growing lineage) and, unlike a
local checkpoint, does not vanish with the executor that made it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, whatever store that path is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table up to which its layout is worth a look.
SMALL = 1 << 26


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than cores dealt out over all cores: its one row group would be one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL or len(df.inputFiles()) >= cores:
        return df
    return df.withColumn("loom_row", F.monotonically_increasing_id()).repartition(cores, "loom_row").drop("loom_row")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written state; a local one only in local mode, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            base = named.get()
        elif spark.sparkContext.master.startswith("local"):
            base = os.path.join(tempfile.gettempdir(), "graphloom-scratch")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/graphloom"


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's hand-offs; nothing in it outlives the application's use."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


#: Bounds of what is handed to a Python worker at once while a table is written.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


#: Only sides marked for it are broadcast. Sorted keys take a byte or two a row in a written table, so a file's size
#: says little of what its rows take in the driver.
MARKED_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def observed(df: DataFrame, label: str, marked: bool = False, **what: Column) -> tuple[DataFrame, dict]:
    """``df``, written, and aggregates of its rows by name: found by the job that writes them."""
    seen = Observation()
    out = materialize(df.observe(seen, *(c.alias(k) for k, c in what.items())), label, marked)
    return out, seen.get


def counted(df: DataFrame, label: str, what: Column) -> tuple[DataFrame, int]:
    """``df``, written, and in how many of its rows ``what`` is true: counted by the job that writes them."""
    out, seen = observed(df, label, n=F.count_if(what))
    return out, seen["n"]


def materialize(df: DataFrame, label: str, marked: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and return a DataFrame that reads it back. ``marked``: under ``MARKED_CONF``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    conf = BATCH_CONF | (MARKED_CONF if marked else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def view(table: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, made from a written ``table`` alone, as that table's name for ``discard``."""
    df._loom_path = table._loom_path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def clear(spark: SparkSession) -> None:
    """Delete all hand-offs of this application, once no DataFrame that reads them is needed."""
    delete(spark, scratch_dir(spark))


def is_empty(df: DataFrame) -> bool:
    """One job whatever the number of partitions; each stops at its first row."""
    return df.limit(1).count() == 0
