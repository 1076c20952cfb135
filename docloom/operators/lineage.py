"""Intermediate tables in the cluster's shared folder, where lineage ends."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Session, path, table and the thread that wrote it.
_TABLES: list[tuple[SparkSession, str, DataFrame | None, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; in a local session that names none, one in Spark's warehouse."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/docloom-shared"


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _TABLES.append((spark, path, table, threading.get_ident()))
    return table


def scratch(spark: SparkSession) -> str:
    """A path of our own in the shared folder, which goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    _TABLES.append((spark, path, None, threading.get_ident()))
    return path


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once all that read them is written; others are left alone. What is never
    dropped goes when the driver's process ends."""
    for entry in [x for x in _TABLES if any(x[2] is t for t in tables)]:
        _TABLES.remove(entry)
        _remove(*entry[:2])


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what ``make`` returns; the tables that this thread cut on the way go, as nothing else reads them."""
    before, own = {x[1] for x in _TABLES}, threading.get_ident()
    table = cut(make())
    for entry in [x for x in _TABLES if x[1] not in before and x[2] is not table and x[3] == own]:
        _TABLES.remove(entry)
        _remove(*entry[:2])
    return table


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_tables() -> None:
    for spark, path, *_ in _TABLES:
        with contextlib.suppress(Exception):
            _remove(spark, path)
