"""Written intermediate tables, and even spreading of small inputs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


_local: dict[str, tempfile.TemporaryDirectory] = {}


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: what ``spark.checkpoint.dir`` names.

    A local session without the setting gets a temporary folder; a cluster has to name one,
    since executors share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.TemporaryDirectory(prefix="glossmeter-")     # removed when Python ends
    return _local[app].name


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are staged inside, at the end. What is built on them has to be written or kept by then."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(frame: DataFrame, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write a frame once and go on from the written table.

    Cuts the lineage, survives the loss of executors, and saves a second pass over the text.
    keep: the table outlives the scratch it is written in and belongs to the one around it, if any.
    by: a column with a folder for each of its values.
    """
    path = f"{stage_dir(frame.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    owner = _scratches[:-1] if keep else _scratches
    if owner:
        owner[-1].append(path)
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of writes that are over.

    It does so once the driver's collector has met what they belonged to, and a driver with memory to spare
    seldom collects, so that the files of all steps would pile up. Tables and results don't depend on it.
    """
    gc.collect()
    time.sleep(1.2)             # py4j tells the JVM once a second what Python has let go of
    spark.sparkContext._jvm.System.gc()


#: Bytes of a written table from which the steps over it are swept and taken in parts; below, that takes longer than it saves.
LARGE_BYTES = 48 << 20


def bytes_of(frame: DataFrame) -> int:
    """Bytes of a written table, as Spark estimates them from the files."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Setting of the session: partitions that an input of a single small file is dealt to.
SPREAD = "glossmeter.spread"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows to as many partitions as the session asks for in ``glossmeter.spread``.

    Off unless it is set. It is for inputs whose one file is one split, as in a local session;
    it moves the texts, so a large table, which has splits enough, is read without it.
    """
    parts = rows.sparkSession.conf.get(SPREAD, None)
    return rows.repartition(int(parts), key) if parts else rows


#: Rows, and bytes as Spark estimates them from the files, of a small table that a join may broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def small(frame: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if it is small by rows and by bytes; else Spark joins by a shuffle.

    The rows of the result are the same.
    """
    return F.broadcast(frame) if bytes_of(frame) <= most_bytes and frame.limit(most + 1).count() <= most else frame
