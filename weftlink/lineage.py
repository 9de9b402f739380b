"""Where plans are cut: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one only where the session names none and all runs in one process, as in tests."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftlink-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With it an execution removes its shuffle files at its end; else they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: a lost executor costs a read, and what follows is planned without what came before.

    Rows are first dealt into even partitions of the advisory size, so small tables become few files. The shuffle files of
    this are removed once all is written, for nothing reads them again.
    """
    shared_dir(df.sparkSession)
    with _cleaning(df.sparkSession):
        return df.hint("rebalance").checkpoint()


def cut_table(df: DataFrame) -> DataFrame:
    """As cut_lineage, but as a compressed table, of which later plans read the columns they need: for rows with texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.hint("rebalance").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
