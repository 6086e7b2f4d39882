"""Small Spark helpers of the operators: tables, folds, written intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the held-out folds of the queries. A null id is in none of them: -1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % F.lit(modulus), F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local session without one gets a temporary folder."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="capsight-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Shuffle files go when the query that made them ends: what ``written`` wrote is read from its table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run within go when each one ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table_ in tables:
        jvm, conf = table_.sparkSession._jvm, table_.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in table_.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Ids that a task may hold as a broadcast set: 16 MB of longs.
BROADCAST_IDS = 2_000_000


def _by_size(frame: DataFrame, ids: DataFrame, key: str, how: str, bound: int) -> DataFrame:
    few = ids.limit(bound + 1).count() <= bound
    return frame.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


def semi_by_size(frame: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``frame`` whose key is in ``ids``: ids are broadcast if counted under ``bound``, else both are shuffled."""
    return _by_size(frame, ids, key, "left_semi", bound)


def anti_by_size(frame: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``frame`` whose key is not in ``ids``, or is null; by the same choice."""
    return _by_size(frame, ids, key, "left_anti", bound)
