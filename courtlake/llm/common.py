"""Helpers shared by the operators: table access and tables stored on the cluster's shared folder."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.session import ensure_checkpoint_dir


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # of stored tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet on the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives Spark the table's size.
    """
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def forget(df: DataFrame) -> None:
    """Delete the folder of a table from ``stored`` that nothing will read again, as the rounds of a loop do."""
    path = _FOLDERS.pop(df, None)
    if path:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


SPARE = 4  # times the rows that a sample needs, which pass the hash threshold on average


def below_share(digest: Column, needed: int, of: Column | int) -> Column:
    """Whether a hex digest is so small that about ``SPARE * needed`` of ``of`` rows have such a one.

    Bounded samples take their rows of least digest from these, so that what is sorted does not grow
    with the table.
    """
    unit = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    return unit * (F.lit(of) if isinstance(of, int) else of) <= SPARE * needed
