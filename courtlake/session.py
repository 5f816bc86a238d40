"""Session helpers: sane defaults for tests and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "courtlake", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans count on; cluster sizes are left to the caller.

    Forcing the skew rule lets a join on a crowded key be split even where the step after it groups
    by the same key, at the price of one more shuffle in that case only. The JVM does not compile
    methods above 8000 bytes of code: where a wide projection would generate one, splitting it
    into smaller methods outside whole-stage generation is several times faster.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; fall back only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="courtlake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the checkpoint folder, so that later uses read it back by column.

    The copy lives on shared storage: losing an executor does not lose it. Spark knows its size.
    """
    path = scratch_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder, deleted when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return folder.toString()
