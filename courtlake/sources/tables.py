"""Where tables live: versions below ``root/layer/name`` as Parquet, with append and atomic replacement."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.schemas import SEASON, Schema, as_ddl

LAYERS = ("public", "staging", "marts", "analytics", "rejects", "keys", "states")
POINTER = "_CURRENT"
KEEP_SECONDS = 24 * 3600
"""How long a replaced version stays for the readers that began before."""


class Tables:
    """Parquet tables of a data root, grouped in layers.

    A table is a folder of versions, each written once and then only appended to, and a pointer file that
    names the current one. Readers look the pointer up once, so a frame reads one version whole, whatever
    is published meanwhile. Replacing the small pointer file is the only moment of change; no data moves.
    """

    def __init__(self, spark: SparkSession, root: str, keep_seconds: int = KEEP_SECONDS):
        self.spark, self.root, self.keep_seconds = spark, root.rstrip("/"), keep_seconds

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}, expected one of {LAYERS}")
        return f"{self.root}/{layer}/{name}"

    def exists(self, layer: str, name: str) -> bool:
        return self.current(layer, name) is not None

    def current(self, layer: str, name: str) -> str | None:
        """The folder of the current version; a folder without a pointer is taken as a version itself."""
        folder, fs = self.path(layer, name), self._fs()
        pointer = self._path(f"{folder}/{POINTER}")
        if fs.exists(pointer):
            stream = fs.open(pointer)
            try:
                return f"{folder}/{bytes(stream.readAllBytes()).decode()}"
            finally:
                stream.close()
        return folder if fs.exists(self._path(folder)) else None

    def read(
        self, layer: str, name: str, schema: Schema | None = None, since_season: int | None = None, seasons: list[int] | None = None
    ) -> DataFrame:
        """A table; with ``schema``, its columns only, and an empty one where there is none yet.

        ``since_season`` opens only the partitions of that season and later ones, ``seasons`` only those named.
        """
        version = self.current(layer, name)
        if schema is not None and version is None:
            return self.spark.createDataFrame([], as_ddl(schema))
        df = self.spark.read.parquet(version or self.path(layer, name))
        if since_season is not None and SEASON in df.columns:
            df = df.filter(F.col(SEASON) >= since_season)
        if seasons is not None and SEASON in df.columns:
            df = df.filter(F.col(SEASON).isin(seasons) if seasons else F.lit(False))
        return df if schema is None else df.select(*schema)

    def append(self, df: DataFrame, layer: str, name: str, partition_by: list[str] | None = None) -> None:
        """Add rows to the current version, in as few files as their size asks for."""
        version, columns = self.current(layer, name), partition_by or []
        if version is None:
            self.replace_all({name: df}, layer, {name: columns} if columns else None)
        else:
            df.hint("rebalance", *columns).write.mode("append").partitionBy(*columns).parquet(version)

    def replace(self, df: DataFrame, layer: str, name: str, partition_by: list[str] | None = None) -> None:
        """Write a new version, then point to it. ``df`` may itself read the table."""
        self.replace_all({name: df}, layer, {name: partition_by} if partition_by else None)

    def replace_all(self, frames: dict[str, DataFrame], layer: str, partition_by: dict[str, list[str]] | None = None) -> None:
        """Write new versions of all tables, and only then point to them, one after another.

        A failed write leaves every live table alone; a failed pointer puts back those replaced so far.
        Versions no longer pointed to are removed once they are ``keep_seconds`` old, so that readers
        that began before can finish.
        """
        before, fresh = {name: self.current(layer, name) for name in frames}, {}
        pointed: list[str] = []
        try:
            for name, df in frames.items():
                columns = (partition_by or {}).get(name, [])
                fresh[name] = f"{self.path(layer, name)}/version-{uuid.uuid4().hex}"
                if columns:
                    # Bring the rows of a partition together, split where it is large: not one file per task and value.
                    df = df.hint("rebalance", *columns)
                df.write.mode("errorifexists").partitionBy(*columns).parquet(fresh[name])
            for name, path in fresh.items():
                self._point(self.path(layer, name), path)
                pointed.append(name)
        except Exception:
            for name in reversed(pointed):
                self._point(self.path(layer, name), before[name])
            for name, path in fresh.items():
                self._drop(path if before[name] else self.path(layer, name))
            raise
        for name in frames:
            if before[name] and before[name] != self.path(layer, name):
                self._fs().create(self._path(f"{before[name]}/_REPLACED"), True).close()  # its age counts from now
            self.remove_old(layer, name)

    def replace_seasons(self, df: DataFrame, layer: str, name: str, by: str = SEASON) -> None:
        """Replace the partitions of the seasons in ``df`` within the current version; other seasons' files stay.

        ``df`` must not read the table itself. Spark moves the new files in when all are written.
        """
        version = self.current(layer, name)
        if version is None:
            self.replace(df, layer, name, [by])
            return
        writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(by).parquet(version)

    def remove_old(self, layer: str, name: str, keep_seconds: int | None = None) -> None:
        """Remove versions that were replaced, or left behind by a failure, ``keep_seconds`` ago or earlier."""
        keep = self.keep_seconds if keep_seconds is None else keep_seconds
        live = (self.current(layer, name) or "").rsplit("/", 1)[-1]
        for status in self._fs().listStatus(self._path(self.path(layer, name))):
            version = status.getPath().getName()
            if version.startswith("version-") and version != live and time.time() - status.getModificationTime() / 1000 >= keep:
                self._fs().delete(status.getPath(), True)

    def _point(self, folder: str, version: str | None) -> None:
        """Name the current version in one atomic step: a new pointer file takes the old one's name."""
        if version is None or version == folder:
            self._fs().delete(self._path(f"{folder}/{POINTER}"), False)
            return
        jvm = self.spark._jvm
        fresh, pointer = self._path(f"{folder}/{POINTER}-{uuid.uuid4().hex}"), self._path(f"{folder}/{POINTER}")
        stream = self._fs().create(fresh, True)
        stream.write(bytearray(version.rsplit("/", 1)[-1].encode()))
        stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().makeQualified(fresh).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs().makeQualified(fresh), self._fs().makeQualified(pointer), how)

    def _drop(self, path: str) -> None:
        self._fs().delete(self._path(path), True)

    def register_views(self, layer: str, frames: dict[str, DataFrame]) -> None:
        """Lazy views named ``layer_name``."""
        for name, df in frames.items():
            df.createOrReplaceTempView(f"{layer}_{name}")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
