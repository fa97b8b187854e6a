"""Tables in the folder that driver and executors share: where a plan is cut, and where files are committed by one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its checkpoint folder; in local mode, where neither is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Files of a folder in any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._path(f"{self.path}/{name}" if name else self.path))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._path(self.path))) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or none of it: written under another name first. An existing file is an error."""
        target, beside = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        stream = self._files.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._files.exists(target) or not self._files.rename(beside, target):
            self._files.delete(beside, False)
            raise FileExistsError(f"{self.path}/{name}")

    def remove(self, path: str = "") -> None:
        """Removes the folder, or another one of the same store."""
        self._files.delete(self._path(path or self.path), True)
