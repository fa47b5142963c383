"""Small files and folders in any Hadoop file system."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import Conflict


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); a local one only in local mode without that setting."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lodestar_root", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = sc._lodestar_root = "file://" + tempfile.mkdtemp(prefix="lodestar-root-")
    return configured.rstrip("/")


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a new file whole, or fail if it is there: written beside under a name of its own, then renamed without overwriting."""
        jvm, target = self.spark._jvm, self._path(name)
        temp = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, target, none)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if self._fs.exists(target):
                raise Conflict(f"{name} was written by another writer") from None
            raise e

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def size(self) -> int:
        return self._fs.getContentSummary(self._path("")).getLength() if self._fs.exists(self._path("")) else 0
