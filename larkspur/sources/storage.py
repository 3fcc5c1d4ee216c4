"""Small metadata files beside the data, on any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Unset, a local session (as in tests) gets a folder of its own; a cluster
    without the setting is refused, since its machines share nothing known.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join("/tmp/checkpoints", f"larkspur-{os.getpid()}")
    return f"file://{own}"


class Store:
    """A folder, through Hadoop's file system layer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._keep = spark.sparkContext._gateway.new_array(rename, 1)
        self._keep[0] = rename.NONE

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def read(self, name: str) -> Any:
        lines = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        stream = self._fs.open(lines)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, content: Any) -> bool:
        """Write a new file whole, or not at all if one of that name exists: readers never see a part, and of several writers one succeeds."""
        new = self._path(self.path(f".{name}.{uuid.uuid4().hex}"))
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(json.dumps(content, indent=1).encode()))
        finally:
            out.close()
        try:
            self._context.rename(new, self._path(self.path(name)), self._keep)
        except Py4JJavaError:
            self._fs.delete(new, False)
            if self.exists(name):
                return False
            raise
        return True

    def names(self) -> list[str]:
        if not self.exists():
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(self._path(self.root))]

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(self.path(name))).getLength()
