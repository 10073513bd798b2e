"""Small files and folders in any store that Spark reaches, by Hadoop's file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, below: str = "") -> list[str]:
        """Names of what lies in the folder, sorted; none where it does not exist."""
        path = self._at(f"{self.path}/{below}" if below else self.path)
        if not self._fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(path))

    def read(self, name: str) -> str:
        """A small text file, whole."""
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a small text file that must not be there yet; False if it is.

        It is written under another name and then renamed, so a reader sees the whole file or none. Where the
        file system renames atomically, as HDFS does, only one of two writers can win.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder, _, last = f"{self.path}/{name}".rpartition("/")
        target, draft = self._at(f"{folder}/{last}"), self._at(f"{folder}/_{last}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        context = hadoop.FileContext.getFileContext(self._fs.makeQualified(target).toUri(), self._fs.getConf())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def bytes(self, below: str) -> int:
        """Length of all files below a name; 0 where there are none."""
        path = self._at(f"{self.path}/{below}")
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def delete(self, below: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{below}"), True)

    def delete_at_exit(self) -> None:
        """The folder goes when the driver ends."""
        self._fs.deleteOnExit(self._at(self.path))
