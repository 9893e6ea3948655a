"""Directories through Hadoop's file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A directory tree that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)))

    def files(self, name: str) -> list[tuple[str, int]]:
        """(path below the root, bytes) of all data files below a directory."""
        out, top = [], self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        if self.exists(name):
            it = self.fs.listFiles(self._path(name), True)
            while it.hasNext():
                s = it.next()
                path = s.getPath().toUri().getPath()[len(top) :]
                if not path.rsplit("/", 1)[-1].startswith(("_", ".")):
                    out.append((path, s.getLen()))
        return sorted(out)

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._path(new).getParent())
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def write(self, name: str, text: str) -> None:
        """A small file, whole or not at all."""
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(tmp, name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def changed(self, name: str) -> float:
        """When a file or directory was last written, in seconds."""
        return self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def newest(self, name: str) -> float:
        """When the newest file below a directory was written; of an empty one, the directory."""
        times, it = [], self.fs.listFiles(self._path(name), True)
        while it.hasNext():
            times.append(it.next().getModificationTime() / 1000)
        return max(times, default=self.changed(name))

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet; False if it is.  Of several writers one succeeds."""
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        try:
            if self.fs.getScheme() == "file":  # Hadoop's local files look first and create then
                none = self.spark.sparkContext._gateway.new_array(self.jvm.java.nio.file.attribute.FileAttribute, 0)
                self.jvm.java.nio.file.Files.createFile(self.jvm.java.io.File(path.toUri().getPath()).toPath(), none)
            out = self.fs.create(path, self.fs.getScheme() == "file")
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True
