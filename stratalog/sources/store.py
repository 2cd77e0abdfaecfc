"""Small driver-side files on whatever file system Spark reaches."""

from __future__ import annotations

import os

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self._conf), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def names(self, name: str) -> list[str]:
        fs, p = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        s = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def write(self, name: str, text: str, sync: bool = False, overwrite: bool = False) -> None:
        """Fails if the file is there, unless ``overwrite``: commits are created exclusively."""
        fs, p = self._at(name)
        s = fs.create(p, overwrite)
        try:
            s.write(bytearray(text.encode()))
            if sync:
                s.hsync()
        finally:
            s.close()

    def sync(self, name: str) -> None:
        """Forces the files of a directory that executors wrote to disk.

        Done here for local files only: other file systems take a closed file as
        durable or are told so by their own settings.
        """
        fs, p = self._at(name)
        if fs.getUri().getScheme() != "file":
            return
        folder = fs.makeQualified(p).toUri().getPath()
        for path in (*(os.path.join(folder, x) for x in os.listdir(folder)), folder):
            handle = os.open(path, os.O_RDONLY)
            try:
                os.fsync(handle)
            finally:
                os.close(handle)

    def replace(self, name: str, text: str) -> None:
        """Readers see the old or the new content, never part of it."""
        fs, p = self._at(name)
        tmp = f"{name}.new"
        self.write(tmp, text, sync=True, overwrite=True)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        flags = SparkContext._active_spark_context._gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        context.rename(self._at(tmp)[1], p, flags)

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)
