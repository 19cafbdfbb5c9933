"""Small metadata files on any file system that Spark reaches."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import StorageError


class Files:
    """Text files with atomic replacement, listing and removal, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str | None:
        """Content as UTF-8; None if there is no such file, ``StorageError`` if it can't be read."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        try:
            stream = fs.open(p)
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise StorageError(f"{path} can't be read: {e.java_exception.getMessage()}") from e

    def replace_text(self, path: str, text: str) -> None:
        """Writes a new file beside ``path`` and renames it over: readers see the old or the new."""
        self._place(path, text, "OVERWRITE")

    def create_text(self, path: str, text: str) -> None:
        """The same for a file that must not exist yet; ``StorageError`` if it does."""
        try:
            self._place(path, text, "NONE")
        except Py4JJavaError as e:
            self.remove(e.tmp)
            raise StorageError(f"{path} exists already or can't be written") from e

    def _place(self, path: str, text: str, mode: str) -> None:
        fs, p = self._at(path)
        tmp = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        opts = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        array[0] = getattr(opts, mode)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else fs.getUri(), self._conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), array)
        except Py4JJavaError as e:
            e.tmp = tmp.toString()
            raise

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it doesn't exist."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age_s(self, path: str) -> float:
        """Seconds since a file or folder was last changed, by the clock of this driver."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)
