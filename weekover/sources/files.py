"""Small files of one folder, which can be created only where there is none yet.

Folders on the driver's machine or mounted there are reached directly; all others through
Spark's own Hadoop file systems. Both create a file by giving a complete one its name, which
fails if the name is taken: a hard link, or a rename that does not overwrite. That is atomic
on POSIX folders and on HDFS; an object store needs a file system that offers the same.
"""

from __future__ import annotations

import os
import shutil
import uuid
from typing import Protocol

from pyspark.sql import SparkSession


class Files(Protocol):
    def names(self) -> list[str]:
        """Files and folders in the folder, in order; none if it does not exist."""

    def read(self, name: str) -> str:
        """The text of a file, or FileNotFoundError."""

    def create(self, name: str, text: str) -> bool:
        """Create a file with a text, whole or not at all; false if the name is taken."""

    def remove(self, name: str) -> None:
        """Remove a file or folder with all it holds, if it is there."""


class LocalFiles:
    def __init__(self, folder: str):
        self.folder = folder

    def names(self) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self.folder) if not n.startswith("."))
        except FileNotFoundError:
            return []

    def read(self, name: str) -> str:
        with open(os.path.join(self.folder, name), encoding="utf-8") as file:
            return file.read()

    def create(self, name: str, text: str) -> bool:
        os.makedirs(self.folder, exist_ok=True)
        draft = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, os.path.join(self.folder, name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def remove(self, name: str) -> None:
        path = os.path.join(self.folder, name)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)


class HadoopFiles:
    def __init__(self, spark: SparkSession, folder: str):
        context = spark.sparkContext
        self._jvm, self._gateway = context._jvm, context._gateway
        self._hadoop = self._jvm.org.apache.hadoop.fs
        conf = context._jsc.hadoopConfiguration()
        self._folder = self._hadoop.Path(folder)
        self._fs = self._folder.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self.scheme = self._fs.getUri().getScheme()

    def _path(self, name: str):
        return self._hadoop.Path(self._folder, name)

    def names(self) -> list[str]:
        if not self._fs.exists(self._folder):
            return []
        found = (status.getPath().getName() for status in self._fs.listStatus(self._folder))
        return sorted(n for n in found if not n.startswith("."))

    def read(self, name: str) -> str:
        path = self._path(name)
        if not self._fs.exists(path):
            raise FileNotFoundError(str(path))
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        self._fs.mkdirs(self._folder)
        draft = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        # No option: a name that is taken is not overwritten.
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(name), options)
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def files(spark: SparkSession, folder: str) -> Files:
    found = HadoopFiles(spark, folder)
    if found.scheme != "file":
        return found
    return LocalFiles(folder.removeprefix("file://").removeprefix("file:"))
