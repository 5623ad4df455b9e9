"""Paths and files of any store Hadoop knows, through the session."""

from __future__ import annotations

import os
import posixpath
import tempfile

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_directory(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def make(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.mkdirs(p)

    def remove(self, path: str, recursive: bool = False) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, recursive)

    def list(self, path: str, recursive: bool = False) -> list[str]:
        """Files below a directory, ascending."""
        fs, p = self._at(path)
        found, names = fs.listFiles(p, recursive), []
        while found.hasNext():
            names.append(found.next().getPath().toString())
        return sorted(names)


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def extension(path: str) -> str:
    return posixpath.splitext(path)[1]


def parent(path: str) -> str:
    return posixpath.dirname(path.rstrip("/"))


def join(*parts: str) -> str:
    return posixpath.join(*parts)


def is_absolute(path: str) -> bool:
    return "://" in path or path.startswith("/")


def absolute(path: str) -> str:
    return path if is_absolute(path) else posixpath.normpath(posixpath.join(os.getcwd(), path))


def temporary() -> str:
    return tempfile.gettempdir()
