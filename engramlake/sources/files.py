"""Small files beside tables, wherever Spark can reach them: made once and whole by one writer, listed and read."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has made what this one was to make."""


class Folder:
    """The files of one folder, by the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *parts: str):
        at = self._hadoop.Path("/".join((self.path, *parts)))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at, fs = self._at()
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, name: str) -> str:
        at, fs = self._at(name)
        stream = fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> None:
        """Makes the file ``name`` with ``text``, seen whole or not at all; ``Conflict`` if it is there."""
        draft, fs = self._at(f".draft-{uuid.uuid4().hex}")
        target, _ = self._at(name)
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename replaces there, a link doesn't
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                made = True
            else:
                made = not fs.exists(target) and fs.rename(draft, target)
        except FileExistsError:
            made = False
        fs.delete(draft, False)
        if not made:
            raise Conflict(f"{name} is another writer's")

    def remove(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)
