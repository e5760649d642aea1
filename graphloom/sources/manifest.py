"""Numbered manifests of a folder: small JSON files of which each number is created by one writer only."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class CommitClash(RuntimeError):
    """Another writer has committed since the version this one read."""


class Manifests:
    """``<folder>/versions/<number>.json`` through the file system that Spark uses for the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/versions"

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _system(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def head(self) -> int:
        """The newest number, 0 where there is none."""
        if not self._system().exists(self._path()):
            return 0
        names = [s.getPath().getName() for s in self._system().listStatus(self._path())]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def read(self, number: int) -> dict:
        path = self._path(f"{number}.json")
        if number < 1 or not self._system().exists(path):
            raise LookupError(f"no version {number}")
        stream = self._system().open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, number: int, content: dict) -> None:
        """Write manifest ``number``; of several writers the file system lets one do so, for the others it is a clash."""
        try:
            stream = self._system().create(self._path(f"{number}.json"), False)
        except Exception as error:
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                raise CommitClash(f"version {number} exists") from error
            raise
        stream.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        stream.close()
