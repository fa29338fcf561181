"""Folders of outputs that appear whole or not at all, on any file system that Spark reaches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

_MANIFEST = "_manifest.json"


class Staged:
    """Outputs of one run, written beside the folder they are for and moved there together by commit().

    A folder that holds something is refused at once, before any work, unless overwrite. If a run ends early, what it had finished stays staged, and a run with the
    same manifest goes on from there; with another one it starts anew. One run may work for a folder at a time.
    """

    def __init__(self, spark: SparkSession, out: str, manifest: dict, overwrite: bool = False):
        self._spark, self.out, self.stage = spark, out.rstrip("/"), f"{out.rstrip('/')}._staged"
        self._fs = self._path(self.out).getFileSystem(spark._jsc.hadoopConfiguration())
        if not overwrite and self._fs.exists(self._path(self.out)) and len(self._fs.listStatus(self._path(self.out))):
            raise FileExistsError(f"{out} exists")
        told = json.dumps(manifest, sort_keys=True)
        if self._read(_MANIFEST) != told:
            self._fs.delete(self._path(self.stage), True)
            self._fs.mkdirs(self._path(self.stage))
            stream = self._fs.create(self._path(f"{self.stage}/{_MANIFEST}"), True)
            stream.write(bytearray(told.encode()))
            stream.close()

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(name)

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.stage}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self._spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def output(self, name: str, write: Callable[[str], None]) -> str:
        """The path of the named output, which write makes there unless an earlier run has finished it."""
        path, mark = f"{self.stage}/{name}", self._path(f"{self.stage}/_done-{name}")
        if not self._fs.exists(mark):
            self._fs.delete(self._path(path), True)
            write(path)
            self._fs.create(mark, True).close()
        return path

    def commit(self) -> None:
        """Moves all outputs to the folder; what was there goes."""
        for status in self._fs.listStatus(self._path(self.stage)):
            if status.getPath().getName().startswith(("_done-", _MANIFEST)):
                self._fs.delete(status.getPath(), True)
        old = self._path(f"{self.out}._old")
        if self._fs.exists(self._path(self.out)):
            self._fs.delete(old, True)
            if not self._fs.rename(self._path(self.out), old):
                raise OSError(f"{self.out} can't be moved")
        if not self._fs.rename(self._path(self.stage), self._path(self.out)):
            raise OSError(f"{self.stage} can't be moved")
        self._fs.delete(old, True)


def inputs(spark: SparkSession, *paths: str | None) -> list:
    """Path, length and time of change of each file or of the files in each folder that a path or pattern names: what tells one input from another."""
    found = []
    for name in filter(None, paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(path) or []:
            rest = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [[x.getPath().toString(), x.getLen(), x.getModificationTime()] for x in rest]
    return sorted(found)
