"""Versioned entries in a folder that all machines share, each put once or not at all.

An entry is a small JSON file named by its version.  It is written under
another name and renamed without overwriting, so of two writers of one version
one gets a refusal, and no reader sees half an entry.  (A local file system
looks first and renames then; HDFS does both at once.)
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a session names none, as in tests, a folder in the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; it isn't made yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """What changes when files come, go or are written anew: a hash of their names, lengths and times."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    seen = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        at = path(folder)
        names = {path(f).getName() for f in files if f.rsplit("/", 1)[0] == folder}
        for s in at.getFileSystem(conf).listStatus(at):
            if s.getPath().getName() in names:
                seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


class Ledger:
    """The entries of one folder; versions count from 0."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = "") -> Any:
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def put(self, version: int, entry: dict[str, Any]) -> bool:
        """Whether this call, and no other, made the entry of ``version``."""
        draft, final = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{version:020d}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(entry).encode())
        out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self._hadoop.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), how)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def get(self, version: int) -> dict[str, Any]:
        stream = self._fs.open(self._path(f"{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict[str, Any]]:
        """The last version and its entry; -1 and none before the first."""
        found = self.versions()
        return (found[-1], self.get(found[-1])) if found else (-1, {})

    def drop_before(self, version: int) -> None:
        """Entries that later ones have replaced."""
        for v in self.versions():
            if v < version:
                self._fs.delete(self._path(f"{v:020d}.json"), False)
