"""Publishing new files of a stored table so that a run which stops anywhere can be finished by the next one.

A run first writes its files to a staging folder, then a manifest into the table's `_commits` folder: which staged files to
move where and which old files to delete. Only then is the table touched: files move in, then old ones go. Every start of a
writer finishes the manifests it finds. Both steps may be repeated, so it does not matter where a run stopped: without a
manifest nothing has happened, with one all of it will. Moves are renames, so staging and table must be in one file system
that renames whole files (HDFS and local ones do). A table has one writer at a time.

Staged files keep their folders (`day=.../part-...`); Spark's file names are unique, so none meets another.
"""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import SparkSession

COMMITS = "_commits"


class Files:
    """The few file operations that publishing needs, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        whole = name.startswith("/") or re.match(r"[A-Za-z][\w+.-]*:/", name)
        return self._jvm.org.apache.hadoop.fs.Path(name if whole else posixpath.join(self.root, name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def _name(self, path) -> str:
        return path.toString().removeprefix(self._fs.makeQualified(self._path("")).toString().rstrip("/") + "/")

    def data_files(self, folder: str = "", hidden: bool = False) -> list[str]:
        """Names, relative to the root, of the data files below a folder; none if there is no such folder.

        Folders below it whose names begin with `_` or `.` count only if they are asked for.
        """
        if not self.exists(folder):
            return []
        found, listed = [], self._fs.listFiles(self._path(folder), True)
        above = len(posixpath.join(folder, "")) if folder else 0
        while listed.hasNext():
            name = self._name(listed.next().getPath())
            parts = name[above:].split("/")
            if not any(part.startswith(("_", ".")) for part in (parts[-1:] if hidden else parts)):
                found.append(name)
        return sorted(found)

    def relative(self, uri: str) -> str:
        """The name of a file that Spark tells as `_metadata.file_path`."""
        return self._name(self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(uri))))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def move(self, source: str, target: str) -> None:
        to = self._path(target)
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(self._path(source), to):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file is there whole or not at all."""
        stream = self._fs.create(self._path(f"{name}.writing"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(f"{name}.writing", name)


def finish(spark: SparkSession, table: str) -> list[str]:
    """Finishes what earlier runs have left, and gives their names."""
    files = Files(spark, table)
    pending = [name for name in files.names(COMMITS) if name.endswith(".json")]
    for name in pending:
        _apply(files, posixpath.join(COMMITS, name))
    return [name.removesuffix(".json") for name in pending]


def publish(spark: SparkSession, table: str, staged: str, replaced: list[str], run_id: str) -> None:
    """Moves the data files of a staging folder into the table and deletes the files (names in the table) they replace."""
    files, name = Files(spark, table), posixpath.join(COMMITS, f"{run_id}.json")
    files.write(name, json.dumps({"staged": staged, "add": Files(spark, staged).data_files(hidden=True), "remove": replaced}))
    _apply(files, name)


def _apply(files: Files, name: str) -> None:
    manifest = json.loads(files.read(name))
    for file in manifest["add"]:
        source = posixpath.join(manifest["staged"], file)
        if files.exists(source):  # else it has moved already
            files.move(source, file)
    for file in manifest["remove"]:
        files.delete(file)
    files.delete(manifest["staged"])
    files.delete(name)
