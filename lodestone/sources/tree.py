"""A tree of files as a sink: `write.format("filetree").save(folder)` of rows (path, source).

Every partition writes its own files, each under a name of its attempt first and then, whole, under its
own; a task that is run again writes the same.  The folder must be one that all executors share.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileTree(DataSource):
    """Options: path, the folder; suffix, put behind each path."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, source string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        at = {f: i for i, f in enumerate(schema.names)}
        if not {"path", "source"} <= at.keys():
            raise ValueError("a tree is written from rows of path and source")
        return _Writer(self.options["path"], self.options.get("suffix", ""), at["path"], at["source"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, suffix: str, path: int, source: int):
        self.folder, self.suffix, self.path, self.source = folder.removeprefix("file://"), suffix, path, source

    def target(self, path: str) -> str:
        parts = path.split("/")
        if not path or any(p in ("", ".", "..") or "\0" in p for p in parts):
            raise ValueError(f"{path!r} is no path below a folder")
        return os.path.join(self.folder, *parts) + self.suffix

    def write(self, rows) -> Written:
        n = 0
        for row in rows:
            to = self.target(row[self.path])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}.part")
            with open(part, "w", encoding="utf-8", errors="replace", newline="") as f:
                f.write(row[self.source] or "")
            os.replace(part, to)
            n += 1
        return Written(n)

    def commit(self, messages) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, "_SUCCESS"), "w") as f:
            f.write(str(sum(m.files for m in messages if m)))

    def abort(self, messages) -> None:
        """Files stay: they are whole, and another run writes them again."""


def write_tree(rows: DataFrame, folder: str, suffix: str = "") -> None:
    """rows(path, source) as files; a folder's files are dealt together."""
    rows.sparkSession.dataSource.register(FileTree)
    dealt = rows.select("path", "source").repartition(F.regexp_extract("path", "^(.*)/", 1))
    dealt.write.format("filetree").option("suffix", suffix).mode("append").save(folder)
