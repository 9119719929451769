"""Files written by executors: one per row, whole or not at all, with a commit at the end.

``register`` makes ``df.write.format("tessera_files")`` available for tables
of (name, content). Every file is written under a name of its attempt and then
renamed, so a lost or repeated task leaves no half of one, and a repeated one
replaces equal bytes. The commit adds ``_SUCCESS`` with how many files and
bytes there are; nothing else passes the driver.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SUCCESS = "_SUCCESS"


def opened(path: str):
    """(file system, path in it) of an address or an absolute path; stores are those Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FileSink(DataSource):
    """``df.write.format("tessera_files").mode("append").save(path)`` for tables of (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema] != ["name", "content"]:
            raise ValueError("files are written from the columns name and content")
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        if overwrite:  # files of the same names are replaced as they come; others stay, but no longer count as complete
            self._drop(SUCCESS)

    def _drop(self, name: str) -> None:
        store, root = opened(self.path)
        try:
            store.delete_file(posixpath.join(root, name))
        except FileNotFoundError:
            pass

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        made = set()
        files = size = 0
        for name, content in rows:
            parts = posixpath.normpath(name).split("/")
            if not name or name.startswith("/") or ".." in parts:
                raise ValueError(f"not a name below the folder: {name!r}")
            target = posixpath.join(root, *parts)
            folder = posixpath.dirname(target)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            own = posixpath.join(folder, f".{parts[-1]}.{uuid.uuid4().hex}")
            try:
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, target)
            except BaseException:
                try:
                    store.delete_file(own)
                except OSError:
                    pass
                raise
            files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        with store.open_output_stream(posixpath.join(root, SUCCESS)) as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files of finished tasks stay; without ``_SUCCESS`` the folder is not complete."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def write_files(files: DataFrame, path: str) -> None:
    """Each row's content (text or bytes) as a file of its name below the path (R10); folders are made as needed. Null contents are empty files."""
    register(files.sparkSession)
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    files.select("name", content.alias("content")).write.format("tessera_files").mode("append").save(path)
