"""A sink of files under their own names: `df.write.format("named_files").mode("append").save(root)`.

Rows are name (a relative path) and content (binary). Task attempts write into a staging folder below the root;
only when all have ended does the driver list the moves in a manifest, make them, and drop the folder. A failed task or attempt
leaves no file that readers see; recover() completes the moves of a driver that was lost while it made them, and drops what was staged in vain.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".staging-"
MANIFEST = "manifest.json"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        files, path = pafs.FileSystem.from_uri(root.replace("file:/", "file:///") if root.startswith("file:/") and not root.startswith("file://") else root)
        return files, path.rstrip("/")
    return pafs.LocalFileSystem(), root.rstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    moves: list[tuple[str, str]]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = _open(self.root)
        attempt = f"{self.staging}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{attempt}", recursive=True)
        moves = []
        for number, row in enumerate(iterator):
            parts = (row.name or "").split("/")
            if any(x in ("", ".", "..") for x in parts) or parts[0].startswith(STAGING):
                raise ValueError(f"not a relative path of a file: {row.name!r}")
            with files.open_output_stream(f"{root}/{attempt}/{number}") as out:
                out.write(bytes(row.content or b""))
            moves.append((f"{attempt}/{number}", row.name))
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        moves = [m for x in messages if x for m in x.moves]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"a name is there twice: {next(n for n in names if names.count(n) > 1)}")
        files, root = _open(self.root)
        files.create_dir(f"{root}/{self.staging}", recursive=True)
        with files.open_output_stream(f"{root}/{self.staging}/{MANIFEST}") as out:
            out.write(json.dumps(moves).encode())
        _move(files, root, self.staging, moves)

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = _open(self.root)
        if files.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


def _move(files: pafs.FileSystem, root: str, staging: str, moves: list[tuple[str, str]]) -> None:
    """Makes the moves that aren't made yet; each file is the old or the new one at any time."""
    for staged, name in moves:
        if files.get_file_info(f"{root}/{staged}").type == pafs.FileType.File:
            files.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            files.move(f"{root}/{staged}", f"{root}/{name}")
    files.delete_dir(f"{root}/{staging}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one; use mode append")
        return NamedFilesWriter(self.options["path"])


def recover(root: str) -> int:
    """Completes writes that were committed but not moved, and drops those that weren't; returns how many it completed.

    Not to be called while a write to the same root is running.
    """
    files, path = _open(root)
    done = 0
    for info in files.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith(STAGING):
            manifest = f"{info.path}/{MANIFEST}"
            if files.get_file_info(manifest).type == pafs.FileType.File:
                with files.open_input_stream(manifest) as source:
                    _move(files, path, info.base_name, json.loads(source.read()))
                done += 1
            else:
                files.delete_dir(info.path)
    return done


def write_files(rows: DataFrame, root: str, name: Column, content: Column) -> None:
    """Writes a file a row; names are relative paths below root. A null content is an empty file.

    root must be reachable by executors and driver alike (a shared folder, HDFS or an object store that pyarrow knows). The driver moves files
    one by one: work that grows with their number, not with their size. Equal names are an error.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select(name.cast("string").alias("name"), content.cast("binary").alias("content")).write.format("named_files").mode("append").save(root)


def class_path(bug_id: Column, version: Column, test_base: Column) -> Column:
    """Where a generated test class goes: in a package of its own below the tests of a bug's version."""
    return F.concat_ws("/", bug_id, version, F.ltrim(test_base, F.lit("/")), F.lit("org/llm/LLMTests.java"))
