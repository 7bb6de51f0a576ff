"""Archives as a Spark data source: spark.read.format("procframe") and df.write.format("procframe").

Reading gives the rows of procframe.sources.archive.VALUES, one partition a file, each opened by its own task. Writing
takes rows (path, values) and puts one file a row below the folder; files go to temporary names and get theirs at commit.
Paths are those pyarrow.fs can open (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import archive


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, layout: archive.Layout):
        self.path, self.layout = path, layout

    def partitions(self) -> list[File]:
        system, root = _place(self.path)
        one = system.get_file_info(root)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = _place(self.path)
        with system.open_input_stream(partition.path) as stream:
            data = stream.read()
        try:
            found = archive.decompress(data, self.layout)
        except (ValueError, KeyError, TypeError) as problem:
            yield partition.path, None, None, None, None, None, None, str(problem)
            return
        v = found.values
        yield partition.path, found.kind, None if v is None else int(v.size), None if v is None else list(v.shape), None if v is None else str(v.dtype), found.rate, None if v is None else v.ravel().astype(float).tolist(), None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, layout: archive.Layout, overwrite: bool, dtype: str):
        self.path, self.layout, self.overwrite, self.dtype = path, layout, overwrite, dtype

    def write(self, iterator: Iterator) -> Written:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        done = []
        for row in iterator:
            name, temporary = f"{root}/{row['path']}", f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as stream:
                stream.write(archive.compress(np.array(row["values"] or [], float).astype(self.dtype), self.layout))
            done.append((temporary, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            keep = {temporary for temporary, _ in files}
            for f in system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)):
                if f.type == fs.FileType.File and f.path not in keep:
                    system.delete_file(f.path)
        for temporary, name in files:
            system.move(temporary, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _place(self.path)
        for temporary in (t for m in messages if m is not None for t, _ in m.files):
            system.delete_file(temporary)


class Archives(DataSource):
    """Options: path; magic (nine characters) and media_prefix for files under other names; dtype of written values."""

    @classmethod
    def name(cls) -> str:
        return "procframe"

    def schema(self) -> str:
        return archive.VALUES

    def _layout(self) -> archive.Layout:
        magic, prefix = self.options.get("magic"), self.options.get("media_prefix", "PROC_")
        return archive.with_magic(magic.encode(), prefix) if magic else archive.LAYOUT

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._layout())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._layout(), overwrite, self.options.get("dtype", "float64"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
