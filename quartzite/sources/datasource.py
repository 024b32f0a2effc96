"""Archives as a Spark data source: `spark.read.format("quartzite_archive").load(folder)`, `df.write.format("quartzite_archive").save(folder)`.

A folder of container files, one or more a task.  Writing goes to a folder of its own that is moved into place when all tasks are
done, so a failed or repeated task leaves nothing behind; each file is a partition when it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quartzite.sources import archive

NAME, SUFFIX = "quartzite_archive", ".qza"


def store(path: str):
    """(file system, path in it): a URI of any store that Arrow knows, or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Container(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Container]:
        from pyarrow import fs

        files, root = store(self.path)
        if files.get_file_info(root).type == fs.FileType.File:
            return [Container(root)]
        found = files.get_file_info(fs.FileSelector(root, recursive=False))
        return [Container(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(SUFFIX)]

    def read(self, partition: Container) -> Iterator[tuple]:
        files, _ = store(self.path)
        with files.open_input_file(partition.path) as f:
            yield from archive.entries(f.read())


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, settings: archive.Settings, overwrite: bool, place: tuple[int, int]):
        self.path, self.settings, self.overwrite, self.place = path.rstrip("/"), settings, overwrite, place
        self.draft = f"{self.path}/_draft-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, draft = store(self.draft)
        files.create_dir(draft, recursive=True)
        rows = (r for b in iterator for r in zip(b.column(self.place[0]).to_pylist(), b.column(self.place[1]).to_pylist(), strict=True))
        names = []
        for _, _, data in archive.containers(rows, self.settings):
            names.append(f"part-{uuid.uuid4().hex}{SUFFIX}")
            with files.open_output_stream(f"{draft}/{names[-1]}") as out:
                out.write(data)
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = store(self.path)
        _, draft = store(self.draft)
        files.create_dir(root, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(SUFFIX)] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):  # only what the successful attempts wrote
            files.move(f"{draft}/{name}", f"{root}/{name}")
        for path in old:
            files.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, draft = store(self.draft)
        if files.get_file_info(draft).type == fs.FileType.Directory:
            files.delete_dir(draft)


class ArchiveSource(DataSource):
    """Options: path; when writing also solid (true), lossy (0), speed (normal).  Rows to write have the columns path and content."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return archive.ENTRY

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        o = self.options
        settings = archive.Settings(o.get("solid", "true").lower() == "true", int(o.get("lossy", "0")), o.get("speed", "normal"))
        names = schema.fieldNames()
        return ArchiveWriter(o["path"], settings, overwrite, (names.index("path"), names.index("content")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
