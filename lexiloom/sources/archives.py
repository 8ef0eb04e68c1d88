"""Members of zip and tar.gz archives as rows: a data source whose tasks read ranges of members.

A zip file has a directory at its end, so its members are dealt into ranges of ``rangeMembers`` and each
task reads its own range.  A tar.gz is one stream that has to be unpacked from its start: it is one
task's work, member by member.  A member is in memory alone, never a whole archive, and none is left out.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, genre string, content binary"
RANGE_MEMBERS = 1000


class _File(io.RawIOBase):
    """A file of any file system as the archive readers want it: places before its start are an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, place: int, whence: int = 0) -> int:
        at = place + (0, self.file.tell(), self.size)[whence]
        if at < 0:
            raise OSError("before the start of the file")
        return self.file.seek(min(at, self.size))

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(uri: str) -> io.BufferedReader:
    system, path = fs.FileSystem.from_uri(uri)
    return io.BufferedReader(_File(system.open_input_file(path)), 1 << 18)


def archives_below(uri: str) -> list[str]:
    """Files of an archive, or of a folder and those below it, in order; named as ``uri`` is."""
    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        return [uri]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    within = len(path.rstrip("/")) + 1
    return sorted(f"{uri.rstrip('/')}/{f.path[within:]}" for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def sniffed(uri: str) -> str | None:
    """zip or tar.gz by the first bytes; null for anything else."""
    with _open(uri) as f:
        head = f.read(4)
    return "zip" if head in (b"PK\x03\x04", b"PK\x05\x06") else "tar.gz" if head[:2] == b"\x1f\x8b" else None


def folder_of(name: str) -> str | None:
    """The folder that a member is in, taken as its genre."""
    return name.rpartition("/")[0].rpartition("/")[2] or None


class Range(InputPartition):
    """Members [begin, end) of an archive, all if ``end`` is null."""

    def __init__(self, uri: str, kind: str, begin: int = 0, end: int | None = None):
        super().__init__((uri, begin))
        self.uri, self.kind, self.begin, self.end = uri, kind, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.members = options["path"], int(options.get("rangeMembers", RANGE_MEMBERS))

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for uri in archives_below(self.uri):
            kind = sniffed(uri)
            if kind == "zip":
                with _open(uri) as f, zipfile.ZipFile(f) as z:
                    n = len(z.infolist())
                out += [Range(uri, kind, a, min(n, a + self.members)) for a in range(0, n, self.members)]
            elif kind:
                out.append(Range(uri, kind))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for name, content in self._members(part):
            rows.append((part.uri, name, folder_of(name), content))
            size += len(content)
            if size >= 1 << 24:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "name", "genre", "content"])

    @staticmethod
    def _members(part: Range) -> Iterator[tuple[str, bytes]]:
        with _open(part.uri) as f:
            if part.kind == "zip":
                with zipfile.ZipFile(f) as z:
                    for info in z.infolist()[part.begin : part.end]:
                        if not info.is_dir():
                            yield info.filename, z.read(info)
            else:
                with tarfile.open(fileobj=f, mode="r|gz") as tar:
                    for m in tar:
                        if m.isfile():
                            yield m.name, tar.extractfile(m).read()


class Archives(DataSource):
    """``spark.read.format("archive").load(uri)``: (archive, name, genre, content) of every member."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_members(spark: SparkSession, uri: str, range_members: int = RANGE_MEMBERS) -> DataFrame:
    """Members of one archive or of a folder of archives; files that are no archives are passed by."""
    spark.dataSource.register(Archives)
    return spark.read.format("archive").option("rangeMembers", str(range_members)).load(uri)


def write_archives(docs: DataFrame, uri: str, kind: str = "zip", id_col: str = "doc_id", text_col: str = "text", genre_col: str = "source") -> int:
    """Each partition's texts as members ``genre/id.txt`` of an archive of its own below ``uri``; gives the number of archives.

    Null texts are empty members.  An archive is written under another name and then renamed, so a task
    that is tried again leaves one whole file.
    """
    columns = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(genre_col).cast("string"), F.lit("none")).alias("genre"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{task.partitionId():05d}.{kind}"
        beside = f"{path}/_part-{task.partitionId():05d}-{task.attemptNumber()}"
        n = 0
        with system.open_output_stream(beside) as out:
            if kind == "zip":
                target = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            else:
                target = tarfile.open(fileobj=out, mode="w|gz")
            with target:
                for batch in batches:
                    for i, genre, text in zip(*(batch.column(c).to_pylist() for c in ("id", "genre", "text")), strict=True):
                        data, member = text.encode(), f"{genre}/{i}.txt"
                        if kind == "zip":
                            target.writestr(member, data)
                        else:
                            info = tarfile.TarInfo(member)
                            info.size = len(data)
                            target.addfile(info, io.BytesIO(data))
                        n += 1
        if n:
            system.move(beside, name)
        else:
            system.delete_file(beside)
        yield pa.RecordBatch.from_arrays([pa.array([int(n > 0)], pa.int64())], names=["n"])

    return columns.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
