"""Data sources of archives: members read by byte range, and folders of files written whole or not at all.

`members` reads archives of any size. Archives up to a split's size are dealt to tasks by
size, and their tables of contents are read there; of larger ones the table is read when
the scan is planned, and ranges of members are dealt. A task holds one member at a time
and what waits to go to Spark, never an archive. What can't be read is a row with an
error: an archive without a sound table of contents is one such row (member null); a
member that is encrypted, broken, larger than `most` bytes unpacked, or packed more than
`ratio` times over (the sign of a bomb, beyond a megabyte) is one. Directories are left
out. A member's ordinal is its place in the table; names may repeat.

`write_files` writes a file for each row (name, content). Tasks write into a folder of
their own attempt, so what failed or ran twice is never seen. When all are done, the
driver moves the files of the attempts that count; should a move fail, those moved go
back and what they replaced returns. A name that isn't a plain file name, one that two
rows share, or a null name is an error, and the folder stays as it was.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quire.sources.session import importable

MEMBERS = "archive string, member string, ordinal int, size long, content binary, error string"
#: Bytes of archives that a task reads, about.
SPLIT = 128 << 20
#: Bytes of a member, unpacked.
MOST = 512 << 20
#: Times that a member may be larger than what it is packed to.
RATIO = 1100
#: Bytes that wait in a task before they go to Spark.
HELD = 8 << 20


class Ranged(io.RawIOBase):
    """A file of any file system, read by ranges; a place before its start is an error of the system, as for other files."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        self.file = files.open_input_file(path)
        self.end = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.file.tell(), self.end)[whence]
        if place < 0:
            raise OSError("before the start")
        self.file.seek(min(place, self.end))
        return self.file.tell()

    def readinto(self, buffer) -> int:
        got = self.file.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def close(self) -> None:
        self.file.close()
        super().close()


@dataclass
class Share(InputPartition):
    """(path, first member, member after the last) of archives; all members if these are None."""

    parts: list[tuple[str, int | None, int | None]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.suffix = options["path"], options.get("suffix", ".epub")
        self.split, self.most, self.ratio = int(options.get("split", SPLIT)), int(options.get("most", MOST)), int(options.get("ratio", RATIO))

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.folder)
        shares, waiting, size = [], [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.base_name):
            if not info.is_file or not info.base_name.endswith(self.suffix):
                continue
            if info.size > self.split:
                shares += self.ranges(files, info.path)
                continue
            if waiting and size + info.size > self.split:
                shares.append(Share(waiting))
                waiting, size = [], 0
            waiting.append((info.path, None, None))
            size += info.size
        return [*shares, Share(waiting)] if waiting or not shares else shares

    def ranges(self, files: fs.FileSystem, path: str) -> list[Share]:
        """Shares of a large archive's members, by their packed sizes."""
        try:
            with io.BufferedReader(Ranged(files, path), 1 << 16) as f, zipfile.ZipFile(f) as z:
                sizes = [i.compress_size for i in z.infolist()]
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
            return [Share([(path, None, None)])]  # the task tells
        out, first, size = [], 0, 0
        for k, n in enumerate(sizes):
            if size and size + n > self.split:
                out.append(Share([(path, first, k)]))
                first, size = k, 0
            size += n
        return [*out, Share([(path, first, len(sizes))])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        held = 0
        for path, first, last in partition.parts:
            for row in self.members(files, path, first, last):
                rows.append(row)
                held += len(row[4] or b"") + 64
                if held >= HELD:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def members(self, files: fs.FileSystem, path: str, first: int | None, last: int | None) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1].removesuffix(self.suffix)
        try:
            with io.BufferedReader(Ranged(files, path), 1 << 16) as f, zipfile.ZipFile(f) as z:
                for k, info in list(enumerate(z.infolist()))[first:last]:
                    if not info.is_dir():
                        yield (name, info.filename, k, info.file_size, *self.content(z, info))
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as e:
            yield name, None, None, None, None, f"not a readable archive: {e}"

    def content(self, z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        if info.flag_bits & 1:
            return None, "encrypted"
        if info.file_size > self.most:
            return None, "too large"
        if info.file_size > 1 << 20 and info.file_size > self.ratio * max(info.compress_size, 1):
            return None, "packed too often over"
        try:
            # no more is unpacked than the table says, and the checksum is that of all of it
            with z.open(info) as member:
                return member.read(), None
        except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, OSError, RuntimeError, NotImplementedError) as e:
            return None, f"broken: {e}"

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in MEMBERS.split(", ")])


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.job = options["path"], uuid4().hex
        files, root = fs.FileSystem.from_uri(self.folder)
        files.create_dir(f"{root}/{self.staging}", recursive=True)

    @property
    def staging(self) -> str:
        return f".writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = fs.FileSystem.from_uri(self.folder)
        own = f"{root}/{self.staging}/{uuid4().hex}"
        files.create_dir(own, recursive=False)  # a task that outlives its job finds no folder to write to
        names: list[str] = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if not name or name in (".", "..") or name.startswith(".writing-") or any(c in name for c in "/\\\0"):
                    raise ValueError(f"{name!r} is not a plain file name")
                with files.open_output_stream(f"{own}/{name}") as f:
                    f.write(content.as_buffer() or b"")
                names.append(name)
        return Staged(own, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.folder)
        every = [(m.folder, name) for m in messages if m is not None for name in m.names]
        undo: list[tuple[str, str]] = []  # moves that take back what was done, in turn
        kept = f"{root}/{self.staging}/replaced"
        try:
            if len({name for _, name in every}) < len(every):
                raise ValueError("two rows have the same name")
            files.create_dir(kept)
            for folder, name in every:
                if files.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    files.move(f"{root}/{name}", f"{kept}/{name}")
                    undo.append((f"{kept}/{name}", f"{root}/{name}"))
                files.move(f"{folder}/{name}", f"{root}/{name}")
                undo.append((f"{root}/{name}", f"{folder}/{name}"))
        except Exception:
            for source, target in reversed(undo):
                files.move(source, target)
            raise
        finally:
            self.clear(files, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear(*fs.FileSystem.from_uri(self.folder))

    def clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class Archives(DataSource):
    """quire_archives: members of the archives of a folder; options suffix, split, most, ratio."""

    @classmethod
    def name(cls) -> str:
        return "quire_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class Files(DataSource):
    """quire_files: writes rows (name, content) as files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def members(spark: SparkSession, folder: str, suffix: str = ".epub", **limits: int) -> DataFrame:
    """MEMBERS of the archives of a folder of any file system that Arrow reaches; limits: split, most, ratio."""
    importable(spark).dataSource.register(Archives)
    return spark.read.format("quire_archives").options(suffix=suffix, **{k: str(v) for k, v in limits.items()}).load(folder)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (name, content), all or none."""
    importable(rows.sparkSession).dataSource.register(Files)
    rows.select("name", "content").write.format("quire_files").mode("append").save(folder)
