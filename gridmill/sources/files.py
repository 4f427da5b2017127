"""Files that tasks write by themselves: one per row, or as a format lays them out.

Tasks write below a staging folder of the job, and the names of their files to a list beside them. When all have ended, the
driver moves the files of the attempts that committed into place, reading the lists as streams; a job that fails removes the
staging folder and leaves what was there before. Stores are those pyarrow reaches (local and mounted folders, hdfs, s3, gs).
"""

import contextlib
import fnmatch
import os
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage)

RUN_BYTES, RUN_FILES = 64_000_000, 2_000  # of a partition that reads files
LIST_FILES, LIST_TASKS = 50_000, 32  # files of a task that lists a folder, and such tasks at most, since each reads all names
CONTENT_BYTES = 16_000_000  # contents of files that leave a task at a time
HASHED = 4_000_000  # names compared at a time, by a hash of 8 bytes each
MOVERS = 8  # threads that move files into place in a remote store; a local one has one at a time move in a folder
AT_ONCE = 1_000  # entries of a folder, or names, looked at in one call


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:/*", "/", path))
    return pafs.FileSystem.from_uri(path)


def entries(files: pafs.FileSystem, folder: str) -> Iterator[pafs.FileInfo]:
    """What is directly inside a folder, if it is there; a local folder is read as a stream."""
    if not isinstance(files, pafs.LocalFileSystem):
        yield from files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return
    with contextlib.suppress(FileNotFoundError), os.scandir(folder) as found:
        for some in batched(found, AT_ONCE):
            yield from files.get_file_info([e.path for e in some])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int = 0


class StagedWriter(DataSourceWriter):
    """What writers of files share: a folder and a list of names per task attempt, and moving or removing at the end."""

    def __init__(self, out: str, overwrite: bool):
        self.out, self.overwrite = out, overwrite
        self.staging = f"{out.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def begin(self) -> Written:
        context = TaskContext.get()
        self.names, self.made = None, set()
        return Written(f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}")

    def open(self, done: Written, name: str):
        """A stream to a new file of this task."""
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"a file name must stay below the output folder: {name}")
        if self.names is None:
            self.files, self.root = store(done.folder)
            self.files.create_dir(self.root, recursive=True)
            self.names = self.files.open_output_stream(f"{self.root}.names", compression=None)
        path = f"{self.root}/{name}"
        self._make(self.files, os.path.dirname(path), self.made)
        self.names.write(name.encode() + b"\0")
        done.files += 1
        return self.files.open_output_stream(path, compression=None)

    def end(self, done: Written) -> Written:
        """What a task returns when its files are written and closed."""
        if self.names is not None:
            self.names.close()
        return done

    @staticmethod
    def _make(files: pafs.FileSystem, folder: str, made: set[str]) -> None:
        if folder not in made:
            files.create_dir(folder, recursive=True)
            if len(made) == AT_ONCE:
                made.clear()
            made.add(folder)

    @staticmethod
    def _listed(files: pafs.FileSystem, folder: str) -> Iterator[bytes]:
        """The names a task wrote below its folder."""
        with files.open_input_stream(f"{folder}.names", compression=None) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *names, rest = (rest + chunk).split(b"\0")
                yield from names

    def _taken(self, files: pafs.FileSystem, out: str, folders: list[str], n: int) -> str | None:
        """A name that two rows have, or that is there already where files are added. A hash per name is held, of HASHED names at a time."""
        hashes = lambda: (np.fromiter(map(hash, self._listed(files, f)), np.int64) for f in folders)
        parts = max(1, -(-n // HASHED))
        for part in range(parts):
            found = np.sort(np.concatenate([h[h % parts == part] for h in hashes()] or [np.empty(0, np.int64)]))
            for some in batched(np.unique(found[1:][found[1:] == found[:-1]]).tolist(), AT_ONCE):
                some, seen = set(some), set()
                for name in (name for f in folders for name in self._listed(files, f) if hash(name) in some):
                    if name in seen:
                        return name.decode()
                    seen.add(name)
        if not self.overwrite:
            for f in folders:
                for some in batched((name.decode() for name in self._listed(files, f)), AT_ONCE):
                    for name, there in zip(some, files.get_file_info([f"{out}/{name}" for name in some])):
                        if there.is_file and not re.search("(^|/)[_.]", name):
                            return name
        return None

    def _move(self, files: pafs.FileSystem, out: str, folder: str) -> None:
        made = set()
        for name in self._listed(files, folder):
            to = f"{out}/{name.decode()}"
            self._make(files, os.path.dirname(to), made)
            files.move(f"{folder}/{name.decode()}", to)

    def commit(self, messages: list[Written | None]) -> None:
        files, out = store(self.out)
        wrote = [m for m in messages if m and m.files]
        folders = [store(m.folder)[1] for m in wrote]
        if name := self._taken(files, out, folders, sum(m.files for m in wrote)):
            self.abort(messages)
            raise ValueError(f"two rows have the file name {name}")
        if self.overwrite:
            for old in entries(files, out):
                if old.base_name != self.staging.rsplit("/", 1)[-1]:
                    (files.delete_file if old.is_file else files.delete_dir)(old.path)
        files.create_dir(out, recursive=True)
        with ThreadPoolExecutor(1 if isinstance(files, pafs.LocalFileSystem) else MOVERS) as pool:
            for _ in pool.map(lambda folder: self._move(files, out, folder), folders):
                pass
        self._clean()
        with files.open_output_stream(f"{out}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        quiet = 0
        for _ in range(150):  # tasks that are being stopped may still write for a moment
            quiet = 0 if self._clean() else quiet + 1
            if quiet == 10:
                break
            time.sleep(0.1)

    def _clean(self) -> bool:
        """Remove the staging folder; False if there was none."""
        files, staging = store(self.staging)
        if files.get_file_info(staging).type == pafs.FileType.NotFound:
            return False
        with contextlib.suppress(OSError):
            files.delete_dir(staging)
        return True


class OneFilePerRow(StagedWriter, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = self.begin()
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                with self.open(done, name) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
        return self.end(done)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FileReader(DataSourceReader):
    """Files in runs of some size. Spark's own binary source leaves empty files out, and an empty page is an answer too."""

    def __init__(self, path: str, glob: str):
        self.path, self.glob = path, glob

    def partitions(self) -> list[Files]:
        files, root = store(self.path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        runs, size = [[]], 0
        for i in sorted((i for i in found if i.is_file), key=lambda i: i.path):
            inside = i.path[len(root) + 1:]
            if re.search("(^|/)[_.]", inside) or not fnmatch.fnmatchcase(i.base_name, self.glob):
                continue
            if runs[-1] and (size + i.size > RUN_BYTES or len(runs[-1]) == RUN_FILES):
                runs.append([])
                size = 0
            runs[-1].append(i.path)
            size += i.size
        return [Files(r) for r in runs]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, root = store(self.path)
        for path in partition.paths:
            with files.open_input_stream(path, compression=None) as f:
                yield path[len(root) + 1:], f.read()


class RowFiles(DataSource):
    """Rows (name, content) as files; content is text (written in UTF-8) or bytes, null is an empty file.

    Read, content is bytes, and option `glob` chooses files by their own names. Names that begin with _ or . are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.options["path"], self.options.get("glob", "*"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OneFilePerRow(self.options["path"], overwrite)


def write_files(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Write (name, content) rows as files of those names below `out`; names must be unique.

    When the job ends the driver reads the names, not the contents, as a stream: for outputs of as many files as a folder may hold.
    """
    df.sparkSession.dataSource.register(RowFiles)
    df.select("name", "content").write.format("row_files").mode(mode).option("path", out).save()


def read_files(spark: SparkSession, out: str, glob: str = "*") -> DataFrame:
    """(name, content) of the files below `out` whose own names match a glob; others are not opened."""
    spark.dataSource.register(RowFiles)
    return spark.read.format("row_files").option("glob", glob).load(out)


class Share(InputPartition):
    """The files of a folder whose names' hash is `number` modulo `of`."""

    def __init__(self, number: int, of: int):
        self.number, self.of = number, of


class FolderReader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...], tasks: int):
        self.path, self.suffixes, self.tasks = path, suffixes, tasks

    def partitions(self) -> list[Share]:
        return [Share(i, self.tasks) for i in range(self.tasks)]

    def _files(self, share: Share) -> Iterator[tuple]:
        with os.scandir(self.path) as found:
            for e in found:
                name = e.name
                if not name.lower().endswith(self.suffixes) or name.startswith(".") or name.startswith("_") and "=" not in name:
                    continue
                with contextlib.suppress(FileNotFoundError, UnicodeEncodeError):  # Spark's readers leave these names out, too
                    if zlib.crc32(name.encode()) % share.of == share.number and not e.is_dir() and (s := e.stat()).st_size:
                        yield f"file:{os.path.join(self.path, name)}", s.st_mtime_ns // 1_000_000 * 1_000, s.st_size

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
        for some in batched(self._files(partition), AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], ["path", "modificationTime", "length"])


class FolderFiles(DataSource):
    """Rows (path, modificationTime, length) of the files directly inside a local or mounted folder, as Spark's binary source has them.

    Every task reads the names of the folder as a stream and asks for the sizes of its share, so nobody holds the list.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], tuple(self.options["suffixes"].split("/")), int(self.options["tasks"]))


def _local_folder(spark: SparkSession, folder: str) -> tuple[str, int] | None:
    """Path and number of entries of a folder that is read as any local one; None for other stores, patterns and partitioned folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() != "file" or re.search(r"[{}\[\]*?\\]", folder) or not os.path.isdir(uri.getPath()):
        return None
    n = 0
    with os.scandir(uri.getPath()) as found:
        for e in found:
            n += 1
            if "=" in e.name and e.is_dir():
                return None
    return uri.getPath(), n


def file_content(path: Column) -> Column:
    """The bytes of local files, read where they are used."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths in batches:
            held, size = [], 0
            for p in paths:
                with open(p.removeprefix("file:"), "rb") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= CONTENT_BYTES:
                    yield pd.Series(held)
                    held, size = [], 0
            if held:
                yield pd.Series(held)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary").asNondeterministic()(path)


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame | None:
    """(path, modificationTime, length, content) of the files directly inside a local or mounted folder whose names end so, in any case.

    Tasks list the folder, the driver counts its entries only. None where that does not do: other stores, patterns,
    partitioned folders.
    """
    found = _local_folder(spark, folder)
    if found is None:
        return None
    spark.dataSource.register(FolderFiles)
    tasks = min(LIST_TASKS, max(1, -(-found[1] // LIST_FILES)))
    listed = spark.read.format("folder_files").option("suffixes", "/".join(suffixes)).option("tasks", tasks).load(found[0])
    return listed.withColumn("content", file_content(F.col("path")))
