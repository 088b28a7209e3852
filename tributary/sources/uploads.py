"""Uploads as a Spark data source: stored as one file each; scanned for sizes, reasons for refusal and content hashes by range reads.

A binary scan holds a file in one row and leaves out empty ones.  Here the files
are listed with their sizes and dealt to tasks by the bytes they have to read;
a task reads the first MiB of a file and, above two, the last.  A file of any
size costs two reads, an empty one is a row with its reason.

Tasks write the files they store themselves, into folders of a thousand: Spark's
file writers would make a folder, a checksum and two renames of each.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MIB = 1 << 20
FORMAT = "uploads"
NAMES = ["path", "length", "reject", "content_hash", "file_hash", "bytes_read"]
#: Files at most that a folder holds when they are stored, and that a task takes when they are scanned.
FOLDER_FILES, TASK_FILES = 1000, 5000
#: Begin of the names of folders whose files aren't stored yet; no scan looks into them.
STAGED = "_staged-"
SCHEMA = "path string, length long, reject string, content_hash string, file_hash string, bytes_read long"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def reason(path: str, length: int, max_bytes: int, suffix: str) -> str | None:
    """Why an upload is refused, by the first rule that applies."""
    if not path.lower().endswith(suffix):
        return "unsupported media type"
    if length > max_bytes:
        return "upload too large"
    return "empty upload" if length == 0 else None


def ends_hash(source, length: int) -> tuple[str, int]:
    """16 hexadecimal digits of the size, the first MiB and, above two MiB, the last; with the bytes read."""
    digest = hashlib.sha256(str(length).encode())
    head = source.read_at(min(MIB, length), 0)
    tail = source.read_at(MIB, length - MIB) if length > 2 * MIB else b""
    digest.update(head)
    digest.update(tail)
    return digest.hexdigest()[:16], len(head) + len(tail)


def whole_hash(source, length: int) -> tuple[str, int]:
    """16 hexadecimal digits of the whole content, a MiB at a time."""
    digest = hashlib.sha256()
    for at in range(0, length, MIB):
        digest.update(source.read_at(min(MIB, length - at), at))
    return digest.hexdigest()[:16], length


def _listed(store: fs.FileSystem, root: str) -> list[tuple[str, list]]:
    """(folder, [(name, size)]) of the files below ``root``, in order; folders of one depth are listed side by side."""

    def entries(folder: str):
        below = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name)
        inner = [i.path for i in below if i.type == fs.FileType.Directory and not i.base_name.startswith(STAGED)]
        return (folder, [(i.base_name, i.size) for i in below if i.type == fs.FileType.File]), inner

    found, folders = [], [root]
    with ThreadPoolExecutor(4) as pool:
        while folders:
            here = list(pool.map(entries, folders))
            found += [files for files, _ in here]
            folders = [path for _, inner in here for path in inner]
    return sorted(found)


@dataclass
class _Files(InputPartition):
    files: dict


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".mp4")
        self.max_bytes, self.whole = int(options.get("max_bytes", 500 * MIB)), options.get("whole", "false").lower() == "true"
        self.share, self.most = int(options.get("partition_bytes", 256 * MIB)), int(options.get("partition_files", TASK_FILES))

    def partitions(self):
        store, root = _place(self.path)
        parts, held, many = [{}], 0, 0
        for folder, name, size in ((folder, *file) for folder, files in _listed(store, root) for file in files):
            cost = 0 if reason(name, size, self.max_bytes, self.suffix) else size if self.whole else min(size, 2 * MIB)
            if many and (held + cost > self.share or many >= self.most):
                parts.append({})
                held = many = 0
            parts[-1].setdefault(folder, []).append((name, size))
            held += cost
            many += 1
        return [_Files(p) for p in parts]

    def read(self, partition):
        store, _ = _place(self.path)
        columns = [[] for _ in NAMES]
        for path, length in ((f"{folder}/{name}", size) for folder, files in partition.files.items() for name, size in files):
            refused, hashed, whole, read = reason(path, length, self.max_bytes, self.suffix), None, None, 0
            if not refused:
                with store.open_input_file(path) as source:
                    hashed, read = ends_hash(source, length)
                    if self.whole:
                        whole, more = whole_hash(source, length)
                        read += more
            for column, value in zip(columns, (path, length, refused, hashed, whole, read)):
                column.append(value)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


@dataclass
class _Stored(WriterCommitMessage):
    part: str


class _Writer(DataSourceArrowWriter):
    """A task fills a staged folder of its own; it is moved to its place as a whole when all tasks have ended."""

    def __init__(self, path: str):
        self.path, self.staged = path, f"{STAGED}{uuid.uuid4().hex}"
        store, folder = _place(path)
        store.create_dir(f"{folder}/{self.staged}", recursive=True)

    def write(self, iterator):
        store, folder = _place(self.path)
        part, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if "/" in (name or ""):
                    raise ValueError(f"the name {name!r} holds a slash")
                if n % FOLDER_FILES == 0:
                    store.create_dir(at := f"{folder}/{self.staged}/{part}/{n // FOLDER_FILES:06d}", recursive=True)
                with store.open_output_stream(f"{at}/{n % FOLDER_FILES:03d}-{name or ''}") as sink:
                    if content.is_valid:
                        sink.write(content.as_buffer())
                n += 1
        return _Stored(part if n else "")

    def commit(self, messages):
        store, folder = _place(self.path)
        for m in messages:
            if m and m.part:
                store.move(f"{folder}/{self.staged}/{m.part}", f"{folder}/{m.part}")
        store.delete_dir(f"{folder}/{self.staged}")

    def abort(self, messages):
        store, folder = _place(self.path)
        store.delete_dir(f"{folder}/{self.staged}")


class Uploads(DataSource):
    """``spark.read.format("uploads").load(folder)``; options suffix, max_bytes, whole (hash all bytes too), partition_bytes, partition_files.

    Writing takes (name string, content binary) by mode append, see ``store``.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("uploads are only added: mode('append')")
        return _Writer(self.options["path"])


def store(rows: DataFrame, path: str) -> None:
    """Store each row (name, content) as a file of its own below ``path``, beside the files that are there.

    A file's name ends in the row's, which holds no slash; rows of one name get
    a file each, a null content is empty.  Rows are written by the tasks that
    hold them, unshuffled; the files of a failed job don't stay.
    """
    rows.sparkSession.dataSource.register(Uploads)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").save(path)


def uploads(spark: SparkSession, path: str, max_bytes: int, suffix: str = ".mp4", whole: bool = False) -> DataFrame:
    """(path, length, reject, content_hash, file_hash, bytes_read) of every file below ``path`` but those that a job still stores.

    ``reject`` is null where the upload is taken; only those are read.
    ``file_hash`` is of the whole content and asked for by ``whole``.
    """
    spark.dataSource.register(Uploads)
    return spark.read.format(FORMAT).option("max_bytes", max_bytes).option("suffix", suffix).option("whole", str(whole).lower()).load(path)
