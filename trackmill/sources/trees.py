"""Trees of files as a Spark data source: each row a file, read and written by tasks.

A tree is written in two phases. Tasks put whole files into a staged tree beside the target, each by a rename, so an
attempt that fails or runs twice leaves nothing half written; the driver then puts the staged tree in the target's
place by one rename, or removes it if a task failed for good. What the driver does doesn't grow with the
number of files. Folders may be local or in any store that Arrow's file systems open by its address.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Parts of a tree that a scan plans, about; bytes of content in a batch; bytes that a copy moves at a time.
PARTS, BATCH_BYTES, COPY_BYTES = 64, 16 << 20, 1 << 20
MANIFEST = "manifest.json"
_FILES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary())])


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(address)
    return found, path.rstrip("/")


def _inside(path: str) -> str:
    """A relative path that stays inside its tree."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"{path!r} is no path inside a tree")
    return path


class _Written(WriterCommitMessage):
    def __init__(self, files: int, size: int):
        self.files, self.size = files, size


class _TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        names = schema.fieldNames()
        if "path" not in names or not {"content", "source"} & set(names):
            raise ValueError("a tree is written from columns path and content or source")
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.extra = json.loads(options.get("manifest", "{}"))

    def _places(self) -> tuple[fs.FileSystem, str, str, str]:
        files, root = _opened(self.root)
        return files, root, f"{root}.new-{self.job}", f"{root}.part-{self.job}"

    def begin(self) -> _TreeWriter:
        """Make both folders, on the driver: a task never makes them, so none can bring them back after an abort."""
        files, _, new, part = self._places()
        files.create_dir(new)
        files.create_dir(part)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, _, new, part = self._places()
        own, made, done = f"{part}/{uuid.uuid4().hex}", {new}, _Written(0, 0)
        files.create_dir(own, recursive=False)
        for batch in iterator:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) if c in names else pa.nulls(batch.num_rows) for c in ("path", "content", "source")]
            for i in range(batch.num_rows):
                path, content, source = columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].as_py()
                to, scratch = f"{new}/{_inside(path)}", f"{own}/{done.files}"
                with files.open_output_stream(scratch) as out:
                    done.size += _copy(source, out) if content is None and source is not None else out.write(content or b"")
                _make(files, posixpath.dirname(to), made)
                files.move(scratch, to)
                done.files += 1
        files.delete_dir(own)
        return done

    def commit(self, messages: list[_Written]) -> None:
        files, root, new, part = self._places()
        there = files.get_file_info(root).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{root} is there already; a tree is only written whole")
        told = self.extra | {"files": sum(m.files for m in messages), "bytes": sum(m.size for m in messages)}
        with files.open_output_stream(f"{new}/{MANIFEST}") as out:
            out.write(json.dumps(told, sort_keys=True, separators=(",", ":")).encode())
        if there:
            files.move(root, f"{root}.old-{self.job}")
        files.move(new, root)
        for gone in (part, f"{root}.old-{self.job}"):
            _remove(files, gone)

    def abort(self, messages: list[_Written]) -> None:
        files, _, new, part = self._places()
        _remove(files, new)
        _remove(files, part)


def _make(files: fs.FileSystem, folder: str, made: set[str]) -> None:
    """A folder below one in ``made``, level by level."""
    if folder not in made:
        _make(files, posixpath.dirname(folder), made)
        files.create_dir(folder, recursive=False)
        made.add(folder)


def _copy(source: str, out) -> int:
    files, path = _opened(source)
    size = 0
    with files.open_input_stream(path) as stream:
        while chunk := stream.read(COPY_BYTES):
            size += out.write(chunk)
    return size


def _remove(files: fs.FileSystem, path: str, tries: int = 100) -> None:
    """Delete a folder, again if a task that is being stopped put something in meanwhile."""
    for left in range(tries, 0, -1):
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return
        try:
            files.delete_dir(path)
        except OSError:
            if left == 1:
                raise
            time.sleep(0.05)


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.parts = int(options.get("parts", PARTS))

    def partitions(self) -> list[_Part]:
        """Folders with all that is below them once there are enough, and those above with their own files only."""
        files, root = _opened(self.root)
        if files.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {root}")
        level, above = [root], []
        while level and len(level) < self.parts:
            below = sorted(x.path for folder in level for x in files.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory)
            above += level
            level = below
        return [_Part(x, False) for x in above] + [_Part(x, True) for x in level]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.root)
        rows, size = [], 0
        for x in sorted(files.get_file_info(fs.FileSelector(partition.folder, recursive=partition.deep)), key=lambda x: x.path):
            if x.type != fs.FileType.File or not x.path.lower().endswith(self.suffixes or ""):
                continue
            content = None
            if self.content:
                with files.open_input_stream(x.path) as stream:
                    content = stream.read()
            rows.append({"path": x.path[len(root) + 1 :], "length": x.size, "modified": x.mtime, "content": content})
            size += 200 + len(content or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _FILES)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FILES)


class FileTree(DataSource):
    """Format ``filetree``. Read: path (inside the tree), length, modified, content; options path, content, suffixes, parts.

    Write: columns path and content, or source (an address to copy from where content is null); options path and
    manifest (JSON that is kept in the tree's manifest beside the counts of files and bytes).
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, length long, modified timestamp, content binary"

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> _TreeWriter:
        return _TreeWriter(self.options, schema, overwrite).begin()


def read_tree(spark: SparkSession, root: str, content: bool = True, suffixes: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """The files of a tree but its manifest, of given suffixes in any case if there are any; content is null if not asked for."""
    spark.dataSource.register(FileTree)
    found = spark.read.format("filetree").option("content", str(content).lower()).option("suffixes", ",".join(suffixes)).option("parts", parts).load(root)
    return found.where(F.col("path") != MANIFEST)


def read_manifest(root: str) -> dict:
    files, path = _opened(root)
    with files.open_input_stream(f"{path}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def write_tree(rows: DataFrame, root: str, overwrite: bool = False, manifest: dict | None = None) -> None:
    """Write rows(path, content and/or source) as the tree ``root``, whole or not at all.

    Two rows of one path, or a path that leaves the tree, raise and write nothing. No rows: a tree of a manifest only.
    """
    again = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path").first()
    if again is not None:
        raise ValueError(f"several rows for {again['path']!r}")
    rows.sparkSession.dataSource.register(FileTree)
    rows.write.format("filetree").option("manifest", json.dumps(manifest or {})).mode("overwrite" if overwrite else "append").save(root)
