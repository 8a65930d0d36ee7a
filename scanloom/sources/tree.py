"""Source trees as a Spark data source, for batches and streams.

``spark.read.format("sourcetree").option("path", root).load()`` gives one row per file, names that
start with a dot included (Spark's own file sources leave them out, and with them every ``.env``).
``register(spark)`` makes the name known to a session.

How a read is planned. The planner looks at directories until it has seen ``planEntries`` entries,
with bounded memory: of a directory's names it keeps a thinning sample, whose quantiles
cut the directory into ranges of names with about ``taskBytes`` or ``taskFiles`` each. So a directory of a
million files is read by many tasks, each of which lists the names and opens only its own.
Small directories share a task. Directories that the planner didn't reach are walked by the
tasks, up to ``taskFolders`` by one; with few of them left, several tasks share the walk by a hash of the path.

Columns: ``repo_id, path, size, modified, content, read_error``. A schema that leaves out
``content`` (``inventory(spark, ...)``) reads names and sizes only. Filters on ``repo_id`` reach the planner and
the tasks. ``content`` is read of files that a scan would open: not below a skipped directory, of a
known kind, not larger than ``maxFileBytes`` (0: no limit); it is null for others. Malformed UTF-8 is
dropped. A file that can't be read after three attempts has a null content and a ``read_error``.

Streams (``readStream``) take files by time of change. An offset is a moment, ``settleSeconds`` before
now, so no listing passes through the driver: a batch's tasks look for files changed after its start and
not after its end. A file that changes again before it's read comes with the later batch, once.
Local trees use the time of the last status change, which a renamed file also gets, others the
modification time.

Options: ``repoLevel`` (1: the directories below the root are the repositories; 0: one project),
``maxFileBytes``, ``taskBytes``, ``taskFiles``, ``planEntries``, ``taskFolders``, ``leastTasks``,
``settleSeconds``.
Links to directories are not followed. An empty tree gives no rows; a file directly below the root is its own repository
with an empty path; a missing root is an error.
"""

from __future__ import annotations

import datetime as dt
import os
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
)
from pyspark.sql.types import StructType

from scanloom import constants as K

NAME = "sourcetree"
LISTED = "repo_id string, path string, size bigint, modified timestamp"
SCHEMA = f"{LISTED}, content string, read_error string"
ATTEMPTS = 3
_BATCH_BYTES = 16 << 20
_BATCH_ROWS = 4096
_SAMPLE = 1 << 14
_SCANNABLE = frozenset(K.SCANNABLE_SUFFIXES)
_SKIP_DIRS = frozenset(K.SKIP_DIRS)


def opened(path: str, size: int | None, max_bytes: int) -> bool:
    """Would a scan read this file? As ``operators.inventory`` decides for table rows."""
    parts = path.split("/")
    if size is None or (max_bytes and size > max_bytes):
        return False
    if any(p.lower() in _SKIP_DIRS for p in parts[:-1]) or parts[-1] in _SKIP_DIRS:
        return False
    name = parts[-1].lower()
    if name == ".env" or name.startswith(".env."):
        return True
    dot = name.rfind(".")
    return dot > 0 and name[dot:] in _SCANNABLE


@dataclass(frozen=True)
class Entry:
    name: str
    uri: str
    is_dir: bool
    size: int | None = None
    changed_ns: int = 0  # when it came to be what it is
    modified_ns: int = 0


def entries(uri: str) -> Iterator[Entry]:
    """What a directory holds, as a stream where the store allows it. A directory that vanished
    meanwhile, or may not be read, is empty."""
    filesystem, base = pafs.FileSystem.from_uri(uri)
    prefix = uri[: len(uri) - len(base)]
    try:
        if filesystem.type_name == "local":
            with os.scandir(base) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield Entry(e.name, prefix + e.path, True)
                        elif not e.is_symlink() or e.is_file():
                            s = e.stat()
                            yield Entry(e.name, prefix + e.path, False, s.st_size, max(s.st_ctime_ns, s.st_mtime_ns), s.st_mtime_ns)
                        elif not os.path.isdir(e.path):  # a broken link
                            yield Entry(e.name, prefix + e.path, False)
                    except FileNotFoundError:
                        continue
        else:
            for info in filesystem.get_file_info(pafs.FileSelector(base)):
                if info.type == pafs.FileType.Directory:
                    yield Entry(info.base_name, prefix + info.path, True)
                else:
                    at = info.mtime_ns or 0
                    yield Entry(info.base_name, prefix + info.path, False, info.size, at, at)
    except (FileNotFoundError, PermissionError):
        return


@dataclass
class Names:
    """A thinning sample of a directory's file names, with totals."""

    every: int = 1
    seen: int = 0
    size: int = 0
    kept: list[tuple[str, int]] = field(default_factory=list)

    def add(self, name: str, size: int) -> None:
        if zlib.crc32(name.encode()) % self.every == 0:
            self.kept.append((name, size))
            if len(self.kept) > _SAMPLE:
                self.every *= 2
                self.kept = [k for k in self.kept if zlib.crc32(k[0].encode()) % self.every == 0]
        self.seen += 1
        self.size += size

    def ranges(self, task_bytes: int, task_files: int) -> list[tuple[str, str | None, int, int]]:
        """(from name, up to name, bytes, files) of consecutive ranges."""
        parts = max(1, -(-self.size // task_bytes), -(-self.seen // task_files))
        names = sorted(self.kept)
        total = sum(1 + s for _, s in names) or 1
        cuts, upto = [], 0
        for name, size in names:
            # the range a name falls into goes by the bytes before it
            if upto * parts >= total * (len(cuts) + 1):
                cuts.append(name)
            upto += 1 + size
        lows, highs = ["", *cuts], [*cuts, None]
        return [(low, high, self.size // len(lows), -(-self.seen // len(lows))) for low, high in zip(lows, highs)]


@dataclass(frozen=True)
class Share:
    """Work of a task: the files of a directory with low <= name < high, or, where ``parts`` is set,
    all files below it whose path hash falls to ``part``."""

    uri: str
    low: str = ""
    high: str | None = None
    part: int = 0
    parts: int = 0

    def files(self) -> Iterator[Entry]:
        if not self.parts:
            for e in entries(self.uri):
                if not e.is_dir and e.name >= self.low and (self.high is None or e.name < self.high):
                    yield e
            return
        folders = [self.uri]
        while folders:
            for e in entries(folders.pop()):
                if e.is_dir:
                    folders.append(e.uri)
                elif zlib.crc32(e.uri.encode()) % self.parts == self.part:
                    yield e


class Task(InputPartition):
    def __init__(self, shares: list[Share], after_ns: int | None = None, upto_ns: int | None = None):
        self.shares, self.after_ns, self.upto_ns = shares, after_ns, upto_ns


class Tree:
    """Options and planning, common to batch and stream."""

    def __init__(self, options, schema: StructType):
        root = options.get("path")
        if not root:
            raise ValueError("option path is missing")
        self.root = root.rstrip("/") or "/"
        self.columns = schema.fieldNames()
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if set(self.columns) - known:
            raise ValueError(f"unknown columns: {sorted(set(self.columns) - known)}")
        self.schema = pa.schema([(c, _TYPES[c]) for c in self.columns])

        def number(name: str, default: int) -> int:
            value = int(options.get(name, default))
            if value < 0:
                raise ValueError(f"{name} must not be negative: {value}")
            return value

        self.repo_level = number("repoLevel", 1)
        if self.repo_level > 1:
            raise ValueError(f"repoLevel must be 0 or 1: {self.repo_level}")
        self.max_bytes = number("maxFileBytes", K.MAX_FILE_BYTES)
        self.task_bytes = number("taskBytes", 128 << 20) or 1
        self.task_files = number("taskFiles", 20_000) or 1
        self.plan_entries = number("planEntries", 50_000)
        self.task_folders = number("taskFolders", 1000) or 1
        self.least_tasks = number("leastTasks", 64)
        self.settle_seconds = float(options.get("settleSeconds", 2))
        self.repos: set[str] | None = None

    def keys(self, uri: str) -> tuple[str, str]:
        """Repository and path of a file."""
        inside = uri[len(self.root):].lstrip("/")
        if self.repo_level == 0:
            return self.root.rpartition("/")[2], inside
        repo, _, path = inside.partition("/")
        return repo, path

    def wants(self, uri: str) -> bool:
        return self.repos is None or self.keys(uri)[0] in self.repos

    def plan(self, after_ns: int | None = None, upto_ns: int | None = None) -> list[Task]:
        if not _is_folder(self.root):
            raise FileNotFoundError(f"no directory {self.root}")
        open_contents = "content" in self.columns
        frontier, seen, tasks = deque([self.root]), 0, []
        shares, size, files = [], 0, 0

        def put(share: Share, more_bytes: int, more_files: int) -> None:
            nonlocal shares, size, files
            if shares and (size + more_bytes > self.task_bytes or files + more_files > self.task_files):
                tasks.append(Task(shares, after_ns, upto_ns))
                shares, size, files = [], 0, 0
            shares.append(share)
            size, files = size + more_bytes, files + more_files

        while frontier and seen < self.plan_entries:
            folder = frontier.popleft()
            names = Names()
            for e in entries(folder):
                seen += 1
                if e.is_dir:
                    if folder != self.root or self.repo_level == 0 or self.wants(e.uri):
                        frontier.append(e.uri)
                elif after_ns is None or after_ns < e.changed_ns <= upto_ns:
                    weight = (e.size or 0) if open_contents and opened(self.keys(e.uri)[1], e.size, self.max_bytes) else 0
                    names.add(e.name, weight)
            if names.seen:
                for low, high, more_bytes, more_files in names.ranges(self.task_bytes, self.task_files):
                    put(Share(folder, low, high), more_bytes, more_files)
        if shares:
            tasks.append(Task(shares, after_ns, upto_ns))
        if frontier:
            # few folders are shared by several tasks each, many are dealt to tasks in runs
            left, least = list(frontier), max(1, self.least_tasks)
            parts, run = max(1, least // len(left)), max(1, min(self.task_folders, len(left) // least))
            tasks += [Task([Share(folder, part=k, parts=parts) for folder in left[low:low + run]], after_ns, upto_ns)
                      for low in range(0, len(left), run) for k in range(parts)]
        return tasks

    def read(self, task: Task | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for share in task.shares if task else []:  # Spark reads None where there is no partition
            for e in share.files():
                if not self.wants(e.uri) or (task.after_ns is not None and not task.after_ns < e.changed_ns <= task.upto_ns):
                    continue
                repo, path = self.keys(e.uri)
                row = {"repo_id": repo, "path": path, "size": e.size, "content": None, "read_error": None,
                       "modified": dt.datetime.fromtimestamp(e.modified_ns / 1e9, dt.UTC) if e.modified_ns else None}
                if "content" in self.columns and opened(path, e.size, self.max_bytes):
                    raw, row["read_error"] = contents(e.uri)
                    if raw is not None:
                        row["content"] = raw.decode("utf-8", errors="ignore")
                        held += len(raw)
                rows.append([row[c] for c in self.columns])
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


_TYPES = {"repo_id": pa.string(), "path": pa.string(), "size": pa.int64(), "modified": pa.timestamp("us", "UTC"),
          "content": pa.string(), "read_error": pa.string()}


def _is_folder(uri: str) -> bool:
    filesystem, base = pafs.FileSystem.from_uri(uri)
    return filesystem.get_file_info(base).type == pafs.FileType.Directory


def contents(uri: str) -> tuple[bytes | None, str | None]:
    """A file's bytes, or the error that several attempts ended with."""
    last = None
    for attempt in range(ATTEMPTS):
        try:
            filesystem, path = pafs.FileSystem.from_uri(uri)
            with filesystem.open_input_stream(path) as stream:
                return stream.read(), None
        except OSError as error:
            last = str(error)[:500] or type(error).__name__
            if isinstance(error, (FileNotFoundError, PermissionError)):
                break
            time.sleep(0.2 * 2 ** attempt)
    return None, last


class TreeReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.tree = Tree(options, schema)

    def pushFilters(self, filters: list[Filter]):
        """Takes equalities on ``repo_id``, and leaves all others to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("repo_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tree.repos = values if self.tree.repos is None else self.tree.repos & values
            else:
                yield f

    def partitions(self) -> list[Task]:
        return self.tree.plan()

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        self.tree = Tree(options, schema)

    def initialOffset(self) -> dict:
        return {"upto_ns": 0}

    def latestOffset(self) -> dict:
        return {"upto_ns": time.time_ns() - int(self.tree.settle_seconds * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        return self.tree.plan(start["upto_ns"], end["upto_ns"])

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options, schema)

    def streamReader(self, schema: StructType) -> TreeStreamReader:
        return TreeStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def read(spark: SparkSession, root: str, schema: str = SCHEMA, **options) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).schema(schema).options(path=root, **options).load()


def inventory(spark: SparkSession, root: str, **options) -> DataFrame:
    """Names and sizes only; no file is opened."""
    return read(spark, root, LISTED, **options)


def read_stream(spark: SparkSession, root: str, schema: str = SCHEMA, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).schema(schema).options(path=root, **options).load()
