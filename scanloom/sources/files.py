"""Reading source trees as files tables, and writing scan results.

Trees are read by the data source of ``sources.tree``. What is here writes what it reads once to
the shared folder, and opens the files of listings that come from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom import constants as K
from scanloom.functions.text import decode_utf8
from scanloom.operators.inventory import SCAN, with_decision
from scanloom.plans.workspace import materialize
from scanloom.sources import tree

_CHUNK_BYTES = 16 * 1024 * 1024


def list_tree(spark: SparkSession, root: str, repo_level: int = 1) -> DataFrame:
    """``repo_id, path, size, uri`` of every file under ``root``, enough for inventory and
    statistics. With ``repo_level`` 1 the directories directly below it are the repositories;
    with 0 it is one project, named after the directory."""
    inside = F.col("path") if repo_level == 0 else F.rtrim(F.concat_ws("/", "repo_id", "path"), F.lit("/"))
    return tree.inventory(spark, root, repoLevel=repo_level).select(
        "repo_id", "path", "size", F.concat(F.lit(root.rstrip("/") + "/"), inside).alias("uri"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add file contents. Output batches are cut by bytes, so that memory does not
    depend on how many rows arrive together."""
    for batch in batches:
        rows, held = [], 0
        for row in batch.to_pylist():
            raw, error = tree.contents(row["uri"]) if row.pop("wanted") else (None, None)
            rows.append({**row, "raw": raw, "read_error": error})
            held += len(raw or b"")
            if held >= _CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)


_READ_ARROW = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()),
                         ("uri", pa.string()), ("raw", pa.binary()), ("read_error", pa.string())])
_READ_TYPE = "repo_id string, path string, size bigint, uri string, raw binary, read_error string"


def read_contents(listing: DataFrame, max_file_bytes: int | None = K.MAX_FILE_BYTES) -> DataFrame:
    """A files table from listed files (batch, or a stream of manifests). Only files
    that will be scanned are opened; ``read_error`` says which of them could not be read."""
    wanted = with_decision(listing, max_file_bytes).select(
        "repo_id", "path", "size", "uri", (F.col("decision") == SCAN).alias("wanted")
    )
    return wanted.mapInArrow(_read, _READ_TYPE).select(
        "repo_id", "path", decode_utf8(F.col("raw")).alias("content"), "size", "read_error"
    )


def read_tree(spark: SparkSession, root: str, repo_level: int = 1,
              max_file_bytes: int | None = K.MAX_FILE_BYTES) -> DataFrame:
    """All files under ``root`` with the contents of those that will be scanned.

    Every file is opened once: the table is written, columnar, to the shared folder, and
    inventory, statistics and findings each read the columns they need from there.
    """
    files = tree.read(spark, root, repoLevel=repo_level, maxFileBytes=max_file_bytes or 0)
    return materialize(files.drop("modified"), "tree")


def write_result(result: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: str | None = None) -> None:
    writer = result.write.mode(mode).format(fmt)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
