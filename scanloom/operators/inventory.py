"""Which files of a tree are scanned, by what, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import constants as K
from scanloom.functions import paths as P

SCAN, PRUNED, SKIPPED, TOO_LARGE, UNREADABLE = (
    "scan", "pruned_directory", "not_scannable", "too_large", "unreadable",
)


def with_decision(files: DataFrame, max_file_bytes: int | None = K.MAX_FILE_BYTES) -> DataFrame:
    """Add ``decision``; needs only ``path`` and ``size``. ``max_file_bytes`` None means no
    limit. A table with a column ``read_error`` says there which files could not be read."""
    path = F.col("path")
    decision = F.when(P.is_pruned(path), PRUNED).when(P.is_skipped(path), SKIPPED)
    if max_file_bytes is not None:
        decision = decision.when(F.col("size") > max_file_bytes, TOO_LARGE)
    unreadable = F.col("size").isNull()
    if "read_error" in files.columns:
        unreadable = unreadable | F.col("read_error").isNotNull()
    return files.withColumn("decision", decision.when(unreadable, UNREADABLE).otherwise(SCAN))


def is_skipped_generated() -> Column:
    """Of a table with a decision: is this a file of generated code or of a dependency?"""
    return F.col("decision").isin(PRUNED) | (
        (F.col("decision") == SKIPPED) & P.is_generated_path(F.col("path"))
    )


def inventory(files: DataFrame, max_file_bytes: int | None = K.MAX_FILE_BYTES) -> DataFrame:
    """One row per file: admission, routing and role. Never reads ``content``."""
    path = F.col("path")
    key = P.scanner_key(path)
    known = [c for c in ("repo_id", "path", "size", "read_error") if c in files.columns]
    return with_decision(files.select(*known), max_file_bytes).select(
        "repo_id", "path", "size", "decision",
        key.alias("scanner_key"),
        P.scanner_of(key).alias("ext_scanner"),
        P.runs_secrets(key).alias("run_secrets"),
        P.file_context(path).alias("file_context"),
        P.is_demo_fixture_path(path).alias("is_demo_fixture"),
        P.is_documentation_path(path).alias("is_documentation"),
        is_skipped_generated().alias("skipped_generated"),
    )


def scan_stats(files: DataFrame, max_file_bytes: int | None = K.MAX_FILE_BYTES) -> DataFrame:
    """File counters per repository. Counting combines on the map side, so a
    repository that owns most of the files costs no more than the others."""
    return count_decisions(inventory(files, max_file_bytes))


def count_decisions(inv: DataFrame) -> DataFrame:
    scanned = F.col("decision") == SCAN
    return inv.groupBy("repo_id").agg(
        F.count_if(scanned).cast("int").alias("scanned_files"),
        F.count_if(~scanned).cast("int").alias("ignored_files"),
        F.count_if("skipped_generated").cast("int").alias("skipped_generated_dependency_files"),
    )
