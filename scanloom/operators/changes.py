"""Comparing scans: which files to scan again, and what changed in the findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom.plans.workspace import materialize

FINDING_KEY = ["repo_id", "rule_id", "file", "line"]


def manifest(files: DataFrame) -> DataFrame:
    """Path and content digest of every file; store it with a scan."""
    return files.select("repo_id", "path", F.sha2("content", 256).alias("content_sha"))


def changed_keys(files: DataFrame, last_manifest: DataFrame) -> DataFrame:
    """Manifest rows of files that are new or differ from the last scan. Digests are
    taken where the files are read; only they are shuffled. Keys are unique, so the anti
    join has no hot key."""
    return manifest(files).join(last_manifest, ["repo_id", "path", "content_sha"], "left_anti")


def changed_files(files: DataFrame, last_manifest: DataFrame) -> DataFrame:
    """The files to scan again, with their contents.

    The changed keys are written first: with their size known Spark broadcasts them if
    they are few, and contents stay where they are.
    """
    keys = materialize(changed_keys(files, last_manifest), "changed")
    return files.join(keys.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def removed_files(files: DataFrame, last_manifest: DataFrame) -> DataFrame:
    return last_manifest.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def rescan(files: DataFrame, last_manifest: DataFrame, last_findings: DataFrame, scan) -> DataFrame:
    """Findings of the current files from those of the last scan: ``scan(files)`` runs on
    changed files only, findings of unchanged ones are kept, and those of removed ones go.
    Equal to scanning everything, as long as ``scan`` looks at one file at a time."""
    changed = changed_files(files, last_manifest)
    fresh = scan(changed)
    gone = removed_files(files, last_manifest).select("repo_id", "path").unionByName(
        changed.select("repo_id", "path"))
    stale = gone.select("repo_id", F.translate("path", "\\", "/").alias("file"))
    return last_findings.join(stale, ["repo_id", "file"], "left_anti").unionByName(fresh)


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, fixed and changed findings between two scans (unchanged ones left out)."""
    old = before.select(*FINDING_KEY, F.col("severity").alias("severity_before"))
    new = after.select(*FINDING_KEY, F.col("severity").alias("severity_after"))
    status = (
        F.when(F.col("severity_before").isNull(), "new")
        .when(F.col("severity_after").isNull(), "fixed")
        .when(F.col("severity_before") != F.col("severity_after"), "severity_changed")
    )
    return (
        old.join(new, FINDING_KEY, "full")
        .withColumn("status", status)
        .filter(F.col("status").isNotNull())
    )
