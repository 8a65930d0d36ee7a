"""One call from a files table to inventory, findings and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from scanloom import constants as K
from scanloom.operators import detect as D, findings as N, inventory as I, rules as R, score as S
from scanloom.plans.workspace import materialize
from scanloom.schemas import FINDING_SCHEMA, SUMMARY_SCHEMA


@dataclass(frozen=True)
class ScanResult:
    """Lazy tables of a scan. ``scored`` carries the sort key and penalties that
    the report operators need; ``findings`` and ``summary`` are the public shapes."""

    files: DataFrame
    scored: DataFrame
    max_file_bytes: int | None = K.MAX_FILE_BYTES

    @property
    def inventory(self) -> DataFrame:
        return I.inventory(self.files, self.max_file_bytes)

    @property
    def stats(self) -> DataFrame:
        return I.scan_stats(self.files, self.max_file_bytes)

    @property
    def findings(self) -> DataFrame:
        return self.scored.select(*FINDING_SCHEMA.fieldNames())

    @property
    def summary(self) -> DataFrame:
        return S.summarize(self.scored, self.stats).select(*SUMMARY_SCHEMA.fieldNames())

    def stored(self) -> ScanResult:
        """Write the findings once and continue from the written table, so that
        several outputs do not each scan the files again."""
        return ScanResult(self.files, materialize(self.scored, "findings"), self.max_file_bytes)


def scan(files: DataFrame, max_file_bytes: int | None = K.MAX_FILE_BYTES,
         catalog: R.Catalog | None = None) -> ScanResult:
    """``files(repo_id, path, content, size)`` to findings and per-repository risk. Files over
    ``max_file_bytes`` are counted but not scanned; None scans files of any size. ``catalog`` holds
    rules and scanners of this scan."""
    raw = D.detect(files, unique=True, max_file_bytes=max_file_bytes, catalog=catalog)
    return ScanResult(files, S.with_penalties(N.final_findings(raw)), max_file_bytes)


def nested_by_file(result: ScanResult) -> DataFrame:
    """One row per file with its findings as an array, in report order. A file is read into
    one row, so its findings fit into one too; a repository's are never put into one."""
    ordered = F.struct("sev_rank", "line", "disc_ord",
                       F.struct(*FINDING_SCHEMA.fieldNames()[1:]).alias("finding"))
    return result.scored.groupBy("repo_id", "file").agg(
        F.sort_array(F.collect_list(ordered))["finding"].alias("findings")
    )


PART_FINDINGS = 1000


def by_repository(result: ScanResult, part_findings: int = PART_FINDINGS) -> DataFrame:
    """The response of every repository: its summary, and its findings in report order. A repository
    may have any number of findings, so they come in parts of ``part_findings``; the first
    part (``part`` 0 of ``n_parts``) carries the summary, and is there without findings too.

    A finding's place in the report is worked out in ranges: sorted ranges of all findings,
    counts of what a repository has in the ranges before, and the place within the range.
    """
    ranged = materialize(
        result.scored.repartitionByRange("repo_id", *N.SORT_KEY).withColumn("_range", F.spark_partition_id()),
        "ranged-findings")
    before = Window.partitionBy("repo_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("repo_id", "_range").count().select(
        "repo_id", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("repo_id", "_range").orderBy(*N.SORT_KEY)
    place = F.col("_before") + F.row_number().over(inside) - 1
    finding = F.struct(*FINDING_SCHEMA.fieldNames()[1:]).alias("finding")
    parts = (
        ranged.join(ranges, ["repo_id", "_range"]).withColumn("place", place)
        .groupBy("repo_id", F.floor(F.col("place") / F.lit(part_findings)).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("place", finding)))["finding"].alias("findings"))
    )
    summary = result.summary.select("repo_id", F.struct(*SUMMARY_SCHEMA.fieldNames()[1:]).alias("summary"))
    part = F.coalesce("part", F.lit(0))
    return summary.join(parts, "repo_id", "left").select(
        "repo_id", part.alias("part"),
        F.greatest(F.ceil(F.col("summary.total") / F.lit(part_findings)), F.lit(1)).cast("int").alias("n_parts"),
        F.when(part == 0, F.col("summary")).alias("summary"),
        F.coalesce("findings", F.array().cast(parts.schema["findings"].dataType)).alias("findings"))
