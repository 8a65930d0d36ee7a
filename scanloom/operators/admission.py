"""Admission of archives, uploads, repositories and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import constants as K
from scanloom.functions import paths as P

# Entries of one archive are totalled in ranges of this many ordinals.
RANGE = 4096


def escapes_root(path: Column) -> Column:
    """Does a relative path climb above its root at any point?"""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda acc, part: _step(acc, part),
    )
    return depth["least"] < 0


def _step(acc: Column, part: Column) -> Column:
    move = F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
    now = acc["now"] + move
    return F.struct(now.alias("now"), F.least(acc["least"], now).alias("least"))


# Reasons in the order they are checked for one entry.
REASONS = ("absolute_path", "null_byte", "path_escape", "file_too_large", "total_too_large",
           "too_many_files")


def _verdict(code: Column) -> Column:
    """Ordinal and reason in one number: the least of an archive is its first
    violation, found by a plain hash aggregate."""
    return F.col("ordinal").cast("bigint") * len(REASONS) + code


def entry_code(max_file_bytes: int = K.MAX_FILE_BYTES) -> Column:
    """Index of the reason why one entry alone rejects its archive; null if none does."""
    path = F.col("path")
    return (
        F.when(path.startswith("/"), 0)
        .when(F.contains(path, F.lit("\x00")), 1)
        .when(escapes_root(path), 2)
        .when(~F.col("is_dir") & (F.col("size") > max_file_bytes), 3)
    )


def archive_admission(
    entries: DataFrame,
    max_file_bytes: int = K.MAX_FILE_BYTES,
    max_total_bytes: int = K.MAX_TOTAL_BYTES,
    max_files: int = K.MAX_FILE_COUNT,
) -> DataFrame:
    """One row per archive: the first violation in entry order, or acceptance.

    Running totals are not taken over whole archives, which may be huge. Ordinal
    ranges are summed first; a window over the few range sums finds the range
    in which a limit is crossed, and only its entries are looked at one by one.
    Expects unique ordinals, from 0, within an archive.
    """
    staged = entries.withColumns({
        "range": F.expr(f"ordinal div {RANGE}"),
        "file_bytes": F.when(F.col("is_dir"), 0).otherwise(F.col("size")),
        "file_count": F.when(F.col("is_dir"), 0).otherwise(1),
    })
    alone = (
        staged.withColumn("verdict", _verdict(entry_code(max_file_bytes)))
        .groupBy("archive_id")
        .agg(F.min("verdict").alias("alone"), F.sum("file_count").alias("n_files"),
             F.sum("file_bytes").alias("total_bytes"))
    )
    before = (Window.partitionBy("archive_id").orderBy("range")
              .rowsBetween(Window.unboundedPreceding, -1))
    none = F.lit(0).cast("bigint")
    ranges = (
        staged.groupBy("archive_id", "range")
        .agg(F.sum("file_bytes").alias("range_bytes"), F.sum("file_count").alias("range_files"))
        .withColumns({
            "bytes_before": F.coalesce(F.sum("range_bytes").over(before), none),
            "files_before": F.coalesce(F.sum("range_files").over(before), none),
        })
    )

    def crossed(so_far: str, added: str, limit: int) -> Column:
        return (F.col(so_far) <= limit) & (F.col(so_far) + F.col(added) > limit)

    crossing = ranges.filter(
        crossed("bytes_before", "range_bytes", max_total_bytes)
        | crossed("files_before", "range_files", max_files)
    ).select("archive_id", "range", "bytes_before", "files_before")
    within = (Window.partitionBy("archive_id", "range").orderBy("ordinal")
              .rowsBetween(Window.unboundedPreceding, 0))
    running = (
        staged.join(crossing, ["archive_id", "range"])
        .withColumns({
            "bytes_so_far": F.col("bytes_before") + F.sum("file_bytes").over(within),
            "files_so_far": F.col("files_before") + F.sum("file_count").over(within),
        })
        .filter(~F.col("is_dir"))
        .withColumn("verdict", _verdict(
            F.when(F.col("bytes_so_far") > max_total_bytes, 4)
            .when(F.col("files_so_far") > max_files, 5)))
        .groupBy("archive_id")
        .agg(F.min("verdict").alias("in_total"))
    )
    first = F.least("alone", "in_total")  # least skips nulls
    names = F.array(*(F.lit(r) for r in REASONS))
    return alone.join(running, "archive_id", "left").select(
        "archive_id", "n_files", "total_bytes",
        first.isNull().alias("accepted"),
        F.when(first.isNotNull(),
               F.element_at(names, (first % len(REASONS) + 1).cast("int"))).alias("reason"),
        F.expr(f"least(alone, in_total) div {len(REASONS)}").alias("reject_ordinal"),
    )


def upload_admission(uploads: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Name and size guards of an upload; ``reason`` is null when it is accepted."""
    return uploads.withColumn(
        "reason",
        F.when(~F.lower(F.coalesce("filename", F.lit(""))).endswith(".zip"), "not_zip")
        .when(F.col("bytes") > max_bytes, "too_large"),
    )


def repo_admission(files: DataFrame, max_files: int = K.MAX_FILE_COUNT) -> DataFrame:
    """Count files outside skip directories; too many reject the repository."""
    counted = files.groupBy("repo_id").agg(
        F.count_if(~P.in_skip_dir(F.col("path"))).alias("n_files")
    )
    return counted.withColumn("accepted", F.col("n_files") <= max_files)


def normalize_repo_url(url: Column) -> tuple[Column, Column]:
    """(clone address, reason); exactly one of them is null for a non-null url."""
    clean = F.translate(F.regexp_replace(url, r"\A\s+|\s+\z", ""), "\t\r\n", "")
    scheme = F.lower(F.regexp_extract(clean, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(clean, r"\A[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"\A//([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*\z", "")
    has_query = rest.rlike(r"\A[^?#]*\?[^#]") | rest.rlike(r"\A[^#]*#[\s\S]")
    two_parts = r"\A/*([^/]+)/+([^/]+?)/*\z"
    owner = F.regexp_extract(path, two_parts, 1)
    repo = F.regexp_replace(F.regexp_extract(path, two_parts, 2), r"\.git\z", "")
    allowed = r"\A[A-Za-z0-9_.-]+\z"
    reason = (
        F.when(scheme != "https", K.URL_SCHEME)
        .when(host != "github.com", K.URL_HOST)
        .when(has_query, K.URL_QUERY)
        .when(owner == "", K.URL_SHAPE)
        .when(repo == "", K.URL_EMPTY)
        .when(~owner.rlike(allowed) | ~repo.rlike(allowed), K.URL_CHARS)
    )
    address = F.when(
        url.isNotNull() & reason.isNull(),
        F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(".git")),
    )
    return address, reason


def repo_urls(urls: DataFrame) -> DataFrame:
    address, reason = normalize_repo_url(F.col("url"))
    return urls.withColumn("clone_url", address).withColumn("reason", reason)
