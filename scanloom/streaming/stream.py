"""Scanning files as they arrive.

Detection and context adjustment look at one file at a time, so a stream runs the
batch functions as they are. Repeat ranks depend on all findings of a repository: see ``summary``.
"""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators import detect as D, explain as E, findings as N
from scanloom.plans.merged import MergedTable


def stream_findings(files: DataFrame) -> DataFrame:
    """Context-adjusted findings of a stream of files, one per rule and line. A column
    ``arrived_at`` of the files is kept for the time-based operators below."""
    carry = tuple(c for c in ("arrived_at",) if c in files.columns)
    return N.adjust_for_context(D.detect(files, unique=True, carry=carry))


def dedup_stream(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop findings already seen within the watermark, as when a tree is uploaded again."""
    return findings.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(
        ["repo_id", "rule_id", "file", "line"]
    )


def request_stream(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Explanation requests, one per cache key within the watermark."""
    return (
        E.with_cache_key(findings)
        .withWatermark("arrived_at", delay)
        .dropDuplicatesWithinWatermark(["cache_key"])
    )


NEW, REPEATED, LATE = "new", "repeated", "late"
_FATE_KEY = ("repo_id", "rule_id", "file", "line")


def with_fate(findings: DataFrame, delay: str = "1 hour", lanes: int = 256) -> DataFrame:
    """Every finding of a stream with its ``fate``, so that nothing is lost unseen: ``late`` if it arrived
    behind the watermark, ``repeated`` if it was seen within it, else ``new``. The new ones are those of
    ``dedup_stream``, which may remember one batch longer. State is kept by lanes of keys, and what the watermark has passed leaves a lane
    whenever rows come to it."""
    columns = [c for c in findings.columns if c != "lane"]
    rows = findings.select(*columns).withWatermark("arrived_at", delay).withColumn(
        "lane", F.pmod(F.xxhash64(*_FATE_KEY), F.lit(lanes)).cast("int"))
    held_ms = int(pd.Timedelta(delay).total_seconds() * 1000)

    def judge(key, batches, state):
        known = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        for batch in batches:
            batch = batch.sort_values("arrived_at", kind="stable")
            # Spark hands over timestamps as wall-clock times of the session's zone
            moments = batch["arrived_at"].dt.tz_localize(zone).astype("datetime64[ns, UTC]").astype("int64") // 10**6
            fates = []
            for at, *parts in zip(moments, *(batch[c] for c in _FATE_KEY)):
                name = json.dumps([str(p) for p in parts])
                if at < watermark:
                    fates.append(LATE)
                elif known.get(name, -1) >= watermark:
                    fates.append(REPEATED)
                else:
                    fates.append(NEW)
                    known[name] = at + held_ms
            yield batch[columns].assign(fate=fates)
        known = {name: until for name, until in known.items() if until >= watermark}
        state.update((zlib.compress(json.dumps(known).encode(), 1),))

    zone = findings.sparkSession.conf.get("spark.sql.session.timeZone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema) + ", fate string"
    return rows.groupBy("lane").applyInPandasWithState(judge, schema, "known binary", "append", "NoTimeout")


def windowed_counts(findings: DataFrame, width: str = "10 minutes",
                    delay: str = "10 minutes") -> DataFrame:
    """Findings per arrival window and severity; a window is final once the watermark
    has passed it."""
    return (
        findings.withWatermark("arrived_at", delay)
        .groupBy(F.window("arrived_at", width), "severity")
        .agg(F.count("*").alias("n_findings"))
        .select(F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), "severity", "n_findings")
    )


def _windows(path: str, every: int) -> MergedTable:
    return MergedTable(path, ("window_start", "window_end", "severity"),
                       "window_start timestamp, window_end timestamp, severity string, n_findings bigint", every)


def write_windows(counts: DataFrame, path: str, checkpoint: str, every: int = 50) -> StreamingQuery:
    """Keep a table of all windows, open ones too, each with its latest count. State is still
    bounded by the watermark, and reading by the number of windows. Read with ``current_windows``."""
    return (
        counts.writeStream.outputMode("update").foreachBatch(_windows(path, every).write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_windows(spark: SparkSession, path: str, every: int = 50) -> DataFrame:
    """Every window with its latest count."""
    return _windows(path, every).read(spark)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append to a parquet table, stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
