"""Risk summaries that follow a stream of files, with Spark keeping the state.

A repository's files are dealt to lanes by a hash of their paths; Spark's state store holds, for every
(repository, lane), what is known of each file: is it scanned, and the place and traits of its findings. A file that
arrives again replaces what was known of it. A lane that changes sends one row: counts of
files, the findings that may still be among the first three of their kind, and how many others have each
combination of traits. Repeat multipliers depend on those first ones only (see ``operators.score``), so the
lanes of a repository give its exact summary, and no lane's row grows with the number of findings.

Rows go to a ``MergedTable``. State, checkpoints and recovery are Spark's own.

Of several versions of a file in one batch the one that arrived last counts (``arrived_at``, where the files have
it; else the one with the greater digest).
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom import constants as K
from scanloom.operators import detect as D, findings as N, inventory as I, score as S
from scanloom.plans.merged import MergedTable

LANES = 64
_PLACE = ("sev_rank", "line", "disc_ord")
_KIND = ("rule_id", "severity", "category")
_KINDS = len(_KIND)
_LANE_ROW = "repo_id string, lane int, content string"
_TRAITS_TYPE = ", ".join(f"{c} {t}" for c, t in S.TRAITS.items())
_CONTENT = (f"scanned bigint, ignored bigint, generated bigint, "
            f"first array<struct<file string, sev_rank int, line int, disc_ord int, {_TRAITS_TYPE}>>, "
            f"rest array<struct<n bigint, {_TRAITS_TYPE}>>")


def arrivals(files: DataFrame, lanes: int = LANES) -> DataFrame:
    """A row per file, with a null ``finding``, and a row per finding of it."""
    if "arrived_at" in files.columns:
        version = F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        version = F.sha2("content", 256)
    files = files.withColumn("version", F.coalesce(version, F.lit("")))
    versioned = I.with_decision(files).select(
        "repo_id", "path", "version", (F.col("decision") == I.SCAN).alias("scanned"),
        I.is_skipped_generated().alias("generated"), F.lit(None).cast("string").alias("finding"))
    found = S.with_traits(N.adjust_for_context(D.detect(files, unique=True, carry=("path", "version"))))
    rows = found.select(
        "repo_id", "path", "version", F.lit(None).cast("boolean").alias("scanned"),
        F.lit(None).cast("boolean").alias("generated"),
        F.to_json(F.struct("file", *_PLACE, *S.TRAITS)).alias("finding"))
    return versioned.union(rows).withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int"))


def _outline(known: dict[str, list]) -> str:
    """What a lane sends, from what is known of its files."""
    counts, by_kind, rest = Counter(), defaultdict(list), Counter()
    for scanned, generated, found in known.values():
        counts["scanned" if scanned else "ignored"] += 1
        counts["generated"] += generated
        for file, sev_rank, line, disc_ord, *traits in found:
            by_kind[tuple(traits[:_KINDS])].append((sev_rank, file, line, disc_ord, traits))
    first = []
    for group in by_kind.values():
        group.sort(key=lambda f: f[:4])
        first += group[:S.DEPTH]
        rest.update(tuple(f[4]) for f in group[S.DEPTH:])
    return json.dumps({
        **{c: counts[c] for c in ("scanned", "ignored", "generated")},
        "first": [{"file": f[1], "sev_rank": f[0], "line": f[2], "disc_ord": f[3], **dict(zip(S.TRAITS, f[4]))} for f in first],
        "rest": [{"n": n, **dict(zip(S.TRAITS, traits))} for traits, n in sorted(rest.items(), key=repr)]})


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
    arrived: dict[str, tuple[str, list]] = {}  # path to version, what is known
    for batch in batches:
        for path, version, scanned, generated, finding in batch[["path", "version", "scanned", "generated", "finding"]].itertuples(index=False):
            if path not in arrived or version > arrived[path][0]:
                arrived[path] = (version, [False, False, []])
            if version < arrived[path][0]:
                continue
            entry = arrived[path][1]
            if finding is None:
                entry[0], entry[1] = bool(scanned), bool(generated)
            else:
                f = json.loads(finding)
                row = [f["file"], *(f[c] for c in _PLACE), *(f.get(c) for c in S.TRAITS)]
                if row not in entry[2]:  # the same version twice
                    entry[2].append(row)
    known.update((path, entry) for path, (_, entry) in arrived.items())
    state.update((zlib.compress(json.dumps(known).encode(), 1),))
    yield pd.DataFrame({"repo_id": [key[0]], "lane": [key[1]], "content": [_outline(known)]})


def lane_rows(files: DataFrame, lanes: int = LANES) -> DataFrame:
    """A stream of the lanes that changed."""
    rows = arrivals(files, lanes)
    return rows.groupBy("repo_id", "lane").applyInPandasWithState(
        _update, _LANE_ROW, "content binary", "update", "NoTimeout")


def summaries(lanes: DataFrame) -> DataFrame:
    """The risk summary of every repository from the rows of its lanes."""
    parsed = lanes.select("repo_id", F.from_json("content", _CONTENT).alias("c"))
    stats = parsed.groupBy("repo_id").agg(*(
        F.sum(f"c.{c}").cast("int").alias(name) for c, name in (
            ("scanned", "scanned_files"), ("ignored", "ignored_files"), ("generated", "skipped_generated_dependency_files"))))
    first = S.repeat_multipliers(parsed.select("repo_id", F.explode("c.first").alias("f")).select("repo_id", "f.*"))
    rest = parsed.select("repo_id", F.explode("c.rest").alias("f")).select("repo_id", "f.*").withColumn(
        "repeat_pct", F.lit(S.LAST_REPEAT_PCT))
    columns = ["repo_id", "n", "repeat_pct", *S.TRAITS]
    found = first.withColumn("n", F.lit(1).cast("bigint")).select(*columns).union(rest.select(*columns))
    measured = S.measures(S.with_units(found), times="n")
    return S.summary_columns(S.with_score(S.complete(measured, stats)))


@dataclass(frozen=True)
class RunningSummary:
    """A running summary under ``root``. ``lanes`` can't change while its checkpoint lives."""

    root: str
    lanes: int = LANES
    every: int = 50

    @property
    def table(self) -> MergedTable:
        return MergedTable(f"{self.root}/lanes", ("repo_id", "lane"), _LANE_ROW, self.every)

    def start(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            lane_rows(files, self.lanes).writeStream.outputMode("update").foreachBatch(self.table.write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def latest(self, spark: SparkSession) -> DataFrame:
        """Current summary of every repository."""
        return summaries(self.table.read(spark))
