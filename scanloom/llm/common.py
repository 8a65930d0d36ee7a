"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.plans.workspace import materialize as stored

__all__ = ["WORD", "bound_batches", "read", "stored", "id_remainder", "unit_hash", "word_count", "connected_components",
           "fresh", "slices"]

# A word is a run of characters other than blank and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = "8m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let batches for Python hold a few megabytes instead of 10,000 rows of any size, where
    the session or cluster doesn't say otherwise: texts may be long."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def unit_hash(seed: int, *columns: str | Column) -> Column:
    """A hash of the columns spread evenly over [0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (longs) to ``(node, component)``: the smallest node reachable.

    Alternates the two contractions of the large-star / small-star algorithm: every
    round hangs nodes under smaller ones, until all edges point at their component's
    smallest node. Edges stay distributed; each round is written to the shared folder, so
    a lost executor costs one round at most. Minima are aggregated before they are
    joined back, so a hub with very many edges is an ordinary skewed join.
    Nodes without an edge (or only an edge to themselves) are not listed.
    """
    spark = edges.sparkSession
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(
            F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == mark or seen["n"] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = tuple(seen)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        )
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        current = stored(
            linked.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` (text or bytes) holds about ``most`` bytes in each, or is
    one row: what a task works on at once then doesn't depend on how long the texts are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        low, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > low and held + size > most:
                yield batch.slice(low, k - low)
                low, held = k, 0
            held += size
        if batch.num_rows > low:
            yield batch.slice(low)
