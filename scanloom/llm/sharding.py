"""Shards of nearly equal size by sampled splitters.

1. A narrow table (key, id, size, checksum) is written once; texts are not shuffled. The
   key is a hash of the text in its upper bits and of the id in its lower ones: equal
   texts are neighbours, and yet a group of copies can be cut anywhere.
2. A sample in which a row's chance follows its size gives the quantiles of bytes over
   the keys: the splitters of many ranges.
3. Ranges found overfull by an exact count are subdivided by key.
4. Exact sums over the ranges, then a running sum within each, place every row on one
   line of bytes; the line is cut into equal shards.

Only the sample (``SAMPLE_PER_RANGE`` rows a range, ``MAX_RANGES`` ranges at most) and the
shard borders come to the driver, and only the table of ranges is broadcast.

Null texts have size 16 like empty ones but form a group of their own; null ids and
repeated rows are placed like any others; an empty table gives no rows. Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.llm.common import stored, unit_hash

ROW_BYTES = 16
RANGE_BYTES = 64 << 20
MAX_RANGES = 1 << 16
SAMPLE_PER_RANGE = 32
GROUP_BITS = 24  # lower bits of a key, from the id
SEED = 11


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def row_key(text: Column, doc_id: Column) -> Column:
    low = (1 << GROUP_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(
        F.xxhash64(F.lit(SEED), doc_id).bitwiseAND(F.lit(low)))


def splitters(narrow: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Keys that cut the rows into ``ranges`` ranges of about equal bytes."""
    want = ranges * SAMPLE_PER_RANGE
    chance = F.col("size") * (want / max(total, 1))
    sample = (
        narrow.filter(unit_hash(SEED + 1, "doc_id", "crc", "size") < chance)
        .select("key", F.greatest(F.col("size").cast("double"), F.lit(total / want)).alias("w"))
        .toPandas().sort_values("key")
    )
    upto = sample["w"].cumsum().to_numpy()
    if not len(upto):
        return np.array([], dtype=np.int64)
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample["key"].to_numpy()[np.minimum(cuts, len(upto) - 1)])


def place(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: key, doc_id, size, crc, shard, and ``row``, its position on
    the line of all documents (from 0)."""
    narrow = stored(docs.select(
        row_key(F.col("text"), F.col("doc_id")).alias("key"), "doc_id",
        row_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("crc")), "shard-rows")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = int(min(MAX_RANGES, max(8 * shards, -(-total // RANGE_BYTES))))
    target = max(1, total // ranges)
    cuts = splitters(narrow, total, ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right"))

    ranged = narrow.withColumn("range", range_of("key"))
    filled = ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
    ).select("range", "low", (F.col("high").cast("double") - F.col("low") + 1).alias("width"),
             F.when(F.col("bytes") > 2 * target, F.ceil(F.col("bytes") / F.lit(target)))
             .otherwise(1).alias("parts"))
    part = F.least(F.floor((F.col("key").cast("double") - F.col("low")) / F.col("width")
                           * F.col("parts")), F.col("parts") - 1)
    divided = ranged.join(F.broadcast(filled), "range").select(
        "key", "doc_id", "size", "crc", "range", part.cast("int").alias("part"))

    line = Window.orderBy("range", "part")
    before = divided.groupBy("range", "part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    ).select("range", "part", (F.sum("bytes").over(line) - F.col("bytes")).alias("bytes_before"),
             (F.sum("rows").over(line) - F.col("rows")).alias("rows_before"))
    inside = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "crc")
    middle = 2 * F.col("bytes_before") + 2 * F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = divided.join(F.broadcast(before), ["range", "part"]).select(
        "key", "doc_id", "size", "crc",
        F.least(F.lit(shards - 1), F.floor(middle / F.lit(2.0 * max(total, 1) / shards)))
        .cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"))
    return stored(placed, "shard-places")


def shard_table(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard, gapless slot, size and checksum of every document."""
    placed = place(docs, shards)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = 40, name: str = "shard") -> DataFrame:
    """The documents, with all their columns, and the number of their shard (a column that
    already has this name is replaced). The exact
    borders of the shards (at most ``shards`` of them) are compared with each row's key,
    so whole documents need not be joined. Rows equal in text and id stay together."""
    borders = (
        place(docs, shards).groupBy("shard")
        .agg(F.min(F.struct("key", F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"))).alias("b"))
        .orderBy("shard").collect()
    )
    mine = F.struct(row_key(F.col("text"), F.col("doc_id")).alias("key"),
                    F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"))
    shard = F.lit(0)
    for row in borders:
        edge = F.struct(F.lit(row.b.key).alias("key"), F.lit(row.b.id).alias("id"))
        shard = F.when(mine >= edge, F.lit(row.shard)).otherwise(shard)
    return docs.withColumn(name, shard.cast("int"))
