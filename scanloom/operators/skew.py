"""Joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with more rows than this on the large side is hot. At most
# (rows / HOT_ROWS) keys can be; how the list is joined is left to its size.
HOT_ROWS = 1_000_000
SALTS = 64


def lookup_join(large: DataFrame, lookup: DataFrame, key: str, spread_by: str,
                hot_rows: int = HOT_ROWS, salts: int = SALTS,
                counted: DataFrame | None = None) -> DataFrame:
    """Left join of a large table with a lookup holding each key at most once.

    Rows of a hot key are spread over ``salts`` sub-keys by a hash of
    ``spread_by``, and only the lookup rows of hot keys are repeated that often.
    ``counted`` may name a cheaper table with the same keys to count them in.
    """
    hot = (
        (large if counted is None else counted).groupBy(key).count().filter(F.col("count") > hot_rows)
        .select(key, F.lit(True).alias("_hot"))
    )

    def marked(table: DataFrame) -> DataFrame:
        return table.join(hot, key, "left")

    salted = marked(large).withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(0)
        .cast("int"),
    ).drop("_hot")
    repeated = marked(lookup).withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                  .otherwise(F.array(F.lit(0)))),
    ).drop("_hot")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
