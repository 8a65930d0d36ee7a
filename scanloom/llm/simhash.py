"""SimHash near-duplicates over an index of byte positions with count filtering.

A fingerprint of 64 bits is eight (position, byte) entries of an inverted index. Two
fingerprints that differ in at most ``MAX_BITS`` bits differ in at most as many bytes, so at
least 8 - MAX_BITS entries are shared: the guaranteed count. Postings of single entries
hold 1/256 of all fingerprints, and tallying pairs in them would be quadratic; the
postings are therefore intersected beforehand: the index is keyed by every choice of
8 - MAX_BITS positions with their bytes, so that two fingerprints meet exactly if their
tally reaches the count. What meets is verified by bits. A posting leaves MAX_BITS bytes
open, hence holds at most 256 ** MAX_BITS fingerprints whatever the input; its links are
found by probing near values, not by pairs, and a spanning forest of them is kept.

Equal fingerprints are one class throughout, so copies cost one row each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import connected_components, slices, stored

MAX_BITS = 2
SHINGLE = 3
SEED = 42
_BLOCK = 1 << 16


def _bit_counts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For runs of hashes that end at ``ends``: how often each of the 64 bits is set."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.zeros((len(ends), 64), dtype=np.int64)
    for low in range(0, len(hashes), _BLOCK):
        part = hashes[low:low + _BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.flatnonzero((starts < low + len(part)) & (ends > low))
        at = np.maximum(starts[inside] - low, 0)
        counts[inside] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return counts


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Fingerprints of UTF-8 texts: A-Z lower-cased, words, shingles of ``width`` words,
    repeats included; a bit is set if it is in over half the hashes. No word: zero."""
    hashes, ends, n = [], np.zeros(len(texts), dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
        if words:
            runs = zip(*(words[k:] for k in range(width))) if len(words) >= width else (words,)
            own = [digest(run, SEED) for run in map(b" ".join, runs)]
            hashes.append(np.array(own, dtype=np.uint64))
            n += len(own)
        ends[i] = n
    result = np.zeros(len(texts), dtype=np.uint64)
    if n:
        sizes = np.diff(ends, prepend=0)
        full = np.flatnonzero(sizes)
        counts = _bit_counts(np.concatenate(hashes), ends[full])
        bits = (2 * counts > sizes[full, None]).astype(np.uint8)
        result[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits. Null texts count as
    empty; every row gives one."""
    def run(batches):
        for batch in slices(batches, "bytes"):
            texts = [t or b"" for t in batch.column("bytes").to_pylist()]
            fps = fingerprints_of(texts, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(
        run, f"doc_id {kind}, fp bigint")


def index(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(positions, shared, fp): an entry per choice of positions; ``shared`` holds their bytes."""
    masks = [sum(0xFF << 8 * p for p in kept) for kept in combinations(range(8), 8 - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = F.array(*[F.struct(F.lit(n).cast("smallint").alias("positions"),
                                 F.col("fp").bitwiseAND(F.lit(m)).alias("shared"))
                        for n, m in enumerate(signed)])
    return classes.select("fp", F.explode(entries).alias("e")).select("e.*", "fp")


def _forest(values: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Links that join all values within ``max_bits`` differing bits of each other. Values
    that far apart have a common neighbour half way; each probes its half."""
    unsigned = [v & (1 << 64) - 1 for v in values]
    open_bits = 0
    for v in unsigned:
        open_bits |= v ^ unsigned[0]
    flips = [1 << b for b in range(64) if open_bits >> b & 1]
    half = max_bits // 2
    reach = [0] + [sum(c) for k in range(1, half + 1) for c in combinations(flips, k)]
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, first = [], {}

    def join(i, j):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            links.append((values[i], values[j]))

    for i, v in enumerate(unsigned):
        for r in reach:
            j = first.setdefault(v ^ r, i)
            if j != i:
                join(i, j)
    if max_bits % 2:  # one more bit between the two halves
        for i, v in enumerate(unsigned):
            for r in reach:
                for f in flips:
                    j = first.get(v ^ r ^ f)
                    if j is not None:
                        join(i, j)
    return links


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that span all that are within
    ``max_bits`` bits. ``classes`` has the column ``fp``, each value once."""
    met = (
        index(classes, max_bits).groupBy("positions", "shared")
        .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    )

    def verify(frames):
        for frame in frames:
            found = [x for fps in frame["fps"] for x in _forest(list(map(int, fps)), max_bits)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.mapInPandas(verify, "a bigint, b bigint")


def components(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): every document with its fingerprint in hex
    digits and the smallest id of the documents it is linked to, directly or not.

    Null and empty texts have fingerprint zero and are linked like any others; a row with a
    null id gets the component of its fingerprint but is never its smallest id; repeated
    rows each keep a row; an empty table gives no rows; other columns are not read.
    """
    known = stored(fingerprints(docs, width), "fingerprints")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    joined = connected_components(links(classes.select("fp"), max_bits))
    grouped = classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(grouped.join(least, "component").select("fp", "component_id"), "components")
    return known.join(named, "fp").select("doc_id", hex_text(F.col("fp")).alias("fingerprint"), "component_id")


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
