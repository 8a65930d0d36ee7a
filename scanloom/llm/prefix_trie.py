"""Trie of the turn prefixes that conversations share, with count-min screening.

A node is a distinct sequence of first turns (role, text); a conversation is a member of the
node of every one of its prefixes. In steps:

1. Turns become narrow rows (conversation, turn, digest of role and text, words); texts are not
   shuffled. Range partitioning by (conversation, turn, digest) and a streaming pass
   cut them into pieces of at most ``PIECE`` rows, so one huge conversation is many pieces.
2. A prefix's 128-bit digest is the exclusive-or of the digests of (depth, turn) along it. Such digests
   compose: what a piece needs from the pieces before it is one value.
3. Every prefix digest is counted in a count-min sketch with saturating two-bit cells, built
   per task and merged block by block. A sketch never counts too little, so an estimate of one proves that
   nobody shares the prefix, nor any longer one: such tails become nodes where they are.
4. Only the other prefixes are shuffled, as rows without text, and grouped exactly. False
   alarms of the sketch cost a row each and change no result, so the sketch's width is
   bounded (``MAX_CELLS`` cells a row: 48 MB in all, sent to the tasks) whatever the input.
5. A node is known by (smallest member, depth). The nodes with one smallest member lie on a chain
   along that conversation, so sums over a subtree are, per member, suffix sums along its own
   path, and one grouping over members adds them up. Long paths are worked on in blocks
   of ``BLOCK`` depths. Popular prefixes are joined back under salted keys.
6. Ids that end at a node are sorted by ranges, joined to chunks in many tasks, and only the chunks
   of a node pass one after the other through SHA-256.

Rows with a null id belong to no conversation and are left out; a null role or text is
empty; equal turn numbers are ordered by SHA-256 of (role, text); repeated rows are repeated turns;
an empty table has no conversation and gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.llm.common import bound_batches, stored, word_count
from scanloom.operators.skew import lookup_join

BORROW_FROM = 20  # a conversation takes its first turns from the next lower multiple of this
BORROW_UP_TO = 4  # it takes fewer turns than this
PIECE = 8192
REPEATS = 64  # equal rows in one piece row
BLOCK = 4096
HOT_ROWS = 20_000
RANGE_ROWS = 1 << 20

SKETCH_ROWS = 3
CELLS_PER_PREFIX = 4
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 26
SKETCH_BLOCK = 1 << 16  # cells in a block of the sketch

# What the screening says of a prefix: perhaps shared; so too, but the next one begins a tail (in this
# piece, or in the next one); proved to have one member; the same, directly under the root.
SHARED, SHARED_END, SHARED_ON, TAIL, TAIL_AT_ROOT = range(5)
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def decimal_hash(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string"))


def _ranges(rows: int) -> int:
    return int(min(1 << 16, max(4, -(-rows // RANGE_ROWS))))


def turn_rows(conversations: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """conv_id, turn, digest, words, sub, times: equal rows are counted, at most ``repeats`` a row."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        word_count(text).alias("words"))
    sub = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / F.lit(repeats))))
    return rows.groupBy("conv_id", "turn", "digest", "words").count().withColumn("sub", sub).withColumn(
        "times", F.least(F.lit(repeats), F.col("count") - F.col("sub") * repeats).cast("int")).drop("count")


PIECES = ("conv_id bigint, part int, seq int, n bigint, digests array<binary>, words array<bigint>, times array<int>, "
          "head_digests array<binary>, head_words array<bigint>")


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """One row per run of at most ``most`` turn rows of one conversation, in order by (part, seq)."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()),
             pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        part, seq, ready = TaskContext.get().partitionId(), 0, []
        conv, held = None, ([], [], [])

        def close():
            nonlocal seq, held
            digests, words, times = held
            head = [(d, w) for d, w, t in zip(digests[:3], words[:3], times[:3]) for _ in range(t)][:BORROW_UP_TO - 1]
            ready.append((conv, part, seq, sum(times), digests, words, times,
                          [d for d, _ in head], [w for _, w in head]))
            seq, held = seq + 1, ([], [], [])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), kinds)], names)
            ready.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "digest", "words", "times"))
            for c, d, w, t in zip(*columns):
                if held[0] and (c != conv or len(held[0]) >= most):
                    close()
                conv = c
                for column, value in zip(held, (d, w, t)):
                    column.append(value)
            if len(ready) >= 512:
                yield flush()
        if held[0]:
            close()
        if ready:
            yield flush()

    order = ("conv_id", "turn", "digest", "words", "sub")
    return rows.repartitionByRange(_ranges(rows.count()), *order).sortWithinPartitions(*order).mapInArrow(run, PIECES)


def paths(conversations: DataFrame, piece: int = PIECE, repeats: int = REPEATS) -> DataFrame:
    """Every piece of every rebuilt conversation: its turns, how many of its own precede them
    (``before``), the borrowed turns, the length of the whole path, and the digest before it."""
    found = stored(pieces(stored(turn_rows(conversations, repeats), "trie-turns"), piece), "trie-pieces")
    along = Window.partitionBy("conv_id").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0).cast("long")))
    heads = placed.filter((F.col("conv_id") % BORROW_FROM == 0) & (F.col("before") < BORROW_UP_TO - 1)).groupBy(
        F.col("conv_id").alias("donor")).agg(
        F.sort_array(F.collect_list(F.struct("before", "head_digests", "head_words"))).alias("heads"))
    borrowed = decimal_hash(F.col("conv_id")) % BORROW_UP_TO
    info = found.groupBy("conv_id").agg(F.sum("n").alias("own"), F.count("*").alias("pieces")).select(
        "*", borrowed.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % BORROW_FROM).alias("donor")
    ).join(heads, "donor", "left")

    def taken(field: str) -> Column:
        whole = F.flatten(F.transform("heads", lambda x: x[field]))
        return F.when(F.col("heads").isNull(), F.array()).otherwise(F.slice(whole, F.lit(1), F.col("h")))

    info = info.select("conv_id", "own", "pieces", "h", taken("head_digests").alias("donor_digests"),
                       taken("head_words").alias("donor_words")).withColumn(
        "length", F.size("donor_digests") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    joined = stored(placed.drop("head_digests", "head_words").join(info, "conv_id"), "trie-paths")

    def ends(batches):
        for batch in batches:
            rows = batch.to_pylist()
            tops = [_prefixes(r, (0, 0)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in rows], t) for c, t in (("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()))),
                 *(pa.array([int(t[k][-1]) if len(t[0]) else 0 for t in tops], pa.int64()) for k in (1, 2))],
                ["conv_id", "part", "seq", "x1", "x2"])

    xors = joined.filter("pieces > 1").mapInArrow(ends, "conv_id bigint, part int, seq int, x1 bigint, x2 bigint").select(
        "conv_id", "part", "seq", *(F.expr(
            f"bit_xor(x{k}) over (partition by conv_id order by part, seq rows between unbounded preceding and 1 preceding)"
        ).alias(f"x{k}") for k in (1, 2)))
    return joined.join(xors, ["conv_id", "part", "seq"], "left").na.fill(0, ["x1", "x2"])


def _prefixes(piece: dict, start: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depths, both halves of the digests, and words of the last turns, of a piece's prefixes."""
    own_digests, own_words, times = piece["digests"], piece["words"], piece["times"]
    turns = [(d, w) for d, w, t in zip(own_digests, own_words, times) for _ in range(t)]
    borrowed = list(zip(piece["donor_digests"], piece["donor_words"]))
    turns = turns[max(0, piece["h"] - piece["before"]):]
    first = len(borrowed) + max(0, piece["before"] - piece["h"]) + 1
    if piece["before"] == 0:
        turns, first = borrowed + turns, 1
    halves = np.frombuffer(b"".join(
        hashlib.blake2b(k.to_bytes(8, "little") + d, digest_size=16).digest()
        for k, (d, _) in enumerate(turns, first)), dtype="<i8").reshape(-1, 2)
    folded = [np.bitwise_xor.accumulate(halves[:, k]) ^ np.int64(start[k]) if len(turns) else halves[:, k] for k in (0, 1)]
    return (np.arange(first, first + len(turns)), *folded,
            np.fromiter((w for _, w in turns), dtype=np.int64, count=len(turns)))


def _cells(x1: np.ndarray, x2: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in every row of the sketch; rows lie one after the other."""
    a, b = x1.astype(np.int64).view(np.uint64), x2.astype(np.int64).view(np.uint64)
    rows = []
    for k in range(SKETCH_ROWS):
        mixed = (a + b * np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append((mixed >> np.uint64(20)) % np.uint64(cells) + np.uint64(k * cells))
    return np.stack(rows).astype(np.int64)


def sketch(found: DataFrame, cells: int) -> np.ndarray:
    """The count-min sketch of all prefixes: two bits a cell, saturated at 2."""
    blocks = -(-SKETCH_ROWS * cells // SKETCH_BLOCK)

    def packed(counts: np.ndarray) -> bytes:
        four = counts.reshape(-1, 4)
        return zlib.compress((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), 1)

    def unpacked(data: bytes) -> np.ndarray:
        raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
        return np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)

    def emit(held: dict[int, np.ndarray]):
        for number in sorted(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([packed(held[number])], pa.binary())], ["block", "cells"])

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in batch.to_pylist():
                _, x1, x2, _ = _prefixes(piece, (piece["x1"], piece["x2"]))
                hit, times = np.unique(_cells(x1, x2, cells).ravel(), return_counts=True)
                home = hit // SKETCH_BLOCK
                for number in np.unique(home):
                    mine = home == number
                    block = held.setdefault(int(number), np.zeros(SKETCH_BLOCK, dtype=np.uint8))
                    at = hit[mine] % SKETCH_BLOCK
                    block[at] = np.minimum(2, block[at] + np.minimum(2, times[mine]))
        yield from emit(held)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                more = unpacked(data)
                held[number] = np.minimum(2, held[number] + more) if number in held else more
        yield from emit(held)

    schema = "block int, cells binary"
    merged = found.mapInArrow(count, schema).repartition(min(blocks, 64), "block").mapInArrow(merge, schema)
    whole = np.zeros(blocks * SKETCH_BLOCK // 4, dtype=np.uint8)
    for row in merged.collect():  # at most MAX_CELLS cells a row
        raw = np.frombuffer(zlib.decompress(row["cells"]), dtype=np.uint8)
        whole[row["block"] * SKETCH_BLOCK // 4:][:len(raw)] = raw
    return whole


SCREENED = "conv_id bigint, depth bigint, length bigint, x1 bigint, x2 bigint, words bigint, kind int"


def screen(found: DataFrame, counts: np.ndarray, cells: int) -> DataFrame:
    """All prefixes with what the sketch says of them (see the constants for ``kind``). The first
    row of a tail is missing where a row of kind ``SHARED_END`` stands for it."""
    sent = found.sparkSession.sparkContext.broadcast(counts)
    names = [c.split()[0] for c in SCREENED.split(", ")]

    def estimate(x1, x2):
        at = _cells(x1, x2, cells)
        return ((sent.value[at >> 2] >> (at & 3) * 2) & 3).min(axis=0)

    def run(batches):
        for batch in batches:
            held = []
            for piece in batch.to_pylist():
                depth, x1, x2, words = _prefixes(piece, (piece["x1"], piece["x2"]))
                if not len(depth):
                    continue
                alone = estimate(x1, x2) == 1
                goes_on = bool(alone[-1]) and depth[-1] < piece["length"]
                later = piece["before"] > 0 and depth[0] > 1
                if later and estimate(np.array([piece["x1"]]), np.array([piece["x2"]]))[0] == 1:
                    start = 0  # the prefix before this piece has one member
                else:  # what follows a doubtful prefix of another piece is grouped exactly
                    alone[0] &= not later
                    start = int(alone.argmax()) if alone.any() else len(alone)
                kind = np.full(len(depth), TAIL)
                kind[:start] = SHARED
                keep = np.ones(len(depth), dtype=bool)
                if start < len(depth) and start > 0:
                    kind[start - 1], keep[start] = SHARED_END, False
                elif start == len(depth) and goes_on:
                    kind[-1] = SHARED_ON
                elif start == 0 and depth[0] == 1:
                    kind[0] = TAIL_AT_ROOT
                held.append([np.full(keep.sum(), piece["conv_id"]), depth[keep], np.full(keep.sum(), piece["length"]),
                             x1[keep], x2[keep], words[keep], kind[keep]])
                if sum(len(h[0]) for h in held) > 1 << 16:
                    yield table(held)
                    held = []
            if held:
                yield table(held)

    def table(held):
        columns = [np.concatenate(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if n == "kind" else pa.int64()) for c, n in zip(columns, names)], names)

    return found.mapInArrow(run, SCREENED)


def ends_hashes(ends: DataFrame, chunk: int = BLOCK) -> DataFrame:
    """``ends(rep, depth, conv_id)`` to ``(rep, depth, ends_sha256)``: of the ids in order, comma-joined."""
    def chunks(batches):
        part, seq, node, ids, out = TaskContext.get().partitionId(), 0, None, [], []

        def close():
            nonlocal seq, ids
            out.append((*node, part, seq, ",".join(ids)))
            seq, ids = seq + 1, []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                ["rep", "depth", "part", "seq", "ids"])
            out.clear()
            return batch

        for batch in batches:
            for rep, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "conv_id"))):
                if ids and ((rep, depth) != node or len(ids) >= chunk):
                    close()
                node = (rep, depth)
                ids.append(str(conv))
            if len(out) >= 1024:
                yield flush()
        if ids:
            close()
        if out:
            yield flush()

    def digest(batches):
        node, state, out = None, None, []
        for batch in batches:
            for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
                if (rep, depth) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _rows(out)
                out = []
        if node:
            yield _rows([(*node, state.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))],
            ["rep", "depth", "ends_sha256"])

    count = ends.count()
    order = ("rep", "depth", "conv_id")
    joined = ends.repartitionByRange(_ranges(count), *order).sortWithinPartitions(*order).mapInArrow(
        chunks, "rep bigint, depth bigint, part int, seq int, ids string")
    return joined.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "part", "seq").mapInArrow(
        digest, "rep bigint, depth bigint, ends_sha256 string")


def trie(conversations: DataFrame, piece: int = PIECE, block_size: int = BLOCK, repeats: int = REPEATS,
         max_cells: int = MAX_CELLS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per node, with the columns of ``NODE``. The sizes change no result."""
    spark = conversations.sparkSession
    bound_batches(spark)
    found = stored(paths(conversations, piece, repeats), "trie-paths")
    heads = found.filter("before = 0")
    total, convs, least, empty = heads.agg(
        F.coalesce(F.sum("length"), F.lit(0)), F.count("*"), F.min("conv_id"), F.count_if(F.col("length") == 0)).first()
    if not convs:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in NODE))
    cells = min(MIN_CELLS, max_cells)
    while cells < min(max_cells, CELLS_PER_PREFIX * total):
        cells *= 2
    screened = stored(screen(found, sketch(found, cells), cells), "trie-screened")

    # exact grouping of the prefixes that may be shared
    key = F.struct("x1", "x2")
    doubtful = screened.filter(F.col("kind") <= SHARED_ON).select(
        "conv_id", "depth", "length", "words", "kind", key.alias("key"), (F.col("depth") == F.col("length")).alias("last"))
    groups = stored(doubtful.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.count_if("last").alias("n_ends")), "trie-groups")
    chains = stored(lookup_join(doubtful, groups, "key", spread_by="conv_id", hot_rows=hot_rows).drop("key"), "trie-chains")

    # along every conversation, in blocks of depths; a block sees the rows next to it
    block = F.floor((F.col("depth") - 1) / F.lit(block_size))
    own = F.col("conv_id") == F.col("rep")
    value = F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(F.lit(0))
    leaf = F.when(F.col("last"), (own & (F.col("n") == F.col("n_ends"))).cast("int"))
    measured = chains.select("*", block.alias("block"), value.cast("long").alias("value"), leaf.alias("leaf"))
    seen_in = F.array_compact(F.array(
        F.col("block"), F.when(F.col("depth") % block_size == 0, F.col("block") + 1),
        F.when(((F.col("depth") - 1) % block_size == 0) & (F.col("block") > 0), F.col("block") - 1)))
    seen = measured.withColumn("at", F.explode(seen_in))
    here = F.col("at") == F.col("block")
    group = Window.partitionBy("conv_id", "at")
    line = group.orderBy("depth")
    down = group.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    walked = seen.select(
        "*", F.lag("rep").over(line).alias("up"), F.lead("rep").over(line).alias("next"),
        F.sum(F.when(here, F.col("value")).otherwise(F.lit(0))).over(down).alias("below"),
        F.max(F.when(here, F.col("leaf"))).over(group).alias("is_leaf")).filter(here)
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = measured.filter(F.col("length") > block_size).groupBy("conv_id", "block").agg(
        F.sum("value").alias("v"), F.max("leaf").alias("f")).select(
        "conv_id", "block", F.sum("v").over(later).alias("beyond"), F.max("f").over(later).alias("leaf_beyond"))
    walked = walked.join(beyond, ["conv_id", "block"], "left").select(
        "*", (F.col("below") + F.coalesce("beyond", F.lit(0))).alias("saved"),
        # a conversation whose last prefix was screened out has that prefix to itself
        F.coalesce("is_leaf", "leaf_beyond", F.lit(1)).alias("leaves"))
    walked = stored(walked, "trie-walked")

    nodes = walked.groupBy(F.col("rep").alias("conv_id"), "depth").agg(
        F.max(F.when(own, F.when(F.col("depth") == 1, F.lit(least)).otherwise(
            F.coalesce("up", "conv_id")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        (F.count_if(F.col("next") == F.col("conv_id")) + F.count_if(F.col("kind").isin(SHARED_END, SHARED_ON))).alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = walked.agg(
        F.count_if(own & (F.col("depth") == 1)).alias("tops"), F.coalesce(F.sum("value"), F.lit(0)).alias("saved"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves")).crossJoin(  # one row each
        screened.agg(F.count_if(F.col("kind") == TAIL_AT_ROOT).alias("tails"),
                     F.count_if((F.col("kind") >= TAIL) & (F.col("depth") == F.col("length"))).alias("tail_leaves"))
    ).crossJoin(walked.agg(F.count_if((F.col("kind") == SHARED_END) & (F.col("depth") + 1 == F.col("length"))).alias("starts"))
                ).select(
        F.lit(least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(convs).cast("long").alias("n_convs"), (F.col("tops") + F.col("tails")).alias("n_children"),
        F.greatest(F.col("leaves") + F.col("tail_leaves") + F.col("starts"), F.lit(1)).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"))
    ends = walked.filter("last").select("rep", "depth", "conv_id").union(
        heads.filter("length = 0").select(F.lit(least), F.lit(0).cast("long"), "conv_id"))
    hashed = ends_hashes(stored(ends, "trie-ends"), block_size).withColumnRenamed("rep", "conv_id")
    grouped = nodes.union(root).join(hashed, ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))

    starts = walked.filter(F.col("kind") == SHARED_END).select(
        "conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"), "length")
    tails = screened.filter(F.col("kind") >= TAIL).select(
        "conv_id", "depth", F.when(F.col("kind") == TAIL, F.col("conv_id")).otherwise(F.lit(least)), "length")
    one, nothing = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = starts.union(tails).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"),
        nothing.alias("saved_tokens"),
        F.sha2(F.when(F.col("depth") == F.col("length"), F.col("conv_id").cast("string")).otherwise(F.lit("")), 256)
        .alias("ends_sha256"))
    return grouped.select(*NODE).union(single.select(*NODE))
