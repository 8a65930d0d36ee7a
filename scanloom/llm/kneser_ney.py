"""Interpolated modified Kneser-Ney model over words: counted in Spark, read through memory maps.

Counting is one job of ``order`` + 1 stages. A task turns texts into word hashes, sums n-grams
of the highest order in memory and ships them, packed, to shards by ranges of a 64-bit key. A shard adds up
its n-grams, writes them as arrays sorted by key, and ships two summaries, again packed by shards:
of each context the total and how many words follow once, twice, more often; and the
n-grams of the next lower order, whose count is the number of different words seen before them. Keys are
uniform, so frequent words or repeated texts make no shard larger than others.

``order`` - 1 start marks precede a text and one end mark follows it. With the counts c of an order, its three
discounts D and the uniform share 1 / (V + 1) below single words,

    p(w | context) = max(c - D(c), 0) / total + (D1 n1 + D2 n2 + D3 n3) / total * p(w | shorter context)

and a context never seen leaves it at the shorter one. D comes from the counts of counts (0.5, 1 and
1.5 where one of them is zero).

Arrays lie in the shared folder, a file a shard. A worker maps one file at a time, looks up the sorted
keys of a batch of texts in it, and lets it go: memory is bounded by a batch and a shard, and the page
cache is shared by all workers of a machine. In a store without local paths a worker copies files to
unnamed temporary ones, which vanish with it. The production order is two: with three, what has to be
shuffled and stored is over twice as much.

Word hashes have ``WORD_BYTES`` bytes: two of V words share one with odds of V * V / 2**49.

A null text is empty: its end mark is scored. No training rows: every token has probability 1
(nothing is known to be unlikely). Repeated rows count and are scored each; ids may be null or of any type;
an empty table gives no rows; other columns are not read. Long texts go piece by piece.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import bound_batches
from scanloom.plans.workspace import new_dir

ORDER = 2
WORD_BYTES = 6
TOKENS_COUNTED = 1 << 22  # tokens summed in memory before n-grams are shipped
TOKENS_SCORED = 1 << 21
SHARD_BYTES = 16 << 20
CACHED_WORDS = 400_000
_SLICE = 1 << 22

START, END = np.uint64(1), np.uint64(2)
_BLANK = b" \t\n\v\f\r"


# ---- tokens and keys

class _Hashes(dict):
    """Hash of a word by its bytes; a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        value = max(xxhash.xxh64_intdigest(word, seed=7) >> (64 - 8 * WORD_BYTES), 3)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def token_pieces(text: str, order: int, hashes: _Hashes):
    """Tokens of a text in pieces, each with the ``order`` - 1 tokens before it."""
    data = text.encode().lower()  # bytes: A-Z only
    context = np.full(order - 1, START, dtype=np.uint64)
    low = 0
    while True:
        high = low + _SLICE
        while high < len(data) and data[high] not in _BLANK:
            high += 1
        words = data[low:high].split()
        tokens = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        last = high >= len(data)
        piece = np.concatenate([context, tokens, [END] if last else []]).astype(np.uint64)
        yield piece
        if last:
            return
        context, low = piece[len(piece) - order + 1:], high


def fold(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of its words but the last, and the last."""
    x = (key * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def key_of(words: list[np.ndarray], size: int) -> np.ndarray:
    key = np.zeros(size, dtype=np.uint64)
    for word in words:
        key = fold(key, word)
    return key


def _columns(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Words of the n-grams that end at each token after the first ``order`` - 1."""
    return [tokens[k:len(tokens) - order + 1 + k] for k in range(order)]


# ---- packed arrays

def _pack(a: np.ndarray) -> bytes:
    """Byte planes of the differences; a sorted array packs well, others about as they are."""
    steps = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _pack_plain(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_plain(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.uint64).reshape(-1)


def _total(keys: np.ndarray, firsts: list[np.ndarray], sums: list[np.ndarray]):
    """Rows of equal key become one: sorted keys, their first columns, their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    return (keys[begins], [c[order[begins]] for c in firsts],
            [np.add.reduceat(s[order], begins) if len(begins) else s for s in sums])


ROW = [("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("arrays", pa.list_(pa.binary())),
       ("sums", pa.list_(pa.int64()))]
ROW_SCHEMA = "kind string, level int, shard int, arrays array<binary>, sums array<bigint>"


def _row(kind: str, level: int, shard: int, arrays: list[bytes], sums: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((kind, level, shard, arrays, sums), ROW)],
                                      [n for n, _ in ROW])


def _ship(kind: str, level: int, shards: int, keys: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]):
    """Rows for the shards of sorted keys; within a shard sorted by the first column, which packs well."""
    edges = np.searchsorted(keys, np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64))
    for shard, (low, high) in enumerate(zip([0, *edges], [*edges, len(keys)])):
        if low == high:
            continue
        order = np.argsort(columns[0][low:high], kind="stable") + low
        yield _row(kind, level, shard, [_pack(columns[0][order]), *(_pack_plain(c[order]) for c in columns[1:] + sums)], [])


# ---- files of sorted arrays

def _path(folder: str) -> str | None:
    """The local path of a folder, or None in a store that has none."""
    parsed = urlparse(folder)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def _write(folder: str, name: str, header: list[int], arrays: list[np.ndarray]) -> None:
    """A file appears whole or not at all, so tasks may run twice."""
    parts = [np.array([len(header), *header], dtype=np.int64), *arrays]
    path = _path(folder)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        part = f"{base}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            for a in parts:
                out.write(np.ascontiguousarray(a).tobytes())
        store.move(part, f"{base}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for a in parts:
            out.write(np.ascontiguousarray(a).tobytes())
    os.replace(part, f"{path}/{name}")


_COPIES: dict[str, object] = {}


def _map(folder: str, name: str) -> np.ndarray | None:
    """A file as a memory map of bytes; None if that shard is empty."""
    path = _path(folder)
    if path is not None:
        try:
            return np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r")
        except FileNotFoundError:
            return None
    key = f"{folder}/{name}"
    if key not in _COPIES:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        copy = None
        if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
            copy = tempfile.TemporaryFile()
            with store.open_input_stream(f"{base}/{name}") as source:
                while block := source.read(1 << 24):
                    copy.write(block)
            copy.flush()
        _COPIES[key] = copy
    return None if _COPIES[key] is None else np.memmap(_COPIES[key], dtype=np.uint8, mode="r")


class _Fields:
    """Arrays one after the other in a map."""

    def __init__(self, data: np.ndarray):
        size = int(data[:8].view(np.int64)[0])
        self.header = data[8:8 + 8 * size].view(np.int64).tolist()
        self.data, self.at = data, 8 + 8 * size

    def take(self, count: int, dtype) -> np.ndarray:
        size = count * np.dtype(dtype).itemsize
        self.at += size
        return self.data[self.at - size:self.at].view(dtype)


def _write_grams(folder: str, level: int, shard: int, keys, counts, raw) -> None:
    """Counts under 255 take a byte, the others stand in a list; single words also keep their plain counts."""
    big = np.flatnonzero(counts >= 255)
    arrays = [keys, *([raw.astype(np.int64)] if level == 1 else []), big.astype(np.int64), counts[big].astype(np.int64),
              np.minimum(counts, 255).astype(np.uint8)]
    _write(folder, f"grams-{level}-{shard}", [len(keys), len(big)], arrays)


def _write_contexts(folder: str, level: int, shard: int, keys, total, following) -> None:
    _write(folder, f"contexts-{level}-{shard}", [len(keys)],
           [keys, total.astype(np.int64), *(n.astype(np.uint32) for n in following)])


def _read_grams(data: np.ndarray, level: int, wanted: np.ndarray) -> list[np.ndarray]:
    fields = _Fields(data)
    size, n_big = fields.header
    keys = fields.take(size, np.uint64)
    raw = fields.take(size, np.int64) if level == 1 else None
    big, big_counts = fields.take(n_big, np.int64), fields.take(n_big, np.int64)
    counts = fields.take(size, np.uint8)
    at = np.minimum(np.searchsorted(keys, wanted), size - 1)
    found = keys[at] == wanted
    got = counts[at].astype(np.int64)
    over = np.flatnonzero(found & (got == 255))
    got[over] = big_counts[np.searchsorted(big, at[over])]
    return [np.where(found, got, 0)] + ([np.where(found, raw[at], 0)] if level == 1 else [])


def _read_contexts(data: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    fields = _Fields(data)
    size = fields.header[0]
    keys = fields.take(size, np.uint64)
    values = [fields.take(size, np.int64), *(fields.take(size, np.uint32) for _ in range(3))]
    at = np.minimum(np.searchsorted(keys, wanted), size - 1)
    found = keys[at] == wanted
    return [np.where(found, v[at].astype(np.int64), 0) for v in values]


# ---- counting

@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    shards: int
    tokens: int  # N
    words: int  # V
    total: int  # of the counts of single words
    following: tuple[int, int, int]  # single words counted once, twice, more often
    discounts: tuple[tuple[float, float, float], ...]  # from order 1 on


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(
        (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def _count(docs: DataFrame, order: int, shards: int, most: int) -> DataFrame:
    def run(batches):
        hashes, held, size = _Hashes(), [], 0

        def ship():
            columns = [np.concatenate(c) for c in zip(*(_columns(p, order) for p in held))]
            keys, columns, sums = _total(key_of(columns, len(columns[0])), columns, [np.ones(len(columns[0]), dtype=np.int64)])
            yield from _ship("grams", order, shards, keys, columns, sums)

        for batch in batches:
            for text in batch.column("text"):
                for piece in token_pieces(text.as_py(), order, hashes):
                    held.append(piece)
                    size += len(piece)
                    if size >= most:
                        yield from ship()
                        held, size = [], 0
        if held:
            yield from ship()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ROW_SCHEMA)


def _merge(shipped: DataFrame, order: int, shards: int, folder: str) -> DataFrame:
    """Write what has arrived at its shard, and ship what follows from it."""
    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == "sums":
                    yield _row("sums", row["level"], row["shard"], [], row["sums"])
                else:
                    held.setdefault((row["kind"], row["level"], row["shard"]), []).append(row["arrays"])
        for kind, level, shard in sorted(held):
            packed = held.pop((kind, level, shard))
            columns = [np.concatenate([(_unpack if k == 0 else _unpack_plain)(p[k]) for p in packed])
                       for k in range(len(packed[0]))]
            if kind == "contexts":
                keys, _, (total, *following) = _total(columns[0], [], columns[1:])
                _write_contexts(folder, level, shard, keys, total, following)
                continue
            words, sums = columns[:level], columns[level:]
            keys, words, sums = _total(key_of(words, len(words[0])), words, sums)
            counts, raw = sums[0].astype(np.int64), sums[-1].astype(np.int64)
            _write_grams(folder, level, shard, keys, counts, raw)
            times = [int((counts == n).sum()) for n in (1, 2, 3, 4)]
            yield _row("sums", level, shard, [], [*times, int((counts >= 3).sum()), int(counts.sum()), int(raw.sum()), len(keys)])
            if level > 1:
                context = key_of(words[:-1], len(keys))
                got, _, parts = _total(context, [], [counts, *((counts == n).astype(np.int64) for n in (1, 2)),
                                                     (counts >= 3).astype(np.int64)])
                yield from _ship("contexts", level, shards, got, [got], parts)
                got, suffix, parts = _total(key_of(words[1:], len(keys)), words[1:], [np.ones(len(keys), dtype=np.int64), raw])
                yield from _ship("grams", level - 1, shards, got, suffix, parts)

    return shipped.repartition(shards, "shard").mapInArrow(run, ROW_SCHEMA)


def fit(docs: DataFrame, train: Column, order: int = ORDER, folder: str | None = None,
        shard_bytes: int = SHARD_BYTES, most: int = TOKENS_COUNTED) -> Model:
    """Count the training rows and write the arrays of the model to ``folder``."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or new_dir(spark, "language-model")
    rows = docs.filter(train)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = int(max(4, -(-size // shard_bytes)))
    table = _count(rows, order, shards, most)
    for _ in range(order):
        table = _merge(table, order, shards, folder)
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(8)]
    found = {r["level"]: list(r)[1:] for r in table.filter("kind = 'sums'").groupBy("level").agg(*sums).collect()}
    empty = [0] * 8
    n1, n2, _, _, more, total, tokens, words = found.get(1, empty)
    return Model(folder, order, shards, tokens, words, total, (n1, n2, more),
                 tuple(discounts(*found.get(k, empty)[:4]) for k in range(1, order + 1)))


# ---- scoring

def _lookup(model: Model, kind: str, level: int, keys: np.ndarray, fields: int) -> list[np.ndarray]:
    """Values of keys, one shard's map at a time."""
    wanted, back = np.unique(keys, return_inverse=True)
    out = [np.zeros(len(wanted), dtype=np.int64) for _ in range(fields)]
    edges = np.searchsorted(wanted, np.array([(s << 64) // model.shards for s in range(1, model.shards)], dtype=np.uint64))
    for shard, (low, high) in enumerate(zip([0, *edges], [*edges, len(wanted)])):
        data = _map(model.folder, f"{kind}-{level}-{shard}") if low < high else None
        if data is None:
            continue
        got = _read_grams(data, level, wanted[low:high]) if kind == "grams" else _read_contexts(data, wanted[low:high])
        for mine, values in zip(out, got):
            mine[low:high] = values
        del data
    return [o[back] for o in out]


def evaluate(model: Model, pieces: list[np.ndarray]) -> np.ndarray:
    """Per piece: tokens, known tokens, log10 by add-one single words, log10 by the model."""
    columns = [np.concatenate(c) for c in zip(*(_columns(p, model.order) for p in pieces))]
    size = len(columns[0])
    p = np.full(size, 1.0 / (model.words + 1))
    raw = np.zeros(size, dtype=np.int64)
    for level in range(1, model.order + 1):
        d = np.array([0.0, *model.discounts[level - 1]])
        context = key_of(columns[model.order - level:-1], size)
        counts, *plain = _lookup(model, "grams", level, fold(context, columns[-1]), 2 if level == 1 else 1)
        if level == 1:
            raw = plain[0]
            total, following = np.int64(model.total), [np.int64(n) for n in model.following]
        else:
            total, *following = _lookup(model, "contexts", level, context, 4)
        rest = d[1] * following[0] + d[2] * following[1] + d[3] * following[2]
        share = np.maximum(counts - d[np.minimum(counts, 3)], 0.0) + rest * p
        p = np.where(total > 0, share / np.maximum(total, 1), p)
    base = np.log10((raw + 1) / (model.tokens + model.words + 1))
    lengths = np.array([len(x) - model.order + 1 for x in pieces])
    at = np.cumsum(lengths) - lengths
    sums = [np.add.reduceat(np.append(x, 0.0), at) * (lengths > 0) for x in ((raw > 0).astype(float), base, np.log10(p))]
    return np.stack([lengths, *sums], axis=1)


def score(docs: DataFrame, model: Model, most: int = TOKENS_SCORED) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes, ids, sums, pieces, owners, size, id_type = _Hashes(), [], [], [], [], 0, None

        def settle():
            nonlocal pieces, owners, size
            if pieces:
                for owner, values in zip(owners, evaluate(model, pieces)):
                    sums[owner] += values
            pieces, owners, size = [], [], 0

        def rows():
            nonlocal ids, sums
            settle()
            values = np.array(sums)
            batch = pa.RecordBatch.from_arrays([
                pa.array(ids, id_type), *(pa.array(np.rint(values[:, k]).astype(np.int64)) for k in (0, 1)),
                pa.array([model.tokens] * len(ids), pa.int64()), *(pa.array(values[:, k]) for k in (2, 3))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            ids, sums = [], []
            return batch

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                sums.append(np.zeros(4))
                for piece in token_pieces(text.as_py(), model.order, hashes):
                    pieces.append(piece)
                    owners.append(len(ids) - 1)
                    size += len(piece)
                    if size >= most:
                        settle()
            if ids and not pieces:
                yield rows()
        if ids:
            yield rows()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
