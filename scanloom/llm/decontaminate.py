"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK walk copies a string symbol by symbol, at each step staying or moving on as a random
bit of (step, symbol) says. Strings a few edits apart leave walks a small Hamming distance
apart, so equal symbols at a few sampled steps are a locality-sensitive hash for edit
distance.

Texts are lower-cased and white space is made single blanks. Items fall into classes by
length; each class has walks of its own, which start at places picked by their own four bytes
(anchors), so both sides pick the same ones, with or without blanks around them. A walk covers a
few bytes only, so that among an item's many anchors some have few edits near them even where
all edits allowed are made. Repetitions are added until walks find the wanted share of copies
of the class's own items edited as far as is allowed (``Walks.measure``). Items with too few
anchors go to a class in which every place is one. Items of less than ``SHORT`` bytes are cut
into one piece more than edits are allowed: one piece is in the text unchanged, so that none is
missed.

Where a hash or piece is shared, 64 bytes of the item around it are compared first, many places at
once, then a window of the item's size is verified by exact edit distance, up to a share of the
item's size.

Items are taken in blocks of ``BLOCK_BYTES``, one pass over the texts for each, so what goes to
the tasks is bounded. No pair of documents is formed, and nothing of the documents is collected.

Null and empty texts and items match nothing; an item that occurs several times in a text is
reported once, at its best place; equal items are reported each; repeated rows too; empty
tables give no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import slices, stored

SHARE = 0.2          # edits allowed, of an item's bytes
SHORT = 40           # bytes; items below are found by their pieces
# least bytes of a class, steps of its walks (a multiple of SAMPLED), places of which one is an anchor
CLASSES = ((40, 16, 2), (80, 24, 4), (160, 32, 8))
DENSE = (40, 16, 1)  # for items in which a class picks too few places
SAMPLED = 8          # steps whose symbols make a hash
RECALL = 0.995       # aimed at, for items with all edits that are allowed
TRIALS = 200         # edited copies of a class's items, to measure it with
MOST_REPEATS = 24    # where the aim is not reached before
ANCHORS = 4          # wanted in every item over two repetitions
BLOCK_BYTES = 4 << 20
SEGMENT = 64         # bytes of an item compared first
SEGMENT_EDITS = 24   # allowed in a segment: edits may lie denser there than in the item
PAD = 2 * SEGMENT + 2 * SEGMENT_EDITS
PLACES = 1 << 16     # worked on at once
SEED = 61


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def edits(item: bytes, window: bytes, most: int) -> tuple[int, int] | None:
    """Least edits that turn the item into some part of the window, and where that part ends;
    None if over ``most``. Bit-parallel over the item's bytes."""
    at = window.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(window):
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        h_up = down | (full & ~(d | up))
        h_down = up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full  # a part may start anywhere: the first row is zero
        h_down = h_down << 1 & full
        up = h_down | (full & ~(x | h_up))
        down = h_up & x
        if score < best:
            best, end = score, k + 1
    return (best, end) if best <= most else None


def heads(text: bytes, size: int = 4) -> np.ndarray:
    """The ``size`` bytes from each place on, as a number."""
    array = np.frombuffer(text, dtype=np.uint8)
    n = max(0, len(array) - size + 1)
    value = np.zeros(n, dtype=np.uint32)
    for k in range(size):
        value |= array[k:k + n].astype(np.uint32) << np.uint32(8 * k)
    return value


def picked(head: np.ndarray, salt: int, one_in: int) -> np.ndarray:
    mixed = (head ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(15)
    return (mixed >> np.uint32(8)) < np.uint32((1 << 24) // one_in)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)


def _matches(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in ``key``, index in sorted ``keys``) of equal values."""
    low = np.searchsorted(keys, key, side="left")
    n = np.searchsorted(keys, key, side="right") - low
    which = np.repeat(np.arange(len(key)), n)
    return which, np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(which))


def edited(item: bytes, most: int, rng: random.Random) -> bytes:
    """A copy ``most`` edits away, by substitutions, insertions and deletions; of long items by
    as many edits, some of which may cancel out."""
    text = bytearray(item)

    def edit():
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text[at:at + (kind != 1)] = b"" if kind == 2 else bytes([item[rng.randrange(len(item))]])

    before = item
    for k in range(2 * most + 8):  # a text of one symbol would stay near for ever
        if k > most and (len(item) > 1024 or not text or (edits(item, bytes(text), most) or (most + 1,))[0] > most):
            break
        before = bytes(text)
        edit()
    return before


class Pieces:
    """Short items, and those that walks find too rarely, by pieces of which at least one stays unchanged."""

    def __init__(self, items: dict[int, bytes]):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for n, item in items.items():
            count = int(SHARE * len(item)) + 1
            cuts = [len(item) * k // count for k in range(count + 1)]
            for low, high in zip(cuts, cuts[1:]):
                size = min(4, high - low)
                rows.setdefault(size, []).append((int(heads(item[low:low + size], size)[0]), n, low))
        for size, found in rows.items():
            key, item, offset = np.array(sorted(found), dtype=np.int64).T
            self.tables[size] = key.astype(np.uint64), item, offset

    def candidates(self, text: bytes, head: np.ndarray):
        for size, (keys, item, offset) in self.tables.items():
            value = head if size == 4 else heads(text, size)
            known = np.zeros(1 << 18, dtype=bool)
            known[_slot(keys)] = True
            for low in range(0, len(value), PLACES):
                part = value[low:low + PLACES].astype(np.uint64)
                at = np.flatnonzero(known[_slot(part)])
                which, j = _matches(keys, part[at])
                yield low + at[which], item[j], offset[j]


class Walks:
    """Hash tables of one class of items."""

    def __init__(self, items: dict[int, bytes], steps: int, one_in: int, seed: int = SEED):
        self.items, self.steps, self.one_in = items, steps, one_in
        self.rng = np.random.default_rng(seed)
        self.tables: list[tuple] = []  # of each repetition

    def add(self) -> None:
        """One more repetition."""
        walk = self.rng.integers(0, 2, (self.steps, 256)).astype(np.intp)
        # one step in each of as many equal stretches, so that a hash sees all of a window
        sampled = (np.arange(SAMPLED) * self.steps + self.rng.integers(0, self.steps, SAMPLED)) // SAMPLED
        keys, items, offsets = [], [], []
        for n, item in self.items.items():
            places = np.flatnonzero(picked(heads(item), len(self.tables), self.one_in))
            key, end = self._walk(item, places, walk, sampled)
            inside = end <= len(item)  # a walk past the item's end would hash what follows it in a text
            keys.append(key[inside])
            items.append(np.full(int(inside.sum()), n))
            offsets.append(places[inside])
        key, item, offset = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, items, offsets))
        order = np.argsort(key.astype(np.uint64), kind="stable")
        key = key.astype(np.uint64)[order]
        known = {}
        for k in (1, 3, 5, 7):
            known[k] = np.zeros(1 << 18, dtype=bool)
            known[k][_slot(key & np.uint64((1 << 8 * (k + 1)) - 1))] = True
        self.tables.append((walk, sampled, known, key, item[order], offset[order]))

    @staticmethod
    def _walk(item: bytes, places, walk, sampled):
        text = np.frombuffer(item + bytes(len(walk)), dtype=np.uint8)
        at, key = places.copy(), np.zeros(len(places), dtype=np.uint64)
        for step in range(int(sampled[-1]) + 1):
            c = text[at]
            for k in np.flatnonzero(sampled == step):
                key |= c.astype(np.uint64) << np.uint64(8 * k)
            at += walk[step][c]
        return key, at

    def measure(self, seed: int = SEED) -> float:
        """Add repetitions until they find ``RECALL`` of copies with all edits allowed of the
        shorter half of the items, which are the harder ones; gives the share found."""
        rng = random.Random(seed)
        shorter = sorted(self.items, key=lambda n: len(self.items[n]))[:(len(self.items) + 1) // 2]
        trials = []
        for k in range(TRIALS):
            n = shorter[k % len(shorter) if len(shorter) <= TRIALS else k * len(shorter) // TRIALS]
            most = int(SHARE * len(self.items[n]))
            text = edited(self.items[n], most, rng)
            trials.append((n, most, np.frombuffer(text + bytes(self.steps), dtype=np.uint8).astype(np.intp), heads(text)))
        while True:
            self.add()
            number = len(self.tables) - 1
            trials = [t for t in trials if not self._finds(number, *t)]
            if len(trials) <= (1 - RECALL) * TRIALS or number + 1 >= MOST_REPEATS:
                return 1 - len(trials) / TRIALS

    def _finds(self, number: int, n: int, most: int, array: np.ndarray, head: np.ndarray) -> bool:
        places = np.flatnonzero(picked(head, number, self.one_in))
        return any(((item == n) & (np.abs(place - offset) <= most)).any()
                   for place, item, offset in self._of(number, array, places))

    def scarce(self, repeats: int = 2) -> list[int]:
        """Items with too few anchors in the first repetitions."""
        count = sum(np.bincount(t[4].astype(np.int64), minlength=max(self.items, default=0) + 1)
                    for t in self.tables[:repeats])
        return [n for n in self.items if count[n] < ANCHORS]

    def candidates(self, text: bytes, head: np.ndarray):
        """(places, items, offsets) of text anchors that share a hash with an item's anchor."""
        array = np.frombuffer(text, dtype=np.uint8)
        for low in range(0, len(head), 2 * PLACES):
            # symbols as indexes, and places within this part: no step of a walk converts them again
            part = array[low:low + 2 * PLACES + self.steps].astype(np.intp)
            own = head[low:low + 2 * PLACES]
            for number in range(len(self.tables)):
                for place, item, offset in self._of(number, part, np.flatnonzero(picked(own, number, self.one_in))):
                    yield low + place, item, offset

    def _of(self, number: int, array: np.ndarray, places: np.ndarray):
        walk, sampled, known, keys, item, offset = self.tables[number]
        places = places[places + len(walk) <= len(array)]
        at, key, k = places.copy(), np.zeros(len(places), dtype=np.uint64), 0
        for step in range(int(sampled[-1]) + 1):
            c = array.take(at)
            if step == sampled[k]:
                key |= c.view(np.uint64) << np.uint64(8 * k)
                if k in known:
                    hit = known[k].take(_slot(key))
                    places, at, key, c = places[hit], at[hit], key[hit], c[hit]
                    if not len(at):
                        return
                k += 1
            at += walk[step].take(c)
        which, j = _matches(keys, key)
        if len(j):
            yield places[which], item[j], offset[j]


class Filter:
    """What finds the items of a block."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = SEED):
        self.items = items
        self.by_pieces = {n: t for n, (_, t) in enumerate(items) if len(t) < SHORT}
        self.walks: list[Walks] = []
        dense: dict[int, bytes] = {}
        for k, (least, steps, one_in) in enumerate(CLASSES):
            most = CLASSES[k + 1][0] if k + 1 < len(CLASSES) else float("inf")
            own = {n: t for n, (_, t) in enumerate(items) if least <= len(t) < most}
            self._add_class(own, steps, one_in, seed + k, dense)
        self._add_class(dense, *DENSE[1:], seed + len(CLASSES), None)
        self.pieces = Pieces(self.by_pieces)
        # segments of items, one after another
        self.first = np.cumsum([0] + [self._segments(len(t)) for _, t in items])
        self._masks = None

    def _add_class(self, own: dict[int, bytes], steps: int, one_in: int, seed: int, dense) -> None:
        if own and dense is not None:
            trial = Walks(own, steps, one_in, seed)
            trial.add()
            trial.add()
            for n in trial.scarce():
                dense[n] = own.pop(n)
        if own:
            walks = Walks(own, steps, one_in, seed)
            if walks.measure(seed) >= RECALL:
                self.walks.append(walks)
            else:
                self.by_pieces |= own

    @staticmethod
    def _segments(size: int) -> int:
        return max(0, -(-(size - SEGMENT) // (SEGMENT // 2))) + 1

    def __getstate__(self):
        return {**self.__dict__, "_masks": None}

    def masks(self):
        """Of each segment: where it starts, its size, and for each symbol (its low six
        bits) the places that have it."""
        if self._masks is None:
            sizes = np.array([len(t) for _, t in self.items], dtype=np.int64)
            item = np.repeat(np.arange(len(sizes)), np.diff(self.first))
            begin = np.minimum((np.arange(len(item)) - self.first[item]) * (SEGMENT // 2),
                               np.maximum(0, sizes[item] - SEGMENT))
            size = np.minimum(sizes[item], SEGMENT)
            text = np.frombuffer(b"".join(t for _, t in self.items) + bytes(SEGMENT), dtype=np.uint8)
            at = (np.cumsum(sizes) - sizes)[item] + begin
            table, every = np.zeros((len(item), 64), dtype=np.uint64), np.arange(len(item))
            for k in range(SEGMENT):
                bit = np.where(k < size, np.uint64(1 << k), np.uint64(0))
                table[every, text[at + k] & 63] |= bit
            whole = sizes[item] <= SEGMENT
            allowed = np.where(whole, (SHARE * sizes[item]).astype(np.int64), SEGMENT_EDITS)
            self._masks = begin, size, allowed, table.reshape(-1)
        return self._masks

    def near(self, array: np.ndarray, place, item, offset) -> np.ndarray:
        """Which places have the item's segment around them within the edits allowed for one, or
        with symbols that look alike in six bits. Bit-parallel, many places at once."""
        begin, size, allowed, table = self.masks()
        last = np.diff(self.first)[item] - 1
        segment = self.first[item] + np.clip((offset - SEGMENT // 4) // (SEGMENT // 2), 0, last)
        begin, size, allowed, row = begin[segment], size[segment], allowed[segment], segment * 64
        drift = np.minimum(allowed, SEGMENT_EDITS)
        at = place - offset + begin - drift
        up, down = np.full(len(place), ~np.uint64(0)), np.zeros(len(place), dtype=np.uint64)
        score, best, top = size.copy(), size.copy(), (size - 1).astype(np.uint64)
        one = np.uint64(1)
        for _ in range(int((size + 2 * drift).max())):
            c = array[np.clip(at, 0, len(array) - 1)] & 63
            eq = table[row + c]
            x = eq | down
            d = (((eq & up) + up) ^ up) | eq
            h_up = down | ~(d | up)
            h_down = up & d
            score += (h_up >> top & one).astype(np.int64) - (h_down >> top & one).astype(np.int64)
            np.minimum(best, score, out=best)
            h_up <<= one
            h_down <<= one
            up = h_down | ~(x | h_up)
            down = h_up & x
            at += 1
        return best <= allowed

    def candidates(self, text: bytes):
        """(place, where the item would start, item) of places that pass the first comparison."""
        array, head = np.frombuffer(text, dtype=np.uint8), heads(text)
        held: list[tuple] = []
        size = 0
        for found in self._seeds(text, head):
            held.append(found)
            size += len(found[0])
            if size >= PLACES:
                yield from self._passed(array, held)
                held, size = [], 0
        yield from self._passed(array, held)

    def _seeds(self, text: bytes, head: np.ndarray):
        for source in (self.pieces, *self.walks):
            yield from source.candidates(text, head)

    def _passed(self, array, held):
        if not held:
            return
        place, item, offset = (np.concatenate(x) for x in zip(*held))
        for low in range(0, len(place), PLACES // 4):
            p, n, o = (x[low:low + PLACES // 4] for x in (place, item, offset))
            hit = self.near(array, p, n, o)
            yield from zip(p[hit].tolist(), (p - o)[hit].tolist(), n[hit].tolist())

    def find(self, texts: list[bytes], once: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, edits, start, end) of each item found, in bytes of the
        normal form; with ``once`` of one item for each text."""
        if not texts or not self.items:
            return []
        parts = [normal(t) for t in texts]
        gap = bytes(PAD)
        text = gap.join([*parts, b""])
        firsts = np.cumsum([0] + [len(p) + len(gap) for p in parts])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        done: set[int] = set()
        for place, start, n in self.candidates(text):
            item_id, item = self.items[n]
            most = int(SHARE * len(item))
            row = int(np.searchsorted(firsts, place, side="right")) - 1
            start -= int(firsts[row])
            spot = (row, start // 8, n)
            if row in done or spot in tried:
                continue
            tried.add(spot)
            if best.get((row, n), (1,))[0] == 0:
                continue
            low = start // 8 * 8 - most
            window = parts[row][max(0, low):max(0, low + len(item) + 2 * most + 8)]
            found = edits(item, window, most)
            if found and found[0] < best.get((row, n), (most + 1,))[0]:
                end = max(0, low) + found[1]
                best[row, n] = (found[0], max(0, end - len(item)), end)
                if once:
                    done.add(row)
        return [(row, self.items[n][0], *v) for (row, n), v in sorted(best.items())]


def blocks_of(benchmark: DataFrame):
    """Items in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("t")).filter(
        "item_id is not null and t is not null")
    for row in rows.toLocalIterator():
        text = normal(bytes(row.t))
        if not text:
            continue
        block.append((row.item_id, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _groups(texts: list[bytes], most: int = 1 << 20):
    """Runs of texts of bounded size, or single long ones."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield low, texts[low:k]
            low, size = k, 0
        size += len(t)
    if texts:
        yield low, texts[low:]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): a row for each benchmark item found in a document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, start bigint, end bigint"
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    found = []
    for block in blocks_of(benchmark):
        items = Filter(block)

        def run(batches, items=items):
            for batch in slices(batches, "bytes"):
                ids = batch.column("doc_id")
                for low, part in _groups([t or b"" for t in batch.column("bytes").to_pylist()]):
                    rows = items.find(part)
                    if rows:
                        row, item, e, start, end = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([low + r for r in row])), pa.array(item), pa.array(e, pa.int32()),
                             pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                            ["doc_id", "item_id", "edits", "start", "end"])

        found.append(stored(texts.mapInArrow(run, schema), "leaks"))
    result = spark.createDataFrame([], schema)
    for part in found:
        result = result.unionByName(part) if result is not None else part
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item is found."""
    for block in blocks_of(benchmark):
        items = Filter(block)

        def run(batches, items=items):
            for batch in slices(batches, "text"):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                keep = np.ones(len(texts), dtype=bool)
                for low, part in _groups(texts):
                    keep[[low + r[0] for r in items.find(part, once=True)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
