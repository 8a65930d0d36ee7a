"""Token ids in files of byte planes.

Layout of a written folder: ``planes`` holds one record per chunk, ordered by document id
within and across segments (a segment is one range of ids, written by one task). A chunk is
a run of whole documents. Its ids are cut into blocks of ``BLOCK_IDS``; each block is transposed
into four planes, the first with the lowest bytes of all its ids, and each plane is
compressed with zstandard on its own. ``index`` holds what locates a chunk and its documents:
segment, chunk number, ids before it in its segment, and the ids and lengths of its
documents. Records travel in uncompressed Parquet, since that is what every store that
Spark writes to can hold; planes and index are this format's own.

Ids are unsigned 32-bit. Memory holds a chunk, that is ``CHUNK_IDS`` ids or one document;
``TEXTS_BYTES`` of texts with their ids; and up to ``CACHED_PIECES`` pieces of texts with theirs.

Null texts count as empty; every document ends with the end id, so none is empty; rows with
equal ids keep a fixed order (by text); a null id comes first; an empty table gives an
empty folder and no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scanloom.llm.common import slices
from scanloom.plans.workspace import new_dir

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 18
LEVEL = 3
SEGMENT_BYTES = 32 << 20
CACHED_PIECES = 800_000
CACHED_IDS = 8_000_000
TEXTS_BYTES = 8 << 20  # texts whose pieces are looked up together
LEARNED_CHARS = 1 << 19  # new pieces that go to the tokenizer as one text

ASCII = [chr(k) for k in range(256)]
WHITE, PUNCTUATION, LETTER = (np.array([c in found for c in ASCII]) for found in (
    " \t\n\v\f\r", string.punctuation, string.ascii_letters))
# further white space, by its bytes; U+180E was white space in older versions of Unicode
SPACES = np.array([int.from_bytes(c.encode(), "big") for c in map(chr, range(0x80, 0x3001)) if c.isspace() or c == "\u180e"])
PLAIN = re.compile("[ \n]?[^\\s\u180e]+")

PLANES = "segment int, chunk int, planes array<binary>"
INDEX = "segment int, chunk int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>"


def to_planes(ids: np.ndarray, level: int = LEVEL) -> list[bytes]:
    """Four compressed planes per block of ids, lowest bytes first."""
    packer = zstandard.ZstdCompressor(level=level)
    planes = []
    for low in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[low:low + BLOCK_IDS], dtype="<u4").view(np.uint8).reshape(-1, 4)
        planes += [packer.compress(np.ascontiguousarray(block[:, k]).tobytes()) for k in range(4)]
    return planes


def from_planes(planes: list[bytes]) -> np.ndarray:
    unpacker = zstandard.ZstdDecompressor()
    blocks = []
    for low in range(0, len(planes), 4):
        columns = [np.frombuffer(unpacker.decompress(p), dtype=np.uint8) for p in planes[low:low + 4]]
        blocks.append(np.stack(columns, axis=1).reshape(-1).view("<u4"))
    return np.concatenate(blocks) if blocks else np.array([], dtype="<u4")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts (UTF-8, end to end) start: at the start of a text; at ASCII white space
    after anything else; at ASCII punctuation after a letter that is ASCII, Latin-1 or Cyrillic (others
    are left in one piece with it). Characters that some take for white space open no piece, nor
    does white space after them."""
    opens = WHITE[data]
    at = np.flatnonzero(opens[1:] & ~opens[:-1]) + 1
    last = data[at - 1]
    opens[:] = False
    clear = (last > 0x1F) & (last < 0x80)
    beyond = np.flatnonzero(last >= 0x80)
    three = [data[at[beyond] - k].astype(np.int32) << 8 * (k - 1) for k in (1, 2, 3)]
    clear[beyond] = ~(np.isin(three[0] | three[1], SPACES) | np.isin(three[0] | three[1] | three[2], SPACES))
    opens[at[clear]] = True
    at = np.flatnonzero(PUNCTUATION[data[1:]]) + 1
    last, before = data[at - 1], data[at - 2]
    latin = (before == 0xC3) & (last != 0x97) & (last != 0xB7)  # all but the signs of times and division
    opens[at[LETTER[last] | (last >= 0x80) & (latin | (before == 0xD0) | (before == 0xD1))]] = True
    opens[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(opens)


class Encoder:
    """Ids of whole texts. Byte-level pre-tokenization starts a token wherever white space follows
    other characters, and wherever ASCII punctuation follows a letter, so texts are cut there
    and encoded piece by piece. The pieces of many texts are told apart and looked up by Arrow;
    only those not seen before go to the tokenizer, together. Texts that hold an added
    token's content go to it whole."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype=np.uint32)
        blank, line = (self.tokenizer.encode(c, add_special_tokens=False).tokens[0][0] for c in (" a", "\n"))
        size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(size, dtype=bool)  # tokens that begin with a blank, and the line feed
        for token, number in self.tokenizer.get_vocab().items():
            self.opens[number] = token.startswith(blank) or token == line
        # added tokens are found in a whole text, across pieces
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # seen pieces, where the ids of each begin in all of them end to end, and how many they are;
        # the first, an empty piece, stands for the end of a text
        self.known = pa.array([""], pa.large_string())
        self.begins, self.counts = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)
        self.flat = self.end

    def each(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts by the tokenizer as loaded, without the offsets it would also work out."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.each([text])[0], dtype=np.uint32)

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of short texts end to end, where those of each begin, and how many each has."""
        found = self.each(texts)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(counts.sum()))
        return ids, np.cumsum(counts) - counts, counts

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for pieces without white space but a blank or line feed in front. As one text
        they are told apart by that; a piece without it gets a line feed, whose id is left out."""
        bare = np.fromiter((p[0] not in " \n" for p in pieces), dtype=bool, count=len(pieces))
        text = "".join([p if p[0] in " \n" else "\n" + p for p in pieces])
        if not any(t in text for t in self.added):
            ids = self.whole(text)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(pieces):
                return ids, starts + bare, np.diff(starts, append=len(ids)) - bare
        return self._apart(pieces)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of new pieces, and begins, counts and ids of the known ones with the new ones
        after them. When enough are kept (the frequent ones come early), further ones serve
        these texts only."""
        names, plain, odd, held = pieces.to_pylist(), [[]], [], 0
        for k, name in enumerate(names):
            if not PLAIN.fullmatch(name):
                odd.append(k)
                continue
            plain[-1].append(k)
            held += len(name)
            if held >= LEARNED_CHARS:
                plain.append([])
                held = 0
        parts = [self._together([names[k] for k in group]) for group in plain if group]
        if odd:
            parts.append(self._apart([names[k] for k in odd]))
        order = np.array([k for group in (*plain, odd) for k in group])
        numbers = np.empty(len(order), dtype=np.int64)
        numbers[order] = len(self.known) + np.arange(len(order))
        used = len(self.flat) + np.cumsum([0] + [len(ids) for ids, _, _ in parts])
        begins = np.concatenate([self.begins, *(b + low for (_, b, _), low in zip(parts, used))])
        counts = np.concatenate([self.counts, *(n for _, _, n in parts)])
        flat = np.concatenate([self.flat, *(ids for ids, _, _ in parts)])
        first, kept = len(self.known), min(CACHED_PIECES, int(np.searchsorted(begins + counts, CACHED_IDS, side="right")))
        if kept > first:
            self.known = pa.concat_arrays([self.known, pieces.take(pa.array(order[:kept - first]))])
            self.begins, self.counts = begins[:kept], counts[:kept]
            self.flat = flat[:begins[kept - 1] + counts[kept - 1]]
        return numbers, begins, counts, flat

    def _encode_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = piece_starts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary
        begins, counts, flat = self.begins, self.counts, self.flat
        numbers = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = numbers < 0
        if new.any():
            numbers[new], begins, counts, flat = self._learn(distinct.filter(pa.array(new)))
        ends = np.searchsorted(starts, offsets[1:])  # pieces up to the end of each text
        which = np.insert(numbers[pieces.indices.to_numpy()], ends, 0)
        lengths = counts[which]
        upto = np.cumsum(lengths)
        ids = flat[np.repeat(begins[which] - upto + lengths, lengths) + np.arange(upto[-1])]
        bounds = [0, *upto[ends + np.arange(len(ends))].tolist()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode_all(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of texts, each with the end id. New pieces of all of them are learned together."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        whole = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_pieces(texts) if len(texts) else []
        cut = iter(self.encode_all(texts.filter(pa.array(~whole))))
        return [np.concatenate([self.whole(t.as_py()), self.end]) if w else next(cut) for t, w in zip(texts, whole)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One per worker process, which serves many tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Encode ``docs(doc_id, text)`` and write the folder. Texts are shuffled once, into
    ranges of ids; encoding comes after, as ids are larger than texts."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // SEGMENT_BYTES))
    ordered = texts.repartitionByRange(int(segments), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encode = encoder(tokenizer_path, end_id).encode_all
        segment, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, doc_ids, size = [], [], 0

        def flush():
            nonlocal chunk, first, held, doc_ids, size
            lengths = [len(x) for x in held]
            row = [segment, chunk, first, size, doc_ids, lengths, to_planes(np.concatenate(held))]
            chunk, first = chunk + 1, first + size
            held, doc_ids, size = [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)], names)

        names = ["segment", "chunk", "first", "n_ids", "doc_ids", "lengths", "planes"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.list_(pa.binary())]
        for batch in slices(batches, "text", TEXTS_BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                if held and size + len(ids) > CHUNK_IDS:
                    yield flush()
                held.append(ids)
                doc_ids.append(doc_id)
                size += len(ids)
        if held:
            yield flush()

    chunks = ordered.mapInArrow(run, INDEX + ", planes array<binary>")
    chunks.write.option("compression", "none").parquet(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with ``start``: the ids of all chunks before them, over all segments."""
    chunks = spark.read.schema(INDEX).parquet(folder)
    along = Window.orderBy("segment")
    before = chunks.groupBy("segment").agg(F.sum("n_ids").alias("_n")).select(
        "segment", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    return chunks.join(before, "segment").select(
        "segment", "chunk", "n_ids", "doc_ids", "lengths", (F.col("first") + F.col("_before")).alias("start"))


def read(spark: SparkSession, folder: str, columns: dict[str, str], digest) -> DataFrame:
    """Read a folder back: ``digest(ids)`` of each document's ids gives ``columns``
    (name to type), besides doc_id, start and n_tokens."""
    stored = spark.read.schema(INDEX + ", planes array<binary>").parquet(folder)
    kinds = [pa.int64()] * 3 + [{"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[t]
                                for t in columns.values()]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                own = [digest(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(own), pa.int32()),
                     *(pa.array(list(v), t) for v, t in zip(
                         [row["doc_ids"], starts + row["first"], row["lengths"], *zip(*own)], kinds))],
                    ["segment", "doc_id", "start", "n_tokens", *columns])

    docs = stored.select("segment", "first", "doc_ids", "lengths", "planes").mapInArrow(
        run, "segment int, doc_id bigint, start bigint, n_tokens bigint, "
        + ", ".join(f"{n} {t}" for n, t in columns.items()))
    along = Window.orderBy("segment")
    before = spark.read.schema(INDEX).parquet(folder).groupBy("segment").agg(
        F.sum("n_ids").alias("_n")).select(
        "segment", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    return docs.join(before, "segment").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", *columns)


def checksum(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()),)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the documents, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "token-planes")
    write(docs, folder, tokenizer_path, end_id)
    return read(spark, folder, {"ids_crc32": "bigint"}, checksum)
