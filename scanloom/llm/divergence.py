"""How the sources of a language differ, by single-pass indexing of terms in bounded memory.

1. Each task builds block postings (term to source to count, and documents a language) until
   ``BLOCK_ENTRIES`` of them fill its memory, then spills them as term-sorted runs, one per language
   and hash shard of terms, and starts anew. Texts are read once and not shuffled.
2. The runs of a (language, shard) meet in one task, which merges them by a heap into the frequencies of
   one term after the other. Every run holds a term once per source at most, so frequent terms
   are no hot keys, and more shards make smaller tasks (``SHARD_BYTES`` of text a shard).
3. Kept terms are streamed once more for the pairs of sources. Two sources differ by ``f(p, q)``
   on every kept term, most of which neither or only one of them has. With p0, q0 for
   count 0, a pair's sum is

       V f(p0, q0) + sum over terms of a: f(p, q0) - f(p0, q0) + the same for b
         + sum over terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

   The second part only needs how many terms of a source have each count; the last is a
   correction streamed over terms that both have, summed in the task for a run of terms
   and emitted as partial sums. No list of pairs per term is kept or shuffled.

All arithmetic is on integers. The table of groups (a row for each language and source) goes to the driver
and the tasks: the result holds a row for every pair of them, so it's the square root of the result at most.

Null text, language and source are empty; a text without terms still makes its group; repeated
rows count as documents each; a language without kept terms has pairs of value 0; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from scanloom.llm.common import bound_batches, stored

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK_ENTRIES = 600_000
SHARD_BYTES = 48 << 20
STREAM_ENTRIES = 1 << 20  # postings worked on at once when pairs are corrected

# bytes of a term: letters, in lower case, and all of multi-byte characters; others become blanks
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 22


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Block:
    """Postings in memory, until they are spilled."""

    def __init__(self):
        self.counts: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        docs = self.docs.setdefault(lang, Counter())
        before = len(counts) + len(docs)
        distinct: set[bytes] = set()
        low = 0
        while low < len(text):  # long texts in slices that end at a blank byte
            high = low + _SLICE
            while high < len(text) and _FOLD[text[high]] != 32:
                high += 1
            found = terms_of(text[low:high])
            counts.update(found)
            distinct.update(found)
            low = high
        docs.update(distinct)
        self.entries += len(counts) + len(docs) - before

    def spill(self, shards: int):
        """Runs: (lang, shard, sources, terms, numbers), terms in order."""
        for lang, by_source in self.counts.items():
            sources = sorted(by_source)
            parts: dict[int, tuple[list, list, list, list, list]] = {}
            docs = self.docs[lang]
            postings = sorted((term, k, n) for k, s in enumerate(sources) for term, n in by_source[s].items())
            for term, group in itertools.groupby(postings, itemgetter(0)):
                terms, in_docs, fan, which, counts = parts.setdefault(zlib.crc32(term) % shards, ([], [], [], [], []))
                size = len(which)
                for _, k, n in group:
                    which.append(k)
                    counts.append(n)
                terms.append(term)
                in_docs.append(docs[term])
                fan.append(len(which) - size)
            pack = zstandard.ZstdCompressor(level=3).compress
            for shard, (terms, in_docs, fan, which, counts) in parts.items():
                yield (lang, shard, sources, len(terms), pack(b"\n".join(terms)),
                       pack(np.array(in_docs + fan + which + counts, dtype="<i4").tobytes()))
        self.__init__()


RUN = [("lang", pa.string()), ("shard", pa.int32()), ("sources", pa.list_(pa.string())), ("n_terms", pa.int32()),
       ("terms", pa.binary()), ("numbers", pa.binary())]
FREQUENCY = [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())),
             ("counts", pa.list_(pa.int64()))]


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def runs(docs: DataFrame, shards: int, entries: int = BLOCK_ENTRIES) -> DataFrame:
    def index(batches):
        block = Block()
        for batch in batches:
            text = batch.column("text")
            for k, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                block.add(lang, source, text[k].as_py().encode())
                if block.entries >= entries:
                    yield from (_batch([run], RUN) for run in block.spill(shards))
        yield from (_batch([run], RUN) for run in block.spill(shards))

    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(
        index, "lang string, shard int, sources array<string>, n_terms int, terms binary, numbers binary")


def merge_runs(found: list[dict], least_docs: int):
    """Heap merge of term-sorted runs: (term, {source: count}) of terms in enough documents."""
    unpack = zstandard.ZstdDecompressor().decompress
    numbers = []

    def walk(k: int, run: dict):
        size = run["n_terms"]
        whole = np.frombuffer(unpack(run["numbers"]), dtype="<i4")
        fan = whole[size:2 * size]
        ends = (2 * size + np.cumsum(fan)).tolist()
        numbers.append((run["sources"], whole, (len(whole) - 2 * size) // 2))
        begins = [2 * size, *ends[:-1]]
        return zip(unpack(run["terms"]).split(b"\n"), itertools.repeat(k), whole[:size].tolist(), begins, ends)

    walks = [walk(k, run) for k, run in enumerate(found)]
    for term, group in itertools.groupby(heapq.merge(*walks), itemgetter(0)):
        held = list(group)
        if sum(h[2] for h in held) < least_docs:
            continue
        counts: dict[str, int] = {}
        for _, k, _, begin, end in held:
            sources, whole, shift = numbers[k]
            for which, n in zip(whole[begin:end].tolist(), whole[begin + shift:end + shift].tolist()):
                source = sources[which]
                counts[source] = counts.get(source, 0) + n
        yield term, counts


def frequencies(docs: DataFrame, shards: int, least_docs: int = LEAST_DOCS, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(lang, term, sources, counts) of every kept term, sources in order."""
    def merge(batches):
        held, key, out = [], None, []

        def close():
            for term, counts in merge_runs(held, least_docs):
                names = sorted(counts)
                out.append((key[0], term.decode(), names, [counts[n] for n in names]))
                if len(out) >= 20_000:
                    yield _batch(out, FREQUENCY)
                    out.clear()

        for batch in batches:
            for run in batch.to_pylist():
                if key != (run["lang"], run["shard"]):
                    yield from close()
                    held, key = [], (run["lang"], run["shard"])
                held.append(run)
        if held:
            yield from close()
        if out:
            yield _batch(out, FREQUENCY)

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, shards)
    return runs(docs, shards, entries).repartition(tasks, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(
        merge, "lang string, term string, sources array<string>, counts array<bigint>")


def share(counts: np.ndarray, total, vocabulary: int) -> np.ndarray:
    """p of counts, in units of 1 / SCALE; exact for counts of any size."""
    if len(counts) and int(counts.max()) > (1 << 62) // SCALE:
        totals = np.broadcast_to(total, counts.shape)
        return np.array([1 + SCALE * (int(c) + 2) // (int(n) + 2 * vocabulary) for c, n in zip(counts, totals)], dtype=np.int64)
    return 1 + SCALE * (counts + 2) // (total + 2 * vocabulary)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


OUT = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]
OUT_SCHEMA = "lang string, source string, part string, item string, value bigint"


class Groups:
    """Of each language: the names of its sources in order, their totals, and V."""

    def __init__(self, rows: list[tuple[str, str, int]], vocabulary: dict[str, int]):
        self.names: dict[str, list[str]] = {}
        totals: dict[str, list[int]] = {}
        for lang, source, total in sorted(rows):
            self.names.setdefault(lang, []).append(source)
            totals.setdefault(lang, []).append(total)
        self.totals = {lang: np.array(n, dtype=np.int64) for lang, n in totals.items()}
        self.vocabulary = {lang: vocabulary.get(lang, 0) for lang in totals}
        self.number = {lang: {s: k for k, s in enumerate(names)} for lang, names in self.names.items()}
        self.none = {lang: share(np.zeros(len(n), dtype=np.int64), n, self.vocabulary[lang])
                     for lang, n in self.totals.items() if self.vocabulary[lang]}


def _terms_of_both(groups: Groups, lang: str, fan: np.ndarray, which: np.ndarray, p: np.ndarray):
    """Partial sums (a, b, value) of the corrections over terms that a and b both have, a < b."""
    names, none = groups.names[lang], groups.none[lang]
    width, term = len(names), np.repeat(np.arange(len(fan)), fan)
    keys, values = [], []
    for step in range(1, int(fan.max())):
        low = np.flatnonzero(term[step:] == term[:-step])
        high = low + step
        a, b = which[low], which[high]
        here, sums = np.unique(a * width + b, return_inverse=True)
        total = np.zeros(len(here), dtype=np.int64)
        np.add.at(total, sums, distance(p[low], p[high]) - distance(p[low], none[b]) - distance(none[a], p[high])
                  + distance(none[a], none[b]))
        keys.append(here)
        values.append(total)
    if keys:
        here, sums = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(here), dtype=np.int64)
        np.add.at(total, sums, np.concatenate(values))
        for key, value in zip(here.tolist(), total.tolist()):
            yield lang, names[key // width], "pair", names[key % width], value


def _top_terms(groups: Groups, lang: str, terms: list[str], fan, which, counts, p, top: int):
    names, vocabulary = groups.names[lang], groups.vocabulary[lang]
    begins = np.cumsum(fan) - fan
    q = share(np.add.reduceat(counts, begins), int(groups.totals[lang].sum()), vocabulary)
    term = np.repeat(np.arange(len(fan)), fan)
    over = np.flatnonzero(p > q[term])
    value = distance(p[over], q[term[over]])
    order = np.lexsort((-value, which[over]))
    source = which[over][order]
    first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else []
    for low, high in zip(first, [*first[1:], len(source)]):
        mine = order[low:high]
        bound = value[mine[min(top, len(mine)) - 1]]
        best = heapq.nsmallest(top, ((-int(value[k]), terms[term[over[k]]].encode()) for k in mine[value[mine] >= bound]))
        for v, t in best:
            yield lang, names[source[low]], "term", t.decode(), -v


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, entries: int = BLOCK_ENTRIES,
          stream_entries: int = STREAM_ENTRIES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    spark = docs.sparkSession
    bound_batches(spark)
    listed = docs.groupBy(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()
    shards = int(max(4, -(-sum(r["bytes"] for r in listed) // shard_bytes)))
    kept = stored(frequencies(docs, shards, least_docs, entries), "term-frequencies")
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    totals = {(r["lang"], r["source"]): r["n"] for r in each.groupBy("lang", "source").agg(
        F.sum("count").alias("n")).collect()}
    vocabulary = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}
    groups = Groups([(r["lang"], r["source"], totals.get((r["lang"], r["source"]), 0)) for r in listed], vocabulary)
    sent = spark.sparkContext.broadcast(groups)

    def of_terms(batches):
        """Corrections for terms that both have, and the best terms, of a run of terms each time."""
        def close(lang, held):
            groups = sent.value
            number = groups.number[lang]
            terms = [t for t, _, _ in held]
            fan = np.array([len(s) for _, s, _ in held])
            which = np.array([number[s] for _, sources, _ in held for s in sources], dtype=np.int64)
            counts = np.array([n for _, _, many in held for n in many], dtype=np.int64)
            p = share(counts, groups.totals[lang][which], groups.vocabulary[lang])
            rows = [*_terms_of_both(groups, lang, fan, which, p), *_top_terms(groups, lang, terms, fan, which, counts, p, top)]
            if rows:
                yield _batch(rows, OUT)

        held: dict[str, list] = {}
        size: Counter = Counter()
        for batch in batches:
            for lang, term, sources, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(lang, []).append((term, sources, counts))
                size[lang] += len(sources)
                if size[lang] >= stream_entries:
                    yield from close(lang, held.pop(lang))
                    del size[lang]
        for lang, rows in held.items():
            yield from close(lang, rows)

    def of_counts(batches):
        """What the terms of one source add to its pairs, whether the other has them or not."""
        for batch in batches:
            for lang, source, counts, terms in zip(*(c.to_pylist() for c in batch.columns)):
                groups = sent.value
                names, none, k = groups.names[lang], groups.none[lang], groups.number[lang][source]
                p = share(np.array(counts, dtype=np.int64), groups.totals[lang][k], groups.vocabulary[lang])
                times = np.array(terms, dtype=np.int64)
                yield _batch([(lang, *sorted((source, other), key=str.encode), int(np.dot(times, distance(p, none[j]) - distance(none[k], none[j]))))
                              for j, other in enumerate(names) if j != k] or [(lang, source, source, 0)],
                             [OUT[0], OUT[1], OUT[3], OUT[4]])

    # how many terms of a source have each count, a bounded number of counts in a row
    histogram = each.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")).groupBy(
        "lang", "source", F.pmod("count", F.lit(997)).alias("part")).agg(
        F.collect_list(F.struct("count", "terms")).alias("x")).select("lang", "source", "x.count", "x.terms")
    base = spark.createDataFrame(
        [(lang, len(names)) for lang, names in groups.names.items()], "lang string, n bigint").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))

    def of_pairs(batches):
        for batch in batches:
            for lang, k in zip(*(c.to_pylist() for c in batch.columns)):
                groups = sent.value
                names, v = groups.names[lang], groups.vocabulary[lang]
                rows = [(lang, names[k], names[j], v * int(distance(groups.none[lang][k:k + 1], groups.none[lang][j])[0]) if v else 0)
                        for j in range(k + 1, len(names))]
                if rows:
                    yield _batch(rows, [OUT[0], OUT[1], OUT[3], OUT[4]])

    pair = "lang string, source string, item string, value bigint"
    found = stored(kept.mapInArrow(of_terms, OUT_SCHEMA), "divergence-parts")
    sums = found.filter("part = 'pair'").drop("part").union(histogram.mapInArrow(of_counts, pair)).union(
        base.mapInArrow(of_pairs, pair)).filter("source <> item").groupBy("source", "lang", "item").agg(
        F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(
        F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    everything = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").union(
        found.filter("part = 'term'"))
    return everything.withColumn("rank", F.row_number().over(order)).filter(
        (F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
