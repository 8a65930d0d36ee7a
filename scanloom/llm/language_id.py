"""Language identification with bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit per language, and the slots that an
n-gram hashes to, and-ed together, give the set of all languages that contain it. A
language's n-grams are the letter trigrams (with blanks at word ends) most frequent in
its training texts. A text's trigrams are looked up, their bits counted per language, and each
count is corrected for the hits that the fill of that language's bits gives by chance; the
language with the highest corrected count wins.

Fitted on a bounded sample (``PER_LANGUAGE`` documents a language, by a hash of the id). The
filter has a fixed number of slots, one byte for every eight languages; it goes to the
tasks with the function.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
could be learned; rows without a language are not learned from; ties go to the language
first in order; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.llm.common import slices, unit_hash

PER_LANGUAGE = 1500
GRAMS = 4000
SLOTS = 1 << 17
HASHES = 4
SEED = 51
_CODE_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool,
                       count=sys.maxunicode + 1)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts, as numbers, and where each text's end. Lower-cased; all
    that is not a letter counts as one blank."""
    codes = np.frombuffer(" ".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t.lower()) for t in texts])
    codes = np.concatenate([[32], codes, [32]]).astype(np.int64)
    ends = np.cumsum(lengths + 1)  # place of the blank after each text
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32)
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]          # the first blank of a run
    upto = np.cumsum(kept)
    codes = codes[kept]
    grams = (codes[:-2] << 2 * _CODE_BITS) | (codes[1:-1] << _CODE_BITS) | codes[2:]
    middle = codes[1:-1] != 32       # a trigram belongs to its middle letter
    counted = np.concatenate([[0], np.cumsum(middle)])
    at = np.clip(upto[ends] - 1 - 1, 0, len(counted) - 1)
    return grams[middle], counted[at]


def slots_of(grams: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    return [((mixed + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(hashes)]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    masks: np.ndarray    # slots x bytes
    by_chance: np.ndarray  # per language: share of unknown n-grams that hit
    hashes: int = HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages or not texts:
            return names, scores
        grams, ends = grams_of([t or "" for t in texts])
        sizes = np.diff(ends, prepend=0)
        full = np.flatnonzero(sizes)
        if not len(full):
            return names, scores
        counts = np.zeros((len(full), len(self.languages)))
        edges = np.concatenate([[0], ends[full]])
        low = 0
        while low < len(full):  # blocks of texts with about a million trigrams
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 20), side="right")) - 1)
            part = grams[edges[low]:edges[high]]
            known = functools.reduce(np.bitwise_and, (
                self.masks[s] for s in slots_of(part, len(self.masks), self.hashes)))
            bits = np.unpackbits(known, axis=1, bitorder="little", count=len(self.languages))
            counts[low:high] = np.add.reduceat(bits, edges[low:high] - edges[low], axis=0, dtype=np.int64)
            low = high
        total = sizes[full][:, None]
        true = np.clip((counts - total * self.by_chance) / (1 - self.by_chance), 0, None)
        best = true.argmax(axis=1)
        sums = true.sum(axis=1)
        for i, row in enumerate(full):
            names[row] = self.languages[best[i]]
            scores[row] = true[i, best[i]] / sums[i] if sums[i] else 0.0
        return names, scores


def build(grams: dict[str, list[int]], slots: int = SLOTS, hashes: int = HASHES) -> Model:
    languages = sorted(grams)
    masks = np.zeros((slots, max(1, -(-len(languages) // 8))), dtype=np.uint8)
    for n, language in enumerate(languages):
        for s in slots_of(np.array(grams[language], dtype=np.int64), slots, hashes):
            masks[s, n // 8] |= np.uint8(1 << n % 8)
    filled = np.unpackbits(masks, axis=1, bitorder="little").mean(axis=0)[:len(languages)]
    return Model(languages, masks, np.minimum(filled ** hashes, 0.999), hashes)


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, grams: int = GRAMS) -> Model:
    usable = docs.filter("lang is not null and text is not null").filter(learn)
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build({})
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(chance)
    sample = usable.filter(unit_hash(SEED, "doc_id") < chance).select("lang", "text")

    def count(batches):
        for batch in slices(batches, "text"):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                values, n = np.unique(grams_of(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values)), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen: dict[str, list[int]] = {}
    for row in counted.withColumn("r", rank).filter(F.col("r") <= grams).collect():
        chosen.setdefault(row.lang, []).append(row.gram)
    return build(chosen)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")
