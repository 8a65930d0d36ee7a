"""Quality classifier by Bradley-Terry pairwise ranking.

Every document gets a score, a weighted sum of features of its text. The weights maximise
the likelihood of preference pairs: that a document labelled good is preferred to one
labelled bad has the logistic of their difference of scores as its chance. The scale has no zero
of its own, so a quantile sets it: the share of bad labels in training cuts off as large
a share of the training scores, and this cut is mapped to ``CUT``.

Every labelled row is learned from. Features are measured by the tasks; rows are dealt to blocks, and within
a block every good row is compared with every bad one, so that pairs grow with the rows and not with
their square (a table of one block: all pairs). Newton's method takes sums over all blocks. Mean, scale and the
quantile are those of all labelled rows. Scoring covers every whole text. Only texts enter a score.

Null texts count as empty and are scored like any text; labels without a document, null labels
and null ids are not learned from; with one label only, every score is the prior; repeated
rows each get a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import slices, stored
from scanloom.llm.quality_rules import repeated_words

BLOCK = 1024
STEPS = 40
PENALTY = 1e-3
CUT = 0.3
SEED = 41
_PAIRED = 2048

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGIT = b"0123456789"
_MARKS = b"#*$%&|<>"


def features_of(text: bytes) -> list[float]:
    """Shape of a text: lengths, cases, marks, repeats. All are shares or logs, so long
    texts and short ones compare."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    solid = max(sum(map(len, words)), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda marks: (size - len(text.translate(None, marks))) / solid
    upper, lower = share(_UPPER), share(_LOWER)
    per_word = max(n, 1)
    return [
        np.log1p(n), solid / per_word, upper, upper / (upper + lower + 1e-9), share(_DIGIT),
        share(_MARKS), text.count(b"!") / per_word, text.count(b"|") / per_word,
        (text.count(b".") + text.count(b"?")) / per_word, text.count(b",") / per_word,
        len(set(words)) / per_word, repeated_words(words) / per_word,
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
        share(b"{}[]()=;_/\\@~^`\"'"), min(n, 50) / 50, text.count(b"http") / per_word,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def inputs(self, texts: list[bytes]) -> np.ndarray:
        return expand((np.array([features_of(t) for t in texts]) - self.mean) / self.scale)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1; the cut is at ``CUT``."""
        if not texts:
            return np.zeros(0)
        gap = np.clip(self.inputs(texts) @ self.weights - self.cut, -40, 40)
        return 1 / (1 + np.exp(-gap) * (1 - CUT) / CUT)


def expand(x: np.ndarray) -> np.ndarray:
    """Bounded features and their squares, so that a score can rise and fall along one."""
    x = np.clip(x, -4, 4)
    return np.concatenate([x, x * x], axis=1)


def preferences(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Of every pair of a good and a bad row: the sum of log-likelihoods, its gradient and its curvature."""
    n = len(w)
    total = [np.zeros(1), np.zeros(n), np.zeros((n, n))]
    for low in range(0, len(bad), _PAIRED):
        for at in range(0, len(good), _PAIRED):
            g, b = good[at:at + _PAIRED], bad[low:low + _PAIRED]
            gap = (g @ w)[:, None] - (b @ w)[None, :]
            miss = 1 / (1 + np.exp(np.clip(gap, -40, 40)))
            spread = miss * (1 - miss)
            cross = g.T @ spread @ b
            total[0] -= np.logaddexp(0, -gap).sum()
            total[1] += miss.sum(axis=1) @ g - miss.sum(axis=0) @ b
            total[2] += (g.T * spread.sum(axis=1)) @ g + (b.T * spread.sum(axis=0)) @ b - cross - cross.T
    return total


def maximise(sums: Callable[[np.ndarray], list[np.ndarray]], pairs: int, size: int, steps: int = STEPS) -> np.ndarray:
    """The weights with the greatest mean log-likelihood of ``pairs`` preferences, by Newton's method;
    ``sums`` gives what ``preferences`` does, over all of them."""
    w, step, at = np.zeros(size), np.zeros(size), None
    for _ in range(steps if pairs else 0):
        likelihood, grad, bend = (x / pairs for x in sums(w + step))
        here = float(likelihood[0]) - 0.5 * PENALTY * (w + step) @ (w + step)
        if at is not None and here < at[0]:
            step = step / 2
            if np.abs(step).max() < 1e-9:
                break
            continue
        w = w + step
        done = at is not None and here - at[0] < 1e-10
        at = (here, grad - PENALTY * w, bend + PENALTY * np.eye(size))
        if done:
            break
        step = np.linalg.solve(at[2], at[1])
    return w


def train(good: list[list[float]], bad: list[list[float]], bad_share: float) -> Model:
    """A model from the features of a few good and bad documents, all of whose pairs are compared."""
    raw = np.array([*good, *bad] or [features_of(b"")])
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    x = expand((raw - mean) / scale)
    w = maximise(lambda w: preferences(x[:len(good)], x[len(good):], w), len(good) * len(bad), x.shape[1])
    score = x @ w
    share = np.concatenate([np.full(len(good), (1 - bad_share) / max(len(good), 1)),
                            np.full(len(bad), bad_share / max(len(bad), 1))])
    cut = 0.0
    if len(share) == len(score) and len(score):
        order = np.argsort(score, kind="stable")
        at = int(np.searchsorted(np.cumsum(share[order]), bad_share * share.sum()))
        at = min(at, len(score) - 1)
        cut = float(score[order[max(at - 1, 0):at + 1]].mean())
    return Model(mean, scale, w, cut)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, features)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        for batch in slices(batches, "bytes"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([features_of(t or b"") for t in batch.column("bytes").to_pylist()],
                                                  pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(
        measure, f"doc_id {kind}, features array<double>")


def in_blocks(rows: DataFrame, n_good: int, n_bad: int, block: int = BLOCK) -> DataFrame:
    """``rows(doc_id, good, features)`` as (block, good, bad), lists of features, dealt at random to blocks of about
    ``block`` rows. Every row is in one; of a label with fewer rows than there are blocks, in several, so that
    rows of the other label have company."""
    blocks = max(1, -(-(n_good + n_bad) // block))
    times = {good: -(-blocks // n) for good, n in ((True, n_good), (False, n_bad))}

    def by_label(value: Callable[[int], int]) -> Column:
        return F.when(F.col("good"), F.lit(value(times[True]))).otherwise(F.lit(value(times[False])))

    dealt = rows.withColumn("k", F.explode(F.sequence(F.lit(0), by_label(lambda n: n - 1)))).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "features") + F.col("k") * by_label(lambda n: max(blocks // n, 1)),
                        F.lit(blocks)))

    def of(good: bool) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("good") == F.lit(good), F.col("features"))))

    return dealt.groupBy("block").agg(of(True).alias("good"), of(False).alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """``labels(doc_id, quality)``, 1 for good; ``learn`` picks the rows to learn from, by
    ``doc_id``."""
    usable = labels.filter("doc_id is not null and quality is not null").filter(learn).select(
        "doc_id", (F.col("quality") == 1).alias("good")).distinct()
    # measured where the texts are; only numbers are joined
    known = measured(docs.filter("doc_id is not null").filter(learn))
    rows = stored(known.join(usable, "doc_id").select("doc_id", "good", "features"), "quality-features")
    width = len(features_of(b""))
    column = [F.col("features")[k] for k in range(width)]
    seen = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"),
                    *(F.avg(c) for c in column), *(F.stddev_pop(c) for c in column)).first()
    if not seen.good + seen.bad:
        return train([], [], 0.0)
    mean, scale = np.array(seen[2:2 + width]), np.array(seen[2 + width:]) + 1e-6
    if not (seen.good and seen.bad):
        return Model(mean, scale, np.zeros(2 * width), 0.0)
    blocks = stored(in_blocks(rows, seen.good, seen.bad), "quality-blocks")

    def inputs(lists: pa.Array) -> np.ndarray:
        flat = np.array(lists.flatten().to_numpy(zero_copy_only=False))
        return expand((flat.reshape(-1, width) - mean) / scale)

    def every_block(part: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """The sums of ``part`` over all blocks, added up by the tasks first."""
        def run(batches):
            total = None
            for batch in batches:
                for good, bad in zip(batch.column("good"), batch.column("bad")):
                    found = part(inputs(good.values), inputs(bad.values))
                    total = found if total is None else [a + b for a, b in zip(total, found)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total])])], ["sums"])

        found = blocks.select("good", "bad").mapInArrow(run, "sums array<double>").collect()
        return np.sum([r.sums for r in found], axis=0)

    n = 2 * width
    pairs = int(blocks.agg(F.sum(F.size("good").cast("long") * F.size("bad"))).first()[0])

    def sums(w: np.ndarray) -> list[np.ndarray]:
        flat = every_block(lambda good, bad: preferences(good, bad, w))
        return [flat[:1], flat[1:1 + n], flat[1 + n:].reshape(n, n)]

    w = maximise(sums, pairs, n)
    return Model(mean, scale, w, quantile(rows, mean, scale, w, seen.bad, seen.good + seen.bad))


def quantile(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, below: int, n: int) -> float:
    """The score that so many of the rows reach at most, half way down to the one before it."""
    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            yield pa.RecordBatch.from_arrays([pa.array(expand((x - mean) / scale) @ w)], ["score"])

    ranks = [max(below - 1.5, 0.5) / n, (below - 0.5) / n]
    found = rows.select("features").mapInArrow(run, "score double").agg(
        F.percentile_approx("score", ranks, 1_000_000)).first()[0]
    return float(np.mean(found))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "bytes"):
            texts = [t or b"" for t in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(texts))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(
        run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least ``cut``, with all their columns."""
    def run(batches):
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) >= cut))

    return docs.mapInArrow(run, docs.schema)
