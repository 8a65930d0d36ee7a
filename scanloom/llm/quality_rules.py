"""Quality rules: counts per document, and a line labeller that finds boilerplate.

Lines with a word are labelled content or boilerplate by a linear-chain conditional random
field, decoded by Viterbi; a document is kept if content holds at least ``LEAST_CONTENT`` of
its words (and no count fails it). The field is fitted here, by maximum likelihood, on a
bounded sample (about ``TRAIN_DOCS`` different texts of at most ``TRAIN_BYTES`` bytes, by a hash of
id and text) whose lines get provisional labels from plain rules: repeated within the
document, common in the corpus, mostly symbols, shouted, or a bare fragment. How common the
sample's lines are is counted over all documents, in different texts: a line is common from
``COMMON_TEXTS`` texts and ``COMMON_SHARE`` of all texts on.

Where the sample is empty, or all its lines get one label, there is nothing to tell apart: every line counts as
content, and a document is kept unless a count fails it.

Null and empty texts have no words: all counts are 0 and the text rules fail them. Repeated rows
each get a row; an empty table gives none; columns other than ``doc_id`` and ``text``
are not read. A text is handled whole within one task, in memory in proportion to it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import slices, unit_hash

TRAIN_DOCS = 400
TRAIN_BYTES = 1 << 20
COMMON_TEXTS = 3
COMMON_SHARE = 0.0025
STEPS = 80
SEQUENCE = 128  # lines, in training
LEAST_CONTENT = 0.5
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
SEED = 31
_DELETE_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha())
_DELETE_DIGITS = b"0123456789"
FEATURES = 12


def features_of(lines: list[bytes], words: list[int]) -> np.ndarray:
    """A row of features per line (lines that have a word, with their word counts)."""
    rows, seen = [], set()
    for line, n in zip(lines, words):
        line = line.strip()
        size = len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        letters = size - len(line.translate(None, _DELETE_LETTERS))
        shouted = letters > 1 and line.upper() == line
        rows.append((
            1.0, n < 3, 3 <= n < 8, n >= 20, symbols * 20 > size, symbols * 5 > size, shouted,
            line in seen, line[-1:] in b".!?:\"'", line[:1].isupper() or line[0] > 127,
            (size - len(line.translate(None, _DELETE_DIGITS))) * 5 > size, 2 * letters < size,
        ))
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES)


def provisional(lines: list[bytes], words: list[int], common: set[bytes]) -> list[int]:
    """1 content, 0 boilerplate."""
    labels, seen = [], set()
    for line, n in zip(lines, words):
        line = line.strip()
        size = len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        letters = size - len(line.translate(None, _DELETE_LETTERS))
        poor = (line in seen or line in common or symbols * 5 > size
                or (n > 1 and letters > 3 and line.upper() == line)
                or (n < 3 and line[-1:] not in (b".", b"!", b"?")))
        seen.add(line)
        labels.append(int(not poor))
    return labels


def train(texts: list[bytes], steps: int = STEPS, common: set[bytes] | None = None) -> dict[str, np.ndarray]:
    """Maximum-likelihood weights of a two-state linear chain, by gradient ascent (Adam). Without
    ``common`` lines given they are those of three of the texts."""
    parts = [_lines(t) for t in dict.fromkeys(texts)]
    parts = [p for p in parts if p[0]]
    if common is None:
        everywhere = Counter(x for lines, _ in parts for x in {y.strip() for y in lines})
        common = {x for x, n in everywhere.items() if n >= COMMON_TEXTS}
    if len({label for p in parts for label in provisional(*p, common)}) < 2:
        # weights that make every line content
        return {"state": np.array([[0.0, 1.0]] + [[0.0, 0.0]] * (FEATURES - 1)), "step": np.zeros((2, 2))}
    # long documents are cut into several sequences, so that padding stays small
    x = [f[k:k + SEQUENCE] for p in parts for f in [features_of(*p)] for k in range(0, len(f), SEQUENCE)]
    y = [np.array(g[k:k + SEQUENCE]) for p in parts for g in [provisional(*p, common)]
         for k in range(0, len(g), SEQUENCE)]
    longest = max(map(len, y))
    feats = np.zeros((len(x), longest, FEATURES))
    gold, mask = np.zeros((len(x), longest), dtype=int), np.zeros((len(x), longest))
    for i, (f, g) in enumerate(zip(x, y)):
        feats[i, :len(g)], gold[i, :len(g)], mask[i, :len(g)] = f, g, 1
    on = np.eye(2)[gold] * mask[..., None]
    both = mask[:, 1:] * mask[:, :-1]
    seen_step = np.einsum("nti,ntj->ij", on[:, :-1] * both[..., None], on[:, 1:])
    seen_state = np.einsum("ntf,nts->fs", feats, on)
    w = np.zeros(FEATURES * 2 + 4)
    m, v, total = np.zeros_like(w), np.zeros_like(w), mask.sum()
    for k in range(1, steps + 1):
        state, step = w[:-4].reshape(FEATURES, 2), w[-4:].reshape(2, 2)
        score = feats @ state
        ahead = np.zeros_like(score)   # log sums from the left, then from the right
        behind = np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1)
            ahead[:, t] = np.where(mask[:, t, None] > 0, new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :]
                      - z[:, None, None, None]) * both[..., None, None]
        grad = np.concatenate([
            (seen_state - np.einsum("ntf,nts->fs", feats, p)).ravel(),
            (seen_step - pair.sum(axis=(0, 1))).ravel()]) / total - 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w = w + 0.2 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return {"state": w[:-4].reshape(FEATURES, 2), "step": w[-4:].reshape(2, 2)}


def viterbi(score: np.ndarray, step: np.ndarray) -> list[int]:
    """Best state of each line: 1 content, 0 boilerplate."""
    (s00, s01), (s10, s11) = step.tolist()
    rows = score.tolist()
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
        a, b = x + (a + s00 if from_a else b + s10), y + (a + s01 if from_b else b + s11)
        back.append((0 if from_a else 1, 0 if from_b else 1))
    path = [0 if a >= b else 1]
    for pair in reversed(back):
        path.append(pair[path[-1]])
    return path[::-1]


def _lines(text: bytes) -> tuple[list[bytes], list[int]]:
    counted = [(line, len(line.split())) for line in text.split(b"\n")]
    counted = [x for x in counted if x[1]]
    return [x[0] for x in counted], [x[1] for x in counted]


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    k = len(known)
    pairs = ids[:-2] * k + ids[1:-1]
    if k < 1 << 20:
        runs = pairs * k + ids[2:]
    else:
        runs = np.unique(pairs, return_inverse=True)[1] * np.int64(k) + ids[2:]
    _, which, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def judge(text: bytes, model: dict[str, np.ndarray]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content
    share (null without a word), kept."""
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - sum(text.count(bytes([c])) for c in SPACES)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines, counts = _lines(text)
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > 50 * n
    share = None
    if lines:
        path = viterbi(features_of(lines, counts) @ model["state"], model["step"])
        share = sum(c for c, s in zip(counts, path) if s) / n
    kept = not failed and share is not None and share >= LEAST_CONTENT
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, share, kept


def _line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, SEED) - (1 << 63)


def common_lines(docs: DataFrame, lines: set[bytes]) -> set[bytes]:
    """Which of some lines, a bounded set, are common: counted over all documents, once per
    different text. Only the lines asked for are shuffled, as hashes."""
    wanted = {_line_hash(x) for x in lines}
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def meet(batches):
        for batch in slices(batches, "bytes"):
            digests, found = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("bytes").to_pylist()):
                mine = {_line_hash(x) for x in {y.strip() for y in (text or b"").split(b"\n")}} & sent.value
                digests += [digest] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(found, pa.int64())], ["digest", "line"])

    raw = F.col("text").cast("binary")
    texts = docs.filter("text is not null").select(F.md5(raw).alias("digest"), raw.alias("bytes"))
    total = docs.select("text").filter("text is not null").count()
    least = max(COMMON_TEXTS, int(np.ceil(COMMON_SHARE * total)))
    counted = texts.mapInArrow(meet, "digest string, line bigint").groupBy("line").agg(
        F.count_distinct("digest").alias("n")).filter(F.col("n") >= least)
    known = {r["line"] for r in counted.collect()}  # of the lines asked for
    return {x for x in lines if _line_hash(x) in known}


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """The labeller's weights, from about ``limit`` different texts and the counts of their lines."""
    n = docs.count()
    chance = min(1.0, limit / max(n, 1))
    text = F.col("text")
    sample = docs.filter((unit_hash(SEED, "doc_id", "text") < chance) & (F.octet_length(text) <= TRAIN_BYTES)).select(
        text.cast("binary").alias("t")).distinct().orderBy(F.md5("t")).limit(4 * limit)
    rows = sorted(bytes(r.t) for r in sample.toLocalIterator())
    lines = {x.strip() for t in rows for x in _lines(t)[0]}
    return train(rows, common=common_lines(docs, lines) if lines else set())


def measure(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row per document: the counts, base_failed, content_share and kept."""
    model = fit(docs) if model is None else model
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "content_share", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches):
        for batch in slices(batches, "bytes"):
            rows = [judge(t or b"", model) for t in batch.column("bytes").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[:5])
        + ", base_failed boolean, content_share double, kept boolean")
