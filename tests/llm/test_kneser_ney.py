"""The language model against a plain one over dictionaries; probabilities that sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import kneser_ney as kn, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, score string, n_tokens string, kind string"


class Plain:
    def __init__(self, texts, order):
        self.order, raw, top = order, Counter(), Counter()
        for text in texts:
            tokens = self.tokens(text)
            raw.update(tokens)
            padded = ["<s>"] * (order - 1) + tokens
            top.update(tuple(padded[k:k + order]) for k in range(len(tokens)))
        self.raw, self.n, self.v = raw, sum(raw.values()), len(raw)
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.context = {}, {}
        for k, counts in self.counts.items():
            times = Counter(counts.values())
            self.d[k] = (0.0, *kn.discounts(*(times[n] for n in (1, 2, 3, 4))))
            held = self.context[k] = defaultdict(lambda: [0, 0, 0, 0])
            for gram, n in counts.items():
                held[gram[:-1]][0] += n
                held[gram[:-1]][min(n, 3)] += 1

    @staticmethod
    def tokens(text):
        return WORD.findall((text or "").translate(UPPER)) + ["</s>"]

    def p(self, gram):
        value = 1 / (self.v + 1)
        for k in range(1, self.order + 1):
            part = gram[self.order - k:]
            if part[:-1] in self.context[k]:
                total, *following = self.context[k][part[:-1]]
                n = self.counts[k][part]
                value = (max(n - self.d[k][min(n, 3)], 0) + sum(a * b for a, b in zip(self.d[k][1:], following)) * value) / total
        return value

    def score(self, text):
        tokens = self.tokens(text)
        padded = ["<s>"] * (self.order - 1) + tokens
        return (len(tokens), sum(t in self.raw for t in tokens), self.n,
                sum(math.log10((self.raw[t] + 1) / (self.n + self.v + 1)) for t in tokens),
                sum(math.log10(self.p(tuple(padded[k:k + self.order]))) for k in range(len(tokens))))


def same(got, want):
    assert got[:3] == want[:3]
    assert got[3:] == pytest.approx(want[3:], rel=1e-9)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("a b c d The the É x-1   zz".split(" ")) for _ in range(rng.randrange(30))), "x", "x", "x", "x")
            for k in range(60)]
    rows += [(100, None, "x", "x", "x", "x"), (101, "", "x", "x", "x", "x"), (None, "a b never seen", "x", "x", "x", "x"),
             (3, "a b c", "x", "x", "x", "x"), (3, "a b c", "x", "x", "x", "x"), (102, "the x " * 400, "x", "x", "x", "x"),
             (103, " \n\t ", "x", "x", "x", "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("order,sizes,most", [(2, {}, kn.TOKENS_SCORED), (3, dict(shard_bytes=300, most=100), 50),
                                              (1, {}, 10), (4, dict(shard_bytes=1000), 1000)])
def test_equals_plain(docs, order, sizes, most):
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 1
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain([t for d, t in rows if (1 if d is None else d) % 3 != 1], order)
    got = sorted((tuple(r) for r in kn.score(docs, kn.fit(docs, train, order, **sizes), most).collect()), key=str)
    want = sorted(((d, *plain.score(t)) for d, t in rows), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        same(g[1:], w[1:])


def test_probabilities_sum_to_one(docs):
    plain = Plain([r.text for r in docs.collect()], 3)
    for context in [("<s>", "<s>"), ("a", "b"), ("nothing", "here"), ("nothing", "a")]:
        assert sum(plain.p((*context, w)) for w in [*plain.raw, "unknown"]) == pytest.approx(1)


def test_large_counts_and_long_texts(spark, tmp_path, monkeypatch):
    keys, counts = np.arange(10, dtype=np.uint64) * 3, np.array([1, 254, 255, 256, 10**12, 3, 255, 7, 10**6, 2])
    kn._write_grams(str(tmp_path), 2, 0, keys, counts, counts)
    wanted = np.arange(30, dtype=np.uint64)
    got = kn._read_grams(kn._map(str(tmp_path), "grams-2-0"), 2, wanted)[0]
    assert got.tolist() == [int(counts[k // 3]) if k % 3 == 0 else 0 for k in range(30)]
    assert kn._map(str(tmp_path), "grams-2-1") is None
    monkeypatch.setattr(kn, "_SLICE", 7)
    hashes = kn._Hashes()
    text = "one two  three\nfour five six seven"
    pieces = list(kn.token_pieces(text, 3, hashes))
    assert len(pieces) > 2 and all(a[-2:].tolist() == b[:2].tolist() for a, b in zip(pieces, pieces[1:]))
    assert [int(t) for p in pieces for t in p[2:]] == [hashes[w] for w in text.encode().split()] + [2]


def test_nothing_to_learn_from(docs):
    rows = kn.score(docs, kn.fit(docs, F.lit(False))).collect()
    assert len(rows) == docs.count() and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)
    assert kn.score(docs.limit(0), kn.fit(docs.limit(0), F.lit(True))).count() == 0


def test_op12(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    plain = Plain([t for d, t in texts.items() if not held[d]], 2)
    rows = queries.op12_kneser_ney(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == held[r.doc_id]
        same(tuple(r)[2:], plain.score(texts[r.doc_id]))
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
