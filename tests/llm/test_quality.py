"""The pairwise ranking against a plain maximiser of the same likelihood, and its cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import quality

GOOD = ["A quiet harbour lies north of town number %d. Ships come in, and gulls follow them.\n" % i * (3 + i % 5)
        for i in range(60)]
BAD = ["BUY NOW!!! %d $$$ | click | click | http://x | FREE %d\n" % (i, i * i) * (1 + i % 7) for i in range(40)]
MIXED = [g[:200] + b for g, b in zip(GOOD, BAD)]


def measured(texts):
    return [quality.features_of(t.encode()) for t in texts]


def likelihood(gap, w):
    return -np.logaddexp(0, -gap @ w).mean() - 0.5e-3 * w @ w


def maximiser(gap):
    """Newton's method on the penalised likelihood of the pairs."""
    w = np.zeros(gap.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(gap @ w))
        grad = p @ gap / len(gap) - 1e-3 * w
        hess = -(gap * (p * (1 - p))[:, None]).T @ gap / len(gap) - 1e-3 * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while likelihood(gap, w - size * step) < likelihood(gap, w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return w


@pytest.mark.parametrize("good, bad", [(GOOD, BAD), (GOOD + MIXED[:20], BAD + MIXED[10:])])
def test_weights_maximise_the_likelihood_of_preferences(good, bad):
    """Over every pair of a good and a bad document, not the drawn ones."""
    model = quality.train(measured(good), measured(bad), 0.4)
    x, y = model.inputs([t.encode() for t in good]), model.inputs([t.encode() for t in bad])
    gap = (x[:, None, :] - y[None, :, :]).reshape(-1, x.shape[1])
    reached, best = likelihood(gap, model.weights), likelihood(gap, maximiser(gap))
    start = likelihood(gap, np.zeros(x.shape[1]))
    assert start < reached <= best + 1e-9
    assert best - reached < 0.05 * (best - start)


@pytest.mark.parametrize("bad_share", [0.1, 0.3, 0.5])
def test_cut_is_the_quantile_of_the_bad_share(bad_share):
    good, bad = measured(GOOD), measured(BAD)
    model = quality.train(good, bad, bad_share)
    scores = model.scores([t.encode() for t in GOOD + BAD])
    weights = np.array([(1 - bad_share) / len(good)] * len(good) + [bad_share / len(bad)] * len(bad))
    below = weights[scores < quality.CUT].sum()
    assert abs(below - bad_share) <= weights.max() * 1.5


def test_scores_follow_from_weights_and_cut():
    model = quality.train(measured(GOOD), measured(BAD), 0.4)
    texts = [*GOOD[:5], *BAD[:5], "", "word", "ü" * 5000, "a b c " * 20000]
    for text, got in zip(texts, model.scores([t.encode() for t in texts])):
        shaped = [max(-4.0, min(4.0, (f - m) / s)) for f, m, s in zip(
            quality.features_of(text.encode()), model.mean, model.scale)]
        total = sum(w * v for w, v in zip(model.weights, [*shaped, *(v * v for v in shaped)]))
        odds = math.exp(max(-40.0, min(40.0, total - model.cut))) * quality.CUT / (1 - quality.CUT)
        assert got == pytest.approx(odds / (1 + odds), abs=1e-9)


@pytest.mark.parametrize("good, bad", [([], []), (GOOD[:3], []), ([], BAD[:3])])
def test_one_label_gives_the_prior(good, bad):
    model = quality.train(measured(good), measured(bad), 0.5)
    assert np.allclose(model.scores([b"", b"any text", BAD[0].encode()]), quality.CUT)


def labelled(spark, good, bad):
    texts = [*good, *bad]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k < len(good))) for k in range(len(texts))], "doc_id bigint, quality int")
    return docs, labels


def cut_of(model, good, bad):
    """Half way between the two rows around the share of bad ones."""
    scores = np.sort(model.inputs([t.encode() for t in [*good, *bad]]) @ model.weights)
    return scores[len(bad) - 2:len(bad)].mean()


def test_every_labelled_row_counts(spark):
    """More rows than a bounded sample of 4,000 of a label holds, in several blocks."""
    good = [f"Ship number {k} came in. " * (1 + k % 7) for k in range(6000)]
    bad = [f"BUY {k} $$$ | click " * (1 + k % 5) for k in range(300)]
    model = quality.fit(*labelled(spark, good, bad), F.lit(True))
    raw = np.array(measured([*good, *bad]))
    assert np.allclose(model.mean, raw.mean(axis=0), rtol=1e-9)
    assert np.allclose(model.scale, raw.std(axis=0) + 1e-6, rtol=1e-6)
    assert model.cut == pytest.approx(cut_of(model, good, bad), abs=1e-6)
    scores = model.scores([t.encode() for t in [*good, *bad]])
    assert scores[:6000].min() > quality.CUT - 1e-6 > scores[6000:].mean()


def test_a_table_of_one_block_compares_all_pairs(spark):
    good, bad = GOOD + MIXED[:20], BAD + MIXED[10:]
    model = quality.fit(*labelled(spark, good, bad), F.lit(True))
    whole = quality.train(measured(good), measured(bad), len(bad) / (len(good) + len(bad)))
    assert np.allclose(model.weights, whole.weights, atol=1e-4)
    assert model.cut == pytest.approx(cut_of(model, good, bad), abs=1e-6)


def test_blocks_hold_every_row(spark):
    rows = spark.createDataFrame([(k, k >= 3, [float(k)]) for k in range(1000)], "doc_id bigint, good boolean, features array<double>")
    found = quality.in_blocks(rows, 997, 3, block=100).collect()
    good = sorted(v for r in found for (v,) in r.good)
    assert good == [float(k) for k in range(3, 1000)] and len(found) == 10
    assert {v for r in found for (v,) in r.bad} == {0.0, 1.0, 2.0}
    assert sum(len(r.bad) for r in found) == 12
