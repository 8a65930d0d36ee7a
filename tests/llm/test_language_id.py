"""The bit-sliced filter against plain sets: a set of slots per language, a loop per text."""

import random

import numpy as np
import pytest

from scanloom.llm import language_id

TEXTS = [
    "The cat sat on the mat", "Der Hund läuft über die Straße", "", None, "1234 --- !!", "a", " a ",
    "é", "ÇA VA? Ça va!", "кот и собака", "日本語 テキスト", "İstanbul", "x\ty\nz", "the" * 500,
    "the the the", "the the the", "word " * 300 + "über " * 10, "\ud800 lone",
]
WORD = (1 << 64) - 1


def trigrams(text):
    """Trigrams around each letter, runs of other characters being one blank."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    padded = " " + " ".join(letters.split()) + " "
    return [padded[i - 1:i + 2] for i in range(1, len(padded) - 1) if padded[i] != " "]


def number(gram):
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def slots(gram, size, hashes):
    mixed = number(gram) * 0x9E3779B97F4A7C15 & WORD
    mixed ^= mixed >> 29
    mixed = mixed * 0xBF58476D1CE4E5B9 & WORD
    mixed ^= mixed >> 32
    step = mixed >> 40 | 1
    return [(mixed + k * step & WORD) % size for k in range(hashes)]


def plain(learned, texts, size, hashes):
    filled = {lang: {s for g in grams for s in slots(g, size, hashes)} for lang, grams in learned.items()}
    results = []
    for text in texts:
        grams = trigrams(text)
        true = {}
        for lang in sorted(learned):
            hits = sum(all(s in filled[lang] for s in slots(g, size, hashes)) for g in grams)
            chance = min((len(filled[lang]) / size) ** hashes, 0.999)
            true[lang] = max((hits - len(grams) * chance) / (1 - chance), 0.0)
        if not grams:
            results.append(("und", 0.0))
            continue
        best = max(sorted(true), key=true.get)
        total = sum(true.values())
        results.append((best, true[best] / total if total else 0.0))
    return results


@pytest.mark.parametrize("size, hashes, langs", [(1 << 17, 4, 3), (1 << 9, 2, 3), (1 << 10, 4, 11), (64, 1, 9)])
def test_equals_plain_sets(size, hashes, langs):
    """Also with filters so full that chance hits decide much, and masks of two bytes."""
    draw = random.Random(size + langs)
    pool = sorted({g for t in TEXTS for g in trigrams(t)})
    learned = {f"l{i:02}": draw.sample(pool, draw.randint(1, len(pool) // 2)) for i in range(langs)}
    model = language_id.build({k: [number(g) for g in v] for k, v in learned.items()}, size, hashes)
    names, scores = model.predict(TEXTS)
    want = plain(learned, TEXTS, size, hashes)
    assert names == [w[0] for w in want]
    assert np.allclose(scores, [w[1] for w in want], atol=1e-9)


def test_every_learned_trigram_returns_its_languages():
    learned = {"aa": ["the", "cat"], "bb": ["the"], "cc": ["dog"]}
    model = language_id.build({k: [number(g) for g in v] for k, v in learned.items()})
    for gram in ("the", "cat", "dog"):
        known = np.bitwise_and.reduce([model.masks[s[0]] for s in language_id.slots_of(
            np.array([number(gram)]), len(model.masks), model.hashes)])
        found = {lang for n, lang in enumerate(model.languages) if known[n // 8] >> n % 8 & 1}
        assert found == {lang for lang, grams in learned.items() if gram in grams}


def test_fit_learns_the_most_frequent_trigrams(spark):
    rows = [(i, lang, text) for i, (lang, text) in enumerate([
        ("aa", "the the the cat"), ("aa", "the cat"), ("aa", None), ("bb", "dog dog"), (None, "bird"), ("bb", "")])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit(docs, docs.doc_id >= 0, grams=3)
    want = {}
    for lang in ("aa", "bb"):
        counts = {}
        for _, name, text in rows:
            for gram in trigrams(text) if name == lang else []:
                counts[number(gram)] = counts.get(number(gram), 0) + 1
        want[lang] = sorted(counts, key=lambda g: (-counts[g], g))[:3]
    plainly = language_id.build(want)
    assert model.languages == plainly.languages
    assert (model.masks == plainly.masks).all()
