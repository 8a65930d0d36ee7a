"""Texts are encoded by pieces; each piece goes to the tokenizer once, and no id differs for it."""

import random

import pyarrow as pa
import pytest

from scanloom.llm import token_planes


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain(path):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    return lambda texts: [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


PARTS = [
    *" \n\t\r\v\f'\"#,.-_/<|&~@[}09", "  ", "\n\n", " \n", "\r\n", "\u00a0", "\u1680", "\u180e", "\u2003", "\u2009",
    "\u2028", "\u205f", "\u3000", "\u200b", "\x1c", "\x1f", "\x85", "\x00", "\u00b2", "\u0663", "\u00e9", "\u00df", "\u00d7",
    "\u00f7", "\u0416", "\u047f", "\u0482", "\u0301", "\u4e2d", "\u30fc", "\U0001f600", "\u2014", "\u2019", "'s", "'t", "'re",
    "'LL", "a", "Bc", "word", " word", " word", "thin", "<|endoftext|>", "<|endof",
]


def odd_texts(rng):
    return ["".join(rng.choices(PARTS, k=rng.choice([0, 1, 2, 3, 6, 12, 40]))) for _ in range(rng.choice([1, 4, 150]))]


def test_words_go_to_the_tokenizer_once(path, plain):
    encoder, sent = token_planes.Encoder(path, 2), []
    each = encoder.each
    encoder.each = lambda texts: sent.extend(texts) or each(texts)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh\u00e4\u0436", k=rng.randrange(2, 9))) for _ in range(60)]
    texts = ["".join(rng.choice(words) + rng.choice(["", ",", ".", "###", "&&&"]) + rng.choice([" ", " ", "\n", "\n\n", "  "])
                     for _ in range(150)) + "end" for _ in range(200)]
    assert [x.tolist() for x in encoder.encode_all(texts)] == plain(texts)
    assert sum(map(len, sent)) < sum(map(len, texts)) / 20


def test_odd_texts(path, plain):
    encoder, rng = token_planes.Encoder(path, 2), random.Random(2)
    for _ in range(60):
        texts = odd_texts(rng)
        for got in (encoder.encode_all(texts), encoder.encode_all(pa.array(["first \u00e9", *texts])[1:])):
            assert [x.tolist() for x in got] == plain(texts)
    assert encoder.encode_all([]) == []


@pytest.mark.parametrize("limit", ["CACHED_PIECES", "CACHED_IDS", "LEARNED_CHARS"])
def test_few_pieces_kept(path, plain, monkeypatch, limit):
    monkeypatch.setattr(token_planes, limit, 30)
    encoder, rng = token_planes.Encoder(path, 2), random.Random(3)
    for _ in range(30):
        texts = odd_texts(rng)
        assert [x.tolist() for x in encoder.encode_all(texts)] == plain(texts)
    if limit != "LEARNED_CHARS":
        assert len(encoder.known) <= 30 and len(encoder.known) == len(encoder.begins)
