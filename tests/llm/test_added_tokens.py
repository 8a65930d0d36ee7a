"""Token ids of texts that hold an added token are those of the tokenizer as loaded."""

import random

import pytest


def test_added_tokens_are_single_ids():
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from scanloom.llm.token_planes import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encoder = tokenizers.Tokenizer.from_file(path), Encoder(path, 2)
    assert encoder.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bc", " ", " word", "\n", "\nline", "\t", "<|endoftext|>", "<|endof", "text|>"])
                       for _ in range(rng.randrange(12)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want + [2], repr(text)
