"""Benchmark items of any length, and with as many edits as are allowed."""

import random

import pytest

from scanloom.llm import decontaminate

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]


def prose(size):
    return " ".join(rng.choice(WORDS) for _ in range(size // 3 + 2)).encode()[:size].strip()


def edited(item, share):
    """A copy about as far from the item as the share allows, by edits of all kinds."""
    most, text = int(share * len(item)), item
    for k in range(most + 40):
        new = bytearray(text)
        at = rng.randrange(len(new))
        new[at:at + rng.randrange(2)] = rng.choice([b"", bytes([rng.choice(b"abcdefgh ")])])
        new = decontaminate.normal(bytes(new))
        if new and (k < most // 2 or decontaminate.edits(item, new, most)):
            text = new
    return text


def found(items, texts):
    rows = decontaminate.Filter(items).find([prose(300) + b" " + t + b" " + prose(300) for t in texts])
    return [any(r[:2] == (n, k) for r in rows) for n, (k, _) in enumerate(items)]


@pytest.mark.parametrize("size", [1, 3, 5, 9, 15, 20, 30, 39, 40, 45, 50, 60, 79, 80])
def test_items_of_any_length_are_found(size):
    items = [(k, prose(size)) for k in range(40)]
    assert all(found(items, [t for _, t in items]))


@pytest.mark.parametrize("size", [5, 10, 20, 30, 39])
def test_no_short_item_is_missed(size):
    items = [(k, prose(size)) for k in range(60)]
    assert all(found(items, [edited(t, decontaminate.SHARE) for _, t in items]))


@pytest.mark.parametrize("item", ["床前明月光疑是地上霜举头望明月低头思故乡" * 3, "=" * 60 + "x" + "=" * 60, "f(x)=y;" * 20, "aaaa" * 30])
def test_items_without_words(item):
    item = item.encode()
    for text in (item, b"qq" + item + b"qq", prose(200) + item + prose(200)):
        assert decontaminate.Filter([(3, item)]).find([text])[0][1:3] == (3, 0)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("low, high", [(40, 80), (80, 160), (160, 400)])
def test_edited_items_are_found(low, high, share):
    items = [(k, prose(rng.randrange(low, high))) for k in range(50)]
    texts = [edited(t, share) for _, t in items]
    distances = [decontaminate.edits(t, x, len(t))[0] for (_, t), x in zip(items, texts)]
    assert all(0.8 * int(share * len(t)) <= d <= share * len(t) for (_, t), d in zip(items, distances))
    assert sum(found(items, texts)) >= 49


@pytest.mark.parametrize("letters", ["acgt", "abcdefghijklmnopqrstuvwxyz      "])
def test_recall_end_to_end(letters):
    """Walks, first comparison and verification together, against the edit distance of every
    (text, item) that was planted: at 5, 10, 15 and 20 % of edits."""
    def some(size):
        return decontaminate.normal("".join(rng.choice(letters) for _ in range(size)).encode())

    items = [(k, some(rng.randrange(60, 300))) for k in range(60)]
    search = decontaminate.Filter(items)
    want, got = 0, 0
    for share in (0.05, 0.1, 0.15, 0.2):
        texts = [some(300) + b" " + decontaminate.edited(t, int(share * len(t)), rng) + b" " + some(300) for _, t in items]
        near = {(n, k) for n, (k, t) in enumerate(items)
                if decontaminate.edits(t, decontaminate.normal(texts[n]), int(decontaminate.SHARE * len(t)))}
        want += len(near)
        got += len(near & {r[:2] for r in search.find(texts)})
    assert want > 200 and got >= 0.99 * want


def test_classes_that_walks_miss_go_by_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "RECALL", 1.01)  # out of reach
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 2)
    items = [(k, prose(60)) for k in range(20)]
    assert not decontaminate.Filter(items).walks
    assert all(found(items, [edited(t, decontaminate.SHARE) for _, t in items]))
