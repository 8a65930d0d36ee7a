"""The prefix trie against a plain trie in memory, and its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from check import compare
from scanloom.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, rep string, depth string, key string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    paths = {}
    for conv, turns in own.items():
        turns.sort()
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        donor = conv - int(math.fmod(conv, 20))
        paths[conv] = tuple(t[3:] for t in own.get(donor, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    return sorted(((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == node))).encode()).hexdigest())
        for node, m in members.items()), key=str)


def built(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.trie(table, **sizes).collect()), key=str)


def some(seed, n=150):
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, t, t]), rng.choice(["user", None, "a"]), rng.choice(["x y", None, "", "z", "é q w"]))
            for c in rng.sample(range(-60, 400), n) for t in range(rng.randrange(1, 7))]
    return rows + rows[:30] + [(None, 1, "user", "lost"), (None, None, None, None)]


def test_equals_a_plain_trie(spark):
    rows = some(1)
    assert built(spark, rows) == plain(rows)


@pytest.mark.parametrize("sizes", [
    dict(piece=2, block_size=2, repeats=3, max_cells=1 << 8, hot_rows=10),  # a sketch that is nearly full
    dict(piece=1, block_size=3, repeats=1, max_cells=1 << 16),
])
def test_sizes_change_nothing(spark, sizes):
    rows = some(2, 90)
    assert built(spark, rows, **sizes) == plain(rows)


def test_long_copies_and_hot_prefixes(spark):
    long = [(c, t, "user", f"turn {t}") for c in (1, 2, 41) for t in range(70)]
    short = [(c, 0, "user", "hello there") for c in range(100, 400)] + [(c, 1, "a", "hi") for c in range(100, 200)]
    rows = long + short + [(7, 0, "user", "hello there")] * 100
    assert built(spark, rows, piece=16, block_size=8, hot_rows=50) == plain(rows)


def test_no_turns(spark):
    assert built(spark, []) == [] and built(spark, [(None, 0, "user", "x")]) == []
    # one turn, and all of it would come from an absent conversation
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert built(spark, [(alone, 0, "user", "x")]) == plain([(alone, 0, "user", "x")])


def test_very_long_text(spark):
    rows = [(c, t, "user", "word " * 300_000) for c in (20, 21, 22) for t in range(3)]
    assert built(spark, rows) == plain(rows)


def test_op11_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    outcome = compare(spark, con, "op11", queries.op11_prefix_trie, queries.SQL["op11_prefix_trie"], "/root/testdata/sf0.001")
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome
