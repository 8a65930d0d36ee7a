"""The divergence audit against its SQL and a plain version, with small memory."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from check import compare
from scanloom.llm import divergence, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string, value string, part string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(UPPER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, mine = len(kept), sorted(s for g, s in groups if g == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in mine}

        def p(n, of):
            return 1 + 10**9 * (n + 2) // (of + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in mine:
            pairs = [(-sum(f(p(counts[lang, s][t], total[s]), p(counts[lang, o][t], total[o])) for t in kept), o.encode())
                     for o in mine if o != s]
            terms = []
            for t in kept:
                a, b = p(counts[lang, s][t], total[s]), p(sum(counts[lang, o][t] for o in mine), sum(total.values()))
                if counts[lang, s][t] and a > b:
                    terms.append((-f(a, b), t.encode()))
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


WORDS = "the Cat sat on é中 MAT and_then it ran 3far away from\x00here"
ROWS = [
    (1, WORDS * 3, "en", "a"), (2, WORDS, "en", "b"), (3, None, "en", "c"), (4, "", None, None), (5, "123 !!", "de", "b"),
    (6, "de wort de", "de", "a"), (7, "de", "de", "a"), (1, WORDS * 3, "en", "a"), (None, "The cat", "en", None),
    (8, "word cat " * 40_000, "en", "b"), (9, None, None, None), (10, "sat " * 3 + "on", "en", "\U0001f600"),
    (11, "Été été ÉTÉ", "en", "z"), (12, "ran ran cat", "en", "ab"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("least,sizes", [
    (2, {}), (1, dict(entries=5, stream_entries=4, shard_bytes=1000)), (3, dict(entries=40)), (100, {})])
def test_equals_plain(docs, least, sizes):
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=least, top=3, **sizes).collect())
    assert got == plain(ROWS, least, 3)


def test_empty(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits():
    import numpy as np
    counts = np.array([10**13, 5])
    assert divergence.share(counts, np.array([3 * 10**13, 7]), 11).tolist() == [
        1 + 10**9 * (c + 2) // (n + 22) for c, n in ((10**13, 3 * 10**13), (5, 7))]


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    outcome = compare(spark, con, "op13", queries.op13_divergence, queries.SQL["op13_divergence"], SF)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome
