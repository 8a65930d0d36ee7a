"""Nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from scanloom.llm import (
    decontaminate, language_id, mixing, near_copies, quality, quality_rules, secrets, sharding,
    simhash, token_planes, url_templates,
)

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, "
          "key string, good string, _id string, `row` string, _digest string, copy string, fp string")
WORDS = "the cat sat on a mat and then it ran far away from here. "
ROWS = [
    (1, WORDS * 5, "en", "a"), (2, WORDS * 5, "en", "b"), (3, None, "en", "a"), (4, "", None, None),
    (5, " \n\t ", "de", "b"), (6, WORDS * 8000, "en", "c"), (1, WORDS * 5, "en", "a"),
    (None, "no id here at all, none", None, "a"), (7, "word", "de", None), (8, "\u00e9\u4e2d \U0001f600 x", "fr", "a"),
    (9, None, None, None), (None, None, None, None), (10, "#### !!! 12345", "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) + ("x",) * 9 for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1), (2, 1), (5, 0), (10, 0), (10, None), (None, 1), (99, 0)], "doc_id bigint, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, WORDS * 2), (2, None), (3, " "), (4, WORDS * 2)], "item_id bigint, text string")


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def per_document(docs, labels, benchmark):
    yield "shards", sharding.shard_table(docs, 3)
    yield "language", language_id.predict(docs, language_id.fit(docs, F.lit(True)))
    yield "tokens", token_planes.round_trip(docs, tokenizer(), 2)
    yield "simhash", simhash.components(docs)
    yield "secrets", secrets.scan(docs)
    yield "mix", mixing.mix(docs).documents
    yield "quality", quality.score(docs, quality.fit(docs, labels, F.lit(True)))
    yield "rules", quality_rules.measure(docs)


def keeping(docs, labels, benchmark):
    yield "quality", quality.keep_good(docs, quality.fit(docs, labels, F.lit(True)))
    yield "copies", near_copies.drop_copies(docs)
    yield "leaks", decontaminate.drop_leaks(docs, benchmark)
    yield "mix", mixing.apply(docs)


def test_every_row_gets_a_row(docs, labels, benchmark):
    for name, result in per_document(docs, labels, benchmark):
        got = sorted((r.doc_id for r in result.collect()), key=str)
        assert got == sorted((r[0] for r in ROWS), key=str), name


def test_columns_are_kept(docs, labels, benchmark):
    for name, result in keeping(docs, labels, benchmark):
        assert result.dtypes == docs.dtypes, name
        result.collect()
    assert sharding.with_shard(docs, 3, "part").columns == [*docs.columns, "part"]


def test_empty_tables(empty, labels, benchmark):
    for name, result in [*per_document(empty, labels, benchmark), *keeping(empty, labels, benchmark)]:
        assert result.count() == 0, name
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert sharding.with_shard(empty, 3, "part").count() == 0


def test_empty_side_tables(docs, labels, benchmark):
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == len(ROWS)
    assert quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).count() == len(ROWS)
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs, F.lit(False))).collect()} == {"und"}


def test_defined_results(docs, labels, benchmark):
    copies = near_copies.drop_copies(docs).collect()
    assert sorted((r.doc_id for r in copies), key=str) == sorted(
        [1, 3, 5, 7, 8, 10, None, None] + ([6] if 6 in {r.doc_id for r in copies} else []), key=str)
    leaks = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert leaks == {(d, i, 0) for d in (1, 2, 6) for i in (1, 4)}
    language = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(
        docs, language_id.fit(docs, F.lit(True))).collect() if r.doc_id in (3, 4, 5, 9)}
    assert language == {(d, "und", 0.0) for d in (3, 4, 5, 9)}
    zero = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs).collect()}
    assert all(zero[d] == ("0" * 16, 3) for d in (3, 4, 5, 9))


def test_pages(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.COM/en/x?y#z"), (5, "x://net/es/1"),
            (5, "x://net/es/1"), (6, "http://www.example.com/en/1"), (7, "http://b.net"), (None, "http://example.com/en/")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(pages, none).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.example.com", "/en/x", "example.com/en/", "block"), (5, "net", "/es/1", "net/es/", "block"),
        (6, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (7, "b.net", "", None, "allow"),
        (None, "example.com", "/en/", "example.com/en/", "block")}
    assert url_templates.judge(pages, none).count() == len(urls)
    assert url_templates.judge(pages.limit(0), none).count() == 0
