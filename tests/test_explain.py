"""Redaction, cache keys, queue, responses, list normalizing, skew-proof join."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions import redact as D
from scanloom.operators import explain as E
from scanloom.operators.skew import lookup_join
from tests import samples as S

FINDING = ("repo_id string, rule_id string, title string, severity string, file string, line int, "
           "evidence string, sev_rank int, disc_ord int")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, expected", [
    (f'k = "{S.OPENAI}"', 'k = "sk-' + 'proj-***"'),
    ("x " + "sk_" + "test_abc y", "x " + "sk_" + "test_*** y"),
    (f"push({S.GITHUB})", "push(gh" + "p_***)"),
    (f"push({S.GITHUB_FINE})", "push(github" + "_pat_***)"),
    (f"maps({S.GOOGLE})", "maps(AI" + "za***)"),
    (f"aws {S.AWS} end", "aws *** end"),
    (f"x{S.AWS}", f"x{S.AWS}"),
    ('a = "0123456789abcdef"', 'a = "***"'),
    ("a = 0123456789abcde", "a = 0123456789abcde"),
    ("plain = text and more", "plain = text and more"),
    ("", ""),
])
def test_redaction(spark, text, expected):
    assert one(spark, D.redact, text) == expected


def test_redaction_reads_whole_texts(spark):
    text = "a" * 5000 + f" {S.GITHUB}"
    assert one(spark, D.redact, text).endswith("gh" + "p_***")
    assert one(spark, lambda c: D.redact(c, 500), text) == "a" * 500


def test_redaction_agrees_with_python(spark):
    import random
    rng = random.Random(9)
    parts = [S.OPENAI, S.GITHUB, S.AWS, S.GOOGLE, "=", '"', "'", " ", "\n", "word", "abcdefgh12345678", "é"]
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
           .orderBy("i").select(D.redact(F.col("t"))).collect()]
    for text, result in zip(texts, got):
        for pattern, replacement in D.REDACTIONS:
            text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), text)
        assert result == text


def findings(spark, *rows):
    return spark.createDataFrame([("r", rule, "T " + rule, sev, f, line, ev, 1, 0)
                                  for rule, sev, f, line, ev in rows], FINDING)


def test_queue_has_one_request_per_key(spark):
    table = findings(spark, ("JS_EVAL", "high", "b.js", 1, "eval(x)"), ("JS_EVAL", "high", "a.js", 9, "eval(x)"),
                     ("JS_EVAL", "low", "a.js", 1, "eval(x)"), ("X", "high", "a.js", 1, f'k = "{S.OPENAI}"'))
    rows = E.explanation_queue(table).collect()
    assert sorted((r.rule_id, r.severity, r.file, r.line) for r in rows) == [
        ("JS_EVAL", "high", "a.js", 9), ("JS_EVAL", "low", "a.js", 1), ("X", "high", "a.js", 1)]
    for r in rows:
        assert "Return valid JSON only" in r.prompt and "Keep each value under 80 words" in r.prompt
        assert S.OPENAI not in r.prompt and re.fullmatch("[0-9a-f]{64}", r.cache_key)
    masked = next(r for r in rows if r.rule_id == "X")
    assert "proj-***" in masked.prompt
    digest = hashlib.sha256(b"eval(x)").hexdigest()
    expected = hashlib.sha256(f"JS_EVAL|{digest}|low".encode()).hexdigest()
    assert next(r for r in rows if r.severity == "low").cache_key == expected
    cache = E.explanation_queue(table).filter("rule_id = 'X'")
    assert E.queue_misses(E.explanation_queue(table), cache).count() == 2


def reply(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


GOOD = json.dumps({"explanation": " Why. ", "attack_scenario": "How.", "fix_details": "Fix."})


@pytest.mark.parametrize("status, error, body, explanation, code", [
    (200, None, reply(GOOD), "Why.", ""),
    (200, None, reply("```json\n" + GOOD + "\n```"), "Why.", ""),
    (200, None, reply("```" + GOOD + "```"), "Why.", ""),
    (200, None, reply('{"explanation": "E"}'), "E", ""),
    (200, None, reply("  "), None, "ai_empty_response"),
    (200, None, reply('{"explanation": " "}'), None, "ai_empty_response"),
    (200, None, reply('{"other": 1}'), None, "ai_empty_response"),
    (200, None, reply("no json"), None, "ai_model_request_failed"),
    (200, None, reply("[1]"), None, "ai_model_request_failed"),
    (200, None, reply('{"explanation": 5}'), None, "ai_model_request_failed"),
    (200, None, "{}", None, "ai_empty_response"),
    (200, None, "upstream error", None, "ai_model_request_failed"),
    (200, None, reply(GOOD)[:40], None, "ai_model_request_failed"),
    (200, None, reply('{"explanation": " ", "fix_details": 5}'), None, "ai_empty_response"),
    (200, None, reply('{"explanation": "E", "fix_details": 5}'), None, "ai_model_request_failed"),
    (200, None, reply('{"explanation": "old", "fix_details": "f", "explanation": "E"}'), "E", ""),
    (200, None, None, None, "ai_empty_response"),
    (429, None, None, None, "ai_rate_limited"),
    (401, None, None, None, "ai_invalid_key"),
    (500, None, reply(GOOD), None, "ai_model_request_failed"),
    (None, "missing_key", None, None, "ai_missing_api_key"),
    (None, "timeout", None, None, "ai_timeout"),
])
def test_responses(spark, status, error, body, explanation, code):
    row = E.parse_responses(spark.createDataFrame(
        [("k", status, error, body)], "cache_key string, status int, error_class string, body string")).first()
    texts = {t[0]: t for t in K.FALLBACKS.values()}
    assert row.error_code == code
    assert row.explanation == (explanation if explanation else texts[code][1])
    if code:
        assert (row.attack_scenario, row.fix_details) == texts[code][2:]


@pytest.mark.parametrize("text, expected", [
    ("1. Remove it.\n2. Store it.", "1. Remove it.\n2. Store it."),
    ("1. Remove it. 2. Store it. 3. Read it. 4. Done.", "1. Remove it.\n2. Store it.\n3. Read it.\n4. Done."),
    ("Version 2.0 fixed item 3.14 billion issues. 2. Second item.",
     "Version 2.0 fixed item 3.14 billion issues.\n2. Second item."),
    ("1. First item.    2. Second item.   3. Third item.", "1. First item.\n2. Second item.\n3. Third item."),
    ("Costs 5. 2. x", "Costs 5. 2. x"),
    ("", ""), (None, None),
])
def test_normalize_lists(spark, text, expected):
    assert one(spark, E.normalize_list, text) == expected


def test_fallback_texts(spark):
    assert one(spark, E.is_fallback_text, "AI is UNAVAILABLE now") is True
    assert one(spark, E.is_fallback_text, "Use the recommendation shown with it") is True
    assert one(spark, lambda c: E.has_real_content(c, F.lit(" "), F.lit(None).cast("string")), "not available") is False
    assert one(spark, lambda c: E.has_real_content(c, F.lit("real")), "not available") is True


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_lookup_join_with_a_hot_key(spark, hot_rows):
    rows = [("hot" if i % 3 else f"k{i % 17}", i) for i in range(900)]
    large = spark.createDataFrame(rows, "key string, id int")
    lookup = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("unused", "u")], "key string, text string")
    got = {(r.key, r.id, r.text) for r in lookup_join(large, lookup, "key", "id", hot_rows, 4).collect()}
    texts = {"hot": "H", "k1": "one"}
    assert got == {(k, i, texts.get(k)) for k, i in rows}


def test_explained_findings(spark):
    table = findings(spark, ("A", "high", "a.js", 2, "e"), ("A", "high", "b.js", 1, "e"), ("B", "low", "a.js", 1, "f"))
    cache = E.explanation_queue(table).filter("rule_id = 'A'").select("cache_key", F.lit("because").alias("explanation"))
    got = {(r.report_key, r.explanation) for r in E.explained_findings(table, cache, hot_rows=1, salts=3).collect()}
    assert got == {("A:a.js:2:1", "because"), ("A:b.js:1:0", "because"), ("B:a.js:1:0", None)}


def test_evidence_limit_is_a_parameter(spark):
    table = findings(spark, ("X", "high", "a.js", 1, "z" * 700))
    lengths = [len(E.explanation_queue(table, n).first().redacted_evidence) for n in (500, 600, None)]
    assert len(E.explanation_queue(table).first().redacted_evidence) == lengths[0]
    assert lengths[0] < lengths[1] < lengths[2] == 700
