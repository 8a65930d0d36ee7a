"""The explanation work queue: requests, cached answers, responses, fallbacks.

Calling a model is left to whoever consumes the queue; requests leave here with
redacted evidence only, and answers come back as a table keyed by ``cache_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import constants as K
from scanloom.functions import redact as D
from scanloom.functions.text import strip
from scanloom.operators import findings as N, report as P
from scanloom.operators.skew import lookup_join


def with_cache_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "cache_key", D.cache_key(F.col("rule_id"), F.col("evidence"), F.col("severity"))
    )


def prompt(title: Column, severity: Column, redacted: Column) -> Column:
    return F.concat(
        F.lit("A scanner reported the issue below. Explain it to someone new to programming.\n\n"
              "Issue: "), title,
        F.lit("\nSeverity: "), severity,
        F.lit("\nFlagged code: "), redacted,
        F.lit("\n\nSay why it is dangerous, how an attacker could use it, and how to fix it in "
              "numbered steps, each step on a line of its own. Use plain words and do not repeat "
              "the input.\n"
              "Return valid JSON only, with the string keys explanation, attack_scenario and "
              "fix_details.\nKeep each value under 80 words."),
    )


def explanation_queue(findings: DataFrame,
                      evidence_chars: int | None = K.EXPLAIN_EVIDENCE_CHARS) -> DataFrame:
    """One request per distinct cache key, taken from its first finding.

    The row-number filter lets Spark cut each task's rows to one per key before the
    shuffle, so a key shared by a large part of all findings is not hot.
    """
    first = Window.partitionBy("cache_key").orderBy("repo_id", *N.SORT_KEY)
    redacted = D.redact(F.col("evidence"), evidence_chars)
    return (
        with_cache_key(findings)
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") == 1)
        .select("cache_key", "rule_id", "severity", "repo_id", "file", "line",
                redacted.alias("redacted_evidence"),
                prompt(F.col("title"), F.col("severity"), redacted).alias("prompt"))
    )


def queue_misses(queue: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a cached answer. Errors are answers too, so a failed request
    is not repeated at once."""
    return queue.join(cache.select("cache_key"), "cache_key", "left_anti")


def explained_findings(findings: DataFrame, cache: DataFrame, **skew) -> DataFrame:
    """Each finding with its report key and explanation, if there is one yet.
    Many findings may share one key, hence the skew-proof join. Keys are counted
    beforehand, so pass findings from a stored table."""
    keyed = with_cache_key(findings)
    return lookup_join(P.report_keys(keyed), cache, "cache_key", spread_by="report_key",
                       counted=keyed, **skew)


# -- responses -----------------------------------------------------------------
def error_class_of_status(status: Column) -> Column:
    return (
        F.when(status == 429, "rate_limited")
        .when(status.isin(400, 401, 403), "invalid_key")
        .when(~status.between(200, 299), "generic")
    )


def _fallback(error_class: Column, field: int) -> Column:
    known = F.lit(K.FALLBACKS["generic"][field])
    for name, texts in K.FALLBACKS.items():
        known = F.when(error_class == name, texts[field]).otherwise(known)
    return F.when(error_class.isNotNull(), known)


def unfenced(text: Column) -> Column:
    """Response text without a surrounding code fence."""
    bare = strip(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"\A```(?:json)?", ""), r"```\z", "")
    return F.when(bare.startswith("```"), strip(inner)).otherwise(bare)


_JSON_STRING = r'"(?:[^"\\]|\\.)*+"'


def _last_keys(json: Column) -> Column:
    """JSON text in which, of string fields that repeat a key side by side in one flat object,
    only the last is left."""
    repeated = (rf'(?s)({_JSON_STRING})\s*+:\s*+(?:{_JSON_STRING}|[^"{{}}\[\],]++)\s*+,\s*+'
                rf'(?=(?:{_JSON_STRING}\s*+:\s*+(?:{_JSON_STRING}|[^"{{}}\[\],]++)\s*+,\s*+)*+\1\s*+:)')
    return F.when(F.try_parse_json(json).isNull(), F.regexp_replace(json, repeated, "")).otherwise(json)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Raw responses ``(cache_key, status, error_class, body)`` to cache rows.

    ``error_class`` is what the caller met before any HTTP status (missing_key,
    timeout); otherwise status and body decide. Every row yields texts: the model's, or
    the fallback of its error.
    """
    # A body is taken apart as text: variants reject an object that repeats a key, while the
    # last value of a repeated key is the one that counts.
    whole = F.try_parse_json(_last_keys(F.col("body")))
    text = F.try_variant_get(whole, "$.candidates[0].content.parts[0].text", "string")
    answer = F.try_parse_json(_last_keys(unfenced(F.col("_text"))))

    def field(name: str) -> Column:
        value = F.try_variant_get(F.col("_answer"), f"$.{name}", "string")
        kind = F.schema_of_variant(F.variant_get(F.col("_answer"), f"$.{name}", "variant"))
        return F.when(kind == "STRING", value), kind

    def wrong(kind: Column) -> Column:
        return kind.isNotNull() & (kind != "STRING")

    explanation, explanation_kind = field("explanation")
    scenario, scenario_kind = field("attack_scenario")
    fix, fix_kind = field("fix_details")
    not_an_object = F.col("_answer").isNull() | ~F.schema_of_variant(F.col("_answer")).startswith("OBJECT")
    # in the order of the checks: the body itself, its text, then field by field
    body_error = (
        F.when(F.col("body").isNotNull() & whole.isNull(), "generic")
        .when(strip(F.coalesce("_text", F.lit(""))) == "", "empty_response")
        .when(not_an_object | wrong(explanation_kind), "generic")
        .when(strip(F.coalesce(explanation, F.lit(""))) == "", "empty_response")
        .when(wrong(scenario_kind) | wrong(fix_kind), "generic")
    )
    error = F.col("_error")

    def outcome(parsed: Column, place: int) -> Column:
        return F.when(error.isNull(), parsed).otherwise(_fallback(error, place))

    return (
        responses.withColumn("_text", text)
        .withColumn("_answer", answer)
        .withColumn("_error", F.coalesce(
            "error_class", error_class_of_status(F.col("status")), body_error))
        .select(
            "cache_key",
            outcome(strip(explanation), 1).alias("explanation"),
            outcome(F.coalesce(scenario, F.lit("")), 2).alias("attack_scenario"),
            outcome(F.coalesce(fix, F.lit("")), 3).alias("fix_details"),
            F.coalesce(_fallback(error, 0), F.lit("")).alias("error_code"),
        )
    )


# -- explanation text ----------------------------------------------------------
def normalize_list(text: Column) -> Column:
    """Numbered list items that share a line, moved to lines of their own."""
    bare = strip(text)
    return F.when(
        bare.rlike(r"(?<!\d)\.\s+[2-9]\."), F.regexp_replace(bare, r"\.\s+(?=[2-9]\.)", ".\n")
    ).otherwise(bare)


def is_fallback_text(text: Column) -> Column:
    return F.lower(text).rlike("|".join(K.FALLBACK_PHRASES))


def has_real_content(*texts: Column) -> Column:
    """Does any of the texts say something that is no fallback?"""
    out = F.lit(False)
    for text in texts:
        bare = strip(F.coalesce(text, F.lit("")))
        out = out | ((bare != "") & ~is_fallback_text(bare))
    return out
