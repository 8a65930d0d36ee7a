"""Secret redaction and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed patterns, applied in this order
REDACTIONS = (
    (r"(sk-(?:proj-)?)[A-Za-z0-9_-]{8,}", "$1***"),
    (r"(sk_test_)[A-Za-z0-9_-]{3,}", "$1***"),
    (r"(ghp_)[A-Za-z0-9]{8,}", "$1***"),
    (r"(github_pat_)[A-Za-z0-9_]{8,}", "$1***"),
    (r"(AIza)[0-9A-Za-z_-]{8,}", "$1***"),
    (r"\b((?:AKIA|ASIA)[0-9A-Z]{8,})\b", "***"),
    (r"""(=\s*["']?)([^"'\s]{16,})(["']?)""", "$1***$3"),
)

# A text without any of these is returned as it is. Every redaction needs one of
# them, and one pass over a clean text is cheaper than seven; the look-ahead rejects
# most positions of that pass at once.
_MAY_NEED_REDACTION = (
    r"""(?=[=_A-])(?:(?<=sk)[-_]|(?<=ghp)_|(?<=github)_pat_|AIza|AKIA|ASIA"""
    r"""|=\s*["']?[^"'\s]{16})"""
)


def redact(text: Column, max_chars: int | None = None) -> Column:
    """Mask secret-looking values. ``max_chars`` cuts first, as the evidence of a
    finding is cut before it is sent anywhere; without it the whole text is kept."""
    source = text if max_chars is None else F.substring(text, 1, max_chars)
    out = source
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(source.rlike(_MAY_NEED_REDACTION), out).otherwise(source)


def cache_key(rule_id: Column, evidence: Column, severity: Column) -> Column:
    """Stable digest that holds no evidence."""
    return F.sha2(F.concat_ws("|", rule_id, F.sha2(evidence, 256), severity), 256)
