"""Declared schemas of the tables that cross module boundaries."""

from __future__ import annotations

from pyspark.sql import types as T

FILES_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
])

FINDING_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("file_context", T.StringType()),
    T.StructField("original_severity", T.StringType()),
    T.StructField("adjusted_severity_reason", T.StringType()),
    T.StructField("score_penalty", T.DoubleType()),
])

# What detection emits, before context adjustment. `disc_ord` is the position in
# which a rule reports within one line; it breaks ties and picks the survivor
# when a rule reports the same line twice.
RAW_FINDING_COLUMNS = (
    "repo_id", "file", "line", "disc_ord", "rule_id", "title", "severity", "category",
    "evidence", "recommendation", "file_context",
)

SUMMARY_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("total", T.IntegerType()),
    T.StructField("critical", T.IntegerType()),
    T.StructField("high", T.IntegerType()),
    T.StructField("medium", T.IntegerType()),
    T.StructField("low", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("risk_label", T.StringType()),
    T.StructField("warning_message", T.StringType()),
    T.StructField("scanned_files", T.IntegerType()),
    T.StructField("ignored_files", T.IntegerType()),
    T.StructField("skipped_generated_dependency_files", T.IntegerType()),
    T.StructField("production_penalty", T.IntegerType()),
    T.StructField("real_env_config_penalty", T.IntegerType()),
    T.StructField("test_demo_penalty", T.IntegerType()),
    T.StructField("documentation_template_penalty", T.IntegerType()),
    T.StructField("duplicate_caps_applied", T.BooleanType()),
    T.StructField("production_critical_count", T.IntegerType()),
    T.StructField("env_critical_count", T.IntegerType()),
    T.StructField("test_demo_critical_count", T.IntegerType()),
    T.StructField("docs_template_critical_count", T.IntegerType()),
    T.StructField("generated_dependency_critical_count", T.IntegerType()),
])
