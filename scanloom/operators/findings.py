"""From raw findings to final ones: de-duplication, context severity, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import constants as K
from scanloom.functions import paths as P

SORT_KEY = ("sev_rank", "file", "line", "disc_ord")

# Findings of one repository are spread over this many lanes by file, so that a
# repository holding a large share of all findings is not one task.
LANES = 256


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low."""
    rank = F.when(severity == K.SEVERITIES[0], 0)
    for i, name in enumerate(K.SEVERITIES[1:], 1):
        rank = rank.when(severity == name, i)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in K.SEVERITIES)), rank + 1)


def lane_of(file: Column, lanes: int = LANES) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(lanes)).cast("int")


def dedup(findings: DataFrame) -> DataFrame:
    """First discovered finding per repository, file, line and rule.

    The row-number filter lets Spark drop repeats within each task before the
    shuffle, so a file that is listed very often does not make one task large.
    """
    by_line = Window.partitionBy("repo_id", "file", "rule_id", "line").orderBy("disc_ord")
    return (
        findings.withColumn("copy", F.row_number().over(by_line))
        .filter(F.col("copy") == 1)
        .drop("copy")
    )


# -- predicates on findings ----------------------------------------------------
def is_env_or_config(file: Column, rule_id: Column) -> Column:
    """Real env/config finding: carries full weight wherever it is."""
    name = P.filename(file)
    return (
        ~P.is_example_env_name(name)
        & ~P.is_demo_fixture_path(file)
        & (P.is_dot_env(name) | rule_id.rlike("^CONFIG_(?:ENV|NEXT_PUBLIC)_"))
    )


def is_example_finding(file: Column, rule_id: Column, context: Column) -> Column:
    return (
        P.is_example_env_name(P.filename(file))
        | (context == K.EXAMPLE_TEMPLATE)
        | rule_id.startswith("CONFIG_EXAMPLE_")
    )


def is_high_confidence_secret(rule_id: Column) -> Column:
    upper = F.upper(rule_id)
    markers = "|".join(K.HIGH_CONFIDENCE_MARKERS)
    return F.contains(upper, F.lit("PRIVATE_KEY")) | upper.rlike(f"^SECRETS_VALUE_.*(?:{markers})")


# -- context adjustment --------------------------------------------------------
def adjust_for_context(findings: DataFrame) -> DataFrame:
    """Lower severities by file role and drop generated files. Row by row."""
    file, rule, context = F.col("file"), F.col("rule_id"), F.col("file_context")
    return (
        findings.filter(context != K.GENERATED)
        .withColumns({
            "_env": is_env_or_config(file, rule),
            "_strong": is_high_confidence_secret(rule),
            "_demo": P.is_demo_fixture_path(file),
            "_doc": P.is_documentation_path(file),
        })
        .withColumn(
            "_steps",
            F.when(F.col("_env") | (context == K.PRODUCTION), 0)
            .when(
                context == K.TEST_DEMO,
                F.when(F.col("_strong"), 0).otherwise(1) + F.col("_demo").cast("int"),
            )
            .when(F.col("_strong"), 1)
            .when(F.col("_doc"), len(K.SEVERITIES) - 1)
            .otherwise(2),
        )
        .withColumn(
            "adjusted_severity_reason",
            F.when(F.col("_env"), K.REASON_ENV)
            .when(context == K.PRODUCTION, K.REASON_PRODUCTION)
            .when(
                context == K.TEST_DEMO,
                F.replace(
                    F.lit(K.REASON_TEST_DEMO), F.lit("{steps}"), F.col("_steps").cast("string")
                ),
            )
            .when(F.col("_strong"), K.REASON_EXAMPLE_SECRET)
            .when(F.col("_doc"), K.REASON_DOCUMENTATION)
            .otherwise(K.REASON_EXAMPLE),
        )
        .withColumn("original_severity", F.col("severity"))
        .withColumn(
            "sev_rank",
            F.least(severity_rank(F.col("severity")) + F.col("_steps"),
                    F.lit(len(K.SEVERITIES) - 1)),
        )
        .withColumn("severity", severity_name(F.col("sev_rank")))
        .drop("_env", "_strong", "_demo", "_doc", "_steps")
    )


def final_findings(raw: DataFrame) -> DataFrame:
    """Raw findings, adjusted and without repeats. The adjustment depends only on
    file and rule, so it may come first, while rows are still where they were found."""
    return dedup(adjust_for_context(raw))


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Report order within each repository (a distributed range sort)."""
    return findings.orderBy("repo_id", *SORT_KEY)
