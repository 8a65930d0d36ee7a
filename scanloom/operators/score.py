"""Repeat multipliers, penalties and the per-repository risk summary.

Penalties are exact integers in units of 1/10000 point (weight x percent x
percent), so sums do not depend on the order rows arrive in.

A finding's repeat multiplier depends on how many findings of the same rule, severity
and category precede it in its repository. The multipliers stop changing after
the third, and a rule's second repeat already has the smallest one of all. So only
the first three findings of each (rule, severity, category) can matter: they
are found lane by lane, then ranked per repository, where few are left. All
others take the final multiplier without ever meeting in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import constants as K
from scanloom.functions import paths as P
from scanloom.operators import findings as N

UNITS = 10_000  # penalty units per point
CONTEXT_PCT = (100, 50, 30, 25, 20, 15)  # every factor with_penalties gives
DEPTH = max(len(K.RULE_REPEAT_PCT), len(K.SEVERITY_REPEAT_PCT), len(K.CATEGORY_REPEAT_PCT)) - 1
LAST_REPEAT_PCT = min(K.RULE_REPEAT_PCT[-1], K.SEVERITY_REPEAT_PCT[-1], K.CATEGORY_REPEAT_PCT[-1])

# What a finding counts by, apart from its place among the others.
TRAITS = {"rule_id": "string", "severity": "string", "category": "string", "file_context": "string",
          "bucket": "string", "critical_bucket": "string", "is_example": "boolean", "score_cap": "int",
          "context_pct": "int"}


def _pct(earlier: Column, table) -> Column:
    out = F.lit(table[-1])
    for count in range(len(table) - 2, -1, -1):
        out = F.when(earlier == count, table[count]).otherwise(out)
    return out


def repeat_multipliers(findings: DataFrame, order=N.SORT_KEY, lanes: int = N.LANES) -> DataFrame:
    """Add ``rule_pct``, ``severity_pct``, ``category_pct`` and their least,
    ``repeat_pct``. ``order`` must order the findings of a repository totally.

    The shared ranking lane of a repository holds at most lanes x 3 rows per rule,
    severity and category, however large the repository is."""
    keys = [F.col(c) for c in order]
    nth = F.row_number().over(
        Window.partitionBy("repo_id", "lane", "rule_id", "severity", "category").orderBy(*keys)
    )
    spread = (
        findings.withColumn("lane", N.lane_of(F.col("file"), lanes))
        .withColumn("nth", nth)
        # lane -1 gathers what may still rank among the first; the rest stays spread
        .withColumn("rank_lane", F.when(F.col("nth") <= DEPTH, -1).otherwise(F.col("lane")))
        .repartition("repo_id", "rank_lane")
    )

    def pct(column: str, table) -> Column:
        earlier = F.row_number().over(
            Window.partitionBy("repo_id", "rank_lane", column).orderBy(*keys)
        ) - 1
        return F.when(F.col("rank_lane") == -1, _pct(earlier, table)).otherwise(table[-1])

    return (
        spread
        .withColumns({
            "rule_pct": pct("rule_id", K.RULE_REPEAT_PCT),
            "severity_pct": pct("severity", K.SEVERITY_REPEAT_PCT),
            "category_pct": pct("category", K.CATEGORY_REPEAT_PCT),
        })
        .withColumn("repeat_pct", F.least("rule_pct", "severity_pct", "category_pct"))
        .drop("lane", "nth", "rank_lane")
    )


def _first_true(cases, otherwise) -> Column:
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def with_traits(findings: DataFrame) -> DataFrame:
    """Add context percentage, cap, and the two buckets a finding counts in (penalty
    breakdown, critical counts). Row by row."""
    file, context = F.col("file"), F.col("file_context")
    env = F.col("is_env")
    context_pct = _first_true(
        [
            (env, 100),
            (context == K.EXAMPLE_TEMPLATE,
             F.when(P.is_documentation_path(file), 15).otherwise(30)),
            (context == K.TEST_DEMO, F.when(P.is_demo_fixture_path(file), 25).otherwise(50)),
            (context == K.GENERATED, 20),
        ],
        100,
    )
    bucket = _first_true(
        [
            (env, "env_config"),
            (context == K.TEST_DEMO, "test_demo"),
            (context.isin(K.EXAMPLE_TEMPLATE, K.GENERATED), "documentation_template"),
        ],
        "production",
    )
    critical_bucket = _first_true(
        [
            (context == K.GENERATED, "generated_dependency"),
            (env, "env_config"),
            (context == K.PRODUCTION, "production"),
            (context == K.TEST_DEMO, "test_demo"),
        ],
        "docs_template",
    )
    return (
        findings.withColumn("is_env", N.is_env_or_config(file, F.col("rule_id")))
        .withColumns({
            "context_pct": context_pct, "bucket": bucket, "critical_bucket": critical_bucket,
            "is_example": N.is_example_finding(file, F.col("rule_id"), context),
            "score_cap": _score_cap(),
        })
    )


def with_units(findings: DataFrame) -> DataFrame:
    """Add ``penalty_units`` and ``score_penalty`` to findings with traits and multipliers."""
    weight = _first_true(
        [(F.col("severity") == s, w) for s, w in K.SEVERITY_WEIGHTS.items()], F.lit(None)
    )
    return findings.withColumn(
        "penalty_units",
        (weight * F.col("repeat_pct") * F.col("context_pct")).cast("bigint"),
    ).withColumn("score_penalty", _shown_penalty(weight))


def with_penalties(findings: DataFrame, order=N.SORT_KEY, lanes: int = N.LANES) -> DataFrame:
    """Add multipliers, traits and penalties."""
    return with_units(with_traits(repeat_multipliers(findings, order, lanes)))


def _shown_penalties() -> dict[int, float]:
    """Displayed penalty of every (weight, repeat, context) combination. Displayed values
    are rounded from binary floats, which decimals cannot tell: 1.275 is shown as 1.27."""
    repeats = {*K.RULE_REPEAT_PCT, *K.SEVERITY_REPEAT_PCT, *K.CATEGORY_REPEAT_PCT}
    return {
        _combination(weight, repeat, context): round(weight * (repeat / 100) * (context / 100), 2)
        for weight in K.SEVERITY_WEIGHTS.values() for repeat in repeats
        for context in CONTEXT_PCT
    }


def _combination(weight, repeat, context):
    return weight * 1_000_000 + repeat * 1_000 + context


def _shown_penalty(weight: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(_shown_penalties())), "map<string,double>")
    code = _combination(weight, F.col("repeat_pct"), F.col("context_pct"))
    return table[code.cast("string")]


def _score_cap() -> Column:
    """The best score a repository with this finding can have."""
    rule, severity = F.upper("rule_id"), F.col("severity")
    return _first_true(
        [
            (F.col("is_env") & (F.col("rule_id") == "CONFIG_ENV_FILE"), 85),
            (F.col("is_env") & severity.isin(K.HIGH, K.CRITICAL), 80),
            (F.col("file_context") != K.PRODUCTION, 100),
            (rule.isin("JS_EVAL", "PY_EVAL", "PY_SUBPROCESS_SHELL"), 80),
            (rule == "JS_LOCALSTORAGE_TOKEN", 85),
            (severity == K.HIGH, 85),
            (severity == K.CRITICAL, 75),
        ],
        100,
    )


def _points(units: Column, digits: int) -> Column:
    """Units to points, rounded half to even."""
    return F.bround(units.cast("decimal(18,0)") / F.lit(UNITS).cast("decimal(5,0)"), digits)


# -- per-repository measures ---------------------------------------------------
def _measure_table() -> dict[str, tuple[str, str]]:
    """name -> (SQL value per finding, aggregate). Every aggregate can be applied again
    to its own results, so partial groups may be merged in any number of steps."""
    critical = f"severity = '{K.CRITICAL}'"
    real = f"{critical} AND NOT is_example"

    def count(condition: str) -> tuple[str, str]:
        return f"if({condition}, 1L, 0L)", "sum"

    def units(condition: str) -> tuple[str, str]:
        return f"if({condition}, penalty_units, 0L)", "sum"

    def mentions(keywords) -> str:
        return f"upper(rule_id) RLIKE '{'|'.join(keywords)}'"

    out = {"total": ("1L", "sum")}
    out |= {name: count(f"severity = '{name}'") for name in K.SEVERITIES}
    for bucket in ("production", "env_config", "test_demo", "documentation_template"):
        out[f"{bucket}_units"] = units(f"bucket = '{bucket}'")
    for bucket in ("production", "env_config", "test_demo", "docs_template",
                   "generated_dependency"):
        out[f"{bucket}_critical"] = count(f"{critical} AND critical_bucket = '{bucket}'")
    out |= {
        "low_units": units(f"severity = '{K.LOW}'"),
        "other_units": units(f"severity <> '{K.LOW}'"),
        "exposed_high": count(
            f"severity = '{K.HIGH}' AND bucket IN ('production', 'env_config')"),
        "confirmed_critical": count(f"{real} AND file_context = '{K.PRODUCTION}'"),
        "ceiling": ("score_cap", "min"),
        "least_repeat_pct": ("repeat_pct", "min"),
        "real_critical": count(real),
        # two categories or more: the least is not the greatest, whatever categories there are
        "real_critical_from": (f"if({real}, category, NULL)", "min"),
        "real_critical_to": (f"if({real}, category, NULL)", "max"),
        "catastrophic_rules": count(f"{real} AND {mentions(K.CATASTROPHIC_KEYWORDS)}"),
        "code_execution_rules": count(f"{real} AND {mentions(K.CODE_EXECUTION_KEYWORDS)}"),
        "top_sev_rank": (
            " ".join(["CASE severity", *(f"WHEN '{s}' THEN {i}"
                                         for i, s in enumerate(K.SEVERITIES)), "END"]), "min"),
    }
    return out


_MEASURES = _measure_table()


def merged_measures() -> list[Column]:
    """The aggregates that turn per-finding values, or rows of ``measures``, into
    measures of a coarser group."""
    return [F.expr(f"{agg}({name}) AS {name}") for name, (_, agg) in _MEASURES.items()]


def measures(penalized: DataFrame, by=("repo_id",), extra=(), times: str | None = None) -> DataFrame:
    """Additive measures per group; the first step combines before the shuffle. ``times`` names a
    column that says how many findings a row stands for."""
    values = [f"({sql}) * {times} AS {name}" if times and agg == "sum" else f"{sql} AS {name}"
              for name, (sql, agg) in _MEASURES.items()]
    return penalized.selectExpr(*by, *extra, *values).groupBy(*by).agg(
        *merged_measures(), *(F.min(column).alias(column) for column in extra)
    )


# -- from measures to score ----------------------------------------------------
def with_score(measured: DataFrame) -> DataFrame:
    """Deduction, score, label and message from the measures of a repository."""
    c = F.col
    cap = F.lit(K.LOW_DEDUCTION_CAP * UNITS)
    catastrophic = (
        ((c("real_critical") >= 4) & (c("real_critical_from") < c("real_critical_to")))
        | (c("catastrophic_rules") > 0)
        | (c("code_execution_rules") >= 2)
    )
    by_highs = F.when(c("exposed_high") >= 4, 65).when(c("exposed_high") >= 2, 75).otherwise(100)
    deducted = c("other_units") + F.least(c("low_units"), cap)
    extra = F.when(c("catastrophic") & (deducted >= 60 * UNITS), 30 * UNITS).otherwise(0)
    raw_score = _points(F.lit(100 * UNITS) - c("deduction_units"), 0).cast("int")
    # floors, in this order
    floors = (
        (~c("catastrophic"), 10),
        (c("exposed_critical") < 3, 20),
        (c("critical") - c("confirmed_critical") > c("confirmed_critical"), 40),
        ((c("exposed_critical") == 0) & (c("production_units") + c("env_config_units") == 0), 50),
    )
    score = F.least(F.greatest(raw_score, F.lit(0)), c("score_ceiling"))
    for condition, floor in floors:
        # a floor lifts a lower score and leaves a higher one, as greatest() does
        score = F.greatest(score, F.when(condition, floor))
    return (
        measured
        .withColumns({
            "exposed_critical": c("production_critical") + c("env_config_critical"),
            "catastrophic": catastrophic,
            "score_ceiling": F.least(c("ceiling"), by_highs),
            "duplicate_caps_applied": (c("least_repeat_pct") < 100) | (c("low_units") > cap),
        })
        .withColumn("deduction_units", deducted + extra)
        .withColumn("score", score)
        .withColumn("risk_label", risk_label())
        .withColumn("warning_message", warning_message())
    )


def score_label(score: Column) -> Column:
    """Label by score alone."""
    return _first_true(
        [(score >= 90, K.HEALTHY), (score >= 71, K.LOW_RISK), (score >= 46, K.MODERATE_RISK),
         (score >= 21, K.HIGH_RISK)],
        K.CRITICAL_RISK,
    )


def risk_label() -> Column:
    base = F.when(F.col("total") == 0, K.HEALTHY).otherwise(score_label(F.col("score")))
    return _first_true(
        [
            (F.col("exposed_critical") >= 2, K.CRITICAL_RISK),
            ((F.col("exposed_critical") == 1)
             & base.isin(K.HEALTHY, K.LOW_RISK, K.MODERATE_RISK), K.HIGH_RISK),
            ((F.col("exposed_high") > 0) & (base == K.HEALTHY), K.LOW_RISK),
        ],
        base,
    )


def warning_message() -> Column:
    c = F.col
    elsewhere = (c("test_demo_critical") + c("docs_template_critical")
                 + c("generated_dependency_critical"))
    return _first_true(
        [
            (c("total") == 0, K.MSG_CLEAN),
            (c("exposed_critical") >= 2, K.MSG_MANY_CRITICAL),
            (c("exposed_critical") == 1, K.MSG_ONE_CRITICAL),
            (elsewhere > 0, K.MSG_NON_PRODUCTION),
            ((c("test_demo_units") > c("production_units") + c("env_config_units"))
             & (c("test_demo_units") > 0), K.MSG_TEST_DEMO),
            (c("risk_label").isin(K.HIGH_RISK, K.CRITICAL_RISK), K.MSG_HIGH_RISK),
        ],
        K.MSG_DEFAULT,
    )


def display_points(units: Column) -> Column:
    """Whole points for display: any fraction rounds up."""
    return F.ceil(units.cast("decimal(18,0)") / F.lit(UNITS).cast("decimal(5,0)")).cast("int")


# absent where there is nothing to compare
_MAY_BE_NULL = ("top_sev_rank", "real_critical_from", "real_critical_to")
_NO_FINDINGS = {"ceiling": 100, "least_repeat_pct": 100}


def complete(measured: DataFrame, repos: DataFrame) -> DataFrame:
    """Measures for every repository, those without findings included. ``repos`` holds
    ``repo_id`` once each, and columns to carry along. One row per repository on
    both sides: the join cannot be skewed."""
    joined = repos.join(measured, "repo_id", "left")
    fills = {name: _NO_FINDINGS.get(name, 0) for name in _MEASURES if name not in _MAY_BE_NULL}
    return joined.fillna(fills)


def summarize(penalized: DataFrame, stats: DataFrame) -> DataFrame:
    """The risk summary, one row for each repository in ``stats``."""
    return summary_columns(with_score(complete(measures(penalized), stats)))


def summary_columns(scored: DataFrame) -> DataFrame:
    def n(name: str, source: str | None = None) -> Column:
        return F.col(source or name).cast("int").alias(name)

    return scored.select(
        "repo_id", n("total"), n("critical"), n("high"), n("medium"), n("low"), n("score"),
        "risk_label", "warning_message", n("scanned_files"), n("ignored_files"),
        n("skipped_generated_dependency_files"),
        display_points(F.col("production_units")).alias("production_penalty"),
        display_points(F.col("env_config_units")).alias("real_env_config_penalty"),
        display_points(F.col("test_demo_units")).alias("test_demo_penalty"),
        display_points(F.col("documentation_template_units"))
        .alias("documentation_template_penalty"),
        "duplicate_caps_applied",
        n("production_critical_count", "production_critical"),
        n("env_critical_count", "env_config_critical"),
        n("test_demo_critical_count", "test_demo_critical"),
        n("docs_template_critical_count", "docs_template_critical"),
        n("generated_dependency_critical_count", "generated_dependency_critical"),
    )
