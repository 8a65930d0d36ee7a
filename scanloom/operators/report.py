"""Report tables over findings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.operators import findings as N, score as S


def report_keys(findings: DataFrame) -> DataFrame:
    """Position of each finding within its file and the key made from it. A window
    per file: files are limited in size, so its groups are."""
    within_file = Window.partitionBy("repo_id", "file").orderBy(*N.SORT_KEY)
    index = (F.row_number().over(within_file) - 1).cast("int")
    return findings.withColumn("file_index", index).withColumn(
        "report_key", F.concat_ws(":", "rule_id", "file", "line", "file_index")
    )


def findings_by_file(findings: DataFrame) -> DataFrame:
    """One row per file with findings. Ordering by ``first_sev_rank, file`` within a
    repository gives the files in order of first appearance."""
    return findings.groupBy("repo_id", "file").agg(
        F.count("*").alias("n_findings"),
        F.min("sev_rank").alias("first_sev_rank"),
        F.count_if(F.col("sev_rank") == 0).alias("n_critical"),
    )


def _category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", "category").agg(
        F.count("*").alias("n"),
        F.min(F.struct(*N.SORT_KEY)).alias("first_key"),
    )


def top_categories(findings: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` most frequent categories per repository, earlier ones first on ties.
    There are only as many rows to rank as there are categories."""
    rank = F.row_number().over(
        Window.partitionBy("repo_id").orderBy(F.desc("n"), F.col("first_key"))
    )
    return (
        _category_counts(findings)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("repo_id", "rank", F.translate("category", "-", " ").alias("category"), "n")
    )


def executive_summary(penalized: DataFrame, stats: DataFrame) -> DataFrame:
    """Up to four sentences per repository.

    Measures are taken per repository and category, which also gives the category
    ranking, and merged per repository: the findings are read once.
    """
    by_category = S.measures(
        penalized.withColumn("first_key", F.struct(*N.SORT_KEY)),
        by=("repo_id", "category"), extra=("first_key",),
    )
    ranked = F.struct((-F.col("total")).alias("neg"), "first_key", "category")
    per_repo = by_category.groupBy("repo_id").agg(
        *S.merged_measures(),
        # as many entries as there are categories
        F.slice(F.sort_array(F.collect_list(ranked)), 1, 2)["category"].alias("top"),
    )
    scored = S.with_score(S.complete(per_repo, stats.select("repo_id")))
    return scored.select("repo_id", summary_sentences().alias("sentences"))


def summary_sentences() -> Column:
    # fixed texts
    total, top = F.col("total").cast("string"), F.transform("top", _spaced)
    return F.when(
        F.col("total") == 0,
        F.array(
            F.lit("This scan did not detect security warnings in the analyzed source."),
            F.lit("Continue reviewing secrets, environment files, generated dependencies, and "
                  "deployment configuration before release."),
        ),
    ).otherwise(F.array(
        F.concat(F.lit("This scan detected "), total, F.lit(" potential security warning"),
                 F.when(F.col("total") == 1, "").otherwise("s"),
                 F.lit(" across the analyzed project.")),
        F.concat(F.lit("The current security score is "), F.col("score").cast("string"),
                 F.lit(" / 100, classified as "), F.col("risk_label"), F.lit(".")),
        F.concat(F.lit("The most serious findings are "), N.severity_name(F.col("top_sev_rank")),
                 F.lit(" severity and should be reviewed before committing, deploying, or "
                       "sharing this project.")),
        F.concat(F.lit("The most common risk categor"),
                 F.when(F.size(top) == 1, "y is ").otherwise("ies are "),
                 F.array_join(top, ", "), F.lit(".")),
    ))


def _spaced(category: Column) -> Column:
    return F.translate(category, "-", " ")


def critical_context(summary: DataFrame) -> DataFrame:
    """How the critical findings spread over contexts, as shown and as printed."""
    names = ("production", "env", "test_demo", "docs_template", "generated_dependency")
    counts = [F.col(f"{n}_critical_count") for n in names]
    total = sum(counts[1:], counts[0])

    def part(count: Column, label: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f" {label}"))

    # fixed values: the labels of the report
    labels = ("production", "env/config", "test/demo", "docs/templates", "generated/dependencies")
    parts = [part(total, "total"), *(part(c, label) for c, label in zip(counts, labels))]
    shown = [*parts[:-1], F.when(counts[-1] > 0, parts[-1])]  # concat_ws skips nulls
    return summary.select(
        "repo_id",
        F.when(total == 0, "Critical issues: 0 total")
        .otherwise(F.concat(F.lit("Critical issues: "), F.concat_ws(" · ", *shown)))
        .alias("shown_line"),
        F.concat(F.lit("Critical context: "), F.concat_ws(", ", *parts), F.lit("."))
        .alias("printed_line"),
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")


def score_bands(summary: DataFrame) -> DataFrame:
    return summary.select(
        "repo_id", "score", score_band(F.col("score")).alias("band"),
        S.score_label(F.col("score")).alias("score_label"),
    )


def rollup(scored: DataFrame) -> DataFrame:
    """Findings and penalties per repository, category and severity, with subtotals: ``level`` 0 is a
    severity of a category, 1 a category, 2 a repository, 3 everything. All levels are
    merged from partial sums of the same rows, made before the one exchange, so a repository
    that has most of the findings costs no more than the others."""
    level = sum(F.grouping(c).cast("int") for c in ("repo_id", "category", "severity"))
    return scored.rollup("repo_id", "category", "severity").agg(
        level.alias("level"), F.count("*").alias("n_findings"), F.sum("penalty_units").alias("penalty_units"),
        F.min("line").alias("first_line"), F.count_if("is_env").alias("n_env_config"))
