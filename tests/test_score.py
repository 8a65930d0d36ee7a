"""Context adjustment, multipliers, score: goldens, brute force, skew."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.operators import findings as N, score as S
from scanloom.plans.scan import nested_by_file, scan
from scanloom.schemas import FINDING_SCHEMA, SUMMARY_SCHEMA
from tests import samples as T

C, H, M, L = "critical", "high", "medium", "low"
COLUMNS = "repo_id string, ord int, rule_id string, severity string, category string, file string, file_context string, line int"


def summary_of(spark, repos):
    """repos: {name: [(severity, category, rule, context, file), ...]} in list order."""
    rows = [(repo, i, rule or f"TEST_{sev.upper()}", sev, cat, file or "test.py", ctx, 1)
            for repo, listed in repos.items()
            for i, (sev, cat, rule, ctx, file) in enumerate(listed)]
    table = spark.createDataFrame(rows, COLUMNS)
    stats = spark.createDataFrame([(r, 1, 0, 0) for r in repos],
                                  "repo_id string, scanned_files int, ignored_files int, "
                                  "skipped_generated_dependency_files int")
    penalized = S.with_penalties(table, order=("ord",))
    return {r.repo_id: r for r in S.summarize(penalized, stats).collect()}


def f(sev, cat=K.SECRETS, rule=None, ctx=K.PRODUCTION, file=None):
    return sev, cat, rule, ctx, file


def test_goldens(spark):
    four = [K.SECRETS, K.DANGEROUS_CODE, K.CONFIG, K.EXPOSURE]
    cases = {
        "G0": ([], 100, "Healthy"),
        "G1": ([f(C), f(H), f(M), f(L)], 62, "High Risk"),
        "G2": ([f(L), f(L)], 98, "Healthy"),
        "G3": ([f(C), f(C), f(C)], 58, "Critical Risk"),
        "G4": ([f(C, K.DANGEROUS_CODE), f(C), f(H, K.EXPOSURE), f(H, K.DANGEROUS_CODE), f(H),
                f(M, K.CORS), f(L, K.EXPOSURE)], 38, "Critical Risk"),
        "G5": ([f(C, cat, f"TEST_PRIVATE_KEY_CRITICAL_{i}") for i, cat in enumerate(four)],
               6, "Critical Risk"),
        "G6": ([f(C, K.SECRETS, "T0", K.TEST_DEMO), f(H, K.EXPOSURE, "T1"), f(H, K.CORS, "T2"),
                f(M, K.CONFIG, "T3")], 63, "Moderate Risk"),
        "G7": ([f(C, K.SECRETS, "T0"), f(H, K.CORS, "T1"), f(M, K.CONFIG, "T2")], 59, "High Risk"),
        "G8": ([f(C, K.DANGEROUS_CODE), f(C, K.SECRETS, "CONFIG_NEXT_PUBLIC_API_KEY", file=".env")],
               58, "Critical Risk"),
        "G9": ([f(H, K.DANGEROUS_CODE, f"TEST_DEMO_HIGH_{i}", K.TEST_DEMO) for i in range(10)],
               74, "Low Risk"),
        "G10": ([f(H, K.DANGEROUS_CODE)], 85, "Low Risk"),
        "G11a": ([f(C)], 75, "High Risk"),
        "G11b": ([f(C, ctx=K.TEST_DEMO)], 88, "Low Risk"),
        "G11c": ([f(C, ctx=K.EXAMPLE_TEMPLATE)], 93, "Healthy"),
        "G12": ([f(M, rule="CONFIG_EXAMPLE_NEXT_PUBLIC_SECRET_LIKE", ctx=K.EXAMPLE_TEMPLATE,
                   file=".env.example")], 98, "Healthy"),
    }
    got = summary_of(spark, {name: listed for name, (listed, _, _) in cases.items()})
    assert {n: (r.score, r.risk_label) for n, r in got.items()} == {
        n: (score, label) for n, (_, score, label) in cases.items()}
    assert got["G0"].warning_message == K.MSG_CLEAN
    assert got["G6"].warning_message == K.MSG_NON_PRODUCTION
    assert (got["G6"].test_demo_critical_count, got["G6"].production_critical_count) == (1, 0)
    assert got["G7"].warning_message == K.MSG_ONE_CRITICAL
    assert got["G8"].warning_message == K.MSG_MANY_CRITICAL
    assert (got["G8"].production_critical_count, got["G8"].env_critical_count) == (1, 1)
    assert got["G9"].warning_message == K.MSG_TEST_DEMO
    assert (got["G4"].critical, got["G4"].high, got["G4"].total) == (2, 3, 7)


def test_end_to_end_goldens(spark, files):
    table = files(repos={
        "E1": [(".env", "NEXT_PUBLIC_GEMINI_API_KEY=secret123\n"),
               (".env.example", "NEXT_PUBLIC_GEMINI_API_KEY=YOUR_KEY_HERE\n"),
               ("app.js", "function run(u, t) {\n  eval(u);\n  localStorage.setItem(\"jwt\", t);\n}\n"),
               ("config.py", 'import subprocess\nOPENAI_API_KEY = "YOUR_API_KEY_HERE"\n'
                             f'subprocess.run("ls", shell=True)\nkey = "{T.STRIPE_TEST}abc"\n')],
        "E2": [(".env", f"OPENAI_API_KEY={T.OPENAI}\n"),
               ("app.py", f'import subprocess\ntoken = "{T.GITHUB}"\ndef run(u):\n    eval(u)\n'
                          "    subprocess.run(u, shell=True)\n")],
        "clean": [("utils.py", "def add(a, b):\n    return a + b\n"), ("lib.js", "export const a = 1;\n")],
        "fixtures": [("src/app.py", "def add(a, b):\n    return a + b\n"),
                     ("BadRepo/fixtures/bad.py", "def run(u):\n    eval(u)\n    exec(u)\n"),
                     ("README.md", 'API_KEY = "secret123"\n'),
                     (".env.example", "GEMINI_API_KEY=YOUR_KEY_HERE\n"),
                     ("tests/test_config.py", 'JWT_SECRET = "dummy"\n')],
    })
    result = scan(table)
    assert result.findings.schema.fieldNames() == FINDING_SCHEMA.fieldNames()
    assert result.summary.dtypes == [(x.name, x.dataType.simpleString()) for x in SUMMARY_SCHEMA]
    got = {r.repo_id: r for r in result.summary.collect()}
    assert (got["E1"].score, got["E1"].risk_label) == (60, "Moderate Risk")
    assert (got["E2"].score, got["E2"].risk_label) == (21, "Critical Risk")
    assert (got["clean"].score, got["clean"].total, got["clean"].scanned_files) == (100, 0, 2)
    assert got["fixtures"].score >= 50 and got["fixtures"].test_demo_penalty > 0
    assert got["fixtures"].documentation_template_penalty > 0
    order = [(r.file, r.rule_id, r.score_penalty) for r in result.scored
             .filter("repo_id = 'E1'").orderBy(*N.SORT_KEY).collect()]
    assert order == [
        (".env", "CONFIG_ENV_FILE", 11.0), (".env", "CONFIG_NEXT_PUBLIC_API_KEY", 8.25),
        ("app.js", "JS_EVAL", 6.05), ("app.js", "JS_LOCALSTORAGE_TOKEN", 3.85),
        ("config.py", "PY_SUBPROCESS_SHELL", 3.85), ("config.py", "SECRETS_VALUE_OPENAI_VALUE", 6.0),
        (".env.example", "CONFIG_EXAMPLE_NEXT_PUBLIC_PLACEHOLDER",
         round(1 * 0.65 * 0.3, 2)),
        ("config.py", "SECRETS_OPENAI_API_KEY", 0.75)]
    nested = {(r.repo_id, r.file): [x.rule_id for x in r.findings]
              for r in nested_by_file(result).collect()}
    assert nested["E1", "app.js"] == ["JS_EVAL", "JS_LOCALSTORAGE_TOKEN"]
    stored = result.stored()
    assert sorted(map(tuple, stored.summary.collect())) == sorted(map(tuple, got.values()))


@pytest.mark.parametrize("context, file, rule, severity, expected, reason", [
    (K.PRODUCTION, "a.py", "PY_EXEC", C, C, K.REASON_PRODUCTION),
    (K.PRODUCTION, ".env", "CONFIG_ENV_FILE", H, H, K.REASON_ENV),
    (K.PRODUCTION, "fixtures/.env", "CONFIG_ENV_FILE", H, H, K.REASON_PRODUCTION),
    (K.TEST_DEMO, "tests/a.py", "PY_EXEC", C, H, "test/demo context downgraded severity by 1 level(s)"),
    (K.TEST_DEMO, "demo/a.py", "PY_EXEC", C, M, "test/demo context downgraded severity by 2 level(s)"),
    (K.TEST_DEMO, "tests/a.py", "SECRETS_VALUE_GITHUB_TOKEN", C, C,
     "test/demo context downgraded severity by 0 level(s)"),
    (K.TEST_DEMO, "demo/a.py", "SECRETS_PRIVATE_KEY", C, H,
     "test/demo context downgraded severity by 1 level(s)"),
    (K.EXAMPLE_TEMPLATE, "examples/a.py", "SECRETS_VALUE_AWS_ACCESS_KEY", C, H, K.REASON_EXAMPLE_SECRET),
    (K.EXAMPLE_TEMPLATE, "docs/a.py", "PY_EXEC", C, L, K.REASON_DOCUMENTATION),
    (K.EXAMPLE_TEMPLATE, "examples/a.py", "PY_EXEC", C, M, K.REASON_EXAMPLE),
    (K.EXAMPLE_TEMPLATE, "examples/a.py", "PY_EVAL", M, L, K.REASON_EXAMPLE),
])
def test_context_adjustment(spark, context, file, rule, severity, expected, reason):
    row = N.adjust_for_context(spark.createDataFrame(
        [(rule, severity, file, context)],
        "rule_id string, severity string, file string, file_context string")).first()
    assert (row.severity, row.original_severity, row.adjusted_severity_reason) == (
        expected, severity, reason)


def test_generated_files_are_dropped(spark):
    assert N.adjust_for_context(spark.createDataFrame(
        [("PY_EVAL", H, "dist/a.py", K.GENERATED)],
        "rule_id string, severity string, file string, file_context string")).count() == 0


# -- brute force ---------------------------------------------------------------
def random_findings(seed, n, hot_share):
    rng = random.Random(seed)
    rules = [("PY_EXEC", K.DANGEROUS_CODE), ("JS_EVAL", K.DANGEROUS_CODE), ("SECRETS_API_KEY", K.SECRETS),
             ("CONFIG_ENV_FILE", K.EXPOSURE), ("CONFIG_CORS_WILDCARD", K.CORS),
             ("SECRETS_PRIVATE_KEY", K.SECRETS), ("X", K.CONFIG)]
    contexts = [(K.PRODUCTION, "src/f{}.py"), (K.TEST_DEMO, "tests/f{}.py"), (K.TEST_DEMO, "demo/f{}.py"),
                (K.EXAMPLE_TEMPLATE, "docs/f{}.md"), (K.EXAMPLE_TEMPLATE, "examples/f{}.py"),
                (K.PRODUCTION, "s{}/.env")]
    rows = []
    for i in range(n):
        repo = "hot" if rng.random() < hot_share else f"r{rng.randrange(12)}"
        rule, category = rng.choice(rules)
        context, path = rng.choice(contexts)
        rows.append((repo, i, rule, rng.choice([C, H, M, L]), category,
                     path.format(rng.randrange(n)), context, rng.randrange(50)))
    return rows


def brute_multipliers(rows):
    seen, out = {}, {}
    for repo, i, rule, sev, cat, *_ in sorted(rows, key=lambda r: r[1]):
        pct = 100
        for key, table in ((("rule", repo, rule), K.RULE_REPEAT_PCT),
                           (("sev", repo, sev), K.SEVERITY_REPEAT_PCT),
                           (("cat", repo, cat), K.CATEGORY_REPEAT_PCT)):
            earlier = seen.get(key, 0)
            seen[key] = earlier + 1
            value = table[min(earlier, len(table) - 1)]
            out.setdefault(i, []).append(value)
            pct = min(pct, value)
        out[i].append(pct)
    return out


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_multipliers_match_brute_force(spark, lanes):
    rows = random_findings(lanes, 3000, 0.4)
    got = S.repeat_multipliers(spark.createDataFrame(rows, COLUMNS), order=("ord",), lanes=lanes)
    assert {r.ord: [r.rule_pct, r.severity_pct, r.category_pct, r.repeat_pct]
            for r in got.collect()} == brute_multipliers(rows)


def test_hot_repository_is_spread(spark):
    """A repository with most findings must not end up in one partition."""
    rows = random_findings(1, 20_000, 0.9)
    table = spark.createDataFrame(rows, COLUMNS).repartition(4)
    ranked = S.repeat_multipliers(table, order=("ord",), lanes=64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000


def test_input_order_and_partitions_do_not_matter(spark):
    rows = random_findings(5, 2000, 0.3)
    stats = spark.createDataFrame([(r, 1, 0, 0) for r in {x[0] for x in rows}],
                                  "repo_id string, scanned_files int, ignored_files int, "
                                  "skipped_generated_dependency_files int")
    results = []
    for seed, parts in ((0, 1), (1, 7)):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        table = spark.createDataFrame(shuffled, COLUMNS).repartition(parts)
        results.append(sorted(map(tuple, S.summarize(
            S.with_penalties(table, order=("ord",)), stats).collect())))
    assert results[0] == results[1]
    for row in results[0]:
        assert 0 <= row[6] <= 100


def test_display_rounding(spark):
    units = spark.createDataFrame([(u,) for u in (0, 1, 9_999, 10_000, 10_001, 15_000, 985_000)], "u bigint")
    shown = [tuple(r) for r in units.select(
        S.display_points(F.col("u")), S._points(F.col("u"), 0).cast("int")).collect()]
    assert [s for s, _ in shown] == [0, 1, 1, 1, 2, 2, 99]
    assert [int(Decimal(u).scaleb(-4).quantize(Decimal(1), ROUND_HALF_EVEN))
            for u in (0, 1, 9_999, 10_000, 10_001, 15_000, 985_000)] == [s for _, s in shown]


def test_shown_penalties():
    table = S._shown_penalties()
    assert len(table) == 216
    assert table[6_000_000 + 85_000 + 25] == round(6 * 0.85 * 0.25, 2) == 1.27
    decimals = {code: float((Decimal(code // 1_000_000) * (code // 1000 % 1000) * (code % 1000) / 10_000)
                            .quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for code in table}
    off = [code for code in table if table[code] != decimals[code]]
    assert len(off) == 18 and all(abs(table[c] - decimals[c]) < 0.011 for c in off)


def test_dedup_survives_copied_files(spark, files):
    from scanloom.operators.detect import detect
    table = files(("a.py", "eval(x)\nexec(y)\n"), ("b.py", "eval(x)\n"))
    copies = table.crossJoin(spark.range(50)).drop("id")
    assert N.dedup(detect(copies)).count() == 3


def test_invariants_on_the_corpus(spark):
    from scanloom.sources.corpus import read_corpus
    result = scan(read_corpus(spark, "/root/testdata/sf0.001")).stored()
    findings = result.findings
    assert findings.count() == findings.select("repo_id", "rule_id", "file", "line").distinct().count()
    totals = {r.repo_id: r["count"] for r in findings.groupBy("repo_id").count().collect()}
    for row in result.summary.collect():
        assert 0 <= row.score <= 100
        assert row.total == totals.get(row.repo_id, 0)
        assert row.total == row.critical + row.high + row.medium + row.low
        exposed = row.production_critical_count + row.env_critical_count
        assert exposed < 2 or row.risk_label == "Critical Risk"
        assert row.total or (row.score, row.risk_label) == (100, "Healthy")
