"""Rules of one scan, memo of contents, response per repository, rollup."""

import pytest
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.operators import detect as D, memo as H, report as P, rules as R, score as S
from scanloom.plans.scan import by_repository, scan
from scanloom.plans.workspace import new_dir


def rule(id_="MY_RULE", pattern="foo", scanners=("javascript",), category="my-own", severity=K.CRITICAL, **kw):
    return R.Rule(id_, "Title", severity, category, scanners, pattern, "Fix.", **kw)


def test_catalogs_do_not_meet(spark, files):
    table = files(("a.js", "foo\nbar\neval(x)\n"))
    one, two = R.Catalog().with_rule(rule()), R.Catalog().with_rule(rule("OTHER", "bar"))

    def ids(catalog):
        return sorted(r.rule_id for r in D.detect(table, catalog=catalog).collect())

    first, second = D.detect(table, catalog=one), D.detect(table, catalog=two)  # planned side by side
    assert sorted(r.rule_id for r in first.collect()) == ["JS_EVAL", "MY_RULE"]
    assert sorted(r.rule_id for r in second.collect()) == ["JS_EVAL", "OTHER"]
    assert ids(one.with_rule(rule("OTHER", "bar"))) == ["JS_EVAL", "MY_RULE", "OTHER"]
    assert ids(None) == ["JS_EVAL"] and one.rules == (rule(),)


@pytest.mark.parametrize("bad", [
    dict(id_="JS_EVAL"), dict(id_="no good"), dict(scanners=("cobol",)), dict(scanners=()), dict(severity="worst"),
    dict(category=""), dict(category="A B"), dict(pattern="(")])
def test_bad_rules_are_refused(bad):
    with pytest.raises(Exception):
        R.Catalog().with_rule(rule(**bad))
    with pytest.raises(ValueError):
        R.Catalog().with_rule(rule(), rule())


def test_new_categories_make_a_catastrophe(spark, files):
    table = files(("a.js", "foo\nfoo\nbar\nbar\n"))
    one = R.Catalog().with_rule(rule("A", "foo"), rule("B", "bar"))
    two = R.Catalog().with_rule(rule("A", "foo"), rule("B", "bar", category="another"))

    def catastrophic(catalog):
        result = scan(table, catalog=catalog)
        return S.with_score(S.complete(S.measures(result.scored), result.stats)).first().catastrophic

    assert not catastrophic(one) and catastrophic(two)
    assert scan(table, catalog=two).summary.first().critical == 4


def test_scanner_of_one_scan(spark, files):
    def empty_files(routed):
        return routed.filter(F.col("content") == "").select(
            "repo_id", "file", F.lit(1).alias("line"), F.lit(0).alias("disc_ord"), F.lit("EMPTY").alias("rule_id"),
            F.lit("Empty").alias("title"), F.lit(K.LOW).alias("severity"), F.lit("size").alias("category"),
            F.lit("").alias("evidence"), F.lit("Fill it.").alias("recommendation"), "file_context")

    table = files(("a.js", ""), ("b.js", "x"))
    result = scan(table, catalog=R.Catalog().with_scanner(empty_files))
    assert [(r.file, r.rule_id) for r in result.findings.collect()] == [("a.js", "EMPTY")]


def test_memo_from_scan_to_scan(spark, files):
    memo = H.ContentMemo(new_dir(spark, "memo"), every=2)
    js, py = ("a.js", "eval(x)\n"), ("b.py", "exec(x)\n")

    def step(number, *entries, catalog=None, repos=None):
        table = files(*entries, repos=repos)
        result = memo.scan(table, number, catalog)
        want = sorted(map(tuple, D.detect(table, catalog=catalog).collect()))
        assert sorted(map(tuple, result.findings.select(*D.detect(table).columns).collect())) == want
        return sorted(r.ext_scanner for r in result.scanned.collect())

    assert step(0, js, py, ("c.md", "nothing")) == ["", "javascript", "python"]
    assert step(1, js, py) == []
    # moved, renamed and copied: known; as another kind of file: not
    assert step(2, repos={"s": [("x/y.js", js[1]), ("z.js", js[1])], "t": [("b.js", py[1])]}) == ["javascript"]
    # a rule for Python changes: only Python files are scanned again
    new = R.Catalog().with_rule(rule(scanners=("python",), pattern="exec"))
    assert step(3, js, py, catalog=new) == ["python"]
    assert step(4, js, py, catalog=new) == [] and step(5, js, py) == []
    changed = R.Catalog().with_rule(rule(scanners=("secrets",), pattern="x"))
    assert step(6, js, py, catalog=changed) == ["javascript", "python"]
    assert step(6, js, py, catalog=changed) == ["javascript", "python"]  # the same scan again, as after a failure
    with pytest.raises(ValueError):
        memo.scan(files(js), 7, R.Catalog().with_scanner(lambda t: t))


def test_response_in_parts(spark, files):
    table = files(repos={"big": [(f"f{k}.js", "eval(x)\n" * 3) for k in range(7)], "one": [("a.py", "exec(x)\n")],
                         "none": [("a.py", "x = 1\n")]})
    result = scan(table)
    rows = by_repository(result, 4).collect()
    got = {(r.repo_id, r.part): r for r in rows}
    assert set(got) == {("one", 0), ("none", 0)} | {("big", k) for k in range(6)} and len(rows) == 8
    assert {r.n_parts for r in rows if r.repo_id == "big"} == {6} and got["none", 0].n_parts == 1
    assert got["none", 0].findings == [] and got["none", 0].summary.score == 100
    assert all((r.summary is not None) == (r.part == 0) for r in rows)
    order = [(f.file, f.line) for k in range(6) for f in got["big", k].findings]
    assert order == [(f"f{k}.js", n) for k in range(7) for n in (1, 2, 3)]
    assert [len(got["big", k].findings) for k in range(6)] == [4, 4, 4, 4, 4, 1]


def test_rollup_has_one_exchange_more(spark, files):
    scored = scan(files(("a.js", "eval(x)\n"), ("b.py", "exec(x)\n"))).stored().scored
    rolled = P.rollup(scored)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rows = {(r.repo_id, r.category, r.severity, r.level): r.n_findings for r in rolled.collect()}
    assert rows[None, None, None, 3] == 2 and rows["r", None, None, 2] == 2
