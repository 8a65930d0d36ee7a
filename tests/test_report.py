"""Report tables and scan comparison."""

from pyspark.sql import functions as F

from scanloom.operators import changes as C, detect as D, findings as N, report as P
from scanloom.plans.scan import scan
from tests import samples as S


def trees(files):
    return files(repos={
        "bad": [(".env", "MAIL_PASSWORD=hunter2hunter2\n"), ("b.js", "eval(x)\neval(y)\n"),
                ("a.py", f'exec(x)\nk = "{S.GITHUB}"\n'), ("c.yml", "origin: '*'\n")],
        "one": [("tests/x.py", "eval(z)\n")],
        "clean": [("a.py", "x = 1\n")],
    })


def test_executive_summary_and_context_lines(files):
    result = scan(trees(files))
    text = {r.repo_id: r.sentences for r in P.executive_summary(result.scored, result.stats).collect()}
    summary = {r.repo_id: r for r in result.summary.collect()}
    assert text["clean"][0] == "This scan did not detect security warnings in the analyzed source."
    assert len(text["clean"]) == 2
    assert text["one"][0] == "This scan detected 1 potential security warning across the analyzed project."
    assert text["one"][3] == "The most common risk category is dangerous code."
    assert text["bad"][0].startswith("This scan detected 7 potential security warnings")
    assert text["bad"][1] == (f"The current security score is {summary['bad'].score} / 100, "
                              f"classified as {summary['bad'].risk_label}.")
    assert "are critical severity" in text["bad"][2]
    assert text["bad"][3] == "The most common risk categories are dangerous code, secrets."
    lines = {r.repo_id: r for r in P.critical_context(result.summary).collect()}
    assert lines["clean"].shown_line == "Critical issues: 0 total"
    assert lines["bad"].shown_line == (
        "Critical issues: 2 total · 2 production · 0 env/config · 0 test/demo · 0 docs/templates")
    assert lines["clean"].printed_line == (
        "Critical context: 0 total, 0 production, 0 env/config, 0 test/demo, 0 docs/templates, "
        "0 generated/dependencies.")
    bands = {r.repo_id: (r.band, r.score_label) for r in P.score_bands(result.summary).collect()}
    assert bands["clean"] == ("green", "Healthy")


def test_files_keys_and_categories(files):
    found = scan(trees(files)).scored
    by_file = [(r.file, r.n_findings) for r in P.findings_by_file(found).filter("repo_id = 'bad'")
               .orderBy("first_sev_rank", "file").collect()]
    assert by_file == [("a.py", 2), (".env", 2), ("b.js", 2), ("c.yml", 1)]
    keys = {r.report_key for r in P.report_keys(found).filter("file = 'b.js'").collect()}
    assert keys == {"JS_EVAL:b.js:1:0", "JS_EVAL:b.js:2:1"}
    top = {(r.repo_id, r["rank"], r.category, r.n) for r in P.top_categories(found).collect()}
    assert top == {("bad", 1, "dangerous code", 3), ("bad", 2, "secrets", 2), ("one", 1, "dangerous code", 1)}


def test_changes_between_scans(files):
    before = files(("a.js", "eval(x)\n"), ("b.js", "eval(x)\n"), ("c.js", "x\n"))
    after = files(("a.js", "eval(x)\n"), ("b.js", "ok\n"), ("d.js", "\neval(x)\n"))
    changed = C.changed_files(after, C.manifest(before))
    assert {r.path for r in changed.collect()} == {"b.js", "d.js"}
    assert {r.path for r in C.removed_files(after, C.manifest(before)).collect()} == {"c.js"}

    def found(table):
        return N.final_findings(D.detect(table))

    diff = {(r.file, r.line, r.status) for r in C.scan_diff(found(before), found(after)).collect()}
    assert diff == {("b.js", 1, "fixed"), ("d.js", 2, "new")}
    lowered = found(before).withColumn("severity", F.lit("low"))
    assert {r.status for r in C.scan_diff(found(before), lowered).collect()} == {"severity_changed"}
