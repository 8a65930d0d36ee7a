"""Archive, upload, repository and address admission."""

import random

import pytest

from scanloom import constants as K
from scanloom.operators import admission as A

ENTRIES = "archive_id string, ordinal bigint, path string, is_dir boolean, size bigint"
MIB = 1024 * 1024


def archives(spark, listed):
    rows = [(name, i, path, path.endswith("/"), size)
            for name, entries in listed.items() for i, (path, size) in enumerate(entries)]
    return {r.archive_id: r for r in A.archive_admission(spark.createDataFrame(rows, ENTRIES)).collect()}


def test_archives(spark):
    cases = {
        "valid": ([("utils.py", 10), ("d/", 0), ("d/lib.js", 10)], None, None),
        "slip": ([("ok.py", 1), ("../../etc/passwd", 1)], "path_escape", 1),
        "slip_inside": ([("a/../../b", 1)], "path_escape", 0),
        "stays_inside": ([("a/b/../../c", 1), ("./x", 1)], None, None),
        "absolute": ([("/etc/passwd", 1)], "absolute_path", 0),
        "absolute_dir": ([("/etc/", 0)], "absolute_path", 0),
        "nul": ([("a\x00b", 1)], "null_byte", 0),
        "large": ([("l.bin", 2 * MIB)], "file_too_large", 0),
        "edge_file": ([("l.bin", MIB)], None, None),
        "edge_total": ([(f"f{i}", MIB) for i in range(100)], None, None),
        "total": ([(f"f{i}", MIB) for i in range(101)], "total_too_large", 100),
        "edge_count": ([(f"f{i}", 1) for i in range(1000)], None, None),
        "count": ([(f"f{i}", 1) for i in range(1001)], "too_many_files", 1000),
        "dirs_not_counted": ([(f"d{i}/", 0) for i in range(1500)], None, None),
        "first_wins": ([("x", 2 * MIB), ("/abs", 1)], "file_too_large", 0),
    }
    got = archives(spark, {n: e for n, (e, _, _) in cases.items()})
    assert {n: (r.accepted, r.reason, r.reject_ordinal) for n, r in got.items()} == {
        n: (reason is None, reason, at) for n, (_, reason, at) in cases.items()}


def test_running_totals_match_brute_force_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE", 7)
    rng = random.Random(3)
    rows, want = [], {}
    for a in range(60):
        total = count = 0
        for i in range(rng.randrange(1, 60)):
            is_dir, size = rng.random() < 0.2, rng.randrange(0, 400)
            rows.append((f"a{a}", i, "p", is_dir, size))
            if f"a{a}" in want or is_dir:
                continue
            total, count = total + size, count + 1
            reason = ("file_too_large" if size > 390 else "total_too_large" if total > 5000
                      else "too_many_files" if count > 30 else None)
            if reason:
                want[f"a{a}"] = (reason, i)
    rng.shuffle(rows)
    got = A.archive_admission(spark.createDataFrame(rows, ENTRIES), 390, 5000, 30).collect()
    assert {r.archive_id: (r.reason, r.reject_ordinal) for r in got if not r.accepted} == want
    assert len(got) == 60


def test_uploads(spark):
    table = spark.createDataFrame(
        [("a.zip", 10), ("A.ZIP", K.MAX_UPLOAD_BYTES), ("test.txt", 10), ("b.zip", 30 * MIB), (None, 1)],
        "filename string, bytes bigint")
    assert [r.reason for r in A.upload_admission(table).collect()] == [
        None, None, "not_zip", "too_large", "not_zip"]


def test_repo_file_count(spark, files):
    table = files(repos={"two": [("one.py", ""), ("two.py", "")],
                         "one": [("one.py", ""), ("node_modules/two.py", "")]})
    got = {r.repo_id: (r.n_files, r.accepted) for r in A.repo_admission(table, 1).collect()}
    assert got == {"two": (2, False), "one": (1, True)}


def kept(owner, name):
    return f"https://github.com/{owner}/{name}.git"


@pytest.mark.parametrize("url, address, reason", [
    # accepted: letters, digits, dot, dash and underscore; blanks, case and doubled slashes forgiven
    ("https://github.com/a-1/b_2.c", kept("a-1", "b_2.c"), None),
    ("https://github.com/Data.Team/etl.git", kept("Data.Team", "etl"), None),
    ("\t https://GITHUB.com/x//y/ ", kept("x", "y"), None),
    ("HTTPS://github.com/x/y", kept("x", "y"), None),
    # scheme
    ("ftp://github.com/x/y", None, K.URL_SCHEME),
    ("github.com/x/y", None, K.URL_SCHEME),
    ("", None, K.URL_SCHEME),
    # host, user info
    ("https://github.com.example.net/x/y", None, K.URL_HOST),
    ("https://gist.github.com/x/y", None, K.URL_HOST),
    ("https://me:pw@github.com/x/y", None, K.URL_HOST),
    # query, fragment
    ("https://github.com/x/y?ref=main&depth=1", None, K.URL_QUERY),
    ("https://github.com/x/y#L10", None, K.URL_QUERY),
    # number of segments
    ("https://github.com/", None, K.URL_SHAPE),
    ("https://github.com/x/y/tree/main/src", None, K.URL_SHAPE),
    # characters, empty name
    ("https://github.com/x/y%20z", None, K.URL_CHARS),
    ("https://github.com/x\u00e9/y", None, K.URL_CHARS),
    ("https://github.com/x/.git", None, K.URL_EMPTY),
    (None, None, None),
])
def test_repo_urls(spark, url, address, reason):
    row = A.repo_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert row.clone_url == address
    assert url is None or row.reason == reason
