"""Path classification, admission of files, counters, reading trees."""

import pytest
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions import paths as P, text as X
from scanloom.operators import inventory as I
from scanloom.operators.detect import detect
from scanloom.plans.scan import scan
from scanloom.sources.files import list_tree, read_contents, read_tree

CONTEXTS = {
    "src/app.py": K.PRODUCTION,
    "tests/test_app.py": K.TEST_DEMO,
    "docs/README.md": K.EXAMPLE_TEMPLATE,
    ".env.example": K.EXAMPLE_TEMPLATE,
    "BadRepo/fixtures/bad.py": K.TEST_DEMO,
    "node_modules/pkg/index.js": K.GENERATED,
    **{f"{d}/file.js": K.GENERATED for d in K.GENERATED_DIRS},
    "tests/.env": K.PRODUCTION,
    "fixtures/.env": K.PRODUCTION,
    "a/app.test.js": K.TEST_DEMO,
    "a/app.spec.ts": K.TEST_DEMO,
    "debug_x.py": K.TEST_DEMO,
    "src/debug": K.TEST_DEMO,
    "src/build": K.GENERATED,
    "x.config.example": K.EXAMPLE_TEMPLATE,
    "Node_Modules/a.js": K.GENERATED,
    "win\\tests\\a.py": K.TEST_DEMO,
    "readme.mdx": K.PRODUCTION,
    "a.test": K.PRODUCTION,
    "attest/a.py": K.PRODUCTION,
    ".cache/a.py": K.PRODUCTION,
    "Samples/a.py": K.EXAMPLE_TEMPLATE,
    "template.env": K.EXAMPLE_TEMPLATE,
}


def test_file_context(spark):
    rows = spark.createDataFrame([(p,) for p in CONTEXTS], "path string")
    got = {r.path: r.c for r in rows.select("path", P.file_context(F.col("path")).alias("c")).collect()}
    assert got == CONTEXTS


@pytest.mark.parametrize("path, decision, key, scanner", [
    ("a/x.PY", I.SCAN, ".py", "python"),
    ("svc/.env", I.SCAN, ".env", "config"),
    (".env.local", I.SCAN, ".env", "config"),
    ("example.env", I.SCAN, ".env", "config"),
    ("x.mdx", I.SCAN, ".mdx", None),
    ("notes.txt", I.SKIPPED, ".txt", None),
    ("Makefile", I.SKIPPED, "", None),
    ("build", I.SKIPPED, "", None),
    ("node_modules/a/b.js", I.PRUNED, ".js", "javascript"),
    ("NODE_MODULES/b.js", I.PRUNED, ".js", "javascript"),
    ("a/.Cache/b.js", I.PRUNED, ".js", "javascript"),
])
def test_decision_and_routing(spark, path, decision, key, scanner):
    row = I.inventory(spark.createDataFrame([("r", path, 10)], "repo_id string, path string, size bigint")).first()
    assert (row.decision, row.scanner_key, row.ext_scanner) == (decision, key, scanner)


def test_size_limit_is_strict(spark):
    table = spark.createDataFrame(
        [("r", "a.py", K.MAX_FILE_BYTES), ("r", "b.py", K.MAX_FILE_BYTES + 1)],
        "repo_id string, path string, size bigint")
    assert [r.decision for r in I.inventory(table).orderBy("path").collect()] == [I.SCAN, I.TOO_LARGE]


def test_stats(files):
    table = files(("tests/bad.py", "eval(x)"), ("README.md", "x"),
                  ("node_modules/pkg/bad.js", "eval(x)"), ("notes.txt", "x"))
    assert tuple(I.scan_stats(table).first()) == ("r", 2, 2, 1)


def test_inventory_reads_no_content(spark, files, tmp_path):
    files(("a.py", "eval(x)")).write.parquet(str(tmp_path / "files"))
    plan = I.scan_stats(spark.read.parquet(str(tmp_path / "files")))\
        ._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "content" not in schema and "path" in schema


def test_read_tree(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "src" / "a.py").write_bytes(b"x = 'caf\xc3\xa9'\neval(\xff y)\n")
    (tmp_path / "two" / ".env").write_text("A_TOKEN=abcdefghijkl\n")
    (tmp_path / "two" / "big.py").write_bytes(b"eval(x)\n" * 140_000)
    (tmp_path / "two" / ".github" / "w").mkdir(parents=True)
    (tmp_path / "two" / ".github" / "w" / "_ci.yml").write_text("origin: '*'\n")
    (tmp_path / "two" / "node_modules").mkdir()
    (tmp_path / "two" / "node_modules" / "x.js").write_text("eval(x)")
    (tmp_path / "two" / "loop").symlink_to(tmp_path / "two")
    (tmp_path / "two" / "gone.py").symlink_to(tmp_path / "nowhere")
    listing = list_tree(spark, str(tmp_path))
    assert {tuple(r) for r in I.scan_stats(listing).collect()} == {
        ("one", 1, 0, 0), ("two", 2, 3, 1)}
    table = read_tree(spark, str(tmp_path))
    rows = {(r.repo_id, r.path): r for r in table.collect()}
    assert set(rows) == {("one", "src/a.py"), ("two", ".env"), ("two", "big.py"),
                         ("two", ".github/w/_ci.yml"), ("two", "node_modules/x.js"),
                         ("two", "gone.py")}
    assert rows["one", "src/a.py"].content == "x = 'café'\neval( y)\n"
    assert rows["two", "big.py"].content is None
    assert rows["two", "node_modules/x.js"].content is None
    found = {(r.repo_id, r.file, r.rule_id, r.line) for r in detect(table).collect()}
    assert found == {("one", "src/a.py", "PY_EVAL", 2), ("two", ".env", "CONFIG_ENV_FILE", 1),
                     ("two", ".env", "CONFIG_ENV_SECRET_LIKE_VALUE", 1),
                     ("two", ".github/w/_ci.yml", "CONFIG_CORS_WILDCARD", 1)}


def test_decoding_keeps_genuine_replacement_characters(spark):
    raw = spark.createDataFrame([("ok � ok".encode(),), (b"a\xffb\xc3",)], "raw binary")
    got = [r[0] for r in raw.select(X.decode_utf8(F.col("raw"))).collect()]
    assert got == ["ok � ok", "ab"]


def test_one_project(spark, tmp_path):
    root = tmp_path / "shop"
    for path, text in {"src/a.py": "exec(x)\n", "tests/b.js": "eval(x)\n", ".env": "A_TOKEN=abcdefghijkl\n",
                       "node_modules/x/i.js": "eval(x)\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    files = read_tree(spark, str(root), repo_level=0)
    rows = {r.path: (r.repo_id, r.decision, r.file_context) for r in I.inventory(files).collect()}
    assert rows == {
        "src/a.py": ("shop", I.SCAN, K.PRODUCTION), "tests/b.js": ("shop", I.SCAN, K.TEST_DEMO),
        ".env": ("shop", I.SCAN, K.PRODUCTION), "node_modules/x/i.js": ("shop", I.PRUNED, K.GENERATED)}
    result = scan(files)
    assert {(r.file, r.severity) for r in result.findings.collect() if r.file == "tests/b.js"} == {
        ("tests/b.js", "medium")}
    assert result.summary.count() == 1
    for table in (result.stats, result.summary):  # files were opened once, by read_tree
        assert "MapInArrow" not in table._jdf.queryExecution().executedPlan().toString()


def test_unreadable_files_are_counted_apart(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("exec(x)\n")
    listing = list_tree(spark, str(tmp_path))
    lost = listing.withColumn("uri", F.concat("uri", F.lit(".gone"))).withColumn("path", F.lit("b.py"))
    files = read_contents(listing.union(lost.select(*listing.columns)))
    rows = {r.path: (r.decision) for r in I.inventory(files).collect()}
    assert rows == {"a.py": I.SCAN, "b.py": I.UNREADABLE}
    assert {r.path: bool(r.read_error) for r in files.collect()} == {"a.py": False, "b.py": True}
    assert tuple(I.scan_stats(files).first())[1:3] == (1, 1)


def test_equal_contents_are_scanned_once(spark, files):
    from scanloom.operators.memo import detect_once

    table = files(repos={"r": [("a.js", "eval(x)\n"), ("tests/a.js", "eval(x)\n"), ("a.py", "eval(x)\n"),
                               (".env", "A_TOKEN=abcdefghijkl\n"), ("b/.env.example", "A_TOKEN=abcdefghijkl\n")],
                         "s": [("z.js", "eval(x)\n"), ("c/.env", "A_TOKEN=abcdefghijkl\n"), ("e.js", None)]})
    want = sorted(map(tuple, detect(table).collect()), key=repr)
    got = detect_once(table)
    assert sorted(map(tuple, got.select(*detect(table).columns).collect()), key=repr) == want
