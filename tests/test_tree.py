"""The tree source: rows, planning, columns, filters, streams."""

import os
import time

import pytest

from scanloom.operators import detect as D, inventory as I
from scanloom.plans.workspace import new_dir
from scanloom.sources import tree as R
from scanloom.streaming import stream as T


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "tree"
    for path, text in {
        "r/a.js": "eval(x)\n", "r/.env": "A_TOKEN=abcdefghijkl\n", "r/deep/er/b.py": "exec(x)\n", "r/notes.bin": "x",
        "r/node_modules/c.js": "eval(x)", "s/.env.local": "X=1\n", "s/big.js": "y" * 5000, "top.js": "eval(y)\n",
    }.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    (base / "s" / "bad.py").write_bytes(b"exec(\xff\xe2\x82x)\xef\xbf\xbd\n")
    os.symlink(base / "r", base / "s" / "loop")
    os.symlink(base / "nowhere", base / "s" / "broken.js")
    return str(base)


def rows(frame):
    return {(r.repo_id, r.path): r for r in frame.collect()}


@pytest.mark.parametrize("options", [{}, {"taskFiles": 1}, {"planEntries": 0}, {"planEntries": 3, "leastTasks": 7},
                                     {"taskBytes": 1, "taskFiles": 2}])
def test_rows(spark, root, options):
    got = rows(R.read(spark, root, maxFileBytes=1000, **options))
    assert set(got) == {
        ("r", "a.js"), ("r", ".env"), ("r", "deep/er/b.py"), ("r", "notes.bin"), ("r", "node_modules/c.js"),
        ("s", ".env.local"), ("s", "big.js"), ("s", "bad.py"), ("s", "broken.js"), ("top.js", "")}
    assert got["r", "a.js"].content == "eval(x)\n" and got["r", ".env"].size == 21
    assert got["s", "bad.py"].content == "exec(x)�\n"  # bad bytes go, a genuine replacement character stays
    for key in (("r", "notes.bin"), ("r", "node_modules/c.js"), ("s", "big.js"), ("s", "broken.js")):
        assert got[key].content is None and got[key].read_error is None
    assert got["s", "broken.js"].size is None


def test_same_choice_as_the_inventory(spark, root):
    for path, decision in ((r.path, r.decision) for r in I.with_decision(R.inventory(spark, root), 1000).collect() if r.size is not None):
        size = 5000 if path == "big.js" else 10
        assert R.opened(path, size, 1000) == (decision == I.SCAN), path


def test_inventory_opens_nothing(spark, root):
    os.chmod(f"{root}/r/a.js", 0)
    found = R.inventory(spark, root)
    assert found.columns == ["repo_id", "path", "size", "modified"] and found.count() == 10


def test_filters_reach_the_planner(spark, root):
    frame = R.read(spark, root).filter("repo_id = 's'")
    assert {k[0] for k in rows(frame)} == {"s"}
    assert {k[0] for k in rows(R.read(spark, root).filter("repo_id in ('r', 'top.js') and path <> '.env'"))} == {"r", "top.js"}
    schema = R.read(spark, root).schema
    reader = R.TreeReader({"path": root}, schema)
    assert list(reader.pushFilters([R.EqualTo(("repo_id",), "s"), R.EqualTo(("path",), "x")])) == [R.EqualTo(("path",), "x")]
    assert {s.uri.rpartition("/")[2] for t in reader.partitions() for s in t.shares} == {"s", "tree"}


def test_a_large_directory_is_many_tasks(tmp_path):
    from pyspark.sql.types import StructType

    flat = tmp_path / "tree" / "r"
    flat.mkdir(parents=True)
    for k in range(3000):
        (flat / f"f{k:05d}.js").write_bytes(b"x" * (10 + k % 7))
    tree = R.Tree({"path": str(tmp_path / "tree"), "taskFiles": 100}, StructType.fromDDL(R.SCHEMA))
    tasks = tree.plan()
    counts = [sum(b.num_rows for b in tree.read(t)) for t in tasks]
    assert sum(counts) == 3000 and len(tasks) >= 30 and max(counts) <= 150
    sample = R.Names()
    for k in range(200_000):
        sample.add(f"n{k:07d}", 3)
    ranges = sample.ranges(1 << 40, 5000)
    assert len(sample.kept) <= R._SAMPLE and len(ranges) == 40
    cuts = [int(low[1:]) for low, *_ in ranges[1:]]
    steps = [b - a for a, b in zip([0, *cuts], [*cuts, 200_000])]
    assert max(steps) < 1.5 * 5000 and min(steps) > 5000 / 1.5


def test_options_are_checked(spark, root, tmp_path):
    for options in ({"repoLevel": 2}, {"maxFileBytes": -1}):
        with pytest.raises(Exception, match="repoLevel|maxFileBytes"):
            R.read(spark, root, **options).count()
    with pytest.raises(Exception, match="no directory"):
        R.read(spark, str(tmp_path / "absent")).count()
    (tmp_path / "empty").mkdir()
    assert R.read(spark, str(tmp_path / "empty")).count() == 0
    assert {k[0] for k in rows(R.read(spark, root, repoLevel=0))} == {"tree"}


def test_stream_takes_what_is_new(spark, root):
    base = new_dir(spark, "tree-stream")

    def step():
        files = R.read_stream(spark, root, settleSeconds=0)
        T.write_available(T.stream_findings(files), f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return sorted((r.repo_id, r.file, r.rule_id) for r in spark.read.parquet(f"{base}/out").collect())

    def want():
        return sorted((r.repo_id, r.file, r.rule_id) for r in
                      T.stream_findings(R.read(spark, root)).collect())

    first = step()
    assert first == want() and first
    assert step() == first  # nothing is new
    (os.makedirs(f"{root}/new"), open(f"{root}/new/x.js", "w").write("eval(z)\n"))
    os.utime(f"{root}/new/x.js", (1, 1))  # an old file that is moved in is new all the same
    time.sleep(0.05)
    assert step() == want()


def test_many_folders_are_dealt_to_few_tasks(spark, tmp_path):
    from pyspark.sql.types import StructType

    for k in range(300):
        (tmp_path / "tree" / f"r{k}" / "src").mkdir(parents=True)
        (tmp_path / "tree" / f"r{k}" / "src" / "a.js").write_text("eval(x)\n")
    tree = R.Tree({"path": str(tmp_path / "tree"), "planEntries": 50, "leastTasks": 8}, StructType.fromDDL(R.SCHEMA))
    tasks = tree.plan()
    counts = [sum(b.num_rows for b in tree.read(t)) for t in tasks]
    assert 8 <= len(tasks) <= 16 and sum(counts) == 300 and max(counts) <= 40
    # what the planner looks at itself doesn't grow with the tree
    assert R.Tree({"path": str(tmp_path)}, StructType.fromDDL(R.SCHEMA)).plan_entries <= 100_000
