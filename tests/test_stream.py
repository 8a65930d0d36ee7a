"""Streams give what batches give."""

import datetime as dt

from pyspark.sql import functions as F

from scanloom.operators import detect as D, findings as N
from scanloom.plans.scan import scan
from scanloom.plans.workspace import new_dir
from scanloom.sources.files import list_tree, read_contents
from scanloom.streaming import stream as T
from scanloom.plans.merged import MergedTable
from scanloom.streaming.summary import RunningSummary

SCHEMA = "repo_id string, path string, content string, size bigint, arrived_at timestamp"
START = dt.datetime(2024, 1, 1)


class Landing:
    """A folder in which tables of files land."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, new_dir(spark, "landing"), 0

    def add(self, *rows, minute=0):
        data = [(repo, path, content, len(content), START + dt.timedelta(minutes=minute))
                for repo, path, content in rows]
        self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self, per_trigger=1):
        return (self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger)
                .parquet(self.path))

    def batch(self):
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def run(spark, stream, base=None):
    base = base or new_dir(spark, "out")
    T.write_available(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def test_stream_equals_batch(spark):
    landing = Landing(spark)
    landing.add(("r", "a.js", "eval(x)\n"), ("r", "c.yml", "Access-Control-Allow-Origin: *\n"))
    landing.add(("s", "tests/b.py", "exec(x)\nsubprocess.run(\n x, shell=True)\n"))
    columns = ["repo_id", "file", "line", "rule_id", "severity", "recommendation"]
    got = run(spark, T.stream_findings(landing.stream())).select(*columns).collect()
    want = N.final_findings(D.detect(landing.batch())).select(*columns).collect()
    assert len(got) == 4 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_repeated_uploads_and_requests(spark):
    landing = Landing(spark)
    for minute in range(3):
        landing.add(("r", "a.js", "eval(x)\n"), ("r", f"b{minute}.js", "eval(x)\n"), minute=minute)
    found = T.stream_findings(landing.stream())
    once = run(spark, T.dedup_stream(found)).select("file").collect()
    assert sorted(r.file for r in once) == ["a.js", "b0.js", "b1.js", "b2.js"]
    assert run(spark, T.request_stream(found)).count() == 1  # same rule, evidence and severity


def test_windows_close_with_the_watermark(spark):
    landing = Landing(spark)
    for minute in (0, 4, 12, 40):
        landing.add(("r", f"a{minute}.js", "eval(x)\n"), minute=minute)
    rows = run(spark, T.windowed_counts(T.stream_findings(landing.stream()))).collect()
    got = {((r.window_start - START).seconds // 60, r.severity, r.n_findings) for r in rows}
    assert got == {(0, "high", 2), (10, "high", 1)}


NAMES = ["repo_id", "path", "content", "size"]


def test_running_summary(spark):
    landing = Landing(spark)
    sink = RunningSummary(new_dir(spark, "running"), lanes=3, every=2)
    checkpoint = new_dir(spark, "checkpoint")

    def step():
        sink.start(landing.stream().select(*NAMES), checkpoint).awaitTermination()
        return sorted(map(tuple, sink.latest(spark).collect()))

    def want(files):
        return sorted(map(tuple, scan(files).summary.collect()))

    landing.add(("r", "a.js", "eval(x)\n"), ("r", "n.txt", "x"), ("s", "a.py", "x = 1\n"))
    assert step() == want(landing.batch().select(*NAMES))
    landing.add(("r", "b.py", "exec(x)\n"), ("t", "node_modules/x.js", "eval(x)"))
    assert step() == want(landing.batch().select(*NAMES))
    # a file that arrives again replaces its earlier version
    landing.add(("r", "a.js", "fine\n"))
    current = landing.batch().select(*NAMES).filter("NOT (path = 'a.js' AND content LIKE 'eval%')")
    assert step() == want(current)
    # many findings of a kind, in several lanes and batches: only the first three count fully
    for k in range(4):
        landing.add(*(("u", f"f{k}{n}.js", "eval(x)\n" * (k + 1) + "new Function('x')\n") for n in range(5)),
                    ("u", "tests/t.py", "exec(x)\n" * 5), ("u", f"c{k}/.env", "A_TOKEN=abcdefghijkl\n"))
    current = landing.batch().select(*NAMES).filter("NOT (path = 'a.js' AND content LIKE 'eval%')").distinct()
    assert step() == want(current)


def test_last_version_of_a_batch_counts(spark):
    landing = Landing(spark)
    landing.add(("r", "a.js", "eval(x)\n"), minute=5).add(("r", "a.js", "fine\n"), minute=9).add(
        ("r", "a.js", "eval(x)\neval(y)\n"), minute=7)
    sink = RunningSummary(new_dir(spark, "running"))
    sink.start(landing.stream(10), new_dir(spark, "checkpoint")).awaitTermination()
    assert [(r.repo_id, r.total, r.scanned_files) for r in sink.latest(spark).collect()] == [("r", 0, 1)]


def test_merged_table(spark):
    table = MergedTable(new_dir(spark, "merged"), ("k",), "k int, v string", every=3)
    want = {}
    for batch in range(11):
        rows = [(k, f"{batch}-{k}") for k in range(batch % 4, batch + 1)]
        want.update(rows)
        for _ in range(1 + batch % 2):  # a batch that runs again changes nothing
            table.write(spark.createDataFrame(rows, "k int, v string"), batch)
        assert dict(map(tuple, table.read(spark).collect())) == want
    # what is read doesn't grow: a base and at most two batches besides the first
    files = table.read(spark).inputFiles()
    assert {f.split("place=")[0].rsplit("/", 2)[-2] for f in files} == {"log", "base"}
    assert len({f.rsplit("/", 1)[0] for f in files}) <= 4


def test_stream_of_manifests_reads_contents(spark, tmp_path):
    (tmp_path / "tree" / "r").mkdir(parents=True)
    (tmp_path / "tree" / "r" / ".env").write_text("A_TOKEN=abcdefghijkl\n")
    manifests = new_dir(spark, "manifests")
    listing = list_tree(spark, str(tmp_path / "tree"))
    listing.write.parquet(manifests)
    files = read_contents(spark.readStream.schema(listing.schema).parquet(manifests))
    rows = run(spark, T.stream_findings(files)).collect()
    assert {r.rule_id for r in rows} == {"CONFIG_ENV_FILE", "CONFIG_ENV_SECRET_LIKE_VALUE"}


def test_all_windows_are_written(spark):
    landing = Landing(spark)
    for minute in (0, 4, 12, 40):
        landing.add(("r", f"a{minute}.js", "eval(x)\n"), minute=minute)
    base = new_dir(spark, "windows")
    T.write_windows(T.windowed_counts(T.stream_findings(landing.stream())), f"{base}/out", f"{base}/c")\
        .awaitTermination()
    rows = T.current_windows(spark, f"{base}/out").collect()
    got = {((r.window_start - START).seconds // 60, r.n_findings) for r in rows}
    assert got == {(0, 2), (10, 1), (40, 1)}


def test_every_row_has_a_fate(spark):
    landing = Landing(spark)
    landing.add(("r", "a.js", "eval(x)\n"), minute=100)
    landing.add(("r", "a.js", "eval(x)\n"), ("r", "b.js", "eval(x)\n"), ("r", "b.js", "eval(x)\n"), minute=95)
    landing.add(("r", "a.js", "eval(x)\n"), ("r", "c.js", "eval(x)\n"), minute=30)  # 40 is the mark
    landing.add(("r", "a.js", "eval(x)\n"), minute=300)  # what was known has expired
    landing.add(("r", "a.js", "eval(x)\n"), minute=310)
    found = T.stream_findings(landing.stream()).select("repo_id", "rule_id", "file", "line", "severity", "arrived_at")
    rows = run(spark, T.with_fate(found, "1 hour", lanes=2)).collect()
    got = sorted((r.file, (r.arrived_at - START).total_seconds() // 60, r.fate) for r in rows)
    # at 300 the mark is still at 40 and a.js is remembered; at 310 the mark is at 240
    assert got == [("a.js", 30, "late"), ("a.js", 95, "repeated"), ("a.js", 100, "new"), ("a.js", 300, "repeated"),
                   ("a.js", 310, "new"), ("b.js", 95, "new"), ("b.js", 95, "repeated"), ("c.js", 30, "late")]
    once = run(spark, T.dedup_stream(found.drop("severity"), "1 hour")).collect()
    # Spark's own operator forgets a finding one batch later
    assert {(r.file, r.arrived_at) for r in once} == {
        (r.file, r.arrived_at) for r in rows if r.fate == "new"} - {("a.js", START + dt.timedelta(minutes=310))}
