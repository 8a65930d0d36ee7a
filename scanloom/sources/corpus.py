"""Code-like files table derived from the ``documents`` table.

The given tables hold prose, so rule queries read this view of them: every
document becomes one file (its whole text plus up to two code snippets picked by
a hash of its id), five files to a repository. It is test input; the engine
takes any table with the columns ``repo_id, path, content, size``.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


PATH_TEMPLATES = (
    "src/a{d}.py", "src/b{d}.py", "app/c{d}.js", "app/d{d}.jsx", "web/e{d}.ts", "web/f{d}.tsx",
    "conf/g{d}.json", "conf/h{d}.yml", "conf/i{d}.yaml", "conf/j{d}.toml", "conf/k{d}.ini",
    "svc{d}/.env", "svc{d}/.env.local", "svc{d}/.env.example", "fixtures/m{d}/.env",
    "tests/n{d}.py", "tests/fixtures/o{d}.js", "docs/p{d}.md", "q{d}/README.md",
    "examples/s{d}.py", "node_modules/t{d}/index.js", "Build/u{d}.js", "notes/v{d}.txt",
    "src/w{d}.test.ts",
)

SNIPPET_SLOTS = 64


def fake_token(prefix: str, length: int, alphabet: str = "aB3dE5gH7jK9mN1pQ") -> str:
    """Prefix plus filler; built at run time so that no file holds a key-shaped literal."""
    return prefix + (alphabet * (length // len(alphabet) + 1))[:length]


def snippets() -> list[str]:
    """The 29 real snippets; the other slots are empty."""
    openai = fake_token("sk-" + "proj-", 24)
    upper = "Q7W4E2R9T5Y1U8I3"
    return [
        # JavaScript
        "const out = eval(input);",
        "const fn = new Function('a', 'return a');",
        "child_process.exec(cmd, done);",
        "<div dangerouslySetInnerHTML={{ __html: body }} />",
        'localStorage.setItem("token", value); // kept for the next visit, see the notes on sessions below',
        # Python
        "result = eval(user_input)",
        "exec(payload)",
        'subprocess.run("ls -l", shell=True)',
        "subprocess.check_output(\n    build(cmd, (1, 2)),\n    shell=True,\n)",
        "obj = pickle.loads(blob)",
        "cfg = yaml.load(stream, Loader=yaml.FullLoader)",
        # CORS
        'allow_origins = ["*"]',
        'origin: "*"',
        "Access-Control-Allow-Origin: *",
        # env assignments
        "DB_PASSWORD=hunter2hunter2  # main database",
        "SERVICE_TOKEN=your_token_here",
        "NEXT_PUBLIC_MAPS_API_KEY=<your-key-here>",
        "NEXT_PUBLIC_APP_SECRET=abc123",
        "export NEXT_PUBLIC_PAY_TOKEN='" + fake_token("", 24, "aB3$dE5%gH7&jK9*mN1(pQ8)") + "'",
        # secrets
        f'OPENAI_API_KEY = "{openai}"',
        'API_KEY: "real-' + 'secret-value-12345"',
        f'client = connect("{openai}")',
        "charge('" + fake_token("sk_" + "test_", 9) + "')",
        "push(" + fake_token("gh" + "p_", 36) + ")",
        "maps('" + fake_token("AI" + "za", 36) + "')",
        "upload('" + fake_token("AK" + "IA", 16, upper) + "')",
        # key block, and a safe call
        "-----BEGIN RSA " + "PRIVATE KEY-----",
        "cfg = yaml.load(stream, Loader=yaml.SafeLoader)",
        # a call in an f-string, and one in its text
        'label = f"{eval(expr)!r:>{width}} {{exec(x)}}"',
    ]


def literal_array(texts) -> Column:
    """A constant array; one literal, folded at planning time."""
    return F.from_json(F.lit(json.dumps(list(texts))), "array<string>")


def hex_int(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("int")


def corpus_path(doc_id: Column) -> Column:
    digest = F.md5(doc_id.cast("string"))
    template = F.element_at(literal_array(PATH_TEMPLATES), hex_int(digest, 3, 2) % len(PATH_TEMPLATES) + 1)
    return F.replace(template, F.lit("{d}"), doc_id.cast("string"))


def corpus_from(documents: DataFrame, second: bool = True, extra=()) -> DataFrame:
    """``documents`` (batch or stream) as a files table; ``second`` is for the second
    snippet, ``extra`` names columns to keep."""
    texts = snippets() + [""] * (SNIPPET_SLOTS - len(snippets()))
    slots = literal_array(texts)
    digest = F.md5(F.col("doc_id").cast("string"))
    first = F.element_at(slots, hex_int(digest, 1, 2) % SNIPPET_SLOTS + 1)
    another = F.element_at(slots, hex_int(digest, 5, 2) % SNIPPET_SLOTS + 1)
    content = F.concat(
        F.col("text"), F.lit("\n"), first, F.lit("\n"),
        F.when(F.lit(second) & (hex_int(digest, 7, 1) < 8), another).otherwise(""),
    )
    return documents.select(
        F.concat(F.lit("r"), F.expr("cast(doc_id div 5 as string)")).alias("repo_id"),
        corpus_path(F.col("doc_id")).alias("path"),
        content.alias("content"), *extra,
    ).withColumn("size", F.octet_length("content").cast("bigint"))


def partitioned(table: DataFrame, key: str) -> DataFrame:
    """The table as it is read, or, where the session sets ``scanloom.corpus.partitions``, in so
    many partitions: test tables are single row groups, which Spark can't split."""
    partitions = table.sparkSession.conf.get("scanloom.corpus.partitions", None)
    return table.repartition(int(partitions), key) if partitions else table


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return corpus_from(partitioned(documents, "doc_id"))


def write_tree(files: DataFrame, root: str) -> None:
    """Write a files table as a tree of files, ``root/repo_id/path``, from the tasks. A repository is written by
    one task, which makes each folder once; several tasks a core, so that few or large input files don't hold it up."""
    def write(batches):
        filesystem, base = pafs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['repo_id']}/{row['path']}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(path) as out:
                    out.write(row["content"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    files.select("repo_id", "path", "content").repartition(tasks, "repo_id").mapInArrow(write, "n bigint").agg(F.sum("n")).first()
