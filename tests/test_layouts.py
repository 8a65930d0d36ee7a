"""Queries on tables that are folders of files, as large ones are."""

import glob
import os

import pytest

from scanloom.plans.queries import QUERIES
from scanloom.plans.workspace import new_dir, shared_dir

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, files: int) -> str:
    """A folder of tables whose documents are a folder of so many files; 0: a single file."""
    rows = [(k, f"word {k}\neval(x)\n", "en", "web", 10) for k in range(40)]
    folder = new_dir(spark, "layout")
    table = spark.createDataFrame(rows, SCHEMA).repartition(max(files, 1), "doc_id")
    if files:
        table.write.parquet(f"{folder}/documents.parquet")
    else:
        os.makedirs(folder)
        table.toPandas().to_parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_scan", "stream_finding_windows", "stream_repo_summary"])
def test_stream_of_a_folder(spark, name):
    got, want = (sorted(map(tuple, QUERIES[name](spark, documents(spark, files)).collect()), key=repr) for files in (3, 0))
    assert got and got == want


def test_uploads_land_in_many_files(spark):
    known = set(glob.glob(f"{shared_dir(spark)}/uploads-*"))
    got, want = (sorted(map(tuple, QUERIES["stream_late_rows"](spark, documents(spark, files)).collect()), key=repr) for files in (3, 0))
    assert {r[-1] for r in got} == {"new", "repeated"} and got == want
    parts = [len(glob.glob(f"{f}/part-*")) for f in set(glob.glob(f"{shared_dir(spark)}/uploads-*")) - known]
    # two uploads; a task never writes the whole of one
    assert max(parts) > 2
