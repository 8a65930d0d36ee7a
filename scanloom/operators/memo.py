"""Scanning equal contents once: within a scan, and across scans by a stored memo."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom import constants as K
from scanloom.functions import paths as P
from scanloom.operators import detect as D, inventory as I, rules as R
from scanloom.operators.skew import lookup_join
from scanloom.plans.merged import MergedTable
from scanloom.plans.workspace import materialize
from scanloom.schemas import RAW_FINDING_COLUMNS

# What the findings of a file depend on, besides its content.
_ROUTE = ("ext_scanner", "run_secrets", "real_env", "example_env")


def _keyed(files: DataFrame) -> DataFrame:
    """Files to scan with the digest of their content and their route, as texts."""
    key, name = P.scanner_key(F.col("path")), P.filename(P.unix_path(F.col("path")))
    keyed = I.with_decision(files).filter((F.col("decision") == I.SCAN) & F.col("content").isNotNull()).select(
        "repo_id", "path", P.unix_path(F.col("path")).alias("file"),
        P.file_context(F.col("path")).alias("file_context"), F.sha2("content", 256).alias("digest"),
        P.scanner_of(key).alias("ext_scanner"), P.runs_secrets(key).alias("run_secrets"),
        P.is_real_env_name(name).alias("real_env"), P.is_example_env_name(name).alias("example_env"))
    return keyed.select("repo_id", "path", "file", "file_context", "digest",
                        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _ROUTE))


def detect_once(files: DataFrame) -> DataFrame:
    """Raw findings, as ``detect`` gives them, with files of equal content and routing scanned
    once. Only digests are grouped; the contents of the first file of each group are read
    again, in place if the list of these is small enough for Spark to broadcast.

    Worth it where many files are copies. Scanners registered as functions may look at paths,
    so they rule this out.
    """
    if R.extra_scanners():
        raise ValueError("registered scanners may depend on more than content")
    keyed = materialize(_keyed(files), "content-keys")
    first = keyed.groupBy("digest", *_ROUTE).agg(F.min(F.struct("repo_id", "path", "file")).alias("first"))
    first = materialize(first, "first-contents")
    found = D.detect(files.join(first.select("first.repo_id", "first.path"), ["repo_id", "path"], "left_semi"))
    members = keyed.join(first, ["digest", *_ROUTE]).select(
        "repo_id", "file", "file_context", F.col("first.repo_id").alias("_repo"), F.col("first.file").alias("_file"))
    return (
        found.withColumnsRenamed({"repo_id": "_repo", "file": "_file"}).drop("file_context")
        .join(members, ["_repo", "_file"]).select(*RAW_FINDING_COLUMNS)
    )


def fingerprints(catalog: R.Catalog) -> dict[tuple[str, str], str]:
    """For every (extension scanner, runs secrets) what its rules are, as a digest: built-in texts and
    patterns, word lists, and the catalog's rules that apply there. A changed rule changes the
    digests of the routes that it applies to, and no others."""
    built_in = {
        "python": (R.PYTHON_CALL_RULES, R.PYTHON_LINE_RULES, R.SUBPROCESS_RULE_ID), "javascript": R.JAVASCRIPT_RULES,
        "config": (R.CORS_RULES, R.CONFIG_FINDINGS, R.ENV_ASSIGNMENT), "": (),
    }
    secrets = (K.NAMED_SECRETS, R.SECRET_VALUES, R.SECRET_VALUE_AFTER_NAME)
    out = {}
    for scanner, own in built_in.items():
        for runs in ("true", "false"):
            extra = [asdict(r) for r in catalog.rules
                     if scanner in r.scanners or (runs == "true" and "secrets" in r.scanners)]
            what = [repr(own), repr(secrets if runs == "true" else ()), R.LINE_HINTS, extra]
            out[scanner, runs] = hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()
    return out


@dataclass(frozen=True)
class MemoScan:
    findings: DataFrame  # as ``detect`` gives them
    scanned: DataFrame   # digest and route of the contents that were scanned, not remembered


_KEY = ("digest", *_ROUTE, "fingerprint")
_FOUND = [c for c in RAW_FINDING_COLUMNS if c not in ("repo_id", "file", "file_context")]
_FOUND_TYPES = {"line": "int", "disc_ord": "int"}
_MEMO = ", ".join([*(f"{c} string" for c in _KEY), "findings array<struct<" + ", ".join(
    f"{c} {_FOUND_TYPES.get(c, 'string')}" for c in _FOUND) + ">>"])


@dataclass(frozen=True)
class ContentMemo:
    """Findings of contents, kept under ``root`` from scan to scan.

    An entry is found by the content's digest, its route, and the fingerprint of the rules that
    apply there, so contents that are known are not scanned again, however files are renamed,
    copied or moved between repositories; a changed rule makes the entries of its own routes unknown.
    Scans of one memo have rising numbers from 0 on; one that runs again, after a failure, starts from the same entries.
    Scanners that are functions may look at more than content and are not allowed.
    """

    root: str
    every: int = 50

    @property
    def table(self) -> MergedTable:
        return MergedTable(self.root, _KEY, _MEMO, self.every)

    def scan(self, files: DataFrame, number: int, catalog: R.Catalog | None = None) -> MemoScan:
        catalog = catalog or R.current()
        if catalog.scanners:
            raise ValueError("scanners may depend on more than content")
        spark = files.sparkSession
        keyed = materialize(_keyed(files).withColumn("fingerprint", self._fingerprint(catalog)), "memo-keys")
        wanted = keyed.groupBy(*_KEY).agg(F.min(F.struct("repo_id", "path", "file")).alias("first"))
        known = self._known(spark, number)
        missing = materialize(wanted.join(known, list(_KEY), "left_anti"), "memo-missing")
        found = D.detect(files.join(missing.select("first.repo_id", "first.path"), ["repo_id", "path"], "left_semi"),
                         catalog=catalog)
        per_file = found.groupBy("repo_id", "file").agg(F.collect_list(F.struct(*_FOUND)).alias("findings"))
        nothing = F.array().cast(per_file.schema["findings"].dataType)
        entries = missing.join(
            per_file, (F.col("first.repo_id") == per_file["repo_id"]) & (F.col("first.file") == per_file["file"]), "left"
        ).select(*_KEY, F.coalesce("findings", nothing).alias("findings"))
        self.table.write(entries, number)
        # the first lookup has one row for each content, the second one only goes over findings
        members = keyed.select("repo_id", "file", "file_context", *_KEY)
        told = self.table.read(spark).filter(F.size("findings") > 0)
        by_key = F.struct(*_KEY).alias("_key")
        looked_up = lookup_join(members.select("repo_id", "file", "file_context", by_key),
                                told.select(by_key, "findings"), "_key", spread_by="file")
        findings = looked_up.select(
            "repo_id", "file", "file_context", F.explode("findings").alias("f")).select(
            "repo_id", "file", "file_context", "f.*").select(*RAW_FINDING_COLUMNS)
        return MemoScan(findings, missing.select(*_KEY))

    def _known(self, spark: SparkSession, number: int) -> DataFrame:
        if number == 0:
            return spark.createDataFrame([], _MEMO).select(*_KEY)
        return self.table.read(spark, before=number).select(*_KEY)

    @staticmethod
    def _fingerprint(catalog: R.Catalog) -> Column:
        out = F.lit(None).cast("string")
        for (scanner, runs), digest in fingerprints(catalog).items():
            out = F.when((F.col("ext_scanner") == scanner) & (F.col("run_secrets") == runs), digest).otherwise(out)
        return out
