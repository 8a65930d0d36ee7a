"""The registered queries: each operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom import constants as K
from scanloom.functions import redact as D, text as X
from scanloom.operators import (
    admission as A, changes as C, detect as M, explain as E, findings as N, inventory as I,
    memo as H, report as P, rules as R, score as S,
)
from scanloom.plans.scan import ScanResult, by_repository, nested_by_file, scan
from scanloom.plans.workspace import materialize, new_dir
from scanloom.schemas import FINDING_SCHEMA
from scanloom.sources.corpus import corpus_from, corpus_path, partitioned, read_corpus, write_tree
from scanloom.sources.files import read_tree
from scanloom.sources.tree import read_stream
from scanloom.streaming import stream as T
from scanloom.streaming.summary import RunningSummary

Query = Callable[[SparkSession, str], DataFrame]

RAW = ["repo_id", "file", "line", "rule_id", "title", "severity", "category", "evidence",
       "recommendation", "file_context"]
FINAL = FINDING_SCHEMA.fieldNames()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_scan(spark: SparkSession, sf_dir: str) -> ScanResult:
    return scan(read_corpus(spark, sf_dir))


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.final_findings(M.detect(read_corpus(spark, sf_dir), unique=True))


def scored_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = corpus_scan(spark, sf_dir)
    return S.with_score(S.complete(S.measures(result.scored), result.stats))


# -- sources, inventory ----------------------------------------------------------
def src_inventory(spark, sf_dir):
    return I.inventory(read_corpus(spark, sf_dir)).select("repo_id", "path", "size", "decision")


def file_routing(spark, sf_dir):
    return I.inventory(read_corpus(spark, sf_dir)).select(
        "repo_id", "path", "scanner_key", "ext_scanner", "run_secrets")


def file_context(spark, sf_dir):
    return I.inventory(read_corpus(spark, sf_dir)).select(
        "repo_id", "path", "file_context", "is_demo_fixture", "is_documentation")


def scan_stats(spark, sf_dir):
    return I.scan_stats(read_corpus(spark, sf_dir))


def _document_lines(spark, sf_dir) -> DataFrame:
    documents = partitioned(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = documents.select(
        "doc_id", F.posexplode(F.split(X.unix_newlines(F.col("text")), "\n", -1))
        .alias("pos", "text_line"))
    return lines.withColumn("line", (F.col("pos") + 1).cast("int"))


def line_explode(spark, sf_dir):
    return _document_lines(spark, sf_dir).select(
        "doc_id", "line", F.length("text_line").alias("n_chars"))


def evidence_snippet(spark, sf_dir):
    return _document_lines(spark, sf_dir).select(
        "doc_id", "line", X.evidence(F.col("text_line")).alias("evidence"))


# -- admission -------------------------------------------------------------------
# Limits scaled to the tables, so that every rejection occurs.
ENTRY_LIMITS = {"max_file_bytes": 20_000, "max_total_bytes": 100_000, "max_files": 40}
UPLOAD_LIMIT = 4_000
REPO_LIMIT = 4


def archive_admission(spark, sf_dir):
    doc_id, name = F.col("doc_id"), corpus_path(F.col("doc_id"))
    entries = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), "lang").alias("archive_id"),
        doc_id.alias("ordinal"),
        # some entries of the kinds that are rejected by their path
        F.when(F.col("n_chars") % 97 == 0, F.concat(F.lit("/"), name))
        .when(F.col("n_chars") % 89 == 0, F.concat(F.lit("a/../../"), name))
        .otherwise(name).alias("path"),
        (F.col("n_chars") % 11 == 0).alias("is_dir"),
        F.col("n_chars").alias("size"),
    )
    return A.archive_admission(entries, **ENTRY_LIMITS)


def upload_admission(spark, sf_dir):
    uploads = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("upload"), "page_id", F.element_at(
            F.array(F.lit(".zip"), F.lit(".ZIP"), F.lit(".tar"), F.lit("")),
            (F.length("url") % 4 + 1).cast("int"))).alias("filename"),
        F.octet_length("html").cast("bigint").alias("bytes"),
    )
    return A.upload_admission(uploads, UPLOAD_LIMIT)


def repo_admission(spark, sf_dir):
    return A.repo_admission(read_corpus(spark, sf_dir), REPO_LIMIT)


URL_SHAPES = (
    "https://github.com/team{id}/etl-jobs", "https://github.com/team{id}/etl.jobs.git",
    "ftp://github.com/team{id}/etl", "https://github.com.example.net/team{id}/etl",
    "github.com/team{id}/etl", "https://github.com/team{id}/",
    "https://github.com/team{id}/etl/tree/main", "https://github.com/team{id}/etl?depth=1",
    "https://github.com/team{id}/etl%20jobs", " HTTPS://GITHUB.com/team{id}//etl/ ",
    "https://github.com/team{id}/.git", "https://github.com/team{id}/etl#L10",
)


def repo_url_normalize(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    shaped = F.replace(
        F.element_at(F.array(*(F.lit(u) for u in URL_SHAPES)),
                     (F.length("url") % len(URL_SHAPES) + 1).cast("int")),
        F.lit("{id}"), F.col("page_id").cast("string"))
    urls = pages.select("page_id", F.explode(F.array("url", shaped)).alias("url"))
    return A.repo_urls(urls)


# -- detection -------------------------------------------------------------------
def _detect(*groups: str) -> Query:
    return lambda spark, sf_dir: M.detect(read_corpus(spark, sf_dir), groups).select(*RAW)


def scan_findings_raw(spark, sf_dir):
    return M.detect(read_corpus(spark, sf_dir)).select(*RAW)


def content_memo_scan(spark, sf_dir):
    return H.detect_once(read_corpus(spark, sf_dir)).select(*RAW)


def memo_rescan(spark, sf_dir):
    """A memo that has seen the earlier state scans what is new, and tells all findings."""
    memo = H.ContentMemo(new_dir(spark, "memo"))
    memo.scan(_before(spark, sf_dir), 0)
    return memo.scan(read_corpus(spark, sf_dir), 1).findings.select(*RAW)


def memo_rescan_work(spark, sf_dir):
    """Contents scanned by each of four scans: the earlier state, the current one, the
    current one again, and with a new rule for Python."""
    memo = H.ContentMemo(new_dir(spark, "memo"), every=2)
    rule = R.Catalog().with_rule(CUSTOM.rules[1])
    runs = [(_before(spark, sf_dir), None), (read_corpus(spark, sf_dir), None), (read_corpus(spark, sf_dir), None),
            (read_corpus(spark, sf_dir), rule)]
    scanned = [memo.scan(files, number, catalog).scanned.withColumn("scan", F.lit(number))
               for number, (files, catalog) in enumerate(runs)]
    return reduce(DataFrame.union, scanned).groupBy("scan", "ext_scanner").agg(F.count("*").alias("n_contents"))


def dedup_findings(spark, sf_dir):
    return N.dedup(M.detect(read_corpus(spark, sf_dir))).select(*RAW)


def context_adjust(spark, sf_dir):
    return final(spark, sf_dir).select(
        "repo_id", "file", "line", "rule_id", "original_severity", "severity",
        "adjusted_severity_reason")


def findings_sorted(spark, sf_dir):
    return N.sorted_findings(final(spark, sf_dir)).select(*RAW)


def _tree(spark, sf_dir) -> str:
    """The corpus as a tree of files, hidden ones too, in the shared folder."""
    root = new_dir(spark, "corpus-tree")
    write_tree(read_corpus(spark, sf_dir), root)
    return root


def tree_inventory(spark, sf_dir):
    return I.inventory(read_tree(spark, _tree(spark, sf_dir))).select(
        "repo_id", "path", "size", "decision", "scanner_key", "file_context")


def tree_scan(spark, sf_dir):
    return M.detect(read_tree(spark, _tree(spark, sf_dir))).select(*RAW)


def stream_tree_scan(spark, sf_dir):
    """The tree as a stream: what is there is scanned as it arrives."""
    files = read_stream(spark, _tree(spark, sf_dir), settleSeconds=0)
    return _run(spark, T.stream_findings(files), new_dir(spark, "stream-tree")).select(*RAW, "adjusted_severity_reason")


# Bytes put before an ``e`` at a word's start, by document: cut-off, overlong, surrogate and too large
# characters, stray bytes, and a genuine replacement character.
DAMAGE = ("C3", "E282", "FF", "C080", "EDA080", "F4908080", "EFBFBD", "80")


def lossy_decode(spark, sf_dir):
    documents = partitioned(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    bad = F.element_at(F.array(*(F.lit(bytes.fromhex(h).decode("latin-1")) for h in DAMAGE)),
                       (F.col("doc_id") % len(DAMAGE) + 1).cast("int"))
    as_bytes = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    raw = F.encode(F.replace(as_bytes, F.lit(" e"), F.concat(F.lit(" "), bad, F.lit("e"))), "ISO-8859-1")
    return documents.select("doc_id", F.octet_length(raw).alias("n_bytes"), X.decode_utf8(raw).alias("decoded"))


def tree_single_project(spark, sf_dir):
    """The whole tree as one project."""
    files = read_tree(spark, _tree(spark, sf_dir), repo_level=0)
    return I.inventory(files).select(
        F.lit("project").alias("repo_id"), "path", "size", "decision", "file_context")


# -- scoring ---------------------------------------------------------------------
def repeat_multipliers(spark, sf_dir):
    return S.repeat_multipliers(final(spark, sf_dir)).select(
        "repo_id", "file", "line", "rule_id", "rule_pct", "severity_pct", "category_pct",
        "repeat_pct")


def finding_penalty(spark, sf_dir):
    return corpus_scan(spark, sf_dir).scored.select(
        "repo_id", "file", "line", "rule_id", "context_pct", "bucket", "penalty_units",
        "score_penalty")


def _measures(*columns: str) -> Query:
    return lambda spark, sf_dir: S.measures(corpus_scan(spark, sf_dir).scored).select(
        "repo_id", *columns)


def _scored(*columns: str) -> Query:
    return lambda spark, sf_dir: scored_repos(spark, sf_dir).select("repo_id", *columns)


def risk_summary(spark, sf_dir):
    return corpus_scan(spark, sf_dir).summary


def scan_response(spark, sf_dir):
    return corpus_scan(spark, sf_dir).findings


def scan_response_nested(spark, sf_dir):
    """One row per file; its findings in report order, each as rule, line and severity."""
    nested = nested_by_file(corpus_scan(spark, sf_dir))
    return nested.select("repo_id", "file", F.size("findings").alias("n_findings"), F.array_join(
        F.transform("findings", lambda f: F.concat_ws(":", f["rule_id"], f["line"].cast("string"), f["severity"])),
        ",").alias("findings"))


def scan_response_by_repo(spark, sf_dir):
    """Parts of three findings; the summary's score and label stand for all of it."""
    return by_repository(corpus_scan(spark, sf_dir), 3).select(
        "repo_id", "part", "n_parts", "summary.score", "summary.risk_label", "summary.total",
        F.array_join(F.transform("findings", lambda f: F.concat_ws(
            ":", f["rule_id"], f["file"], f["line"].cast("string"), f["severity"])), ",").alias("findings"))


# Rules of one query, in categories of their own.
CUSTOM = R.Catalog().with_rule(
    R.Rule("CUSTOM_CALL", "Call to watch", K.CRITICAL, "custom-call", ("python", "javascript"),
           r"\b(?:connect|charge|push|maps|upload)\(", "Review this call."),
    R.Rule("CUSTOM_EVAL_CODE", "Evaluated code", K.CRITICAL, "custom-eval", ("python",),
           r"\beval\s*\(", "Do not evaluate.", on_code=True),
    R.Rule("CUSTOM_ORIGIN", "Origin named", K.LOW, K.CORS, ("config",), "origin", "Review.",
           unless="Access", case_insensitive=True))


def detect_custom_rule(spark, sf_dir):
    return M.detect(read_corpus(spark, sf_dir), (M.EXTRA,), catalog=CUSTOM).select(*RAW)


def custom_rule_summary(spark, sf_dir):
    """New categories count in the test for catastrophic risk."""
    result = scan(read_corpus(spark, sf_dir), catalog=CUSTOM)
    return S.with_score(S.complete(S.measures(result.scored), result.stats)).select(
        "repo_id", "total", "real_critical", "catastrophic", "deduction_units", "score")


def long_files(routed: DataFrame) -> DataFrame:
    """A scanner: files of many lines, reported at their last one."""
    lines = X.lines_of(F.col("content"))
    return routed.filter(F.size(lines) > 12).select(
        "repo_id", "file", F.size(lines).alias("line"), F.lit(0).alias("disc_ord"), F.lit("CUSTOM_LONG_FILE").alias("rule_id"),
        F.lit("Long file").alias("title"), F.lit(K.MEDIUM).alias("severity"), F.lit("custom-size").alias("category"),
        F.concat(F.size(lines).cast("string"), F.lit(" lines")).alias("evidence"), F.lit("Split it.").alias("recommendation"),
        "file_context")


def detect_custom_scanner(spark, sf_dir):
    return M.detect(read_corpus(spark, sf_dir), (), catalog=R.Catalog().with_scanner(long_files)).select(*RAW)


# -- reports ---------------------------------------------------------------------
def critical_context_line(spark, sf_dir):
    return P.critical_context(risk_summary(spark, sf_dir))


def score_band(spark, sf_dir):
    return P.score_bands(risk_summary(spark, sf_dir))


def report_keys(spark, sf_dir):
    return P.report_keys(final(spark, sf_dir)).select(
        "repo_id", "file", "line", "rule_id", "file_index", "report_key")


def findings_by_file(spark, sf_dir):
    return P.findings_by_file(final(spark, sf_dir))


def top_categories(spark, sf_dir):
    return P.top_categories(final(spark, sf_dir))


def findings_rollup(spark, sf_dir):
    return P.rollup(corpus_scan(spark, sf_dir).scored)


def executive_summary(spark, sf_dir):
    result = corpus_scan(spark, sf_dir)
    return P.executive_summary(result.scored, result.stats).select(
        "repo_id", F.array_join("sentences", "\n").alias("text"))


# -- redaction, explanation --------------------------------------------------------
def redact_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return partitioned(documents, "doc_id").select("doc_id", D.redact(F.col("text")).alias("redacted"))


def redact_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", D.redact(F.col("html")).alias("redacted"))


def redact_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", D.redact(F.col("text")).alias("redacted"))


def explain_cache_keys(spark, sf_dir):
    return E.with_cache_key(final(spark, sf_dir)).select(
        "repo_id", "file", "line", "rule_id", "cache_key")


def explain_queue(spark, sf_dir):
    return E.explanation_queue(final(spark, sf_dir))


def explain_queue_misses(spark, sf_dir):
    """The cache holds what critical findings asked before."""
    queue = E.explanation_queue(materialize(final(spark, sf_dir), "findings"))
    cache = queue.filter(F.col("severity") == K.CRITICAL)
    return E.queue_misses(queue, cache).select("cache_key", "rule_id", "severity")


def _response_to(key: Column, kind: Column) -> Column:
    """A response body such as a model sends, in one of twelve kinds."""
    said = F.concat(F.lit("About "), key)
    full = F.to_json(F.struct(said.alias("explanation"), F.lit("They try it.").alias("attack_scenario"),
                              F.lit("1. Stop. 2. Fix it.").alias("fix_details")))
    text = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("```\n"), full, F.lit("```")))
        .when(kind == 3, F.lit("   "))
        .when(kind == 4, F.lit("not json"))
        .when(kind == 5, F.lit('{"explanation": "  ", "fix_details": "x"}'))
        .when(kind == 6, F.to_json(F.struct(said.alias("explanation"))))
        .when(kind == 7, F.lit("[1, 2]"))
        .when(kind == 10, F.lit('{"explanation": " ", "attack_scenario": 5, "fix_details": [1]}'))
        .otherwise(F.concat(F.lit('{"explanation": "old", "fix_details": "1. Stop. 2. Fix it.", '),
                            F.lit('"attack_scenario": "They try it.", "explanation": "'), said, F.lit('"}')))
    )
    part = F.struct(text.alias("text"))
    content = F.struct(F.array(part).alias("parts"))
    body = F.to_json(F.struct(F.array(F.struct(content.alias("content"))).alias("candidates")))
    # the body itself is no JSON, or is cut off
    return F.when(kind == 8, F.lit("upstream error")).when(
        kind == 9, F.substring(body, 1, 25)).otherwise(body)


STATUSES = (200, 200, 200, 200, 200, 200, 429, 403, 500)
ERROR_CLASSES = ("missing_key", "timeout")


def _responses(keyed: DataFrame) -> DataFrame:
    """Responses to a table with a ``cache_key``; its hash decides how they turn out."""
    digest = F.md5("cache_key")

    def pick(start: int, n: int) -> Column:
        return F.conv(F.substring(digest, start, 2), 16, 10).cast("int") % n

    return keyed.select(
        "cache_key",
        F.element_at(F.array(*(F.lit(s) for s in STATUSES)), pick(1, len(STATUSES)) + 1)
        .alias("status"),
        F.when(pick(3, 10) == 0, ERROR_CLASSES[0]).when(pick(3, 10) == 1, ERROR_CLASSES[1])
        .alias("error_class"),
        _response_to(F.col("cache_key"), pick(5, 12)).alias("body"),
    )


def parse_model_response(spark, sf_dir):
    keyed = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn", F.substring("role", 1, 1)).alias("cache_key"))
    return E.parse_responses(_responses(keyed))


def response_fallbacks(spark, sf_dir):
    return parse_model_response(spark, sf_dir).select(
        "cache_key", "error_code",
        E.has_real_content(F.col("explanation")).alias("explains"),
        E.has_real_content(F.col("fix_details")).alias("fixes"),
        E.has_real_content(*(F.col(c) for c in ("explanation", "attack_scenario", "fix_details")))
        .alias("has_content"))


def explain_joined(spark, sf_dir):
    findings = materialize(final(spark, sf_dir), "findings")
    cache = E.parse_responses(_responses(E.explanation_queue(findings)))
    return E.explained_findings(findings, cache).select(
        "repo_id", "report_key", "explanation", "error_code")


def normalize_lists(spark, sf_dir):
    """Every turn, with its sentences numbered inline as a model would."""
    text = F.col("text")
    numbered = F.regexp_replace(text, r"\. +", ". 2. ")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", E.normalize_list(numbered).alias("normalized"))


# -- incremental -------------------------------------------------------------------
def _before(spark, sf_dir) -> DataFrame:
    """An earlier state of the corpus: no Spanish files yet, no second snippets."""
    documents = table(spark, sf_dir, "documents").filter(F.col("lang") != "es")
    return corpus_from(partitioned(documents.select("doc_id", "text"), "doc_id"), second=False)


def incremental_changed_files(spark, sf_dir):
    return C.changed_keys(read_corpus(spark, sf_dir), C.manifest(_before(spark, sf_dir)))


def incremental_rescan(spark, sf_dir):
    """From the earlier state's findings, by scanning what changed, to the current ones."""
    before = _before(spark, sf_dir)

    def findings(files):
        return N.final_findings(M.detect(files, unique=True))

    return C.rescan(read_corpus(spark, sf_dir), C.manifest(before), findings(before), findings).select(
        "repo_id", "file", "line", "rule_id", "original_severity", "severity", "adjusted_severity_reason")


def scan_diff(spark, sf_dir):
    before = N.final_findings(M.detect(_before(spark, sf_dir), unique=True))
    return C.scan_diff(before, final(spark, sf_dir))


# -- streaming -----------------------------------------------------------------------
ARRIVAL_START = "2024-01-01 00:00:00"


def _file_stream(spark, sf_dir) -> DataFrame:
    # a pattern that only the table's own name fits: streams take a single file by pattern only,
    # and a table may be a folder of files as well
    documents = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    files = corpus_from(documents, extra=("doc_id",))
    # one file a second, in order of its id
    return files.withColumn("arrived_at", F.timestamp_seconds(
        F.unix_timestamp(F.lit(ARRIVAL_START)) + F.col("doc_id"))).drop("doc_id")


def _run(spark, stream: DataFrame, base: str) -> DataFrame:
    T.write_available(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_scan(spark, sf_dir):
    found = T.stream_findings(_file_stream(spark, sf_dir))
    return _run(spark, found, new_dir(spark, "stream-scan")).select(*RAW, "adjusted_severity_reason")


def stream_finding_dedup(spark, sf_dir):
    """Every file arrives twice; findings come out once."""
    found = T.stream_findings(_file_stream(spark, sf_dir))
    twice = found.withColumn("upload", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, T.dedup_stream(twice, "1 day"), new_dir(spark, "stream-dedup")).select(
        "repo_id", "file", "line", "rule_id", "severity")


def stream_late_rows(spark, sf_dir):
    """Two uploads: two thirds of the later half, then everything. What lies over a minute behind
    the first one's end is late in the second; of the rest, some is repeated and some is new."""
    landing = new_dir(spark, "uploads")
    documents = table(spark, sf_dir, "documents")
    files = corpus_from(documents, extra=("doc_id",)).withColumn("arrived_at", F.timestamp_seconds(
        F.unix_timestamp(F.lit(ARRIVAL_START)) + F.col("doc_id")))
    half = documents.agg(F.max("doc_id")).first()[0] / 2
    base = new_dir(spark, "stream-fates")
    # an upload lands in as many files as its tasks write, and a run of the stream takes all of it as one batch
    for upload in (files.filter((F.col("doc_id") >= half) & (F.col("doc_id") % 3 != 0)), files):
        upload.write.mode("append").parquet(landing)
        found = T.stream_findings(spark.readStream.schema(files.schema).parquet(landing)).select(
            "repo_id", "rule_id", "file", "line", "arrived_at")
        fates = _run(spark, T.with_fate(found, "1 minute"), base)
    return fates.select("repo_id", "rule_id", "file", "line", "fate")


def stream_explain_dedup(spark, sf_dir):
    found = T.stream_findings(_file_stream(spark, sf_dir))
    return _run(spark, T.request_stream(found, "1 day"), new_dir(spark, "stream-requests")).select(
        "cache_key", "rule_id", "severity")


def stream_finding_windows(spark, sf_dir):
    found = T.stream_findings(_file_stream(spark, sf_dir))
    base = new_dir(spark, "stream-windows")
    T.write_windows(T.windowed_counts(found, "1 minute", "1 minute"), f"{base}/out", f"{base}/checkpoint")\
        .awaitTermination()
    return T.current_windows(spark, f"{base}/out")


def stream_repo_summary(spark, sf_dir):
    base = new_dir(spark, "stream-summary")
    sink = RunningSummary(base)
    sink.start(_file_stream(spark, sf_dir).drop("arrived_at"), f"{base}/checkpoint")\
        .awaitTermination()
    return sink.latest(spark)


QUERIES: dict[str, Query] = {
    "risk_summary": risk_summary,
    "src_inventory": src_inventory,
    "file_routing": file_routing,
    "file_context": file_context,
    "scan_stats": scan_stats,
    "line_explode": line_explode,
    "evidence_snippet": evidence_snippet,
    "archive_admission": archive_admission,
    "upload_admission": upload_admission,
    "repo_admission": repo_admission,
    "repo_url_normalize": repo_url_normalize,
    "detect_js": _detect("javascript"),
    "detect_py": _detect("python"),
    "detect_config_cors": _detect("config_cors"),
    "detect_env_assign": _detect("env_assign"),
    "detect_secrets_named": _detect("secrets_named"),
    "detect_secrets_value": _detect("secrets_value"),
    "scan_findings_raw": scan_findings_raw,
    "tree_inventory": tree_inventory,
    "tree_scan": tree_scan,
    "tree_single_project": tree_single_project,
    "stream_tree_scan": stream_tree_scan,
    "lossy_decode": lossy_decode,
    "content_memo_scan": content_memo_scan,
    "memo_rescan": memo_rescan,
    "memo_rescan_work": memo_rescan_work,
    "dedup_findings": dedup_findings,
    "context_adjust": context_adjust,
    "findings_sorted": findings_sorted,
    "repeat_multipliers": repeat_multipliers,
    "finding_penalty": finding_penalty,
    "severity_counts": _measures("total", *K.SEVERITIES, "top_sev_rank"),
    "penalty_buckets": _measures(
        *(f"{b}_units" for b in
          ("production", "env_config", "test_demo", "documentation_template")),
        "low_units", "other_units"),
    "critical_buckets": _measures(
        *(f"{b}_critical" for b in
          ("production", "env_config", "test_demo", "docs_template", "generated_dependency")),
        "exposed_high"),
    "score_ceiling": _scored("score_ceiling"),
    "catastrophic_flag": _scored("catastrophic", "deduction_units", "score"),
    "scan_response": scan_response,
    "scan_response_nested": scan_response_nested,
    "scan_response_by_repo": scan_response_by_repo,
    "detect_custom_rule": detect_custom_rule,
    "custom_rule_summary": custom_rule_summary,
    "detect_custom_scanner": detect_custom_scanner,
    "findings_rollup": findings_rollup,
    "critical_context_line": critical_context_line,
    "score_band": score_band,
    "report_keys": report_keys,
    "findings_by_file": findings_by_file,
    "top_categories": top_categories,
    "executive_summary": executive_summary,
    "redact_documents": redact_documents,
    "redact_pages": redact_pages,
    "redact_conversations": redact_conversations,
    "explain_cache_keys": explain_cache_keys,
    "explain_queue": explain_queue,
    "explain_queue_misses": explain_queue_misses,
    "explain_joined": explain_joined,
    "parse_model_response": parse_model_response,
    "response_fallbacks": response_fallbacks,
    "normalize_lists": normalize_lists,
    "incremental_changed_files": incremental_changed_files,
    "incremental_rescan": incremental_rescan,
    "scan_diff": scan_diff,
    "stream_scan": stream_scan,
    "stream_finding_dedup": stream_finding_dedup,
    "stream_explain_dedup": stream_explain_dedup,
    "stream_late_rows": stream_late_rows,
    "stream_finding_windows": stream_finding_windows,
    "stream_repo_summary": stream_repo_summary,
}
