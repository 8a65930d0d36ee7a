"""The registered queries of this subpackage, with their production parameters.

``sql`` has the SQL of some of them. The results of the others hang on hashes, trained weights or
libraries that DuckDB lacks: ``tests/llm`` compares them with brute force, round trips and
held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom.llm import (
    decontaminate, divergence, kneser_ney, language_id, mixing, prefix_trie, quality, quality_rules, secrets, sharding, simhash,
    token_planes, url_templates,
)
from scanloom.llm.common import id_remainder, read
from scanloom.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def op1_sharding(spark, sf_dir) -> DataFrame:
    return sharding.shard_table(read(spark, sf_dir, "documents"), shards=40)


def op2_language_id(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 3)
    model = language_id.fit(docs, remainder != 1)
    return language_id.predict(docs, model).select(
        "doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score")


def op3_token_planes(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return token_planes.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op4_decontaminate(spark, sf_dir) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_simhash(spark, sf_dir) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))

    def count(number: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
                        secrets.spans_text(F.col("spans")).alias("spans"))


def op7_mixing(spark, sf_dir) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).documents.select(
        "doc_id", "size", "source_size", "target", "taken")


def page_labels(spark, sf_dir) -> DataFrame:
    """Labels of pages: the last number in a page's path is the document it shows."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]+)(?:\.[A-Za-z]+)?/?$", 1).try_cast("bigint")
    return pages.select("page_id", number.alias("doc_id")).join(
        labels.filter("quality is not null"), "doc_id").select("page_id", (1 - F.col("quality")).alias("bad"))


def op8_url_templates(spark, sf_dir) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"), page_labels(spark, sf_dir)).select(
        "page_id", "host", "path", "rule", "verdict", "template", "bad_share")


def op9_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 5)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), remainder != 0)
    return quality.score(docs, model).select(
        "doc_id", (remainder == 0).alias("held_out"), "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    return quality_rules.measure(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op12_kneser_ney(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 7)
    model = kneser_ney.fit(docs, remainder != 2)
    return kneser_ney.score(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_divergence(spark, sf_dir) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_language_id, op3_token_planes, op4_decontaminate, op5_simhash, op6_secrets,
    op7_mixing, op8_url_templates, op9_quality, op10_quality_rules, op11_prefix_trie,
    op12_kneser_ney,     op13_divergence)}
