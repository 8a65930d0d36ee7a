"""Nothing is lost to depth, size or repetition."""

import random
from collections import Counter

from pyspark.sql import functions as F

from scanloom.llm import mixing, near_copies, simhash, url_templates


def test_branches_differ_at_any_depth(spark):
    rows, labels = [], []
    for n in range(200):
        for k, (kind, bad) in enumerate((("casino", 1), ("news", 0))):
            page = 2 * n + k
            rows.append((page, f"http://site.org/a/b/c/d/e/{kind}/x{n}/y"))
            labels.append((page, bad))
    judged = url_templates.judge(spark.createDataFrame(rows, "page_id bigint, url string"),
                                 spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert Counter((r.verdict, "/casino/" in r.path) for r in judged) == {("block", True): 200, ("allow", False): 200}


def test_few_pages_share_a_tail(spark):
    rows = [(n, f"http://site.org/{'/'.join('abc' * (n + 1))}") for n in range(15)] + [(99, "http://site.org/"), (100, None)]
    judged = url_templates.judge(spark.createDataFrame(rows, "page_id bigint, url string"),
                                 spark.createDataFrame([], "page_id bigint, bad int")).collect()
    assert {r.template for r in judged} == {"site.org/**/", "site.org/", "/"}


def test_a_small_source_takes_its_target(spark):
    rows = [(k, "w " * 1000, "a") for k in range(400)] + [(1000 + k, "w " * 20, "b") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    # blocks of 4,002 words: the small source has 200, its target is three times that
    mixed = mixing.mix(docs, weights=(1, 1), blocks=100).documents.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r.source: (r.taken, r.target) for r in mixed} == {"a": (399_600, 399_600.0), "b": (600, 600.0)}


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "w " * 200, "a", "x")] * 50 + [(k, "w " * 90, "b", "x") for k in range(2, 30)] + [(None, "w w", None, "x")] * 7
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, row string").repartition(4)
    mixed = mixing.mix(docs)
    target = {r.source: r.target for r in mixed.goals.collect()}
    got = mixing.apply(docs)
    assert got.columns == docs.columns
    copies = Counter((r.doc_id, r.source) for r in got.collect())
    assert abs(copies[1, "a"] * 200 - target["a"]) < 200
    assert abs(copies[None, None] * 2 - target[None]) < 2
    assert abs(sum(n for (_, s), n in copies.items() if s == "b") * 90 - target["b"]) < 28 * 90 ** 0.5 * 9


def test_documents_take_the_words_awarded(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 60), rng.choice("abbbccccccc")) for k in range(200)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    goals = {r.source: r for r in mixing.words_awarded(mixed.goals).collect()}
    given = Counter()
    while True:  # one by one to the highest quotient, as long as that reaches the divisor
        best = max(goals, key=lambda s: goals[s].target / (2 * given[s] + 1))
        if goals[best].target / (2 * given[best] + 1) < 0.5:
            break
        given[best] += 1
    taken = Counter()
    for r in mixed.documents.collect():
        taken[r.source] += r.taken
    assert +taken == given == +Counter({s: r.wanted for s, r in goals.items()})
    assert abs(sum(given.values()) - goals["a"].total) < len(goals)


def test_simhash_links_are_copies(spark):
    """Two texts with fingerprints two bits apart or less, whose shingles are less alike."""
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.getrandbits(40):x}" for _ in range(n)]

    base = words(40) * 20
    tail = next(t for t in iter(lambda: words(20), None) if bin(int.from_bytes(
        simhash.fingerprints_of([" ".join(base).encode(), " ".join(base + t).encode()]).tobytes()[:8], "little") ^ int.from_bytes(
        simhash.fingerprints_of([" ".join(base + t).encode()]).tobytes(), "little")).count("1") <= 2)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base + tail)), (3, " ".join(words(300)))], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in near_copies.drop_copies(docs).collect()} == {1, 3}
