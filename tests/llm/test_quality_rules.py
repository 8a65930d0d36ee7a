"""The line labeller: statistics of the whole corpus, and fits from nothing."""

import random

import numpy as np
from pyspark.sql import functions as F

from scanloom.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string"
SHARED = "Subscribe to our newsletter today and never miss a thing."


def prose(rng, lines):
    return "\n".join(" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(10**6)) for _ in range(9)).capitalize()
                     + "." for _ in range(lines))


def test_a_rare_shared_line_is_seen(spark):
    rng = random.Random(1)
    shared = Q.COMMON_SHARE * 2
    rows = [(k, prose(rng, 2) + ("\n" + SHARED if k % int(1 / shared) == 0 else "")) for k in range(20_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    one = rows[1][1].split("\n")[0].encode()
    assert Q.common_lines(docs, {SHARED.encode(), one}) == {SHARED.encode()}
    # copies of one text are one text
    copies = docs.limit(300).union(spark.createDataFrame([(9, rows[1][1])] * 200, SCHEMA))
    assert one not in Q.common_lines(copies, {one})


def test_null_ids_are_judged_like_others(spark):
    rng = random.Random(2)
    texts = [prose(rng, 8) if k % 2 else "## $$ ##\n" * 20 + prose(rng, 8) for k in range(600)]
    known = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    unknown = known.withColumn("doc_id", F.lit(None).cast("bigint"))
    kept = [f.agg(F.avg(F.col("kept").cast("int"))).first()[0] for f in (Q.measure(known), Q.measure(unknown))]
    assert kept[0] > 0.4 and abs(kept[0] - kept[1]) < 0.1


def test_one_sided_fits_keep_by_the_counts(spark):
    rng = random.Random(3)
    good = spark.createDataFrame([(k, prose(rng, 10)) for k in range(20)] + [(50, "too short"), (51, None)], SCHEMA)
    assert {r.doc_id: r.kept for r in Q.measure(good).collect()} == {**{k: True for k in range(20)}, 50: False, 51: False}
    model = Q.train([])
    assert Q.viterbi(Q.features_of([b"x", b"$$$"], [1, 1]) @ model["state"], model["step"]) == [1, 1]
    same = spark.createDataFrame([(None, prose(rng, 10))] * 30, SCHEMA)
    assert all(r.kept for r in Q.measure(same).collect())
    assert Q.measure(good.limit(0)).count() == 0


def test_kept_follows_the_best_labelling(spark):
    """Content share and ``kept`` of the fitted field, against all labellings of short documents."""
    import itertools

    rng = random.Random(4)
    rows = [(k, "\n".join(rng.choice([prose(rng, 1), "$$ ** ##", "MENU HOME ABOUT", prose(rng, 1)]) for _ in range(7))) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = Q.fit(docs)
    got = {r.doc_id: r for r in Q.measure(docs, model).collect()}
    for k, text in rows:
        lines, words = Q._lines(text.encode())
        score = Q.features_of(lines, words) @ model["state"]
        def value(path):
            return sum(score[i, s] for i, s in enumerate(path)) + sum(model["step"][a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        share = sum(w for w, s in zip(words, best) if s) / sum(words)
        assert np.isclose(got[k].content_share, share)
        assert got[k].kept == (not got[k].base_failed and share >= Q.LEAST_CONTENT)
