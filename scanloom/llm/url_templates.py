"""URL filter: host and path rules, then a tree of path templates per host.

A rule fits its host and all subdomains if the path starts with the rule's; the longest one
decides. The other urls are judged by templates. Segments that look variable (numbers, long
hex strings, file names with numbers) become wildcards at once, so that what is left are path
shapes, far fewer than pages, and everything below works on counts of shapes. From the
root down, a branch is kept as it is written only if it is frequent enough and its rate of bad
labels differs from that of its siblings by more than chance; the others are merged into
a wildcard. This goes on, whatever the depth, as long as at least ``LEAST_PAGES`` pages of a
template have further segments: fewer can't be told apart, and their rest is one wildcard ``**``. A template is rejected if its share of bad labels, smoothed towards the overall
rate, reaches a threshold; without labels it has the overall rate.

Built from DataFrame operations only. A null url or one without ``://`` has empty host and
path and no rule, and is judged like any other; repeated rows keep a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import stored
from scanloom.operators.skew import lookup_join

LEAST_PAGES = 20  # a branch with fewer pages is merged with its siblings
SIGNIFICANT = 3.0  # standard deviations
PRIOR_PAGES = 10.0  # weight of the overall rate
REJECT_AT = 0.5
HOT_ROWS = 50_000  # pages of one shape that are looked up under one key


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "com"), Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits, else null. Longer is by
    host first, then by path."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
                        ).otherwise(chosen)
    return chosen


def shape_of(path: Column) -> Column:
    """Segments of a path, variable ones as ``*``."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(
        s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$") | s.rlike("^[0-9a-fA-F-]{16,}$") | s.rlike("[0-9]{4}"),
        F.lit("*")).otherwise(s))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url)`` and ``labels(page_id, bad)`` (bad: 0 or 1; pages without a
    label are simply not in it) to host, path, rule, template, bad_share and verdict."""
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    located = located.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "_shape", shape_of(F.col("path")))
    located = stored(located, "page-shapes")
    one = labels.filter("page_id is not null").groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
    shapes = (
        located.join(one, "page_id", "left").groupBy("host", F.col("_shape").alias("shape"))
        .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"),
             F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    )
    shapes = stored(shapes, "shape-counts")
    tree = templates(shapes)
    overall = shapes.agg(F.try_divide(F.sum("bad"), F.sum("labelled"))).first()[0] or 0.0
    counted = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    judged = counted.select("host", "template", (
        (F.col("bad") + PRIOR_PAGES * overall) / (F.col("labelled") + PRIOR_PAGES)).alias("bad_share"))
    verdicts = stored(
        tree.join(judged, ["host", "template"]).select(
            F.struct("host", "shape").alias("_key"), "template", "bad_share"), "template-verdicts")
    keyed = located.withColumn("_key", F.struct("host", F.col("_shape").alias("shape")))
    return lookup_join(keyed, verdicts, "_key", spread_by="page_id", hot_rows=HOT_ROWS).select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_share") >= REJECT_AT, "block").otherwise("allow"))
        .alias("verdict"),
        F.concat("host", F.lit("/"), "template").alias("template"), "bad_share")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, labelled, bad, template) of the shapes (host, shape, n, labelled, bad), level by
    level. A shape leaves the loop with its last segment, or where its siblings are too few to be told apart."""
    columns = ["host", "shape", "labelled", "bad", "template"]
    table, level, done = shapes.withColumn("template", F.lit("")), 0, []
    while True:
        level += 1
        here = table.withColumn("_seg", F.try_element_at("shape", F.lit(level)))
        branches = here.filter("_seg is not null").groupBy("host", "template", "_seg").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        parents = branches.groupBy("host", "template").agg(
            F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        own = (F.col("b") + 0.5) / (F.col("l") + 1.0)
        rest_l, rest_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        rest = (rest_b + 0.5) / (rest_l + 1.0)
        pooled = (F.col("pb") + 0.5) / (F.col("pl") + 1.0)
        spread = F.sqrt(pooled * (1.0 - pooled) * (1.0 / (F.col("l") + 1.0) + 1.0 / (rest_l + 1.0)))
        kept = (F.col("_seg") != "*") & (F.col("n") >= LEAST_PAGES) & (F.abs(own - rest) > SIGNIFICANT * spread)
        judged = branches.join(parents, ["host", "template"]).select(
            "host", "template", "_seg", kept.alias("_kept"), (F.col("pn") < LEAST_PAGES).alias("_few"))
        table = here.join(judged, ["host", "template", "_seg"], "left").select(
            *shapes.columns, (F.col("_seg").isNull() | F.col("_few")).alias("_done"),
            F.when(F.col("_seg").isNull(), F.col("template"))
            .when(F.col("_few"), F.concat("template", F.lit("**/")))
            .when(F.col("_kept"), F.concat("template", "_seg", F.lit("/")))
            .otherwise(F.concat("template", F.lit("*/"))).alias("template"))
        table = stored(table, "template-level")
        done.append(table.filter("_done").select(*columns))
        table = table.filter("not _done").drop("_done")
        if table.isEmpty():
            return reduce(DataFrame.union, done)
