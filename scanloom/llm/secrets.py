"""Secret scan over a trigram inverted index.

For every rule a Boolean query over trigrams is derived from its regular expression: what any
match must contain. One pass over the texts writes the postings (trigram, document) of the
trigrams that some rule asks for; intersecting them per document gives the candidates of
each rule, and only those texts are searched by the rule's expression. A rule without a
mandatory trigram (hex) searches every text, in the pass that writes the postings.

Built from DataFrame operations only; the queries are derived on the driver from the
rules alone. Documents are told apart by id and text hash, so null or repeated ids
and repeated rows are each searched as they are. Null and empty texts have no spans; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import stored

STEPS_AT_ONCE = 512  # of a fold over the matches of a text
MAX_EXACT = 64  # so many spellings of a part of an expression are followed at most


@dataclass(frozen=True)
class Secret:
    """A kind of secret. Matches whose group ``group`` is shorter than ``least`` are dropped
    after matching, as a dropped match still uses up its text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in their order.
BASE = (
    Secret("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Secret("access", r"AKIA[A-Z0-9]+", 0, 18),
    Secret("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Secret("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Secret("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Secret("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Secret("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# -- Boolean trigram queries: a trigram, ("and", parts), ("or", parts), or True for no demand
def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(spellings: set[str]):
    """Any of the spellings must occur; each demands all its trigrams."""
    return _any(_all(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(spellings))


def _walk(tokens) -> tuple[set[str] | None, object]:
    """All spellings of an expression if they are few, and what its matches must contain."""
    demands, run, exact = [], {""}, True
    for op, arg in tokens:
        spelled, demand = None, True
        if op is sre.LITERAL:
            spelled = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            spelled = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            spelled, demand = _walk(arg[3])
        elif op is sre.BRANCH:
            inner = [_walk(branch) for branch in arg[1]]
            demand = _any(d for _, d in inner)
            if all(s is not None for s, _ in inner):
                spelled = set().union(*(s for s, _ in inner))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            inner, need = _walk(body)
            demand = need if least else True
            if inner is not None and most == 1:
                spelled = inner | ({""} if least == 0 else set())
            elif inner is not None and least == most and least <= 8:
                spelled = reduce(lambda a, _: {x + y for x in a for y in inner}, range(least), {""})
        elif op is sre.AT:
            spelled = {""}
        if spelled is not None and len(spelled) * len(run) <= MAX_EXACT:
            run = {a + b for a in run for b in spelled}
        else:
            demands += [_of_strings(run), demand if spelled is None else _of_strings(spelled)]
            run, exact = {""}, False
    demands.append(_of_strings(run))
    return (run if exact else None), _all(demands)


def trigram_query(pattern: str):
    """What every match of ``pattern`` contains, in trigrams of lower-cased text."""
    return _walk(sre_parser.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def _holds(query, have: str) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    parts = [_holds(q, have) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# -- matching
def spans_of(text: str, rule: Secret, number: int) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, in code points. Expressions
    give no positions, so they are summed from what lies between the matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"),
                         F.transform(found, F.length).alias("hit"),
                         F.transform(judged, F.length).alias("judged"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state, x):
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"),
                        (begin + x["hit"]).alias("end"))
        return F.struct(
            (begin + F.coalesce(x["hit"], F.lit(0))).alias("at"),
            F.when(F.coalesce(x["judged"], F.lit(-1)) >= rule.least,
                   F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def in_blocks(known: Column) -> Column:
        """A step of a fold copies what it carries, so spans are gathered block by block."""
        def block(state, first):
            inside = F.aggregate(F.slice(known, first, F.lit(STEPS_AT_ONCE)),
                                 F.struct(state["at"].alias("at"), none.alias("spans")), step)
            # a fold over one element: what is inside is worked out once
            return F.aggregate(F.array(inside), state, lambda outer, x: F.struct(
                x["at"].alias("at"), F.array_append(outer["blocks"], x["spans"]).alias("blocks")))

        start = F.struct(F.lit(0).alias("at"),
                         F.array().cast("array<array<struct<start:int,kind:int,end:int>>>").alias("blocks"))
        return F.aggregate(F.sequence(F.lit(1), F.size(known), F.lit(STEPS_AT_ONCE)), start, block,
                           lambda s: F.flatten(s["blocks"]))

    return F.when(F.col(text).rlike(rule.pattern), F.transform(F.array(steps), in_blocks)[0]).otherwise(none)


def index(docs: DataFrame, rules=RULES) -> DataFrame:
    """One pass over the texts: per document the trigrams of interest that it contains, and
    the spans of the rules that have no mandatory trigram."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*(trigrams_of(q) for q in queries)))
    folded = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"),
                         F.lower("text").alias("folded"))
    have = F.array_compact(F.array(*[
        F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array()
    plain = [spans_of("text", r, n) for n, (r, q) in enumerate(zip(rules, queries)) if q is True]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return folded.select("doc_id", "text_key", have.cast("array<string>").alias("trigrams"),
                         F.concat(none, *plain).alias("spans"))


def postings(indexed: DataFrame) -> DataFrame:
    """The inverted index: (trigram, document)."""
    return indexed.select(F.explode("trigrams").alias("trigram"), "doc_id", "text_key")


def candidates(lists: DataFrame, rules=RULES) -> DataFrame:
    """Documents in the intersection of the postings that a rule asks for: one row each,
    with the numbers of those rules. All postings of a document come from one row, so they
    are joined up before the shuffle."""
    queries = [(n, trigram_query(r.pattern)) for n, r in enumerate(rules)]
    merged = lists.groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("have"))
    hits = F.array_compact(F.array(*[
        F.when(_holds(q, "have"), F.lit(n)) for n, q in queries if q is not True]))
    return merged.select("doc_id", "text_key", hits.alias("rules")).filter(F.size("rules") > 0)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, spans): one row per document, its spans in order of start, then kind."""
    indexed = stored(index(docs, rules), "trigram-index")
    hopeful = stored(candidates(postings(indexed), rules), "secret-candidates")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    picked = texts.join(hopeful, same(texts, hopeful)).select(
        texts["doc_id"], texts["text_key"], texts["text"], hopeful["rules"])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = picked.select("doc_id", "text_key", F.concat(none, *[
        F.when(F.array_contains("rules", n), spans_of("text", r, n)).otherwise(none)
        for n, r in enumerate(rules) if trigram_query(r.pattern) is not True]).alias("found"))
    found = stored(found.filter(F.size("found") > 0), "secret-spans").dropDuplicates(["doc_id", "text_key"])
    return indexed.join(found, same(indexed, found), "left").select(
        indexed["doc_id"],
        F.array_sort(F.concat(indexed["spans"], F.coalesce(found["found"], none))).alias("spans"))


def spans_text(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
