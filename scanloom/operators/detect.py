"""Rule matching: files in, raw findings out, with no shuffle.

One pass over the content: lines are generated, a cheap hint pattern drops
almost all of them, and the catalog runs on the few that are left. The content
column does not travel past the line generator.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import constants as K
from scanloom.functions import paths as P, text as X, values as V
from scanloom.operators import inventory as I, rules as R
from scanloom.schemas import RAW_FINDING_COLUMNS

# -- Python subprocess calls ---------------------------------------------------
# Calls may span lines, so they are found in the whole masked source; a marker
# character is put before each, and the line split then tells the line.
_DYNAMIC, _STATIC = "\x01", "\x02"


_CALL_HEAD = r"subprocess\s*\.\s*(?:run|call|Popen|check_call|check_output)\s*\("
# What the scan for calls stops at: a call's head, an argument that is exactly
# shell=True, and brackets of all kinds.
_STOPS = (
    rf"(?<![\w.]){_CALL_HEAD}|(?<=[(,\s])shell\s*=\s*True(?=\s*[,)])|[\[({{\])}}]"
)
_LITERAL_FIRST_ARG = (
    r'\s*+(?:(?:[rRuU]?""\s*+)++|[\[(]\s*+(?:[rRuU]?""\s*+,?+\s*+)*+[\])])\s*+[,)]'
)


def _may_call(text: Column) -> Column:
    """Could Python source hold a call that a rule looks for? Only such files are masked."""
    bare = F.contains(text, F.lit("eval")) | F.contains(text, F.lit("exec"))
    shell = F.contains(text, F.lit("subprocess")) & F.contains(text, F.lit("shell"))
    return (bare & text.rlike(r"(?:^|[^.\w])e(?:val|xec)\s*\(")) | shell


_STOPS_AT_ONCE = 512


def _shell_calls(code: Column) -> Column:
    """For each of the subprocess calls in masked source, has it shell=True among its own
    arguments? One walk over the brackets from the end: there a call's arguments come before
    its head, so its answer is known when the head is met, and the answers come in order. The walk
    keeps the depth, and the depths at which an open bracket holds the flag, so nesting may go as
    deep as it likes. A step of a fold copies what it carries, so answers are gathered block by block."""
    none, blocks_type = F.array().cast("array<boolean>"), "array<array<boolean>>"

    def step(at: Column, stop: Column) -> Column:
        head, flag, close = stop.startswith("subprocess"), stop.startswith("shell"), stop.isin(")", "]", "}")
        depth, flagged, answers = at["depth"], at["flagged"], at["answers"]
        return F.struct(
            F.when(flag, depth).when(close, depth + 1).otherwise(F.greatest(depth - 1, F.lit(0))).alias("depth"),
            F.when(close | (flag & (depth == 0)), flagged).when(flag, F.array_append(flagged, depth))
            .when(F.size(flagged) == 0, flagged).otherwise(F.array_remove(flagged, depth)).alias("flagged"),
            F.when(head, F.array_append(answers, F.array_contains(flagged, depth))).otherwise(answers).alias("answers"))

    def blocks(stops: Column) -> Column:
        def block(at: Column, first: Column) -> Column:
            inside = F.aggregate(
                F.slice(stops, first, F.lit(_STOPS_AT_ONCE)),
                F.struct(at["depth"].alias("depth"), at["flagged"].alias("flagged"), none.alias("answers")), step)
            # a fold over one element: what is inside is worked out once
            return F.aggregate(F.array(inside), at, lambda outer, x: F.struct(
                x["depth"].alias("depth"), x["flagged"].alias("flagged"),
                F.array_append(outer["blocks"], x["answers"]).alias("blocks")))

        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("flagged"),
                         F.array().cast(blocks_type).alias("blocks"))
        firsts = F.sequence(F.lit(1), F.size(stops) + 1, F.lit(_STOPS_AT_ONCE))
        return F.aggregate(firsts, start, block, lambda at: F.reverse(F.flatten(at["blocks"])))

    stops = F.reverse(F.regexp_extract_all(code, F.lit(_STOPS), F.lit(0)))
    return F.transform(F.array(stops), blocks)[0]


def marked_shell_calls(code: Column) -> Column:
    """Masked source with a marker before every subprocess call that uses a shell."""
    # the blank in front keeps the first part from being a call itself
    parts = F.split(F.concat(F.lit(" "), code), rf"(?<![\w.])(?={_CALL_HEAD})", -1)
    marked = F.array_join(F.zip_with(
        parts, F.concat(F.array(F.lit(False)), _shell_calls(code)),
        lambda part, shell: F.when(shell, F.concat(F.lit(_DYNAMIC), part)).otherwise(part)), "")
    return F.regexp_replace(
        F.substring(marked, 2, 1 << 30), f"{_DYNAMIC}(?={_CALL_HEAD}{_LITERAL_FIRST_ARG})", _STATIC
    )


# -- hits ----------------------------------------------------------------------
# What a line matches is a small struct: ordinal, catalog key, and the matched value
# where there is one. The conditions are SQL text with literal patterns; texts,
# severities and evidence are looked up and worked out afterwards, on hits only.
_HIT_TYPE = "struct<disc_ord:int,key:string,value:string>"
_ENTRY_TYPE = ("struct<rule_id:string,title:string,severity:string,category:string,"
               "recommendation:string,shows:string>")


def _regex(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _hit(condition: str, ord_, key: str, value: str = "cast(null as string)") -> str:
    return (f"CASE WHEN {condition} THEN named_struct('disc_ord', cast({ord_} AS int), "
            f"'key', {key}, 'value', {value}) END")


def _rule_hit(rule: R.Rule, ord_, key: str | None = None) -> str:
    subject = "code" if rule.on_code else "text_line"
    gates = " OR ".join(
        "run_secrets" if s == "secrets" else f"ext_scanner = '{s}'" for s in rule.scanners
    )
    condition = f"({gates}) AND {subject} RLIKE {_regex(rule.regex)}"
    if rule.unless:
        condition += f" AND NOT {subject} RLIKE {_regex(rule.unless)}"
    return _hit(condition, ord_, f"'{key or rule.id}'")


# Within one line a file's extension scanner reports before the secret rules.
_ORD_LINE_RULES, _ORD_SECRETS, _ORD_EXTRA = 1_000_000_000, 1_100_000_000, 1_200_000_000


def _python_hits() -> list[str]:
    # calls report in source order, so their ordinal is their column
    calls = [
        _rule_hit(r, f"regexp_instr(code, {_regex(r.regex)})") for r in R.PYTHON_CALL_RULES
    ]
    marker = _regex(r"[\x01\x02]")
    shell = _hit(
        f"code RLIKE {marker}", f"regexp_instr(code, {marker})",
        f"if(regexp_extract(code, {marker}, 0) = char(2), "
        f"'{R.SUBPROCESS_RULE_ID}:static', '{R.SUBPROCESS_RULE_ID}')",
    )
    lines = [_rule_hit(r, _ORD_LINE_RULES + i) for i, r in enumerate(R.PYTHON_LINE_RULES)]
    return [*calls, shell, *lines]


def _javascript_hits() -> list[str]:
    return [_rule_hit(r, i) for i, r in enumerate(R.JAVASCRIPT_RULES)]


def _config_hits() -> list[str]:
    env_file = _hit("ext_scanner = 'config' AND real_env AND pos = 0", 0, "'CONFIG_ENV_FILE'")
    cors = [_rule_hit(r, 1 + i, f"{r.id}:{i}") for i, r in enumerate(R.CORS_RULES)]
    return [env_file, *cors]


def _assignment_hits() -> list[str]:
    """At most one finding per assignment line; uses the ``env_*`` columns."""
    cases = {
        "CONFIG_EXAMPLE_NEXT_PUBLIC_PLACEHOLDER": "example_env AND env_public AND env_placeholder",
        "CONFIG_EXAMPLE_NEXT_PUBLIC_SECRET_LIKE":
            "example_env AND env_public AND NOT env_placeholder",
        "CONFIG_EXAMPLE_ENV_SECRET_LIKE_VALUE":
            "example_env AND NOT env_public AND NOT env_placeholder",
        "CONFIG_NEXT_PUBLIC": "NOT example_env AND env_public",
        "CONFIG_ENV_SECRET_LIKE_VALUE": "real_env AND NOT env_public AND NOT env_placeholder",
    }
    return [_hit(f"env_name <> '' AND {c}", 4, f"'{key}'", "env_value")
            for key, c in cases.items()]


def _named_secret_hits() -> list[str]:
    return [
        _hit(f"named AND text_line RLIKE {pattern}", _ORD_SECRETS + i, f"'SECRETS_{name}'",
             f"regexp_extract(text_line, {pattern}, 1)")
        for i, name in enumerate(K.NAMED_SECRETS)
        for pattern in [_regex(R.named_secret_pattern(name))]
    ]


def _secret_value_hits() -> list[str]:
    """One finding per line and pattern, of the line's worst match: the first that is no
    test value, if there is one. (Our choice: a test key must not hide a real one.)"""
    def worst(rule: R.SecretValue, pattern: str) -> str:
        first = f"regexp_extract(text_line, {pattern}, 0)"
        if not rule.weak_is_medium:
            return first
        return (f"coalesce(get(filter(regexp_extract_all(text_line, {pattern}, 0), "
                f"v -> NOT v RLIKE {_regex(R.WEAK_VALUE)}), 0), {first})")

    return [
        _hit(f"run_secrets AND NOT named AND text_line RLIKE {pattern}", _ORD_SECRETS + 100 + i,
             f"'{rule.id}'", worst(rule, pattern))
        for i, rule in enumerate(R.SECRET_VALUES)
        for pattern in [_regex(rule.pattern)]
    ]


GROUPS = {
    "python": _python_hits,
    "javascript": _javascript_hits,
    "config_cors": _config_hits,
    "env_assign": _assignment_hits,
    "secrets_named": _named_secret_hits,
    "secrets_value": _secret_value_hits,
}
EXTRA = "extra"  # the rules of the catalog


def _group_hits(group: str, catalog: R.Catalog) -> list[str]:
    if group == EXTRA:
        return [_rule_hit(r, _ORD_EXTRA + i) for i, r in enumerate(catalog.rules)]
    return GROUPS[group]()


def _texts(catalog: R.Catalog) -> Column:
    """Texts and severities by key: one literal map, folded at planning time."""
    return F.from_json(F.lit(json.dumps(catalog.entries())), f"map<string,{_ENTRY_TYPE}>")


def _with_entries(hits: Column, catalog: R.Catalog) -> Column:
    """Each hit with its catalog entry, looked up once: what is exploded is computed before the
    rows that use it, so the map is not copied into every expression over them."""
    return F.transform(hits, lambda h: F.struct(
        h["disc_ord"].alias("disc_ord"), h["value"].alias("value"), _texts(catalog)[h["key"]].alias("entry")))


def _severity() -> Column:
    """Catalog severity, unless the value itself says otherwise."""
    shows, value = F.col("entry.shows"), F.col("hit.value")
    weak_name = V.is_placeholder(value) | value.rlike(R.WEAK_NAMED_VALUE)
    return (
        F.when((shows == "public") & V.looks_real(value), K.CRITICAL)
        .when((shows == "named") & weak_name, K.LOW)
        .when((shows == "weak_value") & value.rlike(R.WEAK_VALUE), K.MEDIUM)
        .otherwise(F.col("entry.severity"))
    )


def _evidence() -> Column:
    shows, value = F.col("entry.shows"), F.col("hit.value")
    named = F.replace(F.col("entry.rule_id"), F.lit("SECRETS_"), F.lit(""))
    return (
        F.when(shows == "env_file", R.ENV_FILE_EVIDENCE)
        .when(shows == "block", value)
        .when(shows == "assignment", F.concat("env_name", F.lit("="), V.masked(value)))
        .when(shows == "named", F.concat(named, F.lit("="), V.masked(value)))
        .when(shows.isin("value", "weak_value"), V.masked(value))
        .otherwise(X.evidence(F.col("text_line")))
    )


# -- plan ----------------------------------------------------------------------
def admitted(files: DataFrame, carry=(), max_file_bytes: int | None = K.MAX_FILE_BYTES) -> DataFrame:
    """Files to scan, routed and classified. Path and size decide, before any
    expression touches the content. ``carry`` names more file columns to keep."""
    path = F.col("path")
    key = P.scanner_key(path)
    return (
        I.with_decision(files, max_file_bytes)
        .filter(F.col("decision") == I.SCAN)
        .select(
            "repo_id", P.unix_path(path).alias("file"), "content",
            P.scanner_of(key).alias("ext_scanner"), P.runs_secrets(key).alias("run_secrets"),
            P.file_context(path).alias("file_context"), *carry,
        )
    )


def candidate_lines(routed: DataFrame, carry=(), catalog: R.Catalog | None = None) -> DataFrame:
    """The lines that may match a rule, with their masked code where it matters."""
    extra = (catalog or R.current()).rules
    masks = (F.col("ext_scanner") == "python") & _may_call(F.col("text"))
    if any(rule.on_code for rule in extra):
        masks = F.col("ext_scanner") == "python"
    hint = F.col("text_line").rlike(R.LINE_HINTS)
    for rule in extra:
        hint = hint | (F.col("code").rlike(rule.regex) if rule.on_code
                       else F.col("text_line").rlike(rule.regex))
    name = P.filename(F.col("file"))
    keep = ["repo_id", "file", "file_context", "ext_scanner", "run_secrets", "real_env",
            "example_env", *carry]
    return (
        routed
        .withColumns({
            "text": X.unix_newlines(F.col("content")),
            "real_env": P.is_real_env_name(name),
            "example_env": P.is_example_env_name(name),
        })
        .withColumn("masked", F.when(
            masks, X.mask_python(F.translate("text", _DYNAMIC + _STATIC, "  "))))
        .withColumn("code_lines", F.split(
            F.when(F.contains("masked", F.lit("subprocess")), marked_shell_calls(F.col("masked")))
            .otherwise(F.col("masked")), "\n", -1))
        # a line and its masked code leave together: no row carries all lines of its file
        .select(*keep, F.posexplode(F.arrays_zip(
            F.split("text", "\n", -1).alias("text"),
            F.coalesce("code_lines", F.array().cast("array<string>")).alias("code"))).alias("pos", "both"))
        .select(*keep, "pos", F.col("both.text").alias("text_line"), F.col("both.code").alias("code"))
        .filter(hint | (F.col("real_env") & (F.col("pos") == 0)))
        .select(*keep, "pos", "text_line", "code")
    )


def _first_of_rule(hits: Column) -> Column:
    def rule(hit: Column) -> Column:
        return F.substring_index(hit["key"], ":", 1)

    return F.filter(hits, lambda h, i: ~F.exists(
        F.slice(hits, F.lit(1), i), lambda earlier: rule(earlier) == rule(h)
    ))


def match_rules(lines: DataFrame, groups=(*GROUPS, EXTRA), unique: bool = False,
                carry=(), catalog: R.Catalog | None = None) -> DataFrame:
    """Raw findings of the candidate lines, for some or all rule groups.

    ``unique`` keeps only the first finding of a rule on a line. Where every file is
    listed once this is all the de-duplication there is to do.
    """
    catalog = catalog or R.current()
    is_config = F.col("ext_scanner") == "config"
    any_name = "|".join(K.NAMED_SECRETS)
    hits = [h for g in groups for h in _group_hits(g, catalog)] or [f"cast(null AS {_HIT_TYPE})"]
    staged = (
        lines
        .withColumns({
            "env_name": F.when(
                is_config, F.regexp_extract("text_line", R.ENV_ASSIGNMENT, 1)).otherwise(""),
            "named": F.col("run_secrets") & F.col("text_line").rlike(
                f"(?i){R.NOT_IN_A_WORD}(?:{any_name}){R.SECRET_VALUE_AFTER_NAME}"),
        })
        .withColumn("env_value", F.when(
            F.col("env_name") != "",
            V.clean_value(F.regexp_extract("text_line", R.ENV_ASSIGNMENT, 2))))
        .withColumns({
            "env_placeholder": V.is_placeholder(F.col("env_value")),
            "env_public": F.upper("env_name").startswith("NEXT_PUBLIC_"),
        })
    )
    # What is exploded must be an expression: for a bare column Spark would infer a
    # non-empty filter, push it down, and match every rule a second time there.
    found = F.expr(f"filter(array({', '.join(hits)}), h -> h IS NOT NULL)")
    if unique:
        staged = staged.withColumn("hits", found)
        found = _first_of_rule(F.col("hits"))
    public, kind = F.col("entry.shows") == "public", V.secret_type(F.col("env_name"))
    return (
        staged.withColumn("hit", F.explode(_with_entries(found, catalog)))
        .withColumn("entry", F.col("hit.entry"))
        .select(
            "repo_id", "file", (F.col("pos") + 1).cast("int").alias("line"), "hit.disc_ord",
            F.when(public, F.concat("entry.rule_id", F.upper(kind)))
            .otherwise(F.col("entry.rule_id")).alias("rule_id"),
            F.when(public, F.concat("entry.title", F.lower(kind)))
            .otherwise(F.col("entry.title")).alias("title"),
            _severity().alias("severity"), "entry.category", _evidence().alias("evidence"),
            "entry.recommendation", "file_context", *carry,
        )
    )


def detect(files: DataFrame, groups=(*GROUPS, EXTRA), unique: bool = False, carry=(),
           max_file_bytes: int | None = K.MAX_FILE_BYTES, catalog: R.Catalog | None = None) -> DataFrame:
    """Raw findings of a files table; a rule may report one line more than once. ``catalog`` holds
    further rules and scanners; without one, those that the session has registered."""
    catalog = catalog or R.current()
    routed = admitted(files, carry, max_file_bytes)
    raw = match_rules(candidate_lines(routed, carry, catalog), groups, unique, carry, catalog)
    for scanner in catalog.scanners:
        raw = raw.unionByName(scanner(routed).select(*RAW_FINDING_COLUMNS, *carry))
    return raw
