"""DuckDB SQL with the results the registered queries must give.

Written separately from the Spark code and in the plainest form: no hint filter,
no lanes, one UNION ALL branch per rule, ordinary windows. Only fixed values (texts,
word lists, corpus snippets) are shared.
"""

from __future__ import annotations

from scanloom import constants as K
from scanloom.operators import rules as R
from scanloom.sources import corpus as C


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def tup(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NL = "chr(10)"


# -- corpus and inventory --------------------------------------------------------
def corpus_cte(name: str = "corpus", second: bool = True, where: str = "true") -> str:
    slots = lst(C.snippets() + [""] * (C.SNIPPET_SLOTS - len(C.snippets())))
    extra = (
        f"CASE WHEN ('0x' || substr(h, 7, 1))::INT < 8 "
        f"THEN {slots}[('0x' || substr(h, 5, 2))::INT % {C.SNIPPET_SLOTS} + 1] ELSE '' END"
        if second else "''"
    )
    return f"""{name} AS MATERIALIZED (
  SELECT *, strlen(content)::BIGINT AS size FROM (
    SELECT doc_id, 'r' || (doc_id // 5) AS repo_id,
      replace({lst(C.PATH_TEMPLATES)}[('0x' || substr(h, 3, 2))::INT % {len(C.PATH_TEMPLATES)} + 1],
              '{{d}}', doc_id::VARCHAR) AS path,
      text || {NL} || {slots}[('0x' || substr(h, 1, 2))::INT % {C.SNIPPET_SLOTS} + 1] || {NL}
        || {extra} AS content
    FROM (SELECT doc_id, text, md5(doc_id::VARCHAR) AS h FROM documents WHERE {where})))"""


def inv_cte(name: str = "inv", corpus: str = "corpus") -> str:
    keys = K.SCANNABLE_SUFFIXES
    return f"""{name} AS MATERIALIZED (
  SELECT *,
    CASE WHEN pruned THEN 'pruned_directory' WHEN skipped THEN 'not_scannable'
         WHEN size > {K.MAX_FILE_BYTES} THEN 'too_large' ELSE 'scan' END AS decision,
    CASE WHEN scanner_key IN {tup(K.PYTHON_KEYS)} THEN 'python'
         WHEN scanner_key IN {tup(K.JAVASCRIPT_KEYS)} THEN 'javascript'
         WHEN scanner_key IN {tup(K.CONFIG_KEYS)} THEN 'config' END AS ext_scanner,
    scanner_key IN {tup(keys)} AS run_secrets,
    CASE WHEN gen THEN {q(K.GENERATED)}
         WHEN real_env THEN {q(K.PRODUCTION)}
         WHEN example_env OR name IN {tup(K.README_NAMES)} THEN {q(K.EXAMPLE_TEMPLATE)}
         WHEN list_has_any(parts, {lst(K.TEST_DEMO_PARTS)}) OR starts_with(stem, 'debug')
              OR ends_with(stem, '.test') OR ends_with(stem, '.spec') THEN {q(K.TEST_DEMO)}
         WHEN list_has_any(parts, {lst(K.EXAMPLE_PARTS)}) OR ends_with(name, '.example')
              OR ends_with(name, '.sample') OR ends_with(name, '.template')
              THEN {q(K.EXAMPLE_TEMPLATE)}
         ELSE {q(K.PRODUCTION)} END AS file_context,
    list_has_any(parts, {lst(K.DEMO_FIXTURE_PARTS)}) AS is_demo_fixture,
    name IN {tup(K.README_NAMES)} OR list_has_any(parts, {lst(K.DOCUMENTATION_PARTS)})
      AS is_documentation,
    pruned OR (skipped AND gen) AS skipped_generated
  FROM (
    SELECT *,
      list_has_any(parts[1:len(parts) - 1], {lst(K.SKIP_DIRS)}) AS pruned,
      list_has_any(string_split(path, '/'), {lst(K.SKIP_DIRS)})
        OR NOT (dot_env OR ext IN {tup(keys)}) AS skipped,
      list_has_any(parts, {lst(K.GENERATED_DIRS)}) AS gen,
      dot_env AND NOT example_env AS real_env,
      CASE WHEN dot_env THEN '.env' ELSE ext END AS scanner_key,
      left(name, len(name) - len(ext)) AS stem
    FROM (
      SELECT *, name = '.env' OR starts_with(name, '.env.') AS dot_env,
        name IN {tup(K.EXAMPLE_ENV_NAMES)} AS example_env,
        CASE WHEN strpos(name[2:], '.') > 0 THEN '.' || list_last(string_split(name, '.'))
             ELSE '' END AS ext
      FROM (
        SELECT *, list_last(parts) AS name
        FROM (SELECT *, list_transform(string_split(path, '/'), lambda p: lower(p)) AS parts
              FROM {corpus})))))"""


# -- lines, evidence, values -----------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def evidence(x: str) -> str:
    s = strip(x)
    return f"(left({s}, 80) || CASE WHEN length({s}) > 80 THEN '...' ELSE '' END)"


def masked(v: str) -> str:
    return (f"(CASE WHEN {v} = '' THEN '<empty>' WHEN length({v}) <= 8 THEN '***' "
            f"ELSE left({v}, 3) || '...' || right({v}, 3) END)")


def placeholder(v: str) -> str:
    low = f"lower({v})"
    return (f"({low} IN {tup(K.PLACEHOLDER_VALUES)} OR (starts_with({low}, '<') AND "
            f"ends_with({low}, '>') AND length({low}) > 1) OR regexp_full_match({low}, 'x+') OR "
            f"regexp_full_match({low}, "
            f"'your[_-]?[a-z0-9_-]*(key|token|secret|password)[a-z0-9_-]*'))")


F_FIELD = r'\{(?:[^{}"]|\{[^{}"]*\})*\}'
TOKEN = "|".join([
    r'\b[fF]"(?:[^"\\{}\n]|\{\{|\}\}|' + F_FIELD + ')*"',
    r'"""(?:[^"\\]|\\[\s\S]|"{1,2}(?:[^"\\]|\\[\s\S]))*"""',
    r"'''(?:[^'\\]|\\[\s\S]|'{1,2}(?:[^'\\]|\\[\s\S]))*'''",
    r'"(?:[^"\\\n]|\\[\s\S])*"',
    r"'(?:[^'\\\n]|\\[\s\S])*'",
    r"#[^\n]*",
    r"\b(?:def|class)[ \t]+\w+",
])
PAREN = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
CALL = r"subprocess\s*\.\s*(?:run|call|Popen|check_call|check_output)\s*" + PAREN
STATIC = (r'^subprocess\s*\.\s*\w+\s*\(\s*(?:(?:[rRuU]?""\s*)+|'
          r'[\[(]\s*(?:[rRuU]?""\s*,?\s*)*[\])])\s*[,)]')


def lines_cte(name: str = "lines", inv: str = "inv") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (ls, code_ls, content, text), unnest(range(1, len(ls) + 1))::INT AS line,
    unnest(ls) AS txt, unnest(code_ls) AS code
  FROM (
    SELECT *, string_split(text, {NL}) AS ls, string_split(CASE WHEN ext_scanner = 'python' THEN
      array_to_string(list_transform(range(1, len(cs) + 1), lambda i: cs[i]
        || CASE WHEN left(ts[i], 2) IN ('f"', 'F"') THEN 'f""' || regexp_replace(ts[i][3:],
            {q(chr(92) + '{' + chr(92) + '{|(' + F_FIELD + ')|[^' + chr(92) + 'n]')}, '\\1', 'g')
          WHEN left(ts[i], 1) IN ('"', '''') THEN '""' || regexp_replace(ts[i], '[^\\n]+', '', 'g')
          ELSE regexp_replace(coalesce(ts[i], ''), '[^\\n]+', '', 'g') END), '') END, {NL}) AS code_ls
    FROM (
      SELECT repo_id, path AS file, content, file_context, ext_scanner, run_secrets,
        real_env, example_env, text,
        string_split_regex(text, {q(TOKEN)}) AS cs, regexp_extract_all(text, {q(TOKEN)}) AS ts
      FROM (SELECT *, replace(replace(content, chr(13) || {NL}, {NL}), chr(13), {NL}) AS text
            FROM {inv} WHERE decision = 'scan')))),
{name}_shell AS MATERIALIZED (
  SELECT repo_id, file, file_context, line,
    arg_min(CASE WHEN static_call THEN 'high' ELSE 'critical' END, n) AS severity
  FROM (
    SELECT *, 1 + sum(breaks) OVER (PARTITION BY repo_id, file ORDER BY n
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line,
      regexp_matches(piece, {q(STATIC)}) AS static_call,
      regexp_matches(regexp_replace(regexp_replace(regexp_extract(piece, {q('^' + CALL)}),
        '^subprocess\\s*\\.\\s*\\w+\\s*\\(', ''), {q(PAREN)}, '', 'g'),
        '\\bshell\\s*=\\s*True\\b') AS shell
    FROM (
      SELECT *, len(piece) - len(replace(piece, {NL}, '')) AS breaks
      FROM (
        SELECT repo_id, file, file_context, unnest(range(1, len(pieces) + 1)) AS n,
          unnest(pieces) AS piece
        FROM (
          SELECT repo_id, file, file_context, string_split(regexp_replace(
              string_agg(code, {NL} ORDER BY line), {q('(^|[^.' + chr(92) + 'w])(' + CALL + ')')},
              '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS pieces
          FROM {name} WHERE ext_scanner = 'python' GROUP BY ALL))))
  WHERE n > 1 AND shell GROUP BY repo_id, file, file_context, line)"""


def clean(v: str) -> str:
    bare = strip(f"string_split({v}, '#')[1]")
    return (f"(CASE WHEN length({bare}) >= 2 AND left({bare}, 1) = right({bare}, 1) AND "
            f"left({bare}, 1) IN ('\"', '''') THEN {strip(f'{bare}[2:-2]')} ELSE {bare} END)")


def hit(ord_, rule_id, title, severity, category, recommendation, where, src,
        shown="evidence") -> str:
    return (f"SELECT repo_id, file, line, {ord_} AS ord, {rule_id} AS rule_id, {title} AS title, "
            f"{severity} AS severity, {q(category)} AS category, {shown} AS evidence, "
            f"{q(recommendation)} AS recommendation, file_context FROM {src} WHERE {where}")


def group_branches(lines: str = "lines") -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}

    def plain(rule: R.Rule, ord_: int, subject: str, scanner: str) -> str:
        flags = "'i'" if rule.case_insensitive else "'c'"
        where = f"ext_scanner = '{scanner}' AND regexp_matches({subject}, {q(rule.pattern)}, {flags})"
        if rule.unless:
            where += "".join(f" AND NOT contains(txt, {q(w)})" for w in rule.unless.split("|"))
        return hit(ord_, q(rule.id), q(rule.title), q(rule.severity), rule.category,
                   rule.recommendation, where, lines, evidence("txt"))

    out["js"] = [plain(r, i, "txt", "javascript") for i, r in enumerate(R.JAVASCRIPT_RULES)]
    shell = hit(
        12, q(R.SUBPROCESS_RULE_ID), q(R.SUBPROCESS_TITLE), "s.severity", K.DANGEROUS_CODE,
        R.SUBPROCESS_RECOMMENDATION, "true",
        f"{lines} l JOIN {lines}_shell s USING (repo_id, file, line)", evidence("txt"),
    ).replace("file_context FROM", "l.file_context FROM")
    out["py"] = (
        [plain(r, 10 + i, "code", "python") for i, r in enumerate(R.PYTHON_CALL_RULES)]
        + [shell]
        + [plain(r, 20 + i, "txt", "python") for i, r in enumerate(R.PYTHON_LINE_RULES)]
    )
    out["config_cors"] = [
        hit(0, "'CONFIG_ENV_FILE'", q(R.ENV_FILE_TITLE), "'high'", K.EXPOSURE,
            R.ENV_FILE_RECOMMENDATION, "real_env AND ext_scanner = 'config' AND line = 1", lines,
            q(R.ENV_FILE_EVIDENCE)),
        *(plain(r, 1 + i, "txt", "config") for i, r in enumerate(R.CORS_RULES)),
    ]
    env = f"{lines}_env"
    typ = "regexp_extract(name, '(API[_-]?KEY|TOKEN|SECRET|PRIVATE[_-]?KEY|PASSWORD)', 1, 'i')"
    shown = f"name || '=' || {masked('val')}"
    out["env_assign"] = [
        hit(4, "'CONFIG_EXAMPLE_NEXT_PUBLIC_PLACEHOLDER'",
            "'NEXT_PUBLIC variable uses secret-like name'", "'low'", K.EXPOSURE,
            R.EXAMPLE_ENV_RECOMMENDATION, "example_env AND ph AND pub", env),
        hit(4, "'CONFIG_EXAMPLE_NEXT_PUBLIC_SECRET_LIKE'",
            "'Example environment file contains public secret-like variable'", "'medium'",
            K.EXPOSURE, R.EXAMPLE_ENV_RECOMMENDATION, "example_env AND NOT ph AND pub", env),
        hit(4, "'CONFIG_EXAMPLE_ENV_SECRET_LIKE_VALUE'",
            "'Example env file should use clear placeholder values'", "'low'", K.EXPOSURE,
            R.EXAMPLE_ENV_RECOMMENDATION, "example_env AND NOT ph AND NOT pub", env, shown),
        hit(4, f"'CONFIG_NEXT_PUBLIC_' || upper({typ})",
            f"'NEXT_PUBLIC_ variable with ' || lower({typ})",
            "CASE WHEN looks_real THEN 'critical' ELSE 'high' END", K.EXPOSURE,
            R.NEXT_PUBLIC_RECOMMENDATION, "NOT example_env AND pub", env),
        hit(4, "'CONFIG_ENV_SECRET_LIKE_VALUE'",
            "'Environment file contains secret-like variable'", "'high'", K.SECRETS,
            R.ENV_SECRET_RECOMMENDATION, "real_env AND NOT ph AND NOT pub", env, shown),
    ]
    named = []
    for i, name in enumerate(K.NAMED_SECRETS):
        v = (f"regexp_extract(txt, '(?:^|[^A-Za-z0-9_]){name}[\"'']?\\s*[=:]\\s*[\"'']?"
             f"([^\\s\"''#,;]{{5,}})', 1, 'i')")
        weak = (f"({placeholder(v)} OR regexp_matches({v}, "
                f"'example|placeholder|test|dummy|changeme|xxxx|your_', 'i'))")
        named.append(hit(100 + i, q(f"SECRETS_{name}"), q(R.named_secret_title(name)),
                         f"CASE WHEN {weak} THEN 'low' ELSE 'critical' END", K.SECRETS,
                         R.SECRET_RECOMMENDATION, f"run_secrets AND {v} <> ''", lines,
                         f"{q(name + '=')} || {masked(v)}"))
    out["secrets_named"] = named
    any_named = "|".join(K.NAMED_SECRETS)
    not_named = (f"NOT regexp_matches(txt, '(?:^|[^A-Za-z0-9_])(?:{any_named})[\"'']?\\s*[=:]\\s*"
                 f"[\"'']?[^\\s\"''#,;]{{5,}}', 'i')")
    values = []
    for i, rule in enumerate(R.SECRET_VALUES):
        v = f"regexp_extract(txt, {q(rule.pattern)})"
        sev = "'critical'"
        if rule.weak_is_medium:
            v = (f"coalesce(list_filter(regexp_extract_all(txt, {q(rule.pattern)}), lambda x: NOT regexp_matches("
                 f"x, 'sk_test_|test|demo|sample|fake|example', 'i'))[1], {v})")
            sev = (f"CASE WHEN regexp_matches({v}, 'sk_test_|test|demo|sample|fake|example', 'i') "
                   f"THEN 'medium' ELSE 'critical' END")
        values.append(hit(200 + i, q(rule.id), q(rule.title), sev, K.SECRETS,
                          R.SECRET_RECOMMENDATION, f"run_secrets AND {v} <> '' AND {not_named}",
                          lines, v if rule.id.endswith("_BLOCK") else masked(v)))
    out["secrets_value"] = values
    return out


def env_cte(lines: str = "lines") -> str:
    pat = (r"^\s*(?:export\s+)?([A-Z0-9_]*?(?:API_KEY|TOKEN|SECRET|PRIVATE_KEY|PASSWORD)[A-Z0-9_]*)"
           r"\s*=\s*([^\n]*)")
    return f"""{lines}_env AS MATERIALIZED (
  SELECT *, starts_with(upper(name), 'NEXT_PUBLIC_') AS pub, {placeholder('val')} AS ph,
    {evidence('txt')} AS evidence,
    length(val) >= 20 AND (regexp_matches(val, '^(sk-|ghp_|github_pat_|AIza|AKIA|ASIA)') OR (
      regexp_matches(val, '[a-z]')::INT + regexp_matches(val, '[A-Z]')::INT
      + regexp_matches(val, '[0-9]')::INT + regexp_matches(val, '[^A-Za-z0-9]')::INT >= 3
      AND len(list_distinct(string_split(val, ''))) >= 0.45 * length(val))) AS looks_real
  FROM (
    SELECT *, regexp_extract(txt, {q(pat)}, 1, 'i') AS name,
      {clean(f"regexp_extract(txt, {q(pat)}, 2, 'i')")} AS val
    FROM {lines} WHERE ext_scanner = 'config') WHERE name <> '')"""


# -- findings --------------------------------------------------------------------
SEV = "list_position(['critical', 'high', 'medium', 'low'], {}) - 1"


def findings_ctes(p: str = "", second: bool = True, where: str = "true", extra=()) -> list[str]:
    """CTEs from corpus to scored findings; ``p`` prefixes their names."""
    groups = group_branches(f"{p}lines")
    raw = "\n  UNION ALL ".join([*(b for g in groups.values() for b in g), *extra])
    name = "list_last(string_split(lower(file), '/'))"
    parts = "string_split(lower(file), '/')"
    demo = f"list_has_any({parts}, {lst(K.DEMO_FIXTURE_PARTS)})"
    doc = f"({name} IN {tup(K.README_NAMES)} OR list_has_any({parts}, {lst(K.DOCUMENTATION_PARTS)}))"
    env = (f"({name} NOT IN {tup(K.EXAMPLE_ENV_NAMES)} AND NOT {demo} AND ({name} = '.env' OR "
           f"starts_with({name}, '.env.') OR starts_with(rule_id, 'CONFIG_ENV_') OR "
           f"starts_with(rule_id, 'CONFIG_NEXT_PUBLIC_')))")
    example = (f"({name} IN {tup(K.EXAMPLE_ENV_NAMES)} OR file_context = {q(K.EXAMPLE_TEMPLATE)} "
               f"OR starts_with(rule_id, 'CONFIG_EXAMPLE_'))")
    strong = ("(contains(rule_id, 'PRIVATE_KEY') OR (starts_with(rule_id, 'SECRETS_VALUE_') AND ("
              + " OR ".join(f"contains(rule_id, {q(m)})" for m in K.HIGH_CONFIDENCE_MARKERS) + ")))")
    td, ex, pr = q(K.TEST_DEMO), q(K.EXAMPLE_TEMPLATE), q(K.PRODUCTION)
    key = "sev_rank, file, line, ord"
    return [
        corpus_cte(f"{p}corpus", second, where), inv_cte(f"{p}inv", f"{p}corpus"),
        lines_cte(f"{p}lines", f"{p}inv"), env_cte(f"{p}lines"),
        f"{p}raw AS MATERIALIZED (\n  {raw})",
        f"""{p}dedup AS MATERIALIZED (
  SELECT * FROM {p}raw
  QUALIFY row_number() OVER (PARTITION BY repo_id, rule_id, file, line ORDER BY ord) = 1)""",
        f"""{p}ctx AS MATERIALIZED (
  SELECT * EXCLUDE (severity), severity AS original_severity, least(3, {SEV.format('severity')} + steps) AS sev_rank,
    ['critical', 'high', 'medium', 'low'][least(3, {SEV.format('severity')} + steps) + 1] AS severity
  FROM (
    SELECT *, CASE WHEN env OR file_context = {pr} THEN 0
        WHEN file_context = {td} THEN CASE WHEN {strong} THEN CASE WHEN {demo} THEN 1 ELSE 0 END
             WHEN {demo} THEN 2 ELSE 1 END
        WHEN {strong} THEN 1 WHEN {doc} THEN 3 ELSE 2 END AS steps,
      CASE WHEN env THEN {q(K.REASON_ENV)} WHEN file_context = {pr} THEN {q(K.REASON_PRODUCTION)}
        WHEN file_context = {td} THEN 'test/demo context downgraded severity by ' ||
          (CASE WHEN {strong} THEN CASE WHEN {demo} THEN 1 ELSE 0 END
                WHEN {demo} THEN 2 ELSE 1 END)::VARCHAR || ' level(s)'
        WHEN {strong} THEN {q(K.REASON_EXAMPLE_SECRET)}
        WHEN {doc} THEN {q(K.REASON_DOCUMENTATION)} ELSE {q(K.REASON_EXAMPLE)} END
        AS adjusted_severity_reason
    FROM (SELECT *, {env} AS env, {example} AS example, {demo} AS demo, {doc} AS doc FROM {p}dedup)
    WHERE file_context <> {q(K.GENERATED)}))""",
        f"""{p}scored AS MATERIALIZED (
  SELECT *, least(rule_pct, severity_pct, category_pct) AS repeat_pct,
    (weight * least(rule_pct, severity_pct, category_pct) * context_pct)::BIGINT AS units
  FROM (
    SELECT *,
      CASE row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY {key})
        WHEN 1 THEN 100 WHEN 2 THEN 50 ELSE 25 END AS rule_pct,
      CASE row_number() OVER (PARTITION BY repo_id, severity ORDER BY {key})
        WHEN 1 THEN 100 WHEN 2 THEN 75 WHEN 3 THEN 55 ELSE 35 END AS severity_pct,
      CASE row_number() OVER (PARTITION BY repo_id, category ORDER BY {key})
        WHEN 1 THEN 100 WHEN 2 THEN 85 WHEN 3 THEN 65 ELSE 45 END AS category_pct,
      [24, 11, 6, 1][sev_rank + 1] AS weight,
      CASE WHEN env THEN 100 WHEN file_context = {ex} THEN CASE WHEN doc THEN 15 ELSE 30 END
           WHEN file_context = {td} THEN CASE WHEN demo THEN 25 ELSE 50 END ELSE 100 END
        AS context_pct,
      CASE WHEN env THEN 'env_config' WHEN file_context = {td} THEN 'test_demo'
           WHEN file_context = {ex} THEN 'documentation_template' ELSE 'production' END AS bucket,
      CASE WHEN env THEN 'env_config' WHEN file_context = {pr} THEN 'production'
           WHEN file_context = {td} THEN 'test_demo' ELSE 'docs_template' END AS critical_bucket
    FROM {p}ctx))""",
    ]


def summary_ctes() -> list[str]:
    pr = q(K.PRODUCTION)
    crit = "severity = 'critical'"
    cata = " OR ".join(f"contains(rule_id, {q(k)})" for k in K.CATASTROPHIC_KEYWORDS)
    exe = " OR ".join(f"contains(rule_id, {q(k)})" for k in K.CODE_EXECUTION_KEYWORDS)
    units = ", ".join(
        f"coalesce(sum(units) FILTER (bucket = '{b}'), 0)::BIGINT AS {b}_units"
        for b in ("production", "env_config", "test_demo", "documentation_template"))
    crits = ", ".join(
        f"count(*) FILTER ({crit} AND critical_bucket = '{b}') AS {b}_critical"
        for b in ("production", "env_config", "test_demo", "docs_template"))
    return [
        """stats AS (
  SELECT repo_id, count(*) FILTER (decision = 'scan')::INT AS scanned_files,
    count(*) FILTER (decision <> 'scan')::INT AS ignored_files,
    count(*) FILTER (skipped_generated)::INT AS skipped_generated_dependency_files
  FROM inv GROUP BY repo_id)""",
        f"""meas AS (
  SELECT repo_id, count(*) AS total, count(*) FILTER ({crit}) AS critical,
    count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'low') AS low, {units}, {crits}, 0 AS generated_dependency_critical,
    coalesce(sum(units) FILTER (severity = 'low'), 0)::BIGINT AS low_units,
    coalesce(sum(units) FILTER (severity <> 'low'), 0)::BIGINT AS other_units,
    count(*) FILTER (severity = 'high' AND bucket IN ('production', 'env_config')) AS exposed_high,
    count(*) FILTER ({crit} AND file_context = {pr} AND NOT example) AS confirmed,
    min(CASE WHEN env AND rule_id = 'CONFIG_ENV_FILE' THEN 85
             WHEN env AND severity IN ('high', 'critical') THEN 80
             WHEN file_context <> {pr} THEN 100
             WHEN rule_id IN ('JS_EVAL', 'PY_EVAL', 'PY_SUBPROCESS_SHELL') THEN 80
             WHEN rule_id = 'JS_LOCALSTORAGE_TOKEN' THEN 85
             WHEN severity = 'high' THEN 85 WHEN {crit} THEN 75 ELSE 100 END) AS ceiling,
    min(repeat_pct) AS least_pct, min(sev_rank) AS top_rank,
    (count(*) FILTER ({crit} AND NOT example) >= 4
      AND count(DISTINCT category) FILTER ({crit} AND NOT example) >= 2)
    OR count(*) FILTER ({crit} AND NOT example AND ({cata})) > 0
    OR count(*) FILTER ({crit} AND NOT example AND ({exe})) >= 2 AS catastrophic
  FROM scored GROUP BY repo_id)""",
        """joined AS (
  SELECT stats.*, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical,
    coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
    coalesce(production_units, 0) AS production_units,
    coalesce(env_config_units, 0) AS env_config_units,
    coalesce(test_demo_units, 0) AS test_demo_units,
    coalesce(documentation_template_units, 0) AS documentation_template_units,
    coalesce(production_critical, 0) AS production_critical,
    coalesce(env_config_critical, 0) AS env_config_critical,
    coalesce(test_demo_critical, 0) AS test_demo_critical,
    coalesce(docs_template_critical, 0) AS docs_template_critical,
    0 AS generated_dependency_critical,
    coalesce(low_units, 0) AS low_units, coalesce(other_units, 0) AS other_units,
    coalesce(exposed_high, 0) AS exposed_high, coalesce(confirmed, 0) AS confirmed,
    coalesce(ceiling, 100) AS ceiling, coalesce(least_pct, 100) AS least_pct, top_rank,
    coalesce(catastrophic, false) AS catastrophic,
    coalesce(production_critical, 0) + coalesce(env_config_critical, 0) AS exposed_critical
  FROM stats LEFT JOIN meas USING (repo_id))""",
        """s1 AS (
  SELECT *, other_units + least(low_units, 50000) AS base,
    least(ceiling, CASE WHEN exposed_high >= 4 THEN 65 WHEN exposed_high >= 2 THEN 75 ELSE 100 END)
      AS score_ceiling
  FROM joined)""",
        """s2 AS (
  SELECT *, base + CASE WHEN catastrophic AND base >= 600000 THEN 300000 ELSE 0 END
    AS deduction_units FROM s1)""",
        """s3 AS (
  SELECT *, least(score_ceiling, greatest(0, round_even((1000000 - deduction_units) / 10000.0, 0)::INT))
    AS sc0 FROM s2)""",
        """s4 AS (SELECT *, CASE WHEN sc0 < 10 AND NOT catastrophic THEN 10 ELSE sc0 END AS sc1 FROM s3)""",
        """s5 AS (SELECT *, CASE WHEN exposed_critical < 3 AND sc1 < 20 THEN 20 ELSE sc1 END AS sc2 FROM s4)""",
        """s6 AS (SELECT *, CASE WHEN critical - confirmed > confirmed AND sc2 < 40 THEN 40 ELSE sc2 END AS sc3 FROM s5)""",
        """s7 AS (SELECT *, (CASE WHEN exposed_critical = 0 AND production_units + env_config_units = 0
  AND sc3 < 50 THEN 50 ELSE sc3 END)::INT AS score FROM s6)""",
        f"""s8 AS (
  SELECT *, CASE WHEN exposed_critical >= 2 THEN {q(K.CRITICAL_RISK)}
      WHEN exposed_critical = 1 AND base_label IN ({q(K.HEALTHY)}, {q(K.LOW_RISK)}, {q(K.MODERATE_RISK)})
        THEN {q(K.HIGH_RISK)}
      WHEN exposed_high > 0 AND base_label = {q(K.HEALTHY)} THEN {q(K.LOW_RISK)}
      ELSE base_label END AS risk_label
  FROM (SELECT *, CASE WHEN total = 0 OR score >= 90 THEN {q(K.HEALTHY)}
      WHEN score >= 71 THEN {q(K.LOW_RISK)} WHEN score >= 46 THEN {q(K.MODERATE_RISK)}
      WHEN score >= 21 THEN {q(K.HIGH_RISK)} ELSE {q(K.CRITICAL_RISK)} END AS base_label FROM s7))""",
        f"""summary AS (
  SELECT repo_id, total::INT AS total, critical::INT AS critical, high::INT AS high,
    medium::INT AS medium, low::INT AS low, score, risk_label,
    CASE WHEN total = 0 THEN {q(K.MSG_CLEAN)}
      WHEN exposed_critical >= 2 THEN {q(K.MSG_MANY_CRITICAL)}
      WHEN exposed_critical = 1 THEN {q(K.MSG_ONE_CRITICAL)}
      WHEN test_demo_critical + docs_template_critical > 0 THEN {q(K.MSG_NON_PRODUCTION)}
      WHEN test_demo_units > production_units + env_config_units THEN {q(K.MSG_TEST_DEMO)}
      WHEN risk_label IN ({q(K.HIGH_RISK)}, {q(K.CRITICAL_RISK)}) THEN {q(K.MSG_HIGH_RISK)}
      ELSE {q(K.MSG_DEFAULT)} END AS warning_message,
    scanned_files, ignored_files, skipped_generated_dependency_files,
    ceil(production_units / 10000.0)::INT AS production_penalty,
    ceil(env_config_units / 10000.0)::INT AS real_env_config_penalty,
    ceil(test_demo_units / 10000.0)::INT AS test_demo_penalty,
    ceil(documentation_template_units / 10000.0)::INT AS documentation_template_penalty,
    least_pct < 100 OR low_units > 50000 AS duplicate_caps_applied,
    production_critical::INT AS production_critical_count,
    env_config_critical::INT AS env_critical_count, test_demo_critical::INT AS test_demo_critical_count,
    docs_template_critical::INT AS docs_template_critical_count,
    0::INT AS generated_dependency_critical_count
  FROM s8)""",
    ]


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# -- queries ---------------------------------------------------------------------
RAW = ("repo_id, file, line, rule_id, title, severity, category, evidence, recommendation, "
       "file_context")
REDACTED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "regexp_replace({x}, '(sk-(?:proj-)?)[A-Za-z0-9_-]{{8,}}', '\\1***', 'g'), "
    "'(sk_test_)[A-Za-z0-9_-]{{3,}}', '\\1***', 'g'), '(ghp_)[A-Za-z0-9]{{8,}}', '\\1***', 'g'), "
    "'(github_pat_)[A-Za-z0-9_]{{8,}}', '\\1***', 'g'), "
    "'(AIza)[0-9A-Za-z_-]{{8,}}', '\\1***', 'g'), "
    "'\\b((?:AKIA|ASIA)[0-9A-Z]{{8,}})\\b', '***', 'g'), "
    "'(=\\s*[\"'']?)([^\"''\\s]{{16,}})([\"'']?)', '\\1***\\3', 'g')"
)
CACHE_KEY = "sha256(rule_id || '|' || sha256(evidence) || '|' || severity)"


def _pick(start: int, n: int, key: str) -> str:
    return f"(('0x' || substr(md5({key}), {start}, 2))::INT % {n})"


def parsed_responses(key: str, source: str) -> str:
    """What parsing must give for each kind of response, stated outright."""
    from scanloom.plans import queries as Q

    status = f"[{', '.join(map(str, Q.STATUSES))}][{_pick(1, len(Q.STATUSES), key)} + 1]"
    kind = _pick(5, 12, key)
    error = (f"CASE WHEN {_pick(3, 10, key)} = 0 THEN 'missing_key' "
             f"WHEN {_pick(3, 10, key)} = 1 THEN 'timeout' "
             f"WHEN {status} = 429 THEN 'rate_limited' WHEN {status} = 403 THEN 'invalid_key' "
             f"WHEN {status} = 500 THEN 'generic' "
             f"WHEN {kind} IN (3, 5, 10) THEN 'empty_response' "
             f"WHEN {kind} IN (4, 7, 8, 9) THEN 'generic' END")

    def out(i: int, otherwise: str) -> str:
        cases = " ".join(f"WHEN error = {q(n)} THEN {q(t[i])}" for n, t in K.FALLBACKS.items())
        return f"CASE {cases} ELSE {otherwise} END"

    return f"""SELECT cache_key, {out(1, "'About ' || cache_key")} AS explanation,
  {out(2, "CASE WHEN kind = 6 THEN '' ELSE 'They try it.' END")} AS attack_scenario,
  {out(3, "CASE WHEN kind = 6 THEN '' ELSE '1. Stop. 2. Fix it.' END")} AS fix_details,
  {out(0, "''")} AS error_code
FROM (SELECT {key} AS cache_key, {error} AS error, {kind} AS kind FROM {source})"""


def oracle_sql() -> dict[str, str]:
    from scanloom.plans import queries as Q

    found = findings_ctes()
    summed = found + summary_ctes()
    groups = group_branches()
    inventory = [corpus_cte(), inv_cte()]
    base = found[:4]
    out = {}

    def inv(columns: str) -> str:
        return with_(inventory, f"SELECT {columns} FROM inv")

    out["src_inventory"] = inv("repo_id, path, size, decision")
    out["file_routing"] = inv("repo_id, path, scanner_key, ext_scanner, run_secrets")
    out["file_context"] = inv("repo_id, path, file_context, is_demo_fixture, is_documentation")
    out["scan_stats"] = with_(inventory + summary_ctes()[:1], "SELECT * FROM stats")
    lines = (f"SELECT doc_id, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS txt FROM "
             f"(SELECT doc_id, string_split(replace(replace(text, chr(13) || {NL}, {NL}), chr(13), "
             f"{NL}), {NL}) AS ls FROM documents)")
    out["line_explode"] = f"SELECT doc_id, line, length(txt)::INT AS n_chars FROM ({lines})"
    out["evidence_snippet"] = f"SELECT doc_id, line, {evidence('txt')} AS evidence FROM ({lines})"

    lim = Q.ENTRY_LIMITS
    out["archive_admission"] = with_([corpus_cte(), f"""entries AS (
  SELECT source || '-' || lang AS archive_id, doc_id AS ordinal,
    CASE WHEN n_chars % 97 = 0 THEN '/' || path WHEN n_chars % 89 = 0 THEN 'a/../../' || path
         ELSE path END AS path, n_chars % 11 = 0 AS is_dir, n_chars AS size
  FROM documents JOIN (SELECT doc_id, path FROM corpus) USING (doc_id))""", f"""judged AS (
  SELECT *, CASE WHEN starts_with(path, '/') THEN 'absolute_path'
      WHEN starts_with(path, 'a/../../') THEN 'path_escape' WHEN is_dir THEN NULL
      WHEN size > {lim['max_file_bytes']} THEN 'file_too_large'
      WHEN sum(CASE WHEN is_dir THEN 0 ELSE size END) OVER w > {lim['max_total_bytes']}
        THEN 'total_too_large'
      WHEN sum(CASE WHEN is_dir THEN 0 ELSE 1 END) OVER w > {lim['max_files']}
        THEN 'too_many_files' END AS reason
  FROM entries WINDOW w AS (PARTITION BY archive_id ORDER BY ordinal))"""],
        """SELECT archive_id, count(*) FILTER (NOT is_dir) AS n_files,
  coalesce(sum(size) FILTER (NOT is_dir), 0)::BIGINT AS total_bytes,
  count(reason) = 0 AS accepted, arg_min(reason, ordinal) FILTER (reason IS NOT NULL) AS reason,
  min(ordinal) FILTER (reason IS NOT NULL) AS reject_ordinal
FROM judged GROUP BY archive_id""")
    out["upload_admission"] = f"""SELECT page_id, filename, bytes,
  CASE WHEN NOT ends_with(lower(filename), '.zip') THEN 'not_zip'
       WHEN bytes > {Q.UPLOAD_LIMIT} THEN 'too_large' END AS reason
FROM (SELECT page_id, strlen(html)::BIGINT AS bytes,
  'upload' || page_id || ['.zip', '.ZIP', '.tar', ''][length(url) % 4 + 1] AS filename FROM pages)"""
    out["repo_admission"] = with_([corpus_cte()], f"""
SELECT repo_id, n AS n_files, n <= {Q.REPO_LIMIT} AS accepted FROM (
  SELECT repo_id, count(*) FILTER (NOT list_has_any(string_split(path, '/')[1:-2],
    {lst(K.SKIP_DIRS)})) AS n FROM corpus GROUP BY repo_id)""")
    shapes = lst(Q.URL_SHAPES)
    names = "['etl-jobs', 'etl.jobs', '', '', '', '', '', '', '', 'etl', '', '']"
    good = f"'https://github.com/team' || page_id || '/' || {names}[k] || '.git'"
    verdicts = [None, None, K.URL_SCHEME, K.URL_HOST, K.URL_SCHEME, K.URL_SHAPE, K.URL_SHAPE,
                K.URL_QUERY, K.URL_CHARS, None, K.URL_EMPTY, K.URL_QUERY]
    verdict_list = "[" + ", ".join("NULL" if v is None else q(v) for v in verdicts) + "]"
    out["repo_url_normalize"] = f"""
SELECT page_id, url, NULL::VARCHAR AS clone_url, CASE WHEN starts_with(url, 'https://')
  THEN {q(K.URL_HOST)} ELSE {q(K.URL_SCHEME)} END AS reason FROM pages
UNION ALL
SELECT page_id, replace({shapes}[k], '{{id}}', page_id::VARCHAR) AS url,
  CASE WHEN {verdict_list}[k] IS NULL THEN {good} END AS clone_url, {verdict_list}[k] AS reason
FROM (SELECT page_id, (length(url) % {len(Q.URL_SHAPES)} + 1)::INT AS k FROM pages)"""

    names = {"detect_js": "js", "detect_py": "py", "detect_config_cors": "config_cors",
             "detect_env_assign": "env_assign", "detect_secrets_named": "secrets_named",
             "detect_secrets_value": "secrets_value"}
    for name, group in names.items():
        union = "\nUNION ALL ".join(groups[group])
        out[name] = with_(base, f"SELECT {RAW} FROM ({union})")
    out["scan_findings_raw"] = with_(found[:5], f"SELECT {RAW} FROM raw")
    out["dedup_findings"] = with_(found[:6], f"SELECT {RAW} FROM dedup")
    out["context_adjust"] = with_(
        found[:7], "SELECT repo_id, file, line, rule_id, original_severity, severity, "
        "adjusted_severity_reason FROM ctx")
    out["findings_sorted"] = with_(
        found[:7], f"SELECT {RAW} FROM ctx ORDER BY repo_id, sev_rank, file, line, ord")
    out["repeat_multipliers"] = with_(
        found, "SELECT repo_id, file, line, rule_id, rule_pct, severity_pct, category_pct, "
        "repeat_pct FROM scored")
    out["finding_penalty"] = with_(
        found, "SELECT repo_id, file, line, rule_id, context_pct, bucket, units AS penalty_units, "
        "printf('%.2f', weight * (repeat_pct / 100.0) * (context_pct / 100.0))::DOUBLE AS score_penalty FROM scored")
    meas = found + summary_ctes()[:2]
    out["severity_counts"] = with_(
        meas, "SELECT repo_id, total, critical, high, medium, low, top_rank::INT AS top_sev_rank "
        "FROM meas")
    out["penalty_buckets"] = with_(
        meas, "SELECT repo_id, production_units, env_config_units, test_demo_units, "
        "documentation_template_units, low_units, other_units FROM meas")
    out["critical_buckets"] = with_(
        meas, "SELECT repo_id, production_critical, env_config_critical, test_demo_critical, "
        "docs_template_critical, 0::BIGINT AS generated_dependency_critical, exposed_high FROM meas")
    out["score_ceiling"] = with_(summed, "SELECT repo_id, score_ceiling FROM s8")
    out["catastrophic_flag"] = with_(
        summed, "SELECT repo_id, catastrophic, deduction_units, score FROM s8")
    out["risk_summary"] = with_(summed, "SELECT * FROM summary")
    out["scan_response"] = with_(
        found, f"SELECT {RAW}, original_severity, adjusted_severity_reason, "
        "printf('%.2f', weight * (repeat_pct / 100.0) * (context_pct / 100.0))::DOUBLE AS score_penalty FROM scored")
    counts = ("production_critical_count || ' production', env_critical_count || ' env/config', "
              "test_demo_critical_count || ' test/demo', "
              "docs_template_critical_count || ' docs/templates'")
    out["critical_context_line"] = with_(summed, f"""
SELECT repo_id, CASE WHEN critical = 0 THEN 'Critical issues: 0 total'
    ELSE 'Critical issues: ' || concat_ws(' · ', critical || ' total', {counts}) END AS shown_line,
  'Critical context: ' || concat_ws(', ', critical || ' total', {counts},
    '0 generated/dependencies') || '.' AS printed_line
FROM summary""")
    out["score_band"] = with_(summed, f"""
SELECT repo_id, score, CASE WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow'
  ELSE 'red' END AS band, CASE WHEN score >= 90 THEN {q(K.HEALTHY)} WHEN score >= 71
  THEN {q(K.LOW_RISK)} WHEN score >= 46 THEN {q(K.MODERATE_RISK)} WHEN score >= 21
  THEN {q(K.HIGH_RISK)} ELSE {q(K.CRITICAL_RISK)} END AS score_label FROM summary""")
    keyed = f"""keyed AS (SELECT *, (row_number() OVER (PARTITION BY repo_id, file
  ORDER BY sev_rank, line, ord) - 1)::INT AS file_index, {CACHE_KEY} AS cache_key FROM ctx)"""
    report_key = "rule_id || ':' || file || ':' || line || ':' || file_index AS report_key"
    out["report_keys"] = with_(
        found[:7] + [keyed], f"SELECT repo_id, file, line, rule_id, file_index, {report_key} "
        "FROM keyed")
    out["findings_by_file"] = with_(
        found[:7], "SELECT repo_id, file, count(*) AS n_findings, min(sev_rank)::INT AS "
        "first_sev_rank, count(*) FILTER (severity = 'critical') AS n_critical FROM ctx "
        "GROUP BY ALL")
    cats = """cats AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, pos) AS rank FROM (
    SELECT repo_id, category, count(*) AS n, min(pos) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY sev_rank, file, line, ord) AS pos
      FROM ctx) GROUP BY ALL) QUALIFY rank <= 2)"""
    out["top_categories"] = with_(
        found[:7] + [cats], "SELECT repo_id, rank::INT AS rank, replace(category, '-', ' ') AS "
        "category, n FROM cats")
    out["executive_summary"] = with_(summed + [cats, """tops AS (
  SELECT repo_id, count(*) AS n, string_agg(replace(category, '-', ' '), ', ' ORDER BY rank) AS names
  FROM cats GROUP BY repo_id)"""], f"""
SELECT repo_id, CASE WHEN total = 0 THEN
  'This scan did not detect security warnings in the analyzed source.' || {NL} ||
  'Continue reviewing secrets, environment files, generated dependencies, and deployment configuration before release.'
ELSE 'This scan detected ' || total || ' potential security warning' ||
  CASE WHEN total = 1 THEN '' ELSE 's' END || ' across the analyzed project.' || {NL} ||
  'The current security score is ' || score || ' / 100, classified as ' || risk_label || '.' || {NL} ||
  'The most serious findings are ' || CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high'
    WHEN medium > 0 THEN 'medium' ELSE 'low' END ||
  ' severity and should be reviewed before committing, deploying, or sharing this project.' || {NL} ||
  'The most common risk categor' || CASE WHEN n = 1 THEN 'y is ' ELSE 'ies are ' END || names || '.'
END AS text
FROM summary LEFT JOIN tops USING (repo_id)""")

    out["redact_documents"] = f"SELECT doc_id, {REDACTED.format(x='text')} AS redacted FROM documents"
    out["redact_pages"] = f"SELECT page_id, {REDACTED.format(x='html')} AS redacted FROM pages"
    out["redact_conversations"] = (
        f"SELECT conv_id, turn, {REDACTED.format(x='text')} AS redacted FROM conversations")
    out["explain_cache_keys"] = with_(
        found[:7], f"SELECT repo_id, file, line, rule_id, {CACHE_KEY} AS cache_key FROM ctx")
    first = f"""queue AS (
  SELECT *, {REDACTED.format(x='left(evidence, 500)')} AS redacted_evidence
  FROM (SELECT *, {CACHE_KEY} AS cache_key FROM ctx)
  QUALIFY row_number() OVER (PARTITION BY cache_key
    ORDER BY repo_id, sev_rank, file, line, ord) = 1)"""
    words = _prompt_parts()
    out["explain_queue"] = with_(found[:7] + [first], f"""
SELECT cache_key, rule_id, severity, repo_id, file, line, redacted_evidence,
  {words[0]} || title || {words[1]} || severity || {words[2]} || redacted_evidence || {words[3]}
  AS prompt FROM queue""")
    out["explain_queue_misses"] = with_(
        found[:7] + [first], "SELECT cache_key, rule_id, severity FROM queue "
        "WHERE severity <> 'critical'")
    conv = ("(SELECT conv_id || '-' || turn || '-' || left(role, 1) AS k FROM conversations)")
    out["parse_model_response"] = parsed_responses("k", conv)
    def real(c: str) -> str:
        return (f"(trim({c}) <> '' AND NOT (lower({c}) LIKE '%unavailable%' OR lower({c}) LIKE "
                f"'%not available%' OR lower({c}) LIKE '%use the recommendation shown%'))")

    out["response_fallbacks"] = f"""SELECT cache_key, error_code,
  {real('explanation')} AS explains, {real('fix_details')} AS fixes,
  {real('explanation')} OR {real('attack_scenario')} OR {real('fix_details')} AS has_content
FROM ({out['parse_model_response']})"""
    out["explain_joined"] = with_(
        found[:7] + [keyed, f"answers AS ({parsed_responses('ck', '(SELECT DISTINCT cache_key AS ck FROM keyed)')})"],
        f"SELECT repo_id, {report_key}, explanation, error_code FROM keyed LEFT JOIN answers "
        "USING (cache_key)")
    numbered = "regexp_replace(text, '\\. +', '. 2. ', 'g')"
    twice = ("regexp_replace(regexp_replace({x}, '\\.\\s+([2-9]\\.)', '.' || chr(1) || '\\1', 'g'), "
             "'\\.\\s+([2-9]\\.)', '.' || chr(1) || '\\1', 'g')")
    out["normalize_lists"] = f"""SELECT conv_id, turn, CASE WHEN
  regexp_matches(t, '(?:^|[^0-9])\\.\\s+[2-9]\\.') THEN replace({twice.format(x='t')}, chr(1), {NL})
  ELSE t END AS normalized
FROM (SELECT conv_id, turn, {strip(numbered)} AS t FROM conversations)"""

    before = findings_ctes("b_", second=False, where="lang <> 'es'")
    out["incremental_changed_files"] = with_(
        [corpus_cte(), corpus_cte("earlier", False, "lang <> 'es'")], """
SELECT repo_id, path, sha256(content) AS content_sha FROM corpus
WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE e.repo_id = corpus.repo_id
  AND e.path = corpus.path AND e.content = corpus.content)""")
    out["scan_diff"] = with_(found[:7] + before[:7], """
SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.rule_id, o.rule_id) AS rule_id,
  coalesce(n.file, o.file) AS file, coalesce(n.line, o.line) AS line,
  o.severity AS severity_before, n.severity AS severity_after,
  CASE WHEN o.repo_id IS NULL THEN 'new' WHEN n.repo_id IS NULL THEN 'fixed'
       ELSE 'severity_changed' END AS status
FROM b_ctx o FULL JOIN ctx n ON o.repo_id = n.repo_id AND o.rule_id = n.rule_id
  AND o.file = n.file AND o.line = n.line
WHERE o.severity IS DISTINCT FROM n.severity""")

    out["content_memo_scan"] = out["scan_findings_raw"]
    out["incremental_rescan"] = out["context_adjust"]
    out["tree_inventory"] = inv("repo_id, path, size, decision, scanner_key, file_context")
    out["tree_scan"] = out["scan_findings_raw"]
    out["tree_single_project"] = inv(
        "'project' AS repo_id, repo_id || '/' || path AS path, size, decision, file_context")
    out["stream_late_rows"] = with_(found[:7] + ["""timed AS (
  SELECT ctx.*, doc_id, doc_id >= (SELECT max(doc_id) FROM documents) / 2.0 AND doc_id % 3 <> 0 AS first
  FROM ctx JOIN (SELECT repo_id, path AS file, doc_id FROM corpus) USING (repo_id, file))""",
        "behind AS (SELECT max(doc_id) - 60 AS mark FROM timed WHERE first)"], """
SELECT repo_id, rule_id, file, line, 'new' AS fate FROM timed WHERE first
UNION ALL
SELECT repo_id, rule_id, file, line, CASE WHEN doc_id < mark THEN 'late' WHEN first THEN 'repeated' ELSE 'new' END
FROM timed, behind""")
    out["stream_tree_scan"] = with_(found[:7], f"SELECT {RAW}, adjusted_severity_reason FROM ctx")
    out["memo_rescan"] = with_(found[:5], f"SELECT {RAW} FROM raw")
    route = "coalesce(ext_scanner, '') AS ext_scanner, run_secrets, real_env, example_env"
    out["memo_rescan_work"] = with_(
        [corpus_cte(), inv_cte(), corpus_cte("b_corpus", False, "lang <> 'es'"), inv_cte("b_inv", "b_corpus"),
         f"contents AS (SELECT DISTINCT content, {route} FROM inv WHERE decision = 'scan')",
         f"b_contents AS (SELECT DISTINCT content, {route} FROM b_inv WHERE decision = 'scan')"], """
SELECT 0 AS scan, ext_scanner, count(*) AS n_contents FROM b_contents GROUP BY ALL
UNION ALL
SELECT 1, ext_scanner, count(*) FROM (SELECT * FROM contents EXCEPT SELECT * FROM b_contents) GROUP BY ALL
UNION ALL
SELECT 3, ext_scanner, count(*) FROM contents WHERE ext_scanner = 'python' GROUP BY ALL""")
    custom = []
    for i, rule in enumerate(Q.CUSTOM.rules):
        subject, flags = "code" if rule.on_code else "txt", "'i'" if rule.case_insensitive else "'c'"
        kinds = " OR ".join(f"ext_scanner = '{k}'" for k in rule.scanners)
        where = f"({kinds}) AND regexp_matches({subject}, {q(rule.pattern)}, {flags})"
        if rule.unless:
            where += f" AND NOT regexp_matches({subject}, {q(rule.unless)}, {flags})"
        custom.append(hit(1000 + i, q(rule.id), q(rule.title), q(rule.severity), rule.category,
                          rule.recommendation, where, "lines", evidence("txt")))
    union = "\nUNION ALL ".join(custom)
    out["detect_custom_rule"] = with_(base, f"SELECT {RAW} FROM ({union})")
    out["custom_rule_summary"] = with_(findings_ctes(extra=custom) + summary_ctes() + ["""reals AS (
  SELECT repo_id, count(*) FILTER (severity = 'critical' AND NOT example) AS real_critical FROM scored GROUP BY repo_id)"""], """
SELECT repo_id, total, coalesce(real_critical, 0) AS real_critical, catastrophic, deduction_units, score
FROM s8 LEFT JOIN reals USING (repo_id)""")
    out["detect_custom_scanner"] = with_(base, f"""SELECT {RAW} FROM (
  SELECT repo_id, file, max(line) AS line, 'CUSTOM_LONG_FILE' AS rule_id, 'Long file' AS title, 'medium' AS severity,
    'custom-size' AS category, max(line) || ' lines' AS evidence, 'Split it.' AS recommendation, file_context
  FROM lines GROUP BY ALL HAVING max(line) > 12)""")
    out["findings_rollup"] = with_(found, """
SELECT repo_id, category, severity, (GROUPING(repo_id) + GROUPING(category) + GROUPING(severity))::INT AS level,
  count(*) AS n_findings, sum(units)::BIGINT AS penalty_units, min(line)::INT AS first_line,
  count(*) FILTER (env) AS n_env_config
FROM scored GROUP BY ROLLUP (repo_id, category, severity)""")
    out["scan_response_by_repo"] = with_(summed + ["""placed AS (
  SELECT *, ((row_number() OVER (PARTITION BY repo_id ORDER BY sev_rank, file, line, ord) - 1) // 3)::INT AS part,
    count(*) OVER (PARTITION BY repo_id) AS n FROM ctx)"""], """
SELECT repo_id, coalesce(part, 0) AS part, (greatest(coalesce(n, 0) + 2, 3) // 3)::INT AS n_parts,
  CASE WHEN coalesce(part, 0) = 0 THEN any_value(score) END AS score,
  CASE WHEN coalesce(part, 0) = 0 THEN any_value(risk_label) END AS risk_label,
  CASE WHEN coalesce(part, 0) = 0 THEN any_value(total) END AS total,
  coalesce(string_agg(rule_id || ':' || file || ':' || line || ':' || severity, ',' ORDER BY sev_rank, file, line, ord), '') AS findings
FROM summary LEFT JOIN placed USING (repo_id) GROUP BY repo_id, part, n""")
    out["lossy_decode"] = lossy_decode_sql(Q.DAMAGE)
    out["scan_response_nested"] = with_(found[:7], """SELECT repo_id, file, count(*)::INT AS n_findings,
  string_agg(rule_id || ':' || line || ':' || severity, ',' ORDER BY sev_rank, line, ord) AS findings
FROM ctx GROUP BY repo_id, file""")

    out["stream_scan"] = with_(found[:7], f"SELECT {RAW}, adjusted_severity_reason FROM ctx")
    out["stream_finding_dedup"] = with_(
        found[:7], "SELECT repo_id, file, line, rule_id, severity FROM ctx")
    out["stream_explain_dedup"] = with_(
        found[:7], f"SELECT DISTINCT {CACHE_KEY} AS cache_key, rule_id, severity FROM ctx")
    out["stream_finding_windows"] = with_(found[:7] + [f"""timed AS (
  SELECT severity, TIMESTAMP '{Q.ARRIVAL_START}' + to_seconds(doc_id) AS t
  FROM ctx JOIN (SELECT repo_id, path AS file, doc_id FROM corpus) USING (repo_id, file))"""], """
SELECT time_bucket(INTERVAL 1 MINUTE, t) AS window_start,
  time_bucket(INTERVAL 1 MINUTE, t) + INTERVAL 1 MINUTE AS window_end, severity,
  count(*) AS n_findings FROM timed GROUP BY ALL""")
    out["stream_repo_summary"] = out["risk_summary"]
    return out


def lossy_decode_sql(damage) -> str:
    """Damaged bytes as hex, from which the well-formed characters are taken one by one."""
    bad = lst("".join(f"\\x{h[k:k + 2]}" for k in range(0, len(h), 2)) for h in damage)
    good = "|".join((
        "[0-7][0-9A-F] ", "(?:C[2-9A-F]|D[0-9A-F]) [89AB][0-9A-F] ", "E0 [AB][0-9A-F] [89AB][0-9A-F] ",
        "E[1-9A-CEF] [89AB][0-9A-F] [89AB][0-9A-F] ", "ED [89][0-9A-F] [89AB][0-9A-F] ",
        "F0 [9AB][0-9A-F] [89AB][0-9A-F] [89AB][0-9A-F] ",
        "F[1-3] [89AB][0-9A-F] [89AB][0-9A-F] [89AB][0-9A-F] ", "F4 8[0-9A-F] [89AB][0-9A-F] [89AB][0-9A-F] "))
    return f"""
WITH bytes AS (
  SELECT doc_id, list_reduce(list_transform(string_split(text, ' e'), lambda x: encode(x)),
    lambda a, b: a || ' '::BLOB || {bad}[doc_id % {len(damage)} + 1]::BLOB || 'e'::BLOB || b) AS raw FROM documents)
SELECT doc_id, octet_length(raw)::INTEGER AS n_bytes, decode(unhex(replace(array_to_string(
  regexp_extract_all(regexp_replace(hex(raw), '(..)', '\\1 ', 'g'), '{good}'), ''), ' ', ''))) AS decoded FROM bytes"""


def _prompt_parts() -> list[str]:
    return [q(s) for s in (
        "A scanner reported the issue below. Explain it to someone new to programming.\n\nIssue: ",
        "\nSeverity: ", "\nFlagged code: ",
        "\n\nSay why it is dangerous, how an attacker could use it, and how to fix it in "
        "numbered steps, each step on a line of its own. Use plain words and do not repeat "
        "the input.\nReturn valid JSON only, with the string keys explanation, attack_scenario and "
        "fix_details.\nKeep each value under 80 words.")]
