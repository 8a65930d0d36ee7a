"""The rule catalog.

A rule is data; ``detect`` turns the catalog into literal column expressions, so
each pattern is compiled once per task and no rules table is joined to lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from scanloom import constants as K


@dataclass(frozen=True)
class Rule:
    """One finding per line that matches ``pattern`` and not ``unless``.

    ``scanners`` names the file kinds it applies to: python, javascript, config,
    or secrets (every scannable text file). ``on_code`` matches Python source with
    strings and comments masked instead of the raw line.
    """

    id: str
    title: str
    severity: str
    category: str
    scanners: tuple[str, ...]
    pattern: str
    recommendation: str
    unless: str | None = None
    case_insensitive: bool = False
    on_code: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.case_insensitive else "") + self.pattern


def _js(id_: str, pattern: str, severity: str, title: str, recommendation: str) -> Rule:
    return Rule(id_, title, severity, K.DANGEROUS_CODE, ("javascript",), pattern,
                recommendation, case_insensitive=True)


def _py(id_: str, pattern: str, severity: str, title: str, recommendation: str, **kw) -> Rule:
    return Rule(id_, title, severity, K.DANGEROUS_CODE, ("python",), pattern, recommendation, **kw)


# -- fixed values: patterns, titles, severities, recommendations ---------------
JAVASCRIPT_RULES = (
    _js("JS_EVAL", r"\beval\s*\(", K.HIGH, "eval() usage detected",
        "Replace eval() with safer alternatives like Function() with restricted scope or "
        "JSON.parse()."),
    _js("JS_NEW_FUNCTION", r"\bnew\s+Function\s*\(", K.HIGH, "new Function() detected",
        "Avoid dynamic code execution. Use safer alternatives or pre-compiled functions."),
    _js("JS_CHILD_PROCESS_EXEC",
        r"(?:child_process|require\(['\"]child_process['\"])\s*\.\s*exec\s*\(", K.CRITICAL,
        "child_process.exec() with shell execution detected",
        "Use child_process.execFile() instead, which doesn't spawn a shell. Or use safer "
        "alternatives."),
    _js("JS_DANGEROUS_INNER_HTML", r"dangerouslySetInnerHTML\s*=\s*\{", K.HIGH,
        "dangerouslySetInnerHTML usage",
        "Sanitize HTML with libraries like DOMPurify before using dangerouslySetInnerHTML, or "
        "use safer alternatives."),
    _js("JS_LOCALSTORAGE_TOKEN",
        r"localStorage\.setItem\s*\(\s*['\"](?:token|jwt|auth|session|access_token)['\"]", K.HIGH,
        "Token stored in localStorage",
        "Tokens should not be stored in localStorage. Use httpOnly cookies or secure session "
        "storage."),
)
PYTHON_CALL_RULES = (
    _py("PY_EVAL", r"(?:^|[^.\w])eval\s*\(", K.HIGH, "eval() usage detected",
        "Replace eval() with safer alternatives like ast.literal_eval() for data parsing.",
        on_code=True),
    _py("PY_EXEC", r"(?:^|[^.\w])exec\s*\(", K.CRITICAL, "exec() usage detected",
        "Avoid exec(). Use safer alternatives or pre-compiled code.", on_code=True),
)
PYTHON_LINE_RULES = (
    _py("PY_PICKLE", r"pickle\.loads\s*\(", K.HIGH, "pickle.loads() usage detected",
        "pickle.loads() can execute arbitrary code. Use safer serialization formats like JSON."),
    _py("PY_YAML_LOAD", r"yaml\.load\s*\(\s*[^,)]*\s*[,)]", K.HIGH,
        "yaml.load() without SafeLoader",
        "Use yaml.safe_load() or specify Loader=yaml.SafeLoader explicitly.",
        unless="SafeLoader|safe_load"),
)
SUBPROCESS_RULE_ID = "PY_SUBPROCESS_SHELL"
SUBPROCESS_TITLE = "subprocess call with shell=True"
SUBPROCESS_RECOMMENDATION = (
    "Use subprocess without shell=True. Pass list of arguments instead of shell string."
)

CORS_RULE_ID = "CONFIG_CORS_WILDCARD"
CORS_RULES = tuple(
    Rule(CORS_RULE_ID, "CORS allow_origins set to wildcard (*)", K.MEDIUM, K.CORS, ("config",),
         pattern, f"Restrict CORS to specific trusted origins. Currently allows all ({label}).",
         case_insensitive=True)
    for pattern, label in (
        (r"allow_origins\s*=\s*\[\s*['\"]?\*['\"]?\s*\]", "Python FastAPI"),
        (r"origin\s*:\s*['\"]?\*['\"]?", "Config file"),
        (r"Access-Control-Allow-Origin\s*:\s*\*", "HTTP header"),
    )
)

ENV_FILE_TITLE = ".env file found"
ENV_FILE_EVIDENCE = ".env files should not be committed to version control"
ENV_FILE_RECOMMENDATION = (
    "Add .env to .gitignore. Use environment-specific configuration and secrets management."
)
ENV_ASSIGNMENT = (
    r"(?i)^\s*(?:export\s+)?"
    r"([A-Z0-9_]*?(?:API_KEY|TOKEN|SECRET|PRIVATE_KEY|PASSWORD)[A-Z0-9_]*)\s*=\s*([^\n]*)"
)
EXAMPLE_ENV_RECOMMENDATION = (
    "`.env.example` files are usually safe to commit, but values should be obvious placeholders. "
    "Avoid putting real-looking tokens or secret-like values in example files. Also avoid exposing "
    "private API keys through `NEXT_PUBLIC_` variables because they are bundled into the browser."
)
NEXT_PUBLIC_RECOMMENDATION = (
    "NEXT_PUBLIC_ variables are exposed to the browser. Never expose secrets, keys, or tokens "
    "this way."
)
ENV_SECRET_RECOMMENDATION = (
    "Remove secrets from committed .env files. Use a secret manager or runtime environment "
    "variables."
)

# id, title, severity, category, recommendation, evidence source
CONFIG_FINDINGS = (
    ("CONFIG_ENV_FILE", ENV_FILE_TITLE, K.HIGH, K.EXPOSURE, ENV_FILE_RECOMMENDATION, "env_file"),
    ("CONFIG_EXAMPLE_NEXT_PUBLIC_PLACEHOLDER", "NEXT_PUBLIC variable uses secret-like name",
     K.LOW, K.EXPOSURE, EXAMPLE_ENV_RECOMMENDATION, "line"),
    ("CONFIG_EXAMPLE_NEXT_PUBLIC_SECRET_LIKE",
     "Example environment file contains public secret-like variable", K.MEDIUM, K.EXPOSURE,
     EXAMPLE_ENV_RECOMMENDATION, "line"),
    ("CONFIG_EXAMPLE_ENV_SECRET_LIKE_VALUE",
     "Example env file should use clear placeholder values", K.LOW, K.EXPOSURE,
     EXAMPLE_ENV_RECOMMENDATION, "assignment"),
    ("CONFIG_NEXT_PUBLIC_", "NEXT_PUBLIC_ variable with ", K.HIGH, K.EXPOSURE,
     NEXT_PUBLIC_RECOMMENDATION, "public"),
    ("CONFIG_ENV_SECRET_LIKE_VALUE", "Environment file contains secret-like variable",
     K.HIGH, K.SECRETS, ENV_SECRET_RECOMMENDATION, "assignment"),
)

# -- secret rules. The scanner they replace is not available; ids, titles and
#    severities follow its documented behavior, patterns and texts are ours. ----
SECRET_VALUE_AFTER_NAME = r"""["']?\s*[=:]\s*["']?([^\s"'#,;]{5,})"""
NOT_IN_A_WORD = r"(?:^|[^A-Za-z0-9_])"
WEAK_NAMED_VALUE = r"(?i)example|placeholder|test|dummy|changeme|xxxx|your_|\A<[\s\S]*>\z"
WEAK_VALUE = r"(?i)sk_test_|test|demo|sample|fake|example"
SECRET_RECOMMENDATION = (
    "Move the value to a secret manager or an environment variable, and rotate it if it was "
    "ever committed."
)


def named_secret_pattern(name: str) -> str:
    return f"(?i){NOT_IN_A_WORD}{name}{SECRET_VALUE_AFTER_NAME}"


def named_secret_title(name: str) -> str:
    return "Hardcoded generic API Key" if name == "API_KEY" else f"Hardcoded {name}"


@dataclass(frozen=True)
class SecretValue:
    id: str
    title: str
    pattern: str
    weak_is_medium: bool = False


SECRET_VALUES = (
    SecretValue("SECRETS_VALUE_OPENAI_VALUE", "OpenAI-style key value",
                r"sk-(?:proj-)?[A-Za-z0-9_-]{8,}|sk_test_[A-Za-z0-9_-]{3,}", True),
    SecretValue("SECRETS_VALUE_GITHUB_TOKEN", "GitHub token value", r"ghp_[A-Za-z0-9]{20,}", True),
    SecretValue("SECRETS_VALUE_GITHUB_FINE_GRAINED", "GitHub fine-grained token value",
                r"github_pat_[A-Za-z0-9_]{20,}"),
    SecretValue("SECRETS_VALUE_GOOGLE_API_KEY", "Google API key value", r"AIza[0-9A-Za-z_-]{35,}"),
    SecretValue("SECRETS_VALUE_AWS_ACCESS_KEY", "AWS access key ID value",
                r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    SecretValue("SECRETS_VALUE_PRIVATE_KEY_BLOCK", "Private key block",
                r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)

def catalog_entries(extra: tuple[Rule, ...] = ()) -> dict[str, dict[str, str]]:
    """Catalog key -> texts of the finding. ``shows`` tells where its evidence comes
    from: the line, the matched value, or a fixed text."""
    out: dict[str, dict[str, str]] = {}

    def add(key, rule_id, title, severity, category, recommendation, shows="line"):
        out[key] = {"rule_id": rule_id, "title": title, "severity": severity,
                    "category": category, "recommendation": recommendation, "shows": shows}

    for rule in (*JAVASCRIPT_RULES, *PYTHON_CALL_RULES, *PYTHON_LINE_RULES, *extra):
        add(rule.id, rule.id, rule.title, rule.severity, rule.category, rule.recommendation)
    for i, rule in enumerate(CORS_RULES):
        add(f"{rule.id}:{i}", rule.id, rule.title, rule.severity, rule.category,
            rule.recommendation)
    for key, severity in ((SUBPROCESS_RULE_ID, K.CRITICAL), (f"{SUBPROCESS_RULE_ID}:static", K.HIGH)):
        add(key, SUBPROCESS_RULE_ID, SUBPROCESS_TITLE, severity, K.DANGEROUS_CODE,
            SUBPROCESS_RECOMMENDATION)
    for id_, title, severity, category, recommendation, shows in CONFIG_FINDINGS:
        # the public rule's id and title end in the kind of secret, added per finding
        key = "CONFIG_NEXT_PUBLIC" if shows == "public" else id_
        add(key, id_, title, severity, category, recommendation, shows)
    for name in K.NAMED_SECRETS:
        add(f"SECRETS_{name}", f"SECRETS_{name}", named_secret_title(name), K.CRITICAL, K.SECRETS,
            SECRET_RECOMMENDATION, "named")
    for value in SECRET_VALUES:
        shows = ("block" if value.id.endswith("_BLOCK") else
                 "weak_value" if value.weak_is_medium else "value")
        add(value.id, value.id, value.title, K.CRITICAL, K.SECRETS, SECRET_RECOMMENDATION, shows)
    return out


# A line that matches no hint cannot match a built-in rule: keep this a superset.
# Nearly all lines of a corpus end here, so speed matters: each hint is anchored on
# its rarest letter (look-behind for the rest), and one character class test rejects
# most positions without trying the alternatives.
LINE_HINTS = (
    r"(?=[_.kKvVxXwWzZgGbBcCA-])(?i:"
    r"key\w*[\"']?\s*[=:]|(?<=to)ken\w*[\"']?\s*[=:]"
    r"|(?<=se)cret\w*[\"']?\s*[=:]|(?<=pass)word\w*[\"']?\s*[=:]"
    r"|(?<=mongod)b_uri|(?<=data)base_url"
    r"|(?<=sk)-|(?<=sk)_test_|(?<=ghp)_|(?<=github)_pat_|(?<=ai)za|a[ks]ia|-----begin"
    r"|(?<=e)val\s*\(|(?<=e)xec\s*\(|(?<=su)bprocess|(?<=pic)kle|(?<=yaml)\.load"
    r"|(?<=ne)w\s+function|(?<=child)_process|(?<=dan)gerouslyset|(?<=localstora)ge|(?<=ori)gin"
    r")"
)

# -- user extensions -----------------------------------------------------------
Scanner = Callable[[DataFrame], DataFrame]
SCANNERS = frozenset(("python", "javascript", "config", "secrets"))


@dataclass(frozen=True)
class Catalog:
    """What a scan applies besides the built-in rules: line rules, and scanners (admitted files
    in, raw findings out). Immutable: ``with_rule`` and ``with_scanner`` give new catalogs, so
    two scans of one session can't disturb each other. Categories may be new ones."""

    rules: tuple[Rule, ...] = ()
    scanners: tuple[Scanner, ...] = ()

    def __post_init__(self):
        taken = {entry["rule_id"] for entry in catalog_entries().values()}
        for rule in self.rules:
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]*", rule.id):
                raise ValueError(f"rule id must be a plain name: {rule.id!r}")
            if rule.id in taken:
                raise ValueError(f"rule id is taken: {rule.id}")
            if not rule.scanners or set(rule.scanners) - SCANNERS:
                raise ValueError(f"unknown scanners: {rule.scanners}")
            if rule.severity not in K.SEVERITIES:
                raise ValueError(f"unknown severity: {rule.severity}")
            if not re.fullmatch(r"[a-z][a-z0-9-]*", rule.category):
                raise ValueError(f"category must be lower-case words: {rule.category!r}")
            re.compile(rule.pattern)
            taken.add(rule.id)

    def with_rule(self, *rules: Rule) -> Catalog:
        return Catalog(self.rules + rules, self.scanners)

    def with_scanner(self, *scanners: Scanner) -> Catalog:
        return Catalog(self.rules, self.scanners + scanners)

    def entries(self) -> dict[str, dict]:
        return catalog_entries(self.rules)


_session = [None]  # the catalog of scans that name none


def current() -> Catalog:
    return _session[0] or Catalog()


def register_rule(rule: Rule) -> None:
    """Add a line rule to every later scan that names no catalog. Its category must be a known one."""
    if rule.category not in K.CATEGORIES:
        raise ValueError(f"unknown category: {rule.category}")
    _session[0] = current().with_rule(rule)


def register_scanner(scanner: Scanner) -> None:
    """Add a table-level rule to every later scan that names no catalog."""
    _session[0] = current().with_scanner(scanner)


def extra_rules() -> tuple[Rule, ...]:
    return current().rules


def extra_scanners() -> tuple[Scanner, ...]:
    return current().scanners


def clear_extensions() -> None:
    _session[0] = None
