"""Rules on single files: (path, content) -> rule ids, severities, lines."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.operators import detect as D, findings as N, rules as R
from scanloom.sources.corpus import snippets
from tests import samples as S

CASES = [
    # secrets
    ("a.py", f'OPENAI_API_KEY = "{S.OPENAI}"\nAPI_KEY = "real-secret-key-12345"\n',
     {("SECRETS_OPENAI_API_KEY", 1, "critical"), ("SECRETS_API_KEY", 2, "critical")}),
    ("a.py", 'OPENAI_API_KEY = "your_api_key_here"\nAPI_KEY = "example_key"\n'
             'JWT_SECRET = "placeholder"\n',
     {("SECRETS_OPENAI_API_KEY", 1, "low"), ("SECRETS_API_KEY", 2, "low"),
      ("SECRETS_JWT_SECRET", 3, "low")}),
    ("a.py", f'token = "{S.OPENAI}"\n', {("SECRETS_VALUE_OPENAI_VALUE", 1, "critical")}),
    ("a.py", f'key = "{S.GITHUB}"\nfine = "{S.GITHUB_FINE}"\n',
     {("SECRETS_VALUE_GITHUB_TOKEN", 1, "critical"),
      ("SECRETS_VALUE_GITHUB_FINE_GRAINED", 2, "critical")}),
    ("a.py", f'api = "{S.GOOGLE}"\n', {("SECRETS_VALUE_GOOGLE_API_KEY", 1, "critical")}),
    ("a.py", f'aws = "{S.AWS}"\n', {("SECRETS_VALUE_AWS_ACCESS_KEY", 1, "critical")}),
    ("a.md", f"{S.KEY_BLOCK}\n", {("SECRETS_VALUE_PRIVATE_KEY_BLOCK", 1, "critical")}),
    ("a.py", f'k = "{S.STRIPE_TEST}abc12345"\nk = "{S.STRIPE_TEST}abc"\n',
     {("SECRETS_VALUE_OPENAI_VALUE", 1, "medium"), ("SECRETS_VALUE_OPENAI_VALUE", 2, "medium")}),
    ("a.py", 'k = "sk-' + 'demo-abcdef12345"\nk = "sk-' + 'proj-sampleKey12345"\n',
     {("SECRETS_VALUE_OPENAI_VALUE", 1, "medium"), ("SECRETS_VALUE_OPENAI_VALUE", 2, "medium")}),
    # a named match hides the value match; a longer name hides the shorter one
    ("a.py", f'OPENAI_API_KEY = "{S.OPENAI}"\n', {("SECRETS_OPENAI_API_KEY", 1, "critical")}),
    ("a.json", '{"DATABASE_URL": "postgres://u:p@h/db"}', {("SECRETS_DATABASE_URL", 1, "critical")}),
    ("a.py", 'API_KEY = "abc"\n', set()),
    # JavaScript
    ("a.js", "function f(c) {\n  eval(c);\n}\n", {("JS_EVAL", 2, "high")}),
    ("a.ts", "obj.eval(x)", {("JS_EVAL", 1, "high")}),
    ("a.js", "const f = new Function('a', 'return a');", {("JS_NEW_FUNCTION", 1, "high")}),
    ("a.tsx", "<div dangerouslySetInnerHTML={{ __html: x }} />",
     {("JS_DANGEROUS_INNER_HTML", 1, "high")}),
    ("a.jsx", 'localStorage.setItem("token", t);\nlocalStorage.setItem("jwt", t);',
     {("JS_LOCALSTORAGE_TOKEN", 1, "high"), ("JS_LOCALSTORAGE_TOKEN", 2, "high")}),
    ("a.js", "child_process.exec(c)", {("JS_CHILD_PROCESS_EXEC", 1, "critical")}),
    ("a.js", "require('child_process').exec(c)", set()),
    ("a.js", "child_process.execSync(c)", set()),
    # Python
    ("a.py", "def f(x):\n    return eval(x)\n", {("PY_EVAL", 2, "high")}),
    ("a.py", "exec(x)\n", {("PY_EXEC", 1, "critical")}),
    ("a.py", "model.eval()\ndef eval(x):\n    pass\nretrieval(x)\n", set()),
    ("a.py", "# eval(x)\ns = 'eval(x)'\nd = \"\"\"\neval(x)\n\"\"\"\nt = \"it's # eval(\"\n", set()),
    ("a.py", 's = "a \\" b"; eval(x)\n', {("PY_EVAL", 1, "high")}),
    ("a.py", "obj = pickle.loads(b)", {("PY_PICKLE", 1, "high")}),
    ("a.py", "yaml.load(x)\nyaml.load(x, Loader=yaml.SafeLoader)\nyaml.load(x, Loader=yaml.FullLoader)",
     {("PY_YAML_LOAD", 1, "high"), ("PY_YAML_LOAD", 3, "high")}),
    ("a.py", "import subprocess\nsubprocess.run(cmd, shell=True)",
     {("PY_SUBPROCESS_SHELL", 2, "critical")}),
    ("a.py", 'subprocess.run("ls", shell=True)', {("PY_SUBPROCESS_SHELL", 1, "high")}),
    ("a.py", 'subprocess.run(["ls", "-l"], shell=True)', {("PY_SUBPROCESS_SHELL", 1, "high")}),
    ("a.py", 'subprocess.run(["ls", d], shell=True)', {("PY_SUBPROCESS_SHELL", 1, "critical")}),
    ("a.py", 'subprocess.run("ls" + d, shell=True)', {("PY_SUBPROCESS_SHELL", 1, "critical")}),
    ("a.py", 'subprocess.run(f"ls {d}", shell=True)', {("PY_SUBPROCESS_SHELL", 1, "critical")}),
    ("a.py", 'subprocess.run(args="ls", shell=True)', {("PY_SUBPROCESS_SHELL", 1, "critical")}),
    ("a.py", "x = 1\nsubprocess.call(\n    f(a, (b)),\n    shell = True,\n)\n",
     {("PY_SUBPROCESS_SHELL", 2, "critical")}),
    ("a.py", "subprocess.run(f(x, shell=True))\nsubprocess.run(x, shell=False)\n"
             "my.subprocess.run(x, shell=True)\nsubprocess.run(x, shell=True\n", set()),
    ("a.py", 'subprocess.run(c, shell=True); subprocess.run("ls", shell=True)',
     {("PY_SUBPROCESS_SHELL", 1, "critical")}),
    ("a.py", 'subprocess.run("ls", shell=True); subprocess.run(c, shell=True)',
     {("PY_SUBPROCESS_SHELL", 1, "high")}),
    # config
    (".env", "HOME=/x\n", {("CONFIG_ENV_FILE", 1, "high")}),
    (".env.local", "", {("CONFIG_ENV_FILE", 1, "high")}),
    (".env.example", "OPENAI_TOKEN=your_token_here\n", set()),
    (".env.example", "NEXT_PUBLIC_GEMINI_API_KEY=YOUR_KEY_HERE\n",
     {("CONFIG_EXAMPLE_NEXT_PUBLIC_PLACEHOLDER", 1, "low")}),
    (".env.example", "NEXT_PUBLIC_GEMINI_API_KEY=secret123\n",
     {("CONFIG_EXAMPLE_NEXT_PUBLIC_SECRET_LIKE", 1, "medium")}),
    (".env.sample", "MAIL_PASSWORD=hunter2hunter2\n",
     {("CONFIG_EXAMPLE_ENV_SECRET_LIKE_VALUE", 1, "low")}),
    (".env", "NEXT_PUBLIC_API_KEY=sk-real-x\nNEXT_PUBLIC_SECRET=very-secret-value\n",
     {("CONFIG_ENV_FILE", 1, "high"), ("CONFIG_NEXT_PUBLIC_API_KEY", 1, "high"),
      ("CONFIG_NEXT_PUBLIC_SECRET", 2, "high")}),
    ("x.ini", f"export NEXT_PUBLIC_PAY_TOKEN = '{S.OPENAI}'",
     {("CONFIG_NEXT_PUBLIC_TOKEN", 1, "critical"), ("SECRETS_VALUE_OPENAI_VALUE", 1, "critical")}),
    ("prod.env", "DB_PASSWORD=hunter2hunter2\n", set()),
    (".env", "A_TOKEN=\nB_TOKEN=changeme # later\nC_TOKEN='real-value-1'\n",
     {("CONFIG_ENV_FILE", 1, "high"), ("CONFIG_ENV_SECRET_LIKE_VALUE", 3, "high")}),
    ("a.yaml", 'origin: "*"\nallow_origins = ["*"]\n',
     {("CONFIG_CORS_WILDCARD", 1, "medium"), ("CONFIG_CORS_WILDCARD", 2, "medium")}),
    ("a.json", '{"origin": "*"}', set()),
    ("a.py", 'allow_origins=["*"]', set()),
    # lines
    ("a.js", "x\r\neval(a)\reval(b)\n", {("JS_EVAL", 2, "high"), ("JS_EVAL", 3, "high")}),
    ("a.js", "", set()),
    ("a.txt", "eval(x)", set()),
    ("clean.py", "def add(a, b):\n    return a + b\n", set()),
]


def test_rules(files):
    table = files(repos={f"r{i}": [(path, content)] for i, (path, content, _) in enumerate(CASES)})
    found = {}
    for row in N.dedup(D.detect(table)).collect():
        found.setdefault(row.repo_id, set()).add((row.rule_id, row.line, row.severity))
    for i, (path, content, expected) in enumerate(CASES):
        assert found.get(f"r{i}", set()) == expected, (path, content)


def test_texts_of_findings(files):
    rows = D.detect(files(
        ("a.py", f'OPENAI_API_KEY = "{S.OPENAI}"'), ("b.py", f'x = "{S.GITHUB}"'),
        (".env", "MAIL_TOKEN = abcdefghijkl # c"), ("n.ini", "NEXT_PUBLIC_A_PASSWORD=abc"),
        ("c.js", "  eval(x)" + " " * 3), ("d.js", "eval(x)" + "y" * 73), ("e.js", "eval(x)" + "y" * 74),
    )).collect()
    evidence = {(r.file, r.rule_id): r.evidence for r in rows}
    titles = {r.rule_id: r.title for r in rows}
    assert evidence["a.py", "SECRETS_OPENAI_API_KEY"] == f"OPENAI_API_KEY=sk-...{S.OPENAI[-3:]}"
    assert evidence["b.py", "SECRETS_VALUE_GITHUB_TOKEN"] == f"ghp...{S.GITHUB[-3:]}"
    assert evidence[".env", "CONFIG_ENV_SECRET_LIKE_VALUE"] == "MAIL_TOKEN=abc...jkl"
    assert evidence["n.ini", "CONFIG_NEXT_PUBLIC_PASSWORD"] == "NEXT_PUBLIC_A_PASSWORD=abc"
    assert evidence["c.js", "JS_EVAL"] == "eval(x)"
    assert evidence["d.js", "JS_EVAL"] == "eval(x)" + "y" * 73
    assert evidence["e.js", "JS_EVAL"] == "eval(x)" + "y" * 73 + "..."
    assert "OPENAI_API_KEY" in titles["SECRETS_OPENAI_API_KEY"]
    assert titles["CONFIG_NEXT_PUBLIC_PASSWORD"] == "NEXT_PUBLIC_ variable with password"
    assert "API Key" in R.named_secret_title("API_KEY")


def test_cors_header_reports_twice_and_the_earlier_pattern_stays(files):
    raw = D.detect(files(("a.yml", "Access-Control-Allow-Origin: *")))
    assert raw.count() == 2
    kept = N.dedup(raw).collect()
    assert [r.recommendation for r in kept] == [R.CORS_RULES[1].recommendation]
    assert D.detect(files(("a.yml", "Access-Control-Allow-Origin: *")), unique=True).count() == 1


def _noise(seed: int, lines: int) -> str:
    """Lines made of rule fragments, near misses and filler."""
    rng = random.Random(seed)
    pieces = snippets() + [
        "eval (x)", "EVAL(y)", "New  function(", "CHILD_PROCESS . exec(", "API_KEY", "=", ":", '"',
        "'", "value12345", "MONGODB_URI", "DATABASE_URL", "AWS_ACCESS_KEY_ID", "SECRET_KEY",
        "PRIVATE_KEY", "ACCESS_TOKEN", "GEMINI_API_KEY", "NEXT_PUBLIC_X_SECRET=", "my_PASSWORD =",
        "origin:", "*", "allow_origins = [", "]", "Access-Control-Allow-Origin", S.KEY_BLOCK,
        S.AWS, "AS" + "IA" + "1234567890ABCD12", S.GITHUB_FINE, S.GOOGLE, "sk-" + "abcdefgh12",
        "yaml.load(", ")", "pickle.loads(", "subprocess.run(", "shell=True", "#", "é", "word",
    ]
    return "\n".join("".join(rng.choice(pieces) + rng.choice(["", " ", "\t"])
                             for _ in range(rng.randint(1, 5))) for _ in range(lines))


@pytest.mark.parametrize("seed", range(3))
def test_line_hints_lose_nothing(files, monkeypatch, seed):
    paths = ["a.py", "b.js", "c.tsx", "d.yaml", "e.json", ".env", ".env.example", "f.md", "g.env"]
    table = files(*((p, _noise(seed * 100 + i, 150)) for i, p in enumerate(paths)))
    columns = ["file", "line", "rule_id", "severity", "evidence", "disc_ord"]
    hinted = D.detect(table).select(*columns).collect()
    monkeypatch.setattr(R, "LINE_HINTS", "")
    unhinted = D.detect(table).select(*columns).collect()
    assert len(hinted) > 100
    assert sorted(map(tuple, hinted)) == sorted(map(tuple, unhinted))


def test_huge_literals_and_unclosed_calls(files):
    """Neither deep regex loops nor unclosed calls break or stall a file."""
    doc = '"""' + 'line of text with "quotes" and \\" escapes\n' * 8000 + '"""\neval(x)\n'
    unclosed = "subprocess.run(" + "f(a, b), " * 30000 + "shell=True\n"
    nested = "subprocess.run(" * 5000 + "\n"
    closed = "subprocess.run(" + "f(a, b), " * 30000 + "shell=True)\n"
    rows = D.detect(files(("doc.py", doc), ("unclosed.py", unclosed), ("nested.py", nested),
                          ("closed.py", closed))).select("file", "rule_id", "line").collect()
    assert {tuple(r) for r in rows} == {
        ("doc.py", "PY_EVAL", 8002), ("closed.py", "PY_SUBPROCESS_SHELL", 1)}


def test_registered_rule_and_scanner(files):
    try:
        R.register_rule(R.Rule("X_DEBUG", "Debug flag", K.LOW, K.CONFIG, ("python", "config"),
                               r"debug_mode\s*=\s*on", "Turn it off.", case_insensitive=True,
                               unless="# ok"))

        def long_files(admitted):
            return admitted.filter(F.length("content") > 50).select(
                "repo_id", "file", F.lit(1).alias("line"), F.lit(0).alias("disc_ord"),
                F.lit("X_LONG").alias("rule_id"), F.lit("Long file").alias("title"),
                F.lit(K.LOW).alias("severity"), F.lit(K.CONFIG).alias("category"),
                F.lit("").alias("evidence"), F.lit("Split it.").alias("recommendation"),
                "file_context")

        R.register_scanner(long_files)
        rows = D.detect(files(
            ("a.py", "DEBUG_MODE = on\ndebug_mode=on # ok\n"), ("b.js", "debug_mode=on"),
            ("c.ini", "x=1\ndebug_mode=on" + " " * 50),
        )).select("file", "rule_id", "line").collect()
        assert {tuple(r) for r in rows} == {
            ("a.py", "X_DEBUG", 1), ("c.ini", "X_DEBUG", 2), ("c.ini", "X_LONG", 1)}
    finally:
        R.clear_extensions()


@pytest.mark.parametrize("change", [{"id": "it's"}, {"id": "PY_EVAL"}, {"scanners": ("ruby",)},
                                    {"severity": "huge"}, {"category": "licences"}])
def test_bad_rules_are_refused(change):
    good = {"id": "X_OK", "title": "t", "severity": K.LOW, "category": K.CONFIG,
            "scanners": ("python",), "pattern": "x", "recommendation": "r"}
    with pytest.raises(ValueError):
        R.register_rule(R.Rule(**{**good, **change}))


def nest(inner, depth):
    return "f(" * depth + inner + ")" * depth


@pytest.mark.parametrize("call, found", [
    (f"subprocess.run({nest('x', 12)}, shell=True)", True),
    (f"subprocess.run([*a], {{'k': ({nest('x', 9)},)}}, shell = True,)", True),
    (f"subprocess.run({nest('subprocess.call(x, shell=True)', 12)})", True),
    ("subprocess.Popen(x, *, shell=True)", True),
    ("subprocess.run(x, shell=True if a else False)", False),
    ("subprocess.run(x, shell=True and y)", False),
    ("subprocess.run(x, shell==True)", False),
    ("subprocess.run(g(shell=True))", False),
    ("subprocess.run(x, env=dict(shell=True))", False),
    ("subprocess.run(x, myshell=True)", False),
    ("subprocess.run(x, shell=True", False),
])
def test_shell_calls_at_any_depth(files, call, found):
    rules = {r.rule_id for r in D.detect(files(("a.py", f"y = 1\n{call}\n")), ("python",)).collect()}
    assert (R.SUBPROCESS_RULE_ID in rules) == found


def test_shell_calls_keep_their_lines(files):
    text = "subprocess.run(x)\nsubprocess.run(\n  'ls', shell=True)\nsubprocess.call(y, shell=True)\n"
    rows = D.detect(files(("a.py", text)), ("python",)).collect()
    assert {(r.line, r.severity) for r in rows} == {(2, "high"), (4, "critical")}


def test_worst_secret_of_a_line(files):
    line = f"keys = ['{S.STRIPE_TEST}abc12345', '{S.OPENAI}']\n"
    rows = D.detect(files(("a.py", line)), ("secrets_value",)).collect()
    assert {r.severity for r in rows if r.rule_id == "SECRETS_VALUE_OPENAI_VALUE"} == {"critical"}


def test_size_limit_is_a_parameter(files):
    table = files(("a.js", "eval(x)\n" * 200_000), ("b.js", "eval(x)\n" * 10))
    assert {r.file for r in D.detect(table).select("file").distinct().collect()} == {"b.js"}
    assert {r.file for r in D.detect(table, max_file_bytes=20).select("file").distinct().collect()} == set()
    assert D.detect(table, max_file_bytes=None).count() == 200_010


F_STRINGS = [
    ('x = f"{eval(y)}"', {("PY_EVAL", 1)}),
    ("x = f'{exec(y)!r:>{width}}'", {("PY_EXEC", 1)}),
    ('x = f"{{eval(y)}}"', set()),                       # doubled braces are text
    ('x = f"eval(y) {z}"', set()),
    ('x = "{eval(y)}"', set()),                          # no f-string
    ('x = f"{d[\'eval(\']} {z}"', set()),                # a string in a field
    ('x = rf"\\d{eval(y)}"', {("PY_EVAL", 1)}),
    ('x = f"""a\n{b}\n{eval(c)}\n"""\nexec(d)', {("PY_EVAL", 3), ("PY_EXEC", 5)}),
    ("x = f'''{eval(\n y)}''' + 'eval(1)'", {("PY_EVAL", 1)}),
    ('x = f"{f\'{eval(y)}\'}"', {("PY_EVAL", 1)}),       # one in another
    ('x = f"{eval("y")}"', {("PY_EVAL", 1)}),            # the same quotes inside
    ('x = f"{ {1: eval(y)}[1] }"', {("PY_EVAL", 1)}),
    ('x = f"{a}{eval(b)}"', {("PY_EVAL", 1)}),
    ('x = f"{subprocess.run(cmd, shell=True)}"', {("PY_SUBPROCESS_SHELL", 1)}),
    ('subprocess.run(f"ls {d}", shell=True)', {("PY_SUBPROCESS_SHELL", 1)}),
    ('x = f"{\'{\'}" + eval(y)', {("PY_EVAL", 1)}),
    ('if_"eval(x)"', set()),
    ('x = f"broken {eval(y', {("PY_EVAL", 1)}),          # does not parse: scanned as code
]


@pytest.mark.parametrize("source,want", F_STRINGS)
def test_f_strings(spark, files, source, want):
    got = {(r.rule_id, r.line) for r in D.detect(files(("a.py", source))).collect()}
    assert got == want


def test_shell_command_in_f_string_is_dynamic(spark, files):
    rows = D.detect(files(("a.py", 'subprocess.run(f"ls {d}", shell=True)\nsubprocess.run(f"ls", shell=True)\n'
                                 'subprocess.run("ls", shell=True)\n'))).collect()
    assert [r.severity for r in sorted(rows, key=lambda r: r.line)] == ["critical", "critical", "high"]


def test_many_calls_in_one_file_take_linear_time(spark, files):
    import time

    def seconds(n):
        text = "".join(f'subprocess.run(f"{{a{k}}}", (1, [2]), shell={k % 2 == 0})\n' for k in range(n))
        table = files(("a.py", text)).cache()
        table.count()
        start = time.time()
        found = D.detect(table, max_file_bytes=None).filter("rule_id = 'PY_SUBPROCESS_SHELL'").count()
        assert found == n // 2
        return time.time() - start

    seconds(1000)
    short, long = seconds(10_000), seconds(50_000)
    assert long < 12 * short + 3
