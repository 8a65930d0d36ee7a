"""Word lists, limits, weights, labels and texts.

These are data, not logic. They must keep exactly these values for scan
results to be comparable with earlier scans of the same trees.
"""

from __future__ import annotations

# -- severities, categories, contexts (fixed values) --------------------------
CRITICAL, HIGH, MEDIUM, LOW = "critical", "high", "medium", "low"
SEVERITIES = (CRITICAL, HIGH, MEDIUM, LOW)
SEVERITY_WEIGHTS = {CRITICAL: 24, HIGH: 11, MEDIUM: 6, LOW: 1}

SECRETS, DANGEROUS_CODE, CONFIG, CORS, EXPOSURE = (
    "secrets", "dangerous-code", "config", "cors", "exposure",
)
CATEGORIES = (SECRETS, DANGEROUS_CODE, CONFIG, CORS, EXPOSURE)

PRODUCTION = "Production code"
TEST_DEMO = "Test/demo file"
EXAMPLE_TEMPLATE = "Example/template file"
GENERATED = "Generated/dependency file"

# -- path vocabularies (fixed values) -----------------------------------------
EXAMPLE_ENV_NAMES = (
    ".env.example", ".env.sample", ".env.template", ".env.example.local",
    "example.env", "sample.env", "template.env",
)
GENERATED_DIRS = (
    "node_modules", ".next", "dist", "build", "coverage", ".git", "venv", "__pycache__",
)
SKIP_DIRS = GENERATED_DIRS + (".cache",)
DEMO_FIXTURE_PARTS = (
    "fixture", "fixtures", "demo", "demos", "vulnerable", "vuln", "dvwa", "juice-shop",
    "sample-vulnerable-app", "badrepo", "conftest.py", "debug",
)
TEST_DEMO_PARTS = ("test", "tests", "__tests__", "spec", "specs") + DEMO_FIXTURE_PARTS
DOCUMENTATION_PARTS = ("doc", "docs", "documentation")
EXAMPLE_PARTS = DOCUMENTATION_PARTS + (
    "example", "examples", "sample", "samples", "template", "templates",
)
README_NAMES = ("readme", "readme.md", "readme.txt", "readme.rst")

# -- routing by file extension (fixed values) ---------------------------------
PYTHON_KEYS = (".py",)
JAVASCRIPT_KEYS = (".js", ".jsx", ".ts", ".tsx")
CONFIG_KEYS = (".json", ".env", ".yml", ".yaml", ".toml", ".ini")
MARKDOWN_KEYS = (".md", ".mdx")
SCANNABLE_SUFFIXES = JAVASCRIPT_KEYS + PYTHON_KEYS + CONFIG_KEYS + MARKDOWN_KEYS

# -- limits (fixed values) ----------------------------------------------------
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_TOTAL_BYTES = 100 * 1024 * 1024
MAX_FILE_COUNT = 1000
MAX_FILE_BYTES = 1024 * 1024
EVIDENCE_CHARS = 80
EXPLAIN_EVIDENCE_CHARS = 500

# -- secret vocabularies (fixed values) ---------------------------------------
PLACEHOLDER_VALUES = (
    "", "your_key_here", "your_api_key", "changeme", "change_me", "placeholder",
    "example", "demo", "test", "dummy", "xxx", "replace_me",
)
NAMED_SECRETS = (
    "OPENAI_API_KEY", "GEMINI_API_KEY", "GOOGLE_API_KEY", "AWS_ACCESS_KEY_ID",
    "AWS_SECRET_ACCESS_KEY", "MONGODB_URI", "DATABASE_URL", "JWT_SECRET",
    "SECRET_KEY", "PRIVATE_KEY", "API_KEY", "ACCESS_TOKEN",
)

# -- scoring (fixed values). Multipliers and context factors are in percent,
#    indexed by the number of earlier findings; the last entry repeats. --------
RULE_REPEAT_PCT = (100, 50, 25)
SEVERITY_REPEAT_PCT = (100, 75, 55, 35)
CATEGORY_REPEAT_PCT = (100, 85, 65, 45)
LOW_DEDUCTION_CAP = 5
CATASTROPHIC_KEYWORDS = (
    "PRIVATE_KEY", "AUTH_BYPASS", "ADMIN_CREDENTIAL", "SQL_INJECTION",
    "COMMAND_INJECTION", "DESTRUCTIVE", "MALWARE",
)
CODE_EXECUTION_KEYWORDS = ("SUBPROCESS_SHELL", "CHILD_PROCESS_EXEC", "EXEC", "RCE")
HIGH_CONFIDENCE_MARKERS = ("OPENAI", "GITHUB", "GOOGLE", "AWS", "PRIVATE_KEY")

# -- labels and messages (fixed values) ---------------------------------------
HEALTHY, LOW_RISK, MODERATE_RISK, HIGH_RISK, CRITICAL_RISK = (
    "Healthy", "Low Risk", "Moderate Risk", "High Risk", "Critical Risk",
)
MSG_CLEAN = "No security issues found in scanned application files."
MSG_MANY_CRITICAL = "Critical production/env issues found. Fix immediately before deploying."
MSG_ONE_CRITICAL = "1 critical production/env issue found. Fix before deploying."
MSG_NON_PRODUCTION = (
    "Critical-severity patterns found in non-production files. "
    "Review if these are intentional test/demo examples."
)
MSG_TEST_DEMO = "Many findings are from test/demo files. Review production findings first."
MSG_HIGH_RISK = (
    "Security issues found. Prioritize high-impact production findings before deploying."
)
MSG_DEFAULT = "Security issues found. Review the findings before deploying."

REASON_ENV = "real env/config files keep full severity"
REASON_PRODUCTION = "production/application code keeps full severity"
REASON_TEST_DEMO = "test/demo context downgraded severity by {steps} level(s)"
REASON_EXAMPLE_SECRET = "example/template high-confidence secret downgraded by 1 level"
REASON_DOCUMENTATION = "documentation examples are capped at low severity"
REASON_EXAMPLE = "example/template context downgraded severity by 2 levels"

# -- repository URL rejections (fixed values) ---------------------------------
URL_SCHEME = "Repository URL must use https://github.com/owner/repo"
URL_HOST = "Only public github.com repository URLs are supported"
URL_QUERY = "Repository URL must not include query strings or fragments"
URL_SHAPE = "Repository URL must look like https://github.com/owner/repo"
URL_EMPTY = "Repository URL must include an owner and repository name"
URL_CHARS = "Repository URL contains invalid owner or repository characters"

# -- explanation fallbacks (fixed values): error class -> texts ---------------
_NO_SCENARIO = "No AI-generated attack scenario is available right now."
FALLBACKS = {
    "missing_key": (
        "ai_missing_api_key",
        "AI explanations are not configured yet. Add GEMINI_API_KEY to the backend "
        "environment to enable them.",
        _NO_SCENARIO,
        "Use the recommendation shown with this finding, then configure the backend "
        "Gemini key when you want AI help.",
    ),
    "invalid_key": (
        "ai_invalid_key",
        "AI explanations could not be generated because the configured Gemini API key "
        "was rejected.",
        _NO_SCENARIO,
        "Check backend/.env or the server environment and replace GEMINI_API_KEY with a "
        "valid Google AI Studio key.",
    ),
    "timeout": (
        "ai_timeout",
        "AI explanation took too long to generate. Refer to the recommendation above.",
        _NO_SCENARIO,
        "Try again in a moment, or use the recommendation shown with this finding.",
    ),
    "rate_limited": (
        "ai_rate_limited",
        "AI explanation service is temporarily overloaded. Please try again in a few moments.",
        _NO_SCENARIO,
        "Retry this request after waiting a moment. Use the recommendation shown with this "
        "finding in the meantime.",
    ),
    "empty_response": (
        "ai_empty_response",
        "AI explanation service returned an empty response. Refer to the recommendation above.",
        _NO_SCENARIO,
        "Try again, or use the recommendation shown with this finding.",
    ),
    "generic": (
        "ai_model_request_failed",
        "AI explanation is currently unavailable. Refer to the recommendation above.",
        _NO_SCENARIO,
        "Use the recommendation shown with this finding and review the flagged line.",
    ),
}
FALLBACK_PHRASES = ("unavailable", "not available", "use the recommendation shown")
