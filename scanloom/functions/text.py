"""Column functions on text: decoding, lines, evidence, masking of Python source.

All patterns avoid constructs whose meaning differs between regex dialects
(`.` and `$` on unusual line ends), and loops over groups are possessive, which
Java evaluates iteratively: a huge literal cannot overflow the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom.constants import EVIDENCE_CHARS


# One well-formed character of UTF-8 as bytes: no overlong forms, surrogates or values past the last plane.
_UTF8 = (
    r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def decode_utf8(raw: Column) -> Column:
    """Bytes to text, dropping the bytes that belong to no well-formed character. A genuine
    replacement character stays."""
    text = raw.cast("string")
    # each byte as one character: what the pattern matches is kept, any other byte goes
    as_bytes = F.decode(raw, "ISO-8859-1")
    kept = F.regexp_replace(as_bytes, f"((?:{_UTF8})++)|[\\x80-\\xFF]", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))


def unix_newlines(text: Column) -> Column:
    # most files hold no CR at all, and the literal "\n" split afterwards needs no regex
    return F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")
    ).otherwise(text)


def lines_of(text: Column) -> Column:
    """All lines of a text, the trailing empty one included."""
    return F.split(unix_newlines(text), "\n", -1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def evidence(line: Column, chars: int = EVIDENCE_CHARS) -> Column:
    s = strip(line)
    return F.concat(F.substring(s, 1, chars), F.when(F.length(s) > chars, "...").otherwise(""))


# One alternation, leftmost match first: whichever string or comment starts earliest
# hides the others inside it. The look-ahead rejects most positions at once.
_PLAIN = [
    r'"""(?:[^"\\]++|\\[\s\S]|"{1,2}(?:[^"\\]|\\[\s\S]))*+"""',
    r"""'''(?:[^'\\]++|\\[\s\S]|'{1,2}(?:[^'\\]|\\[\s\S]))*+'''""",
    r'"(?:[^"\\\n]++|\\[\s\S])*+"',
    r"'(?:[^'\\\n]++|\\[\s\S])*+'",
]
_STRING = "|".join(_PLAIN)
# What braces of an f-string hold: code, its own strings (also in the quotes of the f-string itself), and
# braces of dictionaries or of format specifications in two levels.
_INNER = rf"(?:[^{{}}\"']++|{_STRING})"
_BRACES = rf"\{{(?:{_INNER}|\{{{_INNER}*+\}})*+\}}"
_FIELD = rf"\{{(?!\{{)(?:{_INNER}|{_BRACES})*+\}}"


def _f_string(quote: str) -> str:
    literal = r"[^\\{}" + quote[0] + (r"\n" if len(quote) == 1 else "") + "]++"
    single = f"|{quote[0]}(?!{quote[1:]})" if len(quote) == 3 else ""
    return rf"{quote}(?:{literal}|\\[\s\S]|\{{\{{|{_FIELD}|\}}{single})*+{quote}"


_F_PREFIX = r"(?<![\w])(?i:f|fr|rf)"
_F_TOKEN = _F_PREFIX + "(?:" + "|".join(_f_string(q) for q in ('"""', "'''", '"', "'")) + ")"
_PY_TOKEN = "(?=[\"'#fFrR])(?:" + "|".join([_F_TOKEN, *_PLAIN, r"#[^\n]*"]) + ")"
_DEFINITION = r"\b(?:def|class)[ \t]+\w+"
_F_LEVELS = 3  # f-strings in fields of f-strings in fields of f-strings


def _without_strings(text: Column, levels: int) -> Column:
    """Python source with every string as ``""``, followed by the fields of an f-string, and without
    comments. Newlines are kept."""
    code_parts = F.split(text, _PY_TOKEN, -1)
    tokens = F.regexp_extract_all(text, F.lit(_PY_TOKEN), F.lit(0))

    def join(code: Column, token: Column) -> Column:
        breaks = F.regexp_replace(token, r"[^\n]+", "")
        shown = F.concat(code, F.lit('""'), breaks)
        if levels:
            body = F.regexp_replace(token, r"""\A[a-zA-Z]+(?:\"{3}|'{3}|\"|')""", "")
            fields = F.regexp_replace(body, rf"({_FIELD})|\\[^\n]|\{{\{{|[^\n]", "$1")
            shown = F.when(
                token.rlike(r"\A[fFrR]") & F.contains(token, F.lit("{")),
                # the prefix stays, as it does before other strings: such a string is no constant
                F.concat(code, F.lit('f""'), _without_strings(fields, levels - 1)),
            ).otherwise(F.when(token.rlike(r"\A[fFrR]"), F.concat(code, F.lit('f""'), breaks)).otherwise(shown))
        return F.when(token.isNull() | token.startswith("#"), code).otherwise(shown)

    return F.array_join(F.zip_with(code_parts, tokens, join), "")


def mask_python(text: Column) -> Column:
    """Python source with strings replaced by ``""`` and with comments and the
    names of definitions removed. Code in the braces of f-strings stays. Newlines are kept, so
    line numbers still hold."""
    return F.regexp_replace(_without_strings(text, _F_LEVELS), _DEFINITION, "")
