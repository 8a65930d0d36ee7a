"""Column functions on assigned values: cleaning, placeholders, secrecy, masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom import constants as K
from scanloom.functions.text import strip

# fixed patterns
PLACEHOLDER_SHAPE = (
    r"\A(?:<[\s\S]*>|x+|your[_-]?[a-z0-9_-]*(?:key|token|secret|password)[a-z0-9_-]*)\z"
)
PROVIDER_PREFIX = r"\A(?:sk-|ghp_|github_pat_|AIza|AKIA|ASIA)"
SECRET_NAME = r"(?i)(API[_-]?KEY|TOKEN|SECRET|PRIVATE[_-]?KEY|PASSWORD)"


def clean_value(raw: Column) -> Column:
    """Value without trailing comment, outer blanks and one pair of quotes."""
    bare = strip(F.substring_index(raw, "#", 1))
    quoted = bare.rlike(r"""\A(?:"[\s\S]*"|'[\s\S]*')\z""")
    return F.when(quoted, strip(bare.substr(F.lit(2), F.length(bare) - 2))).otherwise(bare)


def is_placeholder(cleaned: Column) -> Column:
    low = F.lower(cleaned)
    return low.isin(*K.PLACEHOLDER_VALUES) | low.rlike(PLACEHOLDER_SHAPE)


def masked(cleaned: Column) -> Column:
    return (
        F.when(cleaned == "", "<empty>")
        .when(F.length(cleaned) <= 8, "***")
        .otherwise(F.concat(F.left(cleaned, F.lit(3)), F.lit("..."), F.right(cleaned, F.lit(3))))
    )


def looks_real(cleaned: Column) -> Column:
    """Provider-shaped, or long and varied."""
    kinds = sum(
        (cleaned.rlike(p).cast("int") for p in ("[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
        cleaned.rlike("[a-z]").cast("int"),
    )
    distinct = F.size(F.array_distinct(F.split(cleaned, "")))
    return (F.length(cleaned) >= 20) & (
        cleaned.rlike(PROVIDER_PREFIX)
        | ((kinds >= 3) & (distinct * 100 >= F.length(cleaned) * 45))
    )


def secret_type(name: Column) -> Column:
    return F.regexp_extract(name, SECRET_NAME, 1)
