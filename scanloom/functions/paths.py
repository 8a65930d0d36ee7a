"""Column predicates on relative file paths.

Everything is one literal regex or string comparison per question, so it stays
in generated code and can run before the content column is touched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from scanloom import constants as K


def _any_part(names, dirs_only: bool = False, ignore_case: bool = True) -> str:
    words = "|".join(re.escape(n) for n in names)
    end = "/" if dirs_only else r"(?:/|\z)"
    return f"{'(?i)' if ignore_case else ''}(?:^|/)(?:{words}){end}"


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def filename(path: Column) -> Column:
    """Lower-case last path part."""
    return F.lower(F.regexp_extract(unix_path(path), r"([^/]*)/*\z", 1))


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone starts no extension."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)\z", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"([^/])\.[^./]+\z", "$1")


def is_example_env_name(name: Column) -> Column:
    return name.isin(*K.EXAMPLE_ENV_NAMES)


def is_dot_env(name: Column) -> Column:
    return (name == ".env") | name.startswith(".env.")


def is_real_env_name(name: Column) -> Column:
    return is_dot_env(name) & ~is_example_env_name(name)


def is_demo_fixture_path(path: Column) -> Column:
    return unix_path(path).rlike(_any_part(K.DEMO_FIXTURE_PARTS))


def is_documentation_path(path: Column) -> Column:
    return filename(path).isin(*K.README_NAMES) | unix_path(path).rlike(
        _any_part(K.DOCUMENTATION_PARTS)
    )


def is_generated_path(path: Column) -> Column:
    return unix_path(path).rlike(_any_part(K.GENERATED_DIRS))


def file_context(path: Column) -> Column:
    """Role of a file; the first matching rule decides."""
    name, unix = filename(path), unix_path(path)
    test_stem = stem(name)
    return (
        F.when(is_generated_path(path), K.GENERATED)
        .when(is_real_env_name(name), K.PRODUCTION)
        .when(is_example_env_name(name) | name.isin(*K.README_NAMES), K.EXAMPLE_TEMPLATE)
        .when(
            unix.rlike(_any_part(K.TEST_DEMO_PARTS)) | test_stem.rlike(r"^debug|\.(?:test|spec)\z"),
            K.TEST_DEMO,
        )
        .when(
            unix.rlike(_any_part(K.EXAMPLE_PARTS)) | name.rlike(r"\.(?:example|sample|template)\z"),
            K.EXAMPLE_TEMPLATE,
        )
        .otherwise(K.PRODUCTION)
    )


def is_pruned(path: Column) -> Column:
    """Below a generated or cache directory (any case)."""
    return path.rlike(_any_part(K.SKIP_DIRS, dirs_only=True))


def in_skip_dir(path: Column) -> Column:
    """Below a skip directory, case-sensitive."""
    return path.rlike(_any_part(K.SKIP_DIRS, dirs_only=True, ignore_case=False))


def is_scannable(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return is_dot_env(name) | suffix(name).isin(*K.SCANNABLE_SUFFIXES)


def is_skipped(path: Column) -> Column:
    named_skip = path.rlike(_any_part(K.SKIP_DIRS, ignore_case=False))
    return named_skip | ~is_scannable(path)


def scanner_key(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(is_dot_env(name), ".env").otherwise(suffix(name))


def scanner_of(key: Column) -> Column:
    """Name of the extension scanner for a scanner key, null when there is none."""
    return (
        F.when(key.isin(*K.PYTHON_KEYS), "python")
        .when(key.isin(*K.JAVASCRIPT_KEYS), "javascript")
        .when(key.isin(*K.CONFIG_KEYS), "config")
    )


def runs_secrets(key: Column) -> Column:
    return key.isin(*K.SCANNABLE_SUFFIXES)
