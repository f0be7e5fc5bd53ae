"""Severity columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- Fixed values: keyword order and target levels decide the result. ---
LINUX_KEYWORDS = [
    ("error", "ERROR"), ("fail", "ERROR"), ("critical", "FATAL"),
    ("warn", "WARN"), ("warning", "WARN"), ("debug", "DEBUG"),
]
SSH_KEYWORDS = [
    ("invalid user", "WARN"), ("failed password", "WARN"), ("break-in attempt", "ERROR"),
    ("error", "ERROR"), ("fatal", "FATAL"), ("disconnect", "INFO"),
    ("accepted", "INFO"), ("session opened", "INFO"), ("session closed", "INFO"),
]
ANDROID_LETTERS = {"V": "DEBUG", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
BGL_SYNONYMS = {"WARNING": "WARN", "SEVERE": "ERROR"}
ANOMALY_LEVELS = ["ERROR", "FATAL"]
# --- End of fixed values. ---


def first_keyword(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Value of the first rule whose keyword occurs in ``text``, ignoring case."""
    low = F.lower(text)
    out = F
    for keyword, value in rules:
        out = out.when(low.contains(keyword), F.lit(value))
    return out.otherwise(F.lit(default))


def linux_level(message: Column) -> Column:
    return first_keyword(message, LINUX_KEYWORDS, "INFO")


def ssh_level(message: Column) -> Column:
    return first_keyword(message, SSH_KEYWORDS, "INFO")


def android_level(letter: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ANDROID_LETTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, letter), F.lit("INFO"))


def _fold(level: Column, synonyms: dict[str, str]) -> Column:
    upper = F.upper(level)
    out = F
    for name, target in synonyms.items():
        out = out.when(upper == name, F.lit(target))
    return out.otherwise(upper)


def bgl_level(level: Column) -> Column:
    return _fold(level, BGL_SYNONYMS)


def normalised_level(level: Column) -> Column:
    """Upper case, WARNING folded to WARN; unknown levels pass through."""
    return _fold(level, {"WARNING": "WARN"})


def is_candidate(level: Column) -> Column:
    """Rule anomaly flag; a missing level is never a candidate."""
    return F.coalesce(level.isin(ANOMALY_LEVELS), F.lit(False))
