"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN_PATTERN = "[a-z0-9]+"  # fixed value


def right_trimmed(line: Column) -> Column:
    """Line without trailing white space of any kind (not only blanks)."""
    return F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+$", "")


def tokens(message: Column) -> Column:
    """Lower-case alphanumeric tokens; a missing message has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(message, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
