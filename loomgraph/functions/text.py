"""String functions with the reference's white-space and label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How texts refer to tables, figures and formulas.
TABLE_LABELS = [r"(?i)\b(?:tab|table|表|表格)\s*(\d+)\b"]
IMAGE_LABELS = [r"(?i)\b(?:fig|figure|图|图片)\s*(\d+)\b"]
FORMULA_LABELS = [
    r"(?i)(?:公式|等式)\s*[（(]?\s*(\d+(?:\.\d+)?[a-zA-Z]?)\s*[）)]?",
    r"(?i)(?:Equation|Eq\.?)\s*[（(]?\s*(\d+(?:\.\d+)?[a-zA-Z]?)\s*[）)]?",
    r"(?i)\\label\s*\{([^}]*)\}",
    r"(?i)\\tag\s*\{([^}]*)\}",
    r"(?i)\\eqref\s*\{([^}]*)\}",
    r"(?i)\\ref\s*\{([^}]*)\}.*?(?:equation|align|eqnarray)",
]


def strip(c: Column | str) -> Column:
    """Trims every kind of white space, not spaces alone."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column | str) -> Column:
    """White-space tokens, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0)).cast("long")


def labels(c: Column | str, patterns: list[str]) -> Column:
    """Distinct labels that the patterns find; those of the first pattern first."""
    found = [F.transform(F.regexp_extract_all(c, F.lit(p), 1), lambda m: F.trim(m)) for p in patterns]
    return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])
