"""Column-level clean-up of a freshly read table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from premia.settings import COLUMN_NAME_CHARS

COLUMN_TAGS = ("feature", "target", "ignore")


def safe_column_names(names: list[str]) -> list[str]:
    """Trimmed lower-case names with blanks, dashes and dots as underscores, at most 63 long.

    Names that collide get ``_2``, ``_3`` and so on.
    """
    taken: set[str] = set()
    result = []
    for name in names:
        base = name.strip().lower().translate(str.maketrans(" -.", "___"))[:COLUMN_NAME_CHARS]
        candidate, n = base, 1
        while candidate in taken:
            n += 1
            suffix = f"_{n}"
            candidate = base[:COLUMN_NAME_CHARS - len(suffix)] + suffix
        taken.add(candidate)
        result.append(candidate)
    return result


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_column_names(df.columns))


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value. One aggregate pass; only its single row is fetched."""
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[i] > 0])


def apply_column_tags(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Check a tag map and drop the columns tagged ``ignore``."""
    unknown = sorted(set(tags) - set(df.columns))
    wrong = sorted(t for t in set(tags.values()) if t not in COLUMN_TAGS)
    if unknown or wrong:
        raise ValueError(f"unknown columns {unknown}, unknown tags {wrong}")
    return df.drop(*[c for c, tag in tags.items() if tag == "ignore"])
