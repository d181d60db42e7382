"""Content hash of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns that do not count as content, and the spelling of a missing value.
NOT_CONTENT = ("created_at", "updated_at")
MISSING = "None"


def row_hash(columns: list[str], ignore: tuple[str, ...] = NOT_CONTENT) -> Column:
    """SHA-256 over ``name=value`` of all content columns, in name order.

    The value's length is part of the text, so no two rows share it by moving a separator.
    """
    parts = []
    for name in sorted(c for c in columns if c not in ignore):
        text = F.coalesce(F.col(name).cast("string"), F.lit(MISSING))
        parts += [F.lit(f"{name}={{"), F.length(text).cast("string"), F.lit("}"), text]
    return F.sha2(F.concat(*parts), 256)
