"""Native word expressions: words are runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def word_list(text: Column) -> Column:
    """Null text: no words."""
    bare = F.coalesce(F.regexp_replace(text.cast("string"), f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))
