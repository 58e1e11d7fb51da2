"""Value cores and word sequences shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def core(c: Column | str) -> Column:
    """Letters and digits of a value in lower case; NULL stays NULL."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), NOT_WORD, "")


def words(c: Column | str) -> Column:
    """The word sequence of a text as one string, words in lower case with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), NOT_WORD, " "))
