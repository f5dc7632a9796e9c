"""Text helpers with Unicode white space, as Python's ``str`` methods and ``re`` see it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of every pattern: Unicode classes, and only a line feed ends a line.
U = "(?Ud)"
#: White space as ``str.strip`` and ``str.split`` see it: that of Unicode and the four information separators.
SPACE = r"[\s\x1c-\x1f]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def words(c: str | Column) -> Column:
    """Split at white space; a blank text has no words."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"(?U){SPACE}+"))


def dots(c: str | Column) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit("."), F.lit("")))


def present(c: str | Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(col(c), F.lit("")) != ""


def last_part_dropped(c: str | Column) -> Column:
    """``3.6.5`` to ``3.6``; null if there is no dot."""
    return F.when(F.contains(col(c), F.lit(".")), F.regexp_replace(col(c), r"\.[^.]*$", ""))
