"""Words as the operators of this package count them: runs of bytes other than space and ``\\t \\n \\v \\f \\r``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

GAP = r"[\x20\x09-\x0D]+"
IN_WORD = r"[^\x20\x09-\x0D]"


def full_text(name: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` looks at it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
