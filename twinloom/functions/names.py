"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Reference a column whose name may hold dots, commas or backticks."""
    return F.col(quoted(name))


def div(a, b) -> Column:
    """``a / b``, null where ``b`` is 0 (plain division raises in ANSI mode)."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a, b)
