"""A value that an expression mentions several times, evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``. In branches of conditions and in lambdas each mention would be evaluated anew; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
