"""Where-documents as Columns: ``{"topic": "a", "n": {"$gte": 3}, "$or": [...]}``.

A plain value means equality; several keys mean AND. Catalyst pushes the result down to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c.isNull() if v is None else c == v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "$nin": lambda c, v: ~c.isin(list(v)) if v else F.lit(True),
}


def where(condition: Mapping[str, Any] | None, null_safe: bool = False) -> Column:
    """``null_safe``: ``$ne`` and ``$nin`` keep rows whose value is null. Unknown operators raise ValueError."""
    parts = []
    for key, value in (condition or {}).items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, (where(v, null_safe) for v in value), F.lit(key == "$and")) if value else F.lit(True))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            parts.append(_field(F.col(key), value, null_safe))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _field(column: Column, value: Any, null_safe: bool) -> Column:
    if not isinstance(value, Mapping):
        return _COMPARE["$eq"](column, value)
    out = F.lit(True)
    for op, operand in value.items():
        if op == "$ne":
            found = ~column.eqNullSafe(operand) if null_safe else column != operand
        elif op in _COMPARE:
            found = _COMPARE[op](column, operand)
            if op == "$nin" and null_safe:
                found = found | column.isNull()
        else:
            raise ValueError(f"unknown operator {op}")
        out = out & found
    return out
