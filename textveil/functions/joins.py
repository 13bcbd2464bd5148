"""Joins on scopes that may be null."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame

from .lineage import wide

#: The name of a scope that is held as one struct: never null itself, and structs of equal fields are equal, null ones too.
HELD = "_scope"


def meet(left: DataFrame, right: DataFrame, scope: Iterable[str], keys: Iterable[str] = (), how: str = "inner") -> DataFrame:
    """left joined with right on the scope's columns, of which nulls are equal, and on the keys. Shared columns are left's."""
    scope, keys = list(scope), list(keys)
    if set(scope) <= {HELD}:
        return left.join(wide(right), [*scope, *keys], how)
    side = right.withColumnsRenamed({c: f"_right_{c}" for c in (*scope, *keys)})
    equal = [left[c].eqNullSafe(side[f"_right_{c}"]) for c in scope] + [left[c] == side[f"_right_{c}"] for c in keys]
    return left.join(wide(side), reduce(lambda a, b: a & b, equal), how).drop(*[f"_right_{c}" for c in (*scope, *keys)])
