"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Convention = str | Column


def choose(key: Convention, table: dict) -> Column:
    """Look a key up in a small fixed table; NULL when it is not there."""
    if isinstance(key, str):
        return F.lit(table.get(key))
    result = F.lit(None)
    for name, value in table.items():
        result = F.when(key == name, value).otherwise(result)
    return result


def by_convention(key: Convention, branches: dict[str, Callable[[], Column]]) -> Column:
    """Expression for a convention: given by name, only its branch is built; given as a column,
    rows choose among all branches and get NULL for a name that is not there."""
    if isinstance(key, str):
        return branches[key]()
    result = F.lit(None)
    for name, build in branches.items():
        result = F.when(key == name, build()).otherwise(result)
    return result


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside a lambda; without this it is evaluated at every mention."""
    return F.transform(F.array(value), body).getItem(0)
