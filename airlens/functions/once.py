"""Keep a costly column from being copied into every expression that reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def evaluate_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``df`` with ``expr`` as column ``name``, computed once per row.

    Filters and projections are otherwise merged with the expressions below them, which repeats a byte-level
    computation for every reference. A one-element generator is a boundary they do not cross, and costs no shuffle.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(expr)).alias(name))
