"""Handing a state through the chunks of a key, when each chunk is a map from the state it gets to the state it leaves.

A fold over all chunks of a key would sit in one task. Maps compose, so it can be a tree: neighbouring maps join into one,
``fan`` at a time, until a key has ``fan`` of them at most; then states go down again, from each joined map to those it was
made of. No task ever holds more than ``fan`` maps of a key, and rows are not touched at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from airlens.session import cut_lineage

FAN = 64
State = tuple
_NUMBER, _UP, _PARENT = "__number", "__up", "__parent"


def inherited_states(
    maps: DataFrame,
    keys: list[str],
    chunk: str,
    columns: Sequence[str],
    state: Sequence[str],
    start: State,
    follow: Callable[[State, tuple], State],
    join: Callable[[list[tuple]], tuple],
    fan: int = FAN,
) -> DataFrame:
    """``keys, chunk, *state`` of every row of ``maps``: the state before that chunk.

    ``columns`` make up a map; ``follow(state, map)`` is the state behind it; ``join(maps in order)`` is one map that does
    the same as all of them in turn. States are tuples of integers or None, ``start`` the one before the first chunk.
    Chunk numbers may have gaps. Null keys are a key; an empty table gives no rows.
    """
    low = cut_lineage(maps.select(*dict.fromkeys([*keys, chunk, *columns])))
    bounds = low.agg(F.min(chunk).alias("low"), F.max(chunk).alias("high")).first()
    first, reach = (bounds["low"], bounds["high"] - bounds["low"] + 1) if bounds["low"] is not None else (0, 0)
    key_fields = [low.schema[k] for k in keys]
    map_fields = [low.schema[c] for c in columns]
    number = T.StructField(_NUMBER, T.LongType())
    state_fields = [T.StructField(s, T.LongType()) for s in state]

    levels = [low.select(*keys, (F.col(chunk) - F.lit(first)).cast("bigint").alias(_NUMBER), *columns)]
    def rows_of(table: pa.Table, names: Sequence[str]) -> list[tuple]:
        return list(zip(*(table.column(n).to_pylist() for n in names), strict=True))

    def result(key: tuple, rows: list[tuple], schema: T.StructType) -> pa.Table:
        """Rows of ``schema``, whose first fields are the key's."""
        arrow = to_arrow_schema(schema)
        columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in list(arrow)[len(keys) :]]
        owners = [pa.array([k.as_py()] * len(rows), f.type) for k, f in zip(key[: len(keys)], arrow, strict=False)]
        return pa.table([*owners, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keys) :], strict=True))], schema=arrow)

    kind = T.StructType([*key_fields, number, *map_fields])

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        rows = rows_of(table.sort_by("__below"), columns)
        return result(key, [(key[-1].as_py(), *(rows[0] if len(rows) == 1 else join(rows)))], kind)

    while reach > fan:
        upper = levels[-1].withColumnRenamed(_NUMBER, "__below").withColumn(_NUMBER, F.expr(f"__below div {fan}"))
        levels.append(cut_lineage(upper.groupBy(*keys, _NUMBER).applyInArrow(joined, kind)))
        reach = -(-reach // fan)

    out = T.StructType([*key_fields, number, *state_fields])

    def handed(key: tuple, table: pa.Table) -> pa.Table:
        above = rows_of(table.filter(table.column(_PARENT)), state)
        now, rows = (above[0] if above else start), []
        below = table.filter(pc.invert(table.column(_PARENT))).sort_by(_NUMBER)
        for n, *one in rows_of(below, (_NUMBER, *columns)):
            rows.append((n, *now))
            now = follow(now, tuple(one))
        return result(key, rows, out)

    nothing = [F.lit(None).cast("bigint").alias(s) for s in state]
    states: DataFrame | None = None
    for level in reversed(levels):
        rows = level.select(*keys, F.expr(f"{_NUMBER} div {fan}").alias(_UP), _NUMBER, *columns, *nothing, F.lit(False).alias(_PARENT))
        if states is None:
            states = rows.groupBy(*keys).applyInArrow(handed, out)
            continue
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in map_fields]
        above = states.select(*keys, F.col(_NUMBER).alias(_UP), F.lit(None).cast("bigint").alias(_NUMBER), *empty, *state, F.lit(True).alias(_PARENT))
        states = rows.union(above).groupBy(*keys, _UP).applyInArrow(handed, out)
    return states.select(*keys, (F.col(_NUMBER) + F.lit(first)).cast(low.schema[chunk].dataType).alias(chunk), *state)
