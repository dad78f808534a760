"""Greedy marking: a row is marked when its value passes the last *marked* value by a threshold.

Throttling, cooldowns, bitrate windows and clock resynchronisation all have this shape. It depends on its own
earlier decisions, so no window function expresses it. It is still parallel: a chunk of rows maps the last
mark it inherits to the last mark it leaves, and that map is a short step function. So: one task per
``(key, chunk)`` builds the map, maps of neighbouring chunks join in a tree (``compose``), and the chunks are then
marked independently with their true inheritance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens.operators.compose import FAN, inherited_states
from airlens.operators.ordered import CHUNK, DEFAULT_SPAN


def _next_marks(v: np.ndarray, step: int) -> np.ndarray:
    """Index of the first later row with value >= v[i] + step, or len(v)."""
    n = len(v)
    if n == 0 or np.all(v[1:] >= v[:-1]):
        return np.maximum(np.searchsorted(v, v + step, side="left"), np.arange(1, n + 1))
    # largest values of stretches of 1, 2, 4 ... rows; a row passes stretches that stay below what it needs, longest first
    tops = [v]
    while 2 * (1 << (len(tops) - 1)) <= n:
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    at, need = np.arange(1, n + 1), v + step
    for level in range(len(tops) - 1, -1, -1):
        for _ in range(2 if level == len(tops) - 1 else 1):
            inside = at + (1 << level) <= n
            low = np.zeros(n, bool)
            low[inside] = tops[level][at[inside]] < need[inside]
            at = at + (low.astype(np.int64) << level)
    return at


def chunk_map(v: np.ndarray, step: int) -> tuple[list[int], list[int]]:
    """Step function of a chunk: an inherited mark needing ``value >= x`` leaves ``exit`` of the first ``upto >= x``."""
    n = len(v)
    nxt = _next_marks(v, step)
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:  # each round doubles the number of marks passed
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    exits = v[last]
    running = np.maximum.accumulate(v)
    record = np.append(True, v[1:] > running[:-1])
    return _short(v[record], exits[record])


def _short(uptos: np.ndarray, outs: np.ndarray) -> tuple[list[int], list[int]]:
    """A step function without the steps that change nothing."""
    ends = np.append(outs[1:] != outs[:-1], True)
    ends[0] = True  # the very first row is the entry when nothing is inherited
    return uptos[ends].tolist(), outs[ends].tolist()


def apply_map(last: int | None, upto, exits, step: int) -> int:
    """Mark left by a chunk that inherits ``last``."""
    if last is None:
        return int(exits[0])
    i = int(np.searchsorted(np.asarray(upto), last + step, side="left"))
    return int(exits[i]) if i < len(exits) else last


def join_maps(maps: list[tuple], step: int) -> tuple[list[int], list[int], int | None]:
    """One step function for several chunks in a row, each ``(upto, exits, prior)``.

    ``prior`` is the largest value before a chunk, so no mark it inherits is larger: steps beyond it are left out, which
    keeps a joined map as short as one chunk's.
    """
    uptos, outs, prior = np.asarray(maps[0][0], np.int64), np.asarray(maps[0][1], np.int64), maps[0][2]
    none = prior is None
    for upto, exits, _ in maps[1:]:
        upto, exits = np.asarray(upto, np.int64), np.asarray(exits, np.int64)
        i = np.searchsorted(upto, outs + step, side="left")
        through = np.where(i < len(exits), exits[np.minimum(i, len(exits) - 1)], outs)
        new = upto > uptos[-1]
        uptos, outs = np.append(uptos, upto[new]), np.append(through, exits[new])
        if none:
            uptos, outs = uptos[:1], outs[:1]
        else:
            asked = int(np.searchsorted(uptos, int(prior) + step, side="left")) + 1
            uptos, outs = (np.asarray(x, np.int64) for x in _short(uptos[:asked], outs[:asked]))
    return uptos.tolist(), outs.tolist(), None if none else int(prior)


def greedy_marks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    threshold: int,
    strict: bool = False,
    span: int = DEFAULT_SPAN,
    name: str = "marked",
    fan: int = FAN,
) -> DataFrame:
    """Add a boolean: first row of the key, or value - last marked value >= ``threshold`` (> if ``strict``).

    ``value`` and ``order[0]`` are integers; ``order`` is unique within a key.
    """
    step = int(threshold) + (1 if strict else 0)
    slim = df.select(*keys, *[F.col(o) for o in order], F.col(value).cast("bigint").alias("__v"), F.expr(f"`{order[0]}` div {span}").alias(CHUNK))
    key_fields = [f for f in slim.schema.fields if f.name in keys]
    order_fields = [slim.schema[o] for o in order]
    chunk_field = T.StructField(CHUNK, T.LongType())
    longs = T.ArrayType(T.LongType())

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)["__v"].to_numpy(dtype=np.int64)
        upto, exits = chunk_map(v, step)
        return pd.DataFrame([[*key, upto, exits, int(v.max())]], columns=[*keys, CHUNK, "upto", "exits", "top"])

    fields = [*key_fields, chunk_field, T.StructField("upto", longs), T.StructField("exits", longs), T.StructField("top", T.LongType())]
    maps = slim.groupBy(*keys, CHUNK).applyInPandas(build, T.StructType(fields))
    prior = F.max("top").over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    asked = F.coalesce(F.size(F.filter("upto", lambda u: u < F.col("prior") + step)), F.lit(0)) + 1
    pruned = maps.withColumn("prior", prior).select(*keys, CHUNK, F.slice("upto", 1, asked).alias("upto"), F.slice("exits", 1, asked).alias("exits"), "prior")
    inherited = inherited_states(
        pruned, keys, CHUNK, ("upto", "exits", "prior"), ("inherited",), (None,),
        lambda state, one: (apply_map(state[0], one[0], one[1], step),), lambda several: join_maps(several, step), fan,
    )

    def mark(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = pdf["__v"].to_numpy(dtype=np.int64)
        start = pdf["inherited"].iloc[0]
        if pd.isna(start):
            i = 0
        else:
            hits = np.flatnonzero(v >= int(start) + step)
            i = int(hits[0]) if len(hits) else len(v)
        nxt = _next_marks(v, step)
        rows = []
        while i < len(v):
            rows.append(i)
            i = int(nxt[i])
        return pdf.iloc[rows][[*keys, *order]]

    # `inherited` is one row per chunk: adaptive execution picks the join by its real size.
    marked = (
        slim.join(inherited, [*keys, CHUNK])
        .groupBy(*keys, CHUNK)
        .applyInPandas(mark, T.StructType([*key_fields, *order_fields]))
        .withColumn(name, F.lit(True))
    )
    return df.join(marked, [*keys, *order], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def throttle(df: DataFrame, keys: list[str], order: list[str], interval: int, span: int | None = None) -> DataFrame:
    """Emit a row when none was emitted yet or the last *emitted* row is at least ``interval`` older (WIN-23).

    ``order[0]`` is the time column the interval refers to. Chunks default to 64 intervals.
    """
    span = span or max(64 * interval, DEFAULT_SPAN)
    return greedy_marks(df, keys, order, order[0], interval, span=span, name="emitted").filter("emitted").drop("emitted")
