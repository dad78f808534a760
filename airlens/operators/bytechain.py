"""Walking records in a byte stream that may sit in one key, in parallel.

Audio frames and in-band metadata blocks are chains: where a record starts depends on all before it. The stream is
cut at fixed byte positions, each piece with enough of the next to finish its last record. A task per piece maps
every possible entry position to the position where the chain leaves the piece; maps of neighbouring pieces join in a
tree (``compose``); then each piece is walked from its true entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens.operators.compose import FAN, inherited_states
from airlens.operators.ordered import RunningSum, scan

PIECE_BYTES = 1 << 22
STEP = Callable[[bytes, int], int]  # next position, or -1 when more bytes are needed


def byte_pieces(rows: DataFrame, keys: list[str], order: list[str], data: str, look: int, piece: int = PIECE_BYTES) -> DataFrame:
    """Rows cut into ``(keys, piece)``: bytes [piece * size, (piece + 1) * size + look) of each key's stream."""
    sized = rows.withColumn("__len", F.octet_length(data).cast("bigint")).filter("__len > 0")
    placed = scan(sized, keys, order, __end=RunningSum(F.col("__len"))).withColumn("__at", F.col("__end") - F.col("__len"))
    first = F.floor(F.greatest(F.col("__at") - look, F.lit(0)) / piece)
    cut = placed.withColumn("piece", F.explode(F.sequence(first, F.floor((F.col("__end") - 1) / piece))))
    low = F.greatest(F.col("__at"), F.col("piece") * piece)
    high = F.least(F.col("__end"), (F.col("piece") + 1) * piece + look)
    part = F.substring(data, (low - F.col("__at") + 1).cast("int"), (high - low).cast("int"))
    return cut.filter(high > low).select(*keys, "piece", low.alias("at"), part.alias("part"))


def _exit_map(buf: bytes, base: int, size: int, entries: int, step: STEP) -> tuple[list[int], list[int]]:
    """Last entry of each stretch of equal exits, and those exits as absolute positions (-1: the stream ends here)."""
    known: dict[int, int] = {}
    uptos, exits = [], []
    for entry in range(min(entries, size)):
        at, seen = entry, []
        while 0 <= at < size and at not in known:
            seen.append(at)
            at = step(buf, at)
        out = known[at] if at in known else (base + at if at >= 0 else -1)
        for p in seen:
            known[p] = out
        if exits and exits[-1] == out:
            uptos[-1] = entry
        else:
            uptos.append(entry)
            exits.append(out)
    return uptos, exits


def leave(entry: int, number: int, uptos, exits, size: int) -> int:
    """Where a chain that is at ``entry`` stands behind a piece or joined pieces (-1: its stream has ended).

    Entries lie in the stretches of the map, or behind all of it when a record spans it whole."""
    offset = entry - number * size
    return entry if entry < 0 or offset > uptos[-1] else int(exits[int(np.searchsorted(np.asarray(uptos), offset))])


def join_exits(maps: list[tuple], size: int, look: int) -> tuple[int, list[int], list[int]]:
    """The exit map of neighbouring pieces: entries reach ``look`` bytes into them, over pieces' ends where pieces are
    shorter. Stretches are those of the pieces that an entry may lie in, numbered from the first piece on."""
    first = maps[0][0]
    starts: list[int] = []
    for number, upto, _ in maps:
        shift = (number - first) * size
        if shift > look:
            break
        starts += [shift + int(u) for u in upto]
    at = np.asarray(starts, np.int64) + first * size
    for number, upto, outs in maps:  # all entries go through a map at once
        offset = at - number * size
        inside = (at >= 0) & (offset <= upto[-1])
        at[inside] = np.asarray(outs, np.int64)[np.searchsorted(np.asarray(upto, np.int64), offset[inside])]
    uptos: list[int] = []
    exits: list[int] = []
    for start, out in zip(starts, at.tolist(), strict=True):
        if exits and exits[-1] == out and uptos[-1] < start:
            uptos[-1] = start
        else:
            uptos.append(start)
            exits.append(out)
    return first, uptos, exits


def pack_map(uptos, exits, end: int, look: int) -> bytes:
    """A map as one value: for each entry its exit, counted from ``end``, where the piece or the joined pieces end.

    No exit is further than ``look`` behind that. A piece of a few KB has about as many stretches as entries, so places in
    lists of 8 bytes would be several times the stream itself.
    """
    reach = np.diff(np.asarray(uptos, np.int64), prepend=-1)
    outs = np.asarray(exits, np.int64)
    return np.repeat(np.where(outs < 0, 0, outs - end + 1), reach).astype(_packed(look)).tobytes()


def unpack_map(packed: bytes, end: int, look: int) -> tuple[np.ndarray, np.ndarray]:
    """``uptos, exits`` of a packed map."""
    places = np.frombuffer(packed, _packed(look)).astype(np.int64)
    uptos = np.append(np.flatnonzero(np.diff(places)), len(places) - 1)
    outs = places[uptos]
    return uptos, np.where(outs == 0, -1, outs + end - 1)


def _packed(look: int) -> str:
    return "<u2" if look < (1 << 16) - 1 else "<u4"


def walk_records(
    pieces: DataFrame,
    keys: list[str],
    look: int,
    step_of: Callable[[tuple], STEP],
    emit: Callable[[tuple, bytes, int, int], Iterator[tuple]],
    schema: str,
    piece: int = PIECE_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """Records of every stream. ``step_of(key)`` gives the step of a stream; ``emit(key, buf, start, next)`` yields
    rows (without keys) for one step, or none when it only skips. ``schema`` describes them after ``keys, at``.
    """
    key_fields = [f for f in pieces.schema.fields if f.name in keys]
    longs = [T.StructField(name, T.LongType()) for name in ("piece", "until")]

    def joined(pdf: pd.DataFrame) -> bytes:
        return b"".join(bytes(p) for p in pdf.sort_values("at")["part"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(key[-1]) * piece
        uptos, exits = _exit_map(joined(pdf), base, piece, look + 1 if base else 1, step_of(key[:-1]))
        until = int(key[-1]) + 1
        return pd.DataFrame([[*key, until, pack_map(uptos, exits, until * piece, look)]], columns=[*keys, "piece", "until", "map"])

    maps = pieces.groupBy(*keys, "piece").applyInPandas(build, T.StructType([*key_fields, *longs, T.StructField("map", T.BinaryType())]))

    def follow(state: tuple, one: tuple) -> tuple:
        number, until, packed = one
        return (leave(state[0], number, *unpack_map(packed, until * piece, look), piece),)

    def join(several: list[tuple]) -> tuple:
        until = several[-1][1]
        first, uptos, exits = join_exits([(n, *unpack_map(m, u * piece, look)) for n, u, m in several], piece, look)
        return first, until, pack_map(uptos, exits, until * piece, look)

    entered = inherited_states(maps, keys, "piece", ("piece", "until", "map"), ("entry",), (0,), follow, join, fan)
    offset = F.col("entry") - F.col("piece") * piece
    # the stream ended before this piece, or one record spans it whole
    entries = entered.where((F.col("entry") >= 0) & (offset < piece)).withColumn("entry", offset)
    out = T._parse_datatype_string(schema)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        buf, base, at = joined(pdf), int(key[-1]) * piece, int(pdf["entry"].iloc[0])
        step, rows = step_of(key[:-1]), []
        while 0 <= at < piece:
            after = step(buf, at)
            if after < 0:
                break
            rows += [(*key[:-1], base + at, *r) for r in emit(key[:-1], buf, at, after)]
            at = after
        return pd.DataFrame(rows, columns=[*keys, "at", *out.fieldNames()])

    return pieces.join(entries, [*keys, "piece"]).groupBy(*keys, "piece").applyInPandas(
        walk, T.StructType([*key_fields, T.StructField("at", T.LongType()), *out.fields])
    )
