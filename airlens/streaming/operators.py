"""Structured Streaming operators: keyed state for the folds, built-in windows and deduplication for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from airlens.streaming import folds
from airlens.streaming.folds import Fold

ENDS = "ends"
KEY, GROUP = "fold_key", "fold_group"  # a row's key as one text, and the group of keys that it falls in


class _Keyed(StatefulProcessor):
    """Runs a fold for each key of a group of keys, which share a call, a list of states and a timer: what a call to the
    state store costs is paid once a group and micro-batch.

    The state is a list of typed rows, one for each key with something to remember, and a list of entries for each map; the timer stands at the earliest of
    the keys' deadlines. A row whose ``ends`` is true closes its key: what is still open is released and its state is gone.
    """

    def __init__(self, fold: Fold, columns: list[str], timed: bool):
        self.fold, self.columns, self.timed = fold, columns, timed
        self.fields = [f.split()[0] for f in fold.state.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("state", f"{KEY} string, {self.fold.state}")
        self.maps = {name: handle.getListState(name, f"{KEY} string, {key}, {value}") for name, (key, value) in self.fold.maps.items()}

    def _load(self) -> dict[str, dict]:
        states = {}
        for key, *values in self.held.get():
            state = {n: list(v) if isinstance(v, (list, np.ndarray)) else v for n, v in zip(self.fields, values, strict=True) if v is not None}
            states[key] = state | {name: {} for name in self.maps}
        for name, entries in self.maps.items():
            for key, number, *value in entries.get():
                states[key][name][number] = value[0] if len(value) == 1 else tuple(value)
        return {key: self.fold.unpacked(state) for key, state in states.items()}

    def _save(self, states: dict[str, dict], expiring: bool = False) -> None:
        if self.timed:
            if not expiring:  # the engine itself deletes a timer that fired
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            ends = [end for end in map(self.fold.deadline, states.values()) if end is not None]
            if ends:
                self.handle.registerTimer(-(-min(ends) // 1000))  # whole milliseconds, never early
        kept = {key: self.fold.packed(state) for key, state in states.items() if state}
        self._put(self.held, [(key, *map(state.get, self.fields)) for key, state in kept.items()])
        for name, entries in self.maps.items():
            pairs = [(key, number, value) for key, state in kept.items() for number, value in state.get(name, {}).items()]
            self._put(entries, [(key, number, *(value if isinstance(value, tuple) else (value,))) for key, number, value in pairs])

    @staticmethod
    def _put(held: ListState, rows: list[tuple]) -> None:
        if rows:
            held.put(rows)
        else:
            held.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[KEY, *self.columns])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch[GROUP] = batch[KEY].factorize()[0]
        batch = batch.sort_values([GROUP, *self.fold.order], kind="stable")
        owners, keys = batch.pop(GROUP).to_numpy(), batch.pop(KEY).tolist()
        columns = {c: batch[c].to_numpy() for c in batch.columns}  # folds keep what they work out for a batch beside them
        plain = {c: values.tolist() for c, values in columns.items()}
        edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(batch)]
        closing = np.flatnonzero(columns[ENDS].astype(bool)).tolist() if ENDS in columns else []
        states, out, at, next_end = self._load(), [], 0, 0
        for high in edges[1:]:
            owner = keys[at]
            state = states.setdefault(owner, {})
            found = []
            while at < high:
                closes = next_end < len(closing) and closing[next_end] < high
                end = closing[next_end] if closes else high
                while at < end:
                    after, released = self.fold.stretch(state, columns, at, end)
                    if after == at:
                        released, after = self.fold.step(state, {c: values[at] for c, values in plain.items()}), at + 1
                    found += released
                    at = after
                if closes:
                    found += self.fold.finish(state, {c: values[end] for c, values in plain.items()})
                    state.clear()
                    at, next_end = end + 1, next_end + 1
            out += [(owner, *r) for r in found]
        self._save(states)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        states, out = self._load(), []
        for owner, state in states.items():
            end, before = self.fold.deadline(state), None
            while end is not None and end != before and -(-end // 1000) <= now:
                out += [(owner, *r) for r in self.fold.expire(state, -(-end // 1000) * 1000)]
                end, before = self.fold.deadline(state), end
        self._save(states, expiring=True)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def keyed_fold(stream: DataFrame, fold: Fold, keys: list[str], time_us: str | None = None, delay: str = "1 second", mode: str = "append", groups: int = 1024) -> DataFrame:
    """Rows a fold releases per key. ``time_us`` drives its timers through a watermark ``delay`` behind.

    A boolean column ``ends`` is optional: where it is true, the row closes its key. Rows of a key are ordered within a
    micro-batch, so its size (files or offsets per trigger) bounds a task's memory. Folds look at the clock on every row,
    so a timer only matters for keys that get none. Keys are whole numbers or texts; they are dealt to ``groups`` groups,
    and the state of a group is read and written as a whole when one of its keys has rows, so many millions of open keys
    want more groups. Needs the RocksDB state store.
    """
    released = T._parse_datatype_string(fold.output)
    schema = T.StructType([T.StructField(KEY, T.StringType()), *released.fields])
    timed = stream.withColumn(KEY, F.to_json(F.struct(*keys)))
    timed = timed.withColumn(GROUP, F.pmod(F.xxhash64(KEY), F.lit(groups)).cast("int"))
    if time_us:
        timed = timed.withColumn("__ts", F.timestamp_micros(F.col(time_us))).withWatermark("__ts", delay)
    found = timed.groupBy(GROUP).transformWithStateInPandas(
        _Keyed(fold, released.fieldNames(), time_us is not None), schema, mode, "EventTime" if time_us else "None"
    )
    named = found.withColumn(KEY, F.from_json(KEY, T.StructType([stream.schema[k] for k in keys])))
    return named.select(*[F.col(KEY)[k].alias(k) for k in keys], *released.fieldNames())


def metric_store(stream: DataFrame, expiry_s: int = 30, delay: str = "1 second") -> DataFrame:
    """Accepted and expired snapshots per instance (STR-1)."""
    return keyed_fold(stream, folds.MetricStore(expiry_s * 1_000_000), ["component", "metrics_id"], "recv_us", delay)


def rtp_repair(stream: DataFrame, wait_us: int = 200_000, delay: str = "1 second") -> DataFrame:
    """Delivered and lost numbers per channel in delivery order (STR-2)."""
    return keyed_fold(stream, folds.RtpRepair(wait_us), ["channel"], "arrival_us", delay)


def doc_reassembly(stream: DataFrame) -> DataFrame:
    """Complete documents per payload and segment (STR-3), as ``docs.doc_reassembly`` has them; a text payload gives text."""
    found = keyed_fold(stream, folds.DocReassembly(), ["payload_id", "segment_id"])
    return found if isinstance(stream.schema["payload"].dataType, T.BinaryType) else found.withColumn("document", F.decode("document", "UTF-8"))


def bitrate_stream(stream: DataFrame, window: str = "2 seconds", delay: str = "1 second") -> DataFrame:
    """Bits per fixed window and channel (STR-4)."""
    timed = stream.withColumn("ts", F.timestamp_micros("arrival_us")).withWatermark("ts", delay)
    sums = timed.groupBy("channel", F.window("ts", window).alias("w")).agg((F.sum("payload_len") * 8).cast("bigint").alias("bits"))
    return sums.select("channel", F.unix_micros("w.start").alias("window_us"), "bits")


def bitrate_stream_exact(stream: DataFrame, window_s: int = 2) -> DataFrame:
    """Bitrate windows as a live counter closes them (STR-4, exact)."""
    return keyed_fold(stream, folds.ExactBitrate(window_s), ["channel"])


def activity_stream(stream: DataFrame, keys: list[str], time_us: str, idle_us: int, delay: str = "1 second") -> DataFrame:
    """Activity sessions per key, closed after ``idle_us`` of silence (STR-5 per channel, STR-6 per client).

    Silence of exactly the limit still counts as the same session, hence the extra microsecond.
    """
    timed = stream.withColumn("ts", F.timestamp_micros(F.col(time_us))).withWatermark("ts", delay)
    gap = f"{idle_us + 1} microseconds"
    sessions = timed.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.min(time_us).alias("first_us"), F.max(time_us).alias("last_us"), F.count(F.lit(1)).alias("rows"))
    return sessions.drop("w")


def integrity_stream(stream: DataFrame) -> DataFrame:
    """Integrity counters per pid, one row a micro-batch with the totals so far (STR-7); the latest replaces those before
    it. Add a connection number to ``capture`` to start over on reconnect."""
    return keyed_fold(stream, folds.Integrity(), ["capture", "pid"], mode="update")


def service_discovery(stream: DataFrame, budget_s: float = 5.0, delay: str = "1 second") -> DataFrame:
    """Programs of each capture once all are named, or what is known when the budget is over (STR-8)."""
    return keyed_fold(stream, folds.ServiceDiscovery(int(budget_s * 1_000_000)), ["capture"], "us", delay)


def dedupe_segments(stream: DataFrame, time_us: str = "arrival_us", horizon: str = "10 minutes") -> DataFrame:
    """Each (payload, segment, version) once within ``horizon`` (STR-9)."""
    timed = stream.withColumn("ts", F.timestamp_micros(F.col(time_us))).withWatermark("ts", horizon)
    return timed.dropDuplicatesWithinWatermark(["payload_id", "segment_id", "version"]).drop("ts")


def cue_stream(stream: DataFrame, lead_ms: int = 0, delay: str = "1 second") -> DataFrame:
    """Subtitle cues per capture as they end (STR-10). ``stream``: ``capture, i, ts_ms, text``, and ``ends`` where
    a capture closes."""
    timed = stream.withColumn("__us", F.col("ts_ms") * 1000)
    return keyed_fold(timed, folds.Cues(lead_ms), ["capture"], "__us", delay)
