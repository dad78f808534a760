"""Removal of long repeated byte strings: suffix arrays in a family of sorted levels, sharded by content anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.llm import work
from airlens.llm.fingerprints import in_order

LENGTH = 100
SEED = 24
SLICE = 1 << 20
HEAVY_SHARE = 500
HEAVY_LEAST = 200
PLACE = np.uint64((1 << 21) - 1)


def _powers(root: int) -> np.ndarray:
    out = np.ones(SLICE + 4096, np.uint64)
    done = 1
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(pow(root, done, 1 << 64))
        done += more
    return out


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``seed, first, last``: for every anchor the hash of its bytes, and the first and last start of its windows.

    The anchor of a window (``length`` bytes) is its substring of 24 bytes with the smallest hash, the leftmost of equal
    ones, so equal windows have equal anchors wherever they stand. Each window belongs to one anchor, and the windows
    of an anchor follow each other.
    """
    root = int(work.GOLDEN)
    up, down = work.per_process(("powers", root), lambda: (_powers(root), _powers(pow(root, -1, 1 << 64))))
    width = length - SEED + 1
    out: list[tuple] = []
    for at in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data, np.uint8)[at : at + SLICE + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        value = work.mixed((total[SEED:] - total[:-SEED]) * down[: len(part) - SEED + 1])
        low = (value & ~PLACE) | np.arange(len(value), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        place = (low & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        out.append((value[place[first]], first + at, np.append(first[1:], len(place)) - 1 + at))
    if not out:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _of_batch(ids: list, texts: list, length: int, heavy: np.ndarray) -> dict:
    """Anchor rows of a batch: ``key, content`` (hashes of the anchor and of all bytes of its windows), and where they stand.

    Windows of a heavy anchor are rows of their own, keyed by their bytes: its documents then spread over many keys.
    """
    keys, contents, docs, firsts, lasts = [], [], [], [], []
    for i, text in zip(ids, texts, strict=True):
        data = work.raw(text)
        seed, first, last = anchors(data, length)
        if not len(seed):
            continue
        wide = np.isin(seed, heavy) if len(heavy) else np.zeros(len(seed), bool)
        a, b = first[~wide].tolist(), (last[~wide] + length).tolist()
        content = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        one = np.concatenate([np.arange(x, y + 1) for x, y in zip(first[wide], last[wide], strict=True)]) if wide.any() else np.empty(0, np.int64)
        both = [(xxhash.xxh3_64_intdigest(w), xxhash.xxh3_64_intdigest(w, 1)) for w in (data[s : s + length] for s in one.tolist())]
        keys.append(np.concatenate([seed[~wide], np.array([k for k, _ in both], np.uint64)]))
        contents.append(np.concatenate([content, np.array([c for _, c in both], np.uint64)]))
        firsts.append(np.concatenate([first[~wide], one]))
        lasts.append(np.concatenate([last[~wide], one]))
        docs.append(np.full(len(keys[-1]), i, np.int64))
    if not keys:
        return {k: np.empty(0, np.int64) for k in ("key", "content", "id", "first", "last")}
    return {k: np.concatenate(v) for k, v in zip(("key", "content", "id", "first", "last"), (keys, contents, docs, firsts, lasts), strict=True)}


def _heavy(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors with differing surroundings in at least one of 500 documents: at most 500 times the anchors of a document.

    Counted over all documents, batch by batch; a batch reports the anchors that it saw in 8 surroundings or more.
    """

    def run(ids, texts):
        rows = _of_batch(ids, texts, length, np.empty(0, np.uint64))
        pairs = np.unique(np.stack([rows["key"].view(np.int64), rows["content"].view(np.int64)], 1), axis=0) if len(rows["key"]) else np.empty((0, 2), np.int64)
        key, n = np.unique(pairs[:, 0], return_counts=True)
        return {"key": key[n >= 8], "n": n[n >= 8]}

    least = max(HEAVY_LEAST, docs.count() // HEAVY_SHARE)
    found = work.map_batches(docs, run, "key bigint, n bigint", "id", "text").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array([r.key for r in found.select("key").collect()], np.int64).view(np.uint64)


def _placed(docs: DataFrame, length: int) -> DataFrame:
    """``key, content, id, first, last, known``; known: a batch already holds the same content earlier."""
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(docs, length))

    def run(ids, texts):
        rows = _of_batch(ids, texts, length, heavy.value)
        order = np.lexsort((rows["first"], rows["id"], rows["content"], rows["key"]))
        rows = {k: v[order] for k, v in rows.items()}
        known = np.zeros(len(order), bool)
        known[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["content"][1:] == rows["content"][:-1])
        # These need no further look, so they go anywhere: a batch sends one row of a content, however often it holds it.
        spread = work.mixed(rows["id"].astype(np.uint64) * work.GOLDEN + rows["first"].astype(np.uint64))
        rows["key"] = np.where(known, spread, rows["key"]).view(np.int64)
        rows["content"] = rows["content"].view(np.int64)
        return rows | {"known": known}

    return work.map_batches(docs, run, "key bigint, content bigint, id bigint, first bigint, last bigint, known boolean", "id", "text")


class Levels:
    """Sorted runs of distinct ``length``-byte strings; each new batch is matched against all of them and joins them.

    A batch's windows are put in suffix order. A merge scan of that order against every level finds the windows that
    stand earlier; the others become a level of their own, and levels of like size merge, so a string moves a
    logarithmic number of times.
    """

    def __init__(self, length: int):
        self.type = f"S{length}"
        self.runs: list[np.ndarray] = []

    def clear(self) -> None:
        self.runs = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Whether each window (in order of its place) equals an earlier one, of this batch or before."""
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        again = np.zeros(len(ordered), bool)
        again[1:] = ordered[1:] == ordered[:-1]
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, ordered), len(run) - 1)
            again |= run[at] == ordered
        fresh = ordered[~again]
        if len(fresh):
            self.runs.append(fresh)
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            last, before = self.runs.pop(), self.runs.pop()
            self.runs.append(np.sort(np.concatenate([before, last]), kind="stable"))
        out = np.empty(len(order), bool)
        out[order] = again
        return out


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that the windows at ``starts`` (rising) cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + length)))
    return starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)] + length


def _resolve(rows: DataFrame, length: int) -> DataFrame:
    """``id, start, stop``: repeated ranges among ``key, id, first, data``, rows of a key in order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, last_key = Levels(length), None
        for batch in work.slices(batches):
            keys = batch.column("key").to_pylist()
            if keys[0] != last_key:
                levels.clear()  # keys rise: nothing of an earlier one comes again
            last_key = keys[-1]
            spans = batch.column("data").to_pylist()
            text = np.frombuffer(b"".join(spans), np.uint8)
            sizes = np.array([len(s) for s in spans], np.int64)
            count = sizes - length + 1
            row = np.repeat(np.arange(len(spans)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            starts = np.repeat(np.cumsum(sizes) - sizes, count) + inside
            windows = np.lib.stride_tricks.sliding_window_view(text, length)[starts].copy().view(levels.type)[:, 0]
            again = levels.add(windows)
            # Rows far apart on one scale: windows of different rows never join.
            begin, end = _runs(row[again] * (1 << 24) + inside[again], length)
            owner = begin >> 24
            ids = np.array(batch.column("id").to_pylist(), np.int64)[owner]
            first = np.array(batch.column("first").to_pylist(), np.int64)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first + (begin & 0xFFFFFF)), pa.array(first + end - (owner << 24))], names=["id", "start", "stop"])
        levels.clear()
        work.give_back()

    sharded = rows.repartition("key").sortWithinPartitions("key", "id", "first")
    return sharded.select("key", "id", "first", "data").mapInArrow(run, "id bigint, start bigint, stop bigint")


def repeated_ranges(docs: DataFrame, packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """``id, start, stop``: byte ranges of ``docs(id, text)`` covered by ``length``-byte strings that start earlier.

    ``packed(id, packed)``: the same texts, compressed. Every window is known by its anchor. Anchors are shuffled as hashes,
    first: windows of an anchor whose whole surroundings stand earlier are done; anchors that occur in one surrounding only
    have no repeat. The rest, a few in a hundred, send their bytes to the shard of their anchor, where suffix arrays
    in levels compare them window by window. A batch sends a surrounding once however often it holds it, and windows
    of the most frequent anchors are sharded by their own bytes, so that no shard grows with a passage that a large
    part of all documents shares.
    """
    by_key = Window.partitionBy("key")
    ranked = (
        _placed(docs, length)
        .withColumn("before", F.lag("content").over(by_key.orderBy("content", "id", "first")))
        .withColumn("low", F.min("content").over(by_key))
        .withColumn("high", F.max("content").over(by_key))
        .withColumn("whole", F.col("known") | F.coalesce(F.col("before") == F.col("content"), F.lit(False)))
        .where("whole or low <> high")
    )
    ranked = work.written(ranked.select("key", "id", "first", "last", "whole"))
    whole = ranked.where("whole").select("id", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    open_ = ranked.where("not whole").groupBy("id").agg(F.collect_list(F.struct("key", "first", "last")).alias("spans"))  # at most a row for each byte of a text

    def cut(ids, packs, spans):
        unpack = zstandard.ZstdDecompressor().decompress
        out = {"key": [], "id": [], "first": [], "data": []}
        for i, pack, own in zip(ids, packs, spans, strict=True):
            data = unpack(pack)
            for s in own:
                out["key"].append(s["key"])
                out["id"].append(i)
                out["first"].append(s["first"])
                out["data"].append(data[s["first"] : s["last"] + length])
        return out

    parts = work.map_batches(packed.join(open_, "id"), cut, "key bigint, id bigint, first bigint, data binary", "id", "packed", "spans")
    return whole.union(_resolve(parts, length))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` of every row: its text without repeats.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document of smaller doc_id, or further left
    in the same one. Overlaps count; all strings are judged on the input. ``spans`` are the removed ranges as pairs
    ``start, stop``, ``kept`` the bytes that stay (binary: a cut may part a character).

    Null text is empty; texts under ``length`` bytes stay whole. Null doc_id counts as the smallest. Rows of one doc_id follow
    each other by a hash of their text, so of equal rows one stays whole. Other columns are ignored.
    """
    return _cut(docs, length, [])


def _cut(docs: DataFrame, length: int, carry: list[str]) -> DataFrame:
    """``without_repeats``; the columns in ``carry`` come along as ``carry_<name>``."""
    lowest = -(1 << 63) + 1
    carried = [F.col(c).alias(f"carry_{c}") for c in carry]
    rows = docs.select(F.coalesce("doc_id", F.lit(lowest)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", *carried)
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = in_order(rows, F.col("id"), F.xxhash64("text")).drop("total", "id").withColumnRenamed("pos", "id")
    names = ["doc_id", *[f"carry_{c}" for c in carry]]
    types = ", ".join(f"`{n}` {dict(rows.dtypes)[n]}" for n in names)

    def pack(ids, texts, *others):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return {"id": ids, "packed": [squeeze(work.raw(t)) for t in texts]} | dict(zip(names, others, strict=True))

    packed = work.map_batches(rows, pack, f"id bigint, packed binary, {types}", "id", "text", *names)
    ranges = work.written(repeated_ranges(rows, packed.select("id", "packed"), length))
    per_doc = ranges.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))  # ranges of one text

    def finish(packs, ranges, *others):
        unpack = zstandard.ZstdDecompressor().decompress
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for pack, own in zip(packs, ranges, strict=True):
            data, spans, kept, at = unpack(pack), [], [], 0
            for r in sorted((r["start"], r["stop"]) for r in own or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], r[1]))
                else:
                    spans.append(r)
            for start, stop in spans:
                kept.append(data[at:start])
                at = stop
            rest = b"".join([*kept, data[at:]])
            row = (len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "stop": b} for a, b in spans], rest)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out | dict(zip(names, others, strict=True))

    schema = f"{types}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    return work.map_batches(packed.join(per_doc, "id", "left"), finish, schema, "packed", "ranges", *names)


def trimmed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeats taken out of ``text`` and ``n_chars`` of the rest; parts of a cut character go too."""
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text", "n_chars")]

    def run(kept, ids, *columns):
        texts = [k.decode("utf-8", "ignore") for k in kept]
        return dict(zip(others, columns, strict=True)) | {"doc_id": ids, "text": texts, "n_chars": [len(t) for t in texts]}

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return work.map_batches(_cut(docs, length, others), run, schema, "kept", "doc_id", *[f"carry_{c}" for c in others])
