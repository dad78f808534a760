"""Packing of documents into sequences of a fixed number of tokens: dominance reduction, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.llm import work
from airlens.llm.word_bpe import encoder

BUCKET_ROWS = 200_000


class _Lengths:
    """A multiset of lengths, kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, times: int = 1) -> None:
        self.n[length] -= times
        if not self.n[length]:
            del self.n[length]
            self.order.remove(length)

    def largest(self, room: int) -> int:
        """The largest length up to ``room``, 0 if there is none."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else 0

    def smallest(self, k: int) -> list[int]:
        """The ``k`` smallest items, as many as there are."""
        out: list[int] = []
        for x in self.order:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out


def _dominating(item: int, rest: _Lengths, capacity: int) -> tuple[int, ...] | None:
    """Partners that, with ``item``, dominate every other set it could stand in; None if none is found.

    A set dominates another when the other's items can be split so that each part fits into one of its items.
    """
    room = capacity - item
    one = rest.largest(room)
    if not one:
        return ()
    if one == room:  # all that may stand beside the item fits into this one
        return (one,)
    low = rest.smallest(3)
    if len(low) < 2 or sum(low[:2]) > room:  # nothing but single partners fits
        return (one,)
    if len(low) == 3 and sum(low) <= room:
        return None
    rest.take(one)
    two = rest.largest(room - one)
    rest.n[one] = rest.n.get(one, 0) + 1
    if one not in rest.order:
        rest.order.insert(bisect_left(rest.order, one), one)
    for small in rest.order[bisect_right(rest.order, two) : bisect_right(rest.order, room // 2)]:
        mate = rest.largest(room - small)
        if mate == small and rest.n[small] < 2:
            mate = 0
        if mate >= small and mate + small > one:
            return None
    return (one, two) if two else (one,)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, for ``counts[length]`` pieces.

    Dominance reduction first: from the longest on, sets of up to three pieces that dominate all alternatives are fixed
    for good and leave the instance. The rest goes, longest first, into the fullest sequence with room. The plan depends
    on the histogram of lengths alone, so it has at most a few patterns a length whatever the number of documents.
    """
    rest = _Lengths(counts)
    fixed: Counter = Counter()
    for item in sorted(counts, reverse=True):
        while rest.n.get(item):
            rest.take(item)
            partners = _dominating(item, rest, capacity)
            if partners is None:
                rest.n[item] = rest.n.get(item, 0) + 1
                if item not in rest.order:
                    rest.order.insert(bisect_left(rest.order, item), item)
                break
            need = Counter(partners)
            # The verdict holds as long as its partners last; at least once, they were counted in it.
            times = 1 + max(0, min([rest.n.get(item, 0), *((rest.n[p] - k) // k for p, k in need.items() if p != item)])) if item not in need else 1
            if item in need:
                times = max(1, (rest.n.get(item, 0) + 1) // (need[item] + 1)) if len(need) == 1 else 1
            rest_items = times - 1
            if rest_items:
                rest.take(item, rest_items)
            for p, k in need.items():
                rest.take(p, k * times)
            fixed[(item, *partners)] += times
    return list(fixed.items()) + _best_fit(rest.n, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length over a histogram: open sequences with equal contents are handled as one."""
    rooms: dict[int, Counter] = defaultdict(Counter)  # room left: contents -> sequences
    order: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if not rooms[room]:
            order.insert(bisect_left(order, room), room)
        rooms[room][content] += n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(order, length)
            if i == len(order):
                each = min(n, capacity // length)
                bins = n // each
                put(capacity - each * length, (length,) * each, bins)
                n -= bins * each
                continue
            room = order[i]
            content, have = next(iter(rooms[room].items()))
            each = min(n, room // length)
            bins = min(have, n // each)
            rooms[room][content] -= bins
            if not rooms[room][content]:
                del rooms[room][content]
                if not rooms[room]:
                    order.pop(i)
            put(room - each * length, content + (length,) * each, bins)
            n -= bins * each
    return [(content, n) for held in rooms.values() for content, n in held.items()]


def pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and a closing 0, cut at ``capacity`` ids."""

    def run(ids, texts):
        bpe = encoder(path)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
        for doc, text in zip(ids, texts, strict=True):
            data = bpe.encode(text) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[np.frombuffer(part, "<u4")] * with_ids)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
        return out

    return work.map_batches(docs, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids, "doc_id", "text")


def pack(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their place: ``sequence_id``, and ``offset`` in it, without gaps from 0.

    ``with_ids`` also returns each piece's token ids. Only documents of more than ``capacity`` ids are cut.

    The plan is made from the histogram of piece lengths (``capacity`` rows at most), and pieces take its places by
    their rank among those of their length. Ranks are counted in hash buckets of bounded size, so a length that a third
    of all documents share is spread. Null and empty texts are the single id 0. Repeated rows and null ids are packed as
    they are. No rows: no sequences. Other columns are ignored.
    """
    rows = work.written(pieces(docs, path, capacity, with_ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("length").orderBy("bucket")) - F.col("size")).drop("size")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(within)).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))

    # Where the pieces of each length go: parallel lists of first ranks, first sequences, pieces a sequence and offsets.
    places = defaultdict(lambda: ([], [], [], []))
    used: Counter = Counter()
    sequence = 0
    for content, n in plan(counts, capacity):
        offset = 0
        for length, times in Counter(content).items():
            starts, sequences, each, offsets = places[length]
            starts.append(used[length])
            sequences.append(sequence)
            each.append(times)
            offsets.append(offset)
            used[length] += n * times
            offset += length * times
        sequence += n
    places = {k: tuple(np.array(x, np.int64) for x in v) for k, v in places.items()}
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(*columns):
        *kept, ranks = columns
        length, rank = np.array(kept[3], np.int64), np.array(ranks, np.int64)
        sequence_id, offset = np.empty_like(rank), np.empty_like(rank)
        for value in np.unique(length):
            own = length == value
            starts, sequences, each, offsets = places[int(value)]
            at = np.searchsorted(starts, rank[own], "right") - 1
            nth = rank[own] - starts[at]
            sequence_id[own] = sequences[at] + nth // each[at]
            offset[own] = offsets[at] + nth % each[at] * value
        return dict(zip(names, kept, strict=True)) | {"sequence_id": sequence_id, "offset": offset}

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return work.map_batches(ranked, run, schema + ", sequence_id bigint, offset bigint", *names, "rank")
