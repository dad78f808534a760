"""Packet files as a Spark data source: read by byte range, written with commit and abort.

    register(spark)
    spark.read.format("packets").load("captures/*.ts")             # capture, pkt_no, pkt
    packets.write.format("packets").mode("overwrite").save(path)   # or write_packets(packets, path)

A file of any size is cut into ranges of ``rangeBytes``; a task reads neighbouring ranges, 32 MB of them at most unless one is
larger, so short ranges and short files make no more tasks. Each task looks at the first 2.7 kB of its files, finds raw packets or RTP records of 1 to 7 packets (``framing``: auto, raw), and takes the records that begin in its
range. ``resynced`` also finds packets that do not stand at multiples of their length: where no sync byte stands, the next
one is taken. Where a packet begins then depends on all before it, so each range is first reduced to a map from the place
where it is entered to the place where it is left, the maps meet in a tree (``compose``), and ranges are read from there.

Files are opened through Arrow's file systems: local paths, ``file:``, ``hdfs:``, ``s3:`` and the like.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from airlens.operators.compose import inherited_states

PACKET, SYNC, RTP_HEADER = 188, 0x47, 12
HEAD_BYTES = RTP_HEADER + 7 * PACKET + RTP_HEADER + 1 + 2 * PACKET
RANGE_BYTES = 32 << 20
BATCH = 16_384
NO_CAPTURE = "__HIVE_DEFAULT_PARTITION__"

PACKETS = "capture string, pkt_no bigint, pkt binary"
HEADS = "capture string, size bigint, content binary"
MAPS = "capture string, range_no bigint, uri string, size bigint, start bigint, stop bigint, exits array<bigint>, counts array<bigint>"


class Framing(NamedTuple):
    """Records of ``stride`` bytes, ``header`` of them in front of packets. Packets lie in the records' payloads end to end."""

    stride: int = PACKET
    header: int = 0

    @property
    def load(self) -> int:
        return self.stride - self.header

    def payload_size(self, size: int) -> int:
        return size // self.stride * self.load + max(size % self.stride - self.header, 0)


def framing_of(head: bytes) -> Framing:
    """Raw if the first three packets are in step, else RTP records that are, else raw (SRC-2)."""
    at = lambda i: i < len(head) and head[i] == SYNC
    if all(at(k * PACKET) for k in range(3)):
        return Framing()
    if len(head) >= RTP_HEADER + PACKET and head[0] >> 6 == 2:
        for n in range(1, 8):
            stride = RTP_HEADER + n * PACKET
            if at(stride + RTP_HEADER) and all(at(RTP_HEADER + k * PACKET) for k in range(n)):
                return Framing(stride, RTP_HEADER)
    return Framing()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+://", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """``(URI, size)`` of a file, of all files below a folder or of those that a pattern matches, by name."""
    system, inside = located(path)
    prefix = path[: len(path) - len(inside)] if "://" in path else ""
    magic = re.search(r"[*?\[]", inside)
    root = inside[: magic.start()].rpartition("/")[0] or "/" if magic else inside
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    fits = lambda p: not magic or fnmatch.fnmatch(p, inside)
    hidden = lambda p: any(part[:1] in "_." for part in p[len(root) :].split("/") if part)
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and fits(f.path) and not hidden(f.path))


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file of ``size`` bytes; ``before`` packets lie in earlier files of its capture."""

    capture: str | None
    uri: str
    size: int
    low: int
    high: int
    number: int
    before: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]


def _dealt(ranges: list[Range], size: int) -> list[Ranges]:
    """Neighbouring ranges in tasks of ``size`` bytes, or of a 64th of all bytes where that is less."""
    size = min(size, sum(r.high - r.low for r in ranges) // 64)
    tasks, held = [], size
    for one in ranges:
        if held >= size:
            tasks.append(Ranges([]))
            held = 0
        tasks[-1].ranges.append(one)
        held += one.high - one.low
    return tasks


def _owner(uri: str) -> str | None:
    folder = re.search(r"/capture=([^/]*)/[^/]*$", uri)
    if not folder:
        return uri
    return None if folder[1] == NO_CAPTURE else unquote(folder[1])


class _File:
    """An open file and its framing."""

    def __init__(self, uri: str, size: int, framing: str):
        system, inside = located(uri)
        self.uri, self.file, self.size = uri, system.open_input_file(inside), size
        self.framing = Framing() if framing == "raw" else framing_of(self.file.read_at(min(HEAD_BYTES, size), 0))
        self.total = self.framing.payload_size(size)

    def records(self, low: int, high: int) -> tuple[int, int]:
        """Payload of the records that begin in bytes ``low`` to ``high``."""
        stride, load = self.framing.stride, self.framing.load
        return min(-(-low // stride) * load, self.total), min(-(-high // stride) * load, self.total)

    def payload(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.total)
        if stop <= start:
            return b""
        stride, header, load = self.framing.stride, self.framing.header, self.framing.load
        if not header:
            return self.file.read_at(stop - start, start)
        first, last = start // load, -(-stop // load)
        held = self.file.read_at(min(last * stride, self.size) - first * stride, first * stride)
        whole = len(held) // stride
        rows = np.frombuffer(held, np.uint8, whole * stride).reshape(whole, stride)[:, header:]
        joined = rows.tobytes() + held[whole * stride + header :]
        return joined[start - first * load : stop - first * load]


def _batch(capture: str | None, first: int, data: bytes | pa.Buffer, n: int) -> pa.RecordBatch:
    """``n`` packets that lie end to end in ``data``, without copying them."""
    offsets = pa.py_buffer(np.arange(0, (n + 1) * PACKET, PACKET, dtype=np.int32))
    packets = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array([capture] * n, pa.string()), pa.array(np.arange(first, first + n)), packets], names=["capture", "pkt_no", "pkt"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.framing = options["path"], options.get("framing", "auto")
        self.range_bytes = max(int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))), 8 * PACKET)

    def partitions(self) -> list[InputPartition]:
        out, before, last = [], 0, object()
        for uri, size in _files(self.path):
            capture = _owner(uri)
            if capture != last:
                before, last = 0, capture
            out += [Range(capture, uri, size, low, min(low + self.range_bytes, size), i, before) for i, low in enumerate(range(0, size, self.range_bytes))]
            before += size // PACKET
        return _dealt(out, RANGE_BYTES) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator:
        file = None
        for one in partition.ranges:
            if file is None or file.uri != one.uri:
                file = _File(one.uri, one.size, self.framing)
            yield from self.rows(file, one)

    def rows(self, file: _File, one: Range) -> Iterator:
        raise NotImplementedError


class PacketReader(_Reader):
    """Packets at multiples of their length, whatever their first byte; a last part shorter than a packet is left out."""

    def rows(self, file: _File, one: Range) -> Iterator[pa.RecordBatch]:
        start, stop = file.records(one.low, one.high)
        number, end = start // PACKET, stop // PACKET
        while number < end:
            n = min(BATCH, end - number)
            yield _batch(one.capture, one.before + number, file.payload(number * PACKET, (number + n) * PACKET), n)
            number += n


class HeadReader(_Reader):
    """The first 2.7 kB of each file: enough to tell its framing."""

    def partitions(self) -> list[InputPartition]:
        files = _files(self.path)
        return [InputPartition(files[i : i + 1000]) for i in range(0, len(files), 1000)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri, size in partition.value:
            system, inside = located(uri)
            with system.open_input_file(inside) as file:
                yield _owner(uri), size, file.read_at(min(HEAD_BYTES, size), 0)


class MapReader(_Reader):
    """One row a range: its payload ``start`` to ``stop``, and for an entry at ``start + i`` where the chain of packets
    leaves it (``exits``, from ``start``) and how many packets begin in it (``counts``)."""

    def rows(self, file: _File, one: Range) -> Iterator[tuple]:
        start, stop = file.records(one.low, one.high)
        if start < stop:
            exits, counts = range_map(file.payload(start, stop + PACKET - 1), stop - start, PACKET if start else 1)
            yield one.uri, one.number, one.uri, one.size, start, stop, exits, counts


class PacketFiles(DataSource):
    """Options: ``rangeBytes``; ``framing`` auto or raw; when writing, ``records`` any for values that are no packets."""

    kind, rows = PacketReader, PACKETS

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return self.rows

    def reader(self, schema) -> DataSourceReader:
        return self.kind(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PacketWriter:
        return PacketWriter(self.options["path"], overwrite, self.options.get("records", "packets") == "any")


class PacketHeads(PacketFiles):
    kind, rows = HeadReader, HEADS

    @classmethod
    def name(cls) -> str:
        return "packet_heads"


class PacketMaps(PacketFiles):
    kind, rows = MapReader, MAPS

    @classmethod
    def name(cls) -> str:
        return "packet_maps"


def register(spark: SparkSession) -> None:
    for source in (PacketFiles, PacketHeads, PacketMaps):
        spark.dataSource.register(source)


def _run(held: np.ndarray, at: int, most: int) -> int:
    """How many of ``most`` packets from ``at`` on begin with the sync byte; longer and longer stretches are looked at."""
    done, stretch = 0, 16
    while done < most:
        n = min(stretch, most - done)
        wrong = np.flatnonzero(held[at + done * PACKET : at + (done + n - 1) * PACKET + 1 : PACKET] != SYNC)
        if len(wrong):
            return done + int(wrong[0])
        done, stretch = done + n, stretch * 8
    return done


def _chain(data: bytes, size: int, at: int) -> Iterator[tuple[int, int]]:
    """``(place, packets)`` of each unbroken stretch of packets that begin before ``size``, then ``(exit, 0)``."""
    held = np.frombuffer(data, np.uint8)
    while at < size and at + PACKET <= len(data):
        if data[at] != SYNC:
            at = data.find(b"\x47", at, size)
            if at < 0:
                at = size
            continue
        n = _run(held, at, min(-(-(size - at) // PACKET), (len(data) - at) // PACKET))
        yield at, n
        at += n * PACKET
    yield max(at, size), 0


def range_map(data: bytes, size: int, entries: int = PACKET) -> tuple[list[int], list[int]]:
    """Exits and counts of the first ``entries`` entries of a range of ``size`` bytes (``data`` reaches into the next one).

    Chains that meet go on as one: each stops at a stretch that an earlier one has been through.
    """
    held = np.frombuffer(data, np.uint8)
    stretches: dict[int, list[tuple[int, int, int, int]]] = {}  # by place in a packet: from, to, packets after, exit
    exits, counts = [], []
    for entry in range(min(entries, size)):
        at, own, after, out = entry, [], 0, None
        while out is None:
            if at >= size or at + PACKET > len(data):
                out = max(at, size)
                break
            if data[at] != SYNC:
                at = data.find(b"\x47", at, size)
                at = size if at < 0 else at
                continue
            met = next((s for s in stretches.get(at % PACKET, ()) if s[0] <= at < s[1]), None)
            if met:
                after, out = met[2] + (met[1] - at) // PACKET, met[3]
                break
            n = _run(held, at, min(-(-(size - at) // PACKET), (len(data) - at) // PACKET))
            own.append((at, at + n * PACKET))
            at += n * PACKET
        for low, high in reversed(own):
            stretches.setdefault(low % PACKET, []).append((low, high, after, out))
            after += (high - low) // PACKET
        exits.append(out)
        counts.append(after)
    return exits, counts


def _follow(state: tuple, one: tuple) -> tuple:
    """Place and packet number behind a range; an entry behind all of it passes by."""
    start, stop, exits, counts = one
    entry, number = state
    i = entry - start
    return state if entry >= stop or i >= len(exits) else (start + int(exits[i]), number + int(counts[i]))


def _join(maps: list[tuple]) -> tuple:
    start, stop, size = int(maps[0][0]), int(maps[-1][1]), len(maps[0][2])
    exits, counts = [], []
    for i in range(size):
        state = (start + i, 0)
        for one in maps:
            state = _follow(state, one)
        exits.append(state[0] - start)
        counts.append(state[1])
    return start, stop, exits, counts


def resynced(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, framing: str = "auto", fan: int = 64) -> DataFrame:
    """Packets of files whose packets may stand anywhere, ``capture, pkt_no, pkt`` (SRC-1): each file is one capture.

    From its first byte on, the next sync byte begins a packet, the place behind a packet is looked at next; a tail shorter
    than a packet is left out. Ranges of any size give the same packets. Files are read twice.
    """
    register(spark)
    maps = spark.read.format("packet_maps").option("rangeBytes", range_bytes).option("framing", framing).load(path)
    states = inherited_states(maps, ["uri"], "range_no", ("start", "stop", "exits", "counts"), ("entry", "number"), (0, 0), _follow, _join, fan)
    # ranges by their own numbers: the reader cuts files in the same way again
    ranges = states.select("uri", "range_no", "entry", "number").repartition(F.col("uri"), F.col("range_no"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, range_no, entry, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inside = located(uri)
                file = _File(uri, system.get_file_info(inside).size, framing)
                start, stop = file.records(range_no * range_bytes, min((range_no + 1) * range_bytes, file.size))
                data = file.payload(start, stop + PACKET - 1)
                for at, n in _chain(data, stop - start, entry - start):
                    for k in range(0, n, BATCH):
                        m = min(BATCH, n - k)
                        yield _batch(uri, number + k, pa.py_buffer(data)[at + k * PACKET : at + (k + m) * PACKET], m)
                    number += n

    return ranges.mapInArrow(read, PACKETS)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PacketWriter(DataSourceArrowWriter):
    """Each task appends its packets, in their order, to one file a capture in a folder of the job; only when all tasks have
    succeeded do the files move to ``capture=<name>/``, so a failed or repeated task leaves nothing behind."""

    def __init__(self, path: str, overwrite: bool, any_length: bool):
        self.path, self.overwrite, self.any_length = path.rstrip("/"), overwrite, any_length
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = located(self.path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        moves, now, out = [], object(), None
        try:
            for batch in iterator:
                captures, values = batch.column("capture").to_pylist(), batch.column("pkt")
                if values.null_count or not self.any_length and any(n != PACKET for n in pa.compute.binary_length(values).to_pylist()):
                    raise ValueError(f"a packet must have {PACKET} bytes")
                cuts = [0, *[i for i in range(1, len(captures)) if captures[i] != captures[i - 1]], len(captures)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if low == high:
                        continue
                    if captures[low] != now:
                        if out:
                            out.close()
                        now = captures[low]
                        folder = f"capture={NO_CAPTURE if now is None else quote(str(now), safe='')}"
                        name = f"part-{part:06d}-{len(moves):06d}"
                        source = f"{root}/{self.job}/{attempt}/{folder}"
                        system.create_dir(source)
                        moves.append((f"{source}/{name}.ts", f"{folder}/{name}-{attempt}.ts"))
                        out = system.open_output_stream(moves[-1][0])
                    _, offsets, data = values.buffers()
                    at = np.frombuffer(offsets, np.int32)[values.offset + low : values.offset + high + 1]
                    out.write(data[int(at[0]) : int(at[-1])])
        finally:
            if out:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("capture="):
                    system.delete_dir(info.path)
        for source, target in (m for message in messages if message for m in message.files):
            system.create_dir(f"{root}/{target}".rpartition("/")[0])
            system.move(source, f"{root}/{target}")
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*located(self.path))

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def write_packets(
    packets: DataFrame, path: str, columns: tuple[str, str] = ("capture", "pkt_no"), mode: str = "overwrite", any_length: bool = False, one_file: bool = False
) -> None:
    """Kept packets as packet files, in their order, one folder a capture (SNK-5): files in name order are the capture.

    Range partitioning splits a large capture over many tasks, each of which writes a file. With ``one_file`` a capture's
    packets go through one task instead, one by one. Read back with the same format; packets are then numbered from 0 on in
    each capture. ``any_length``: values need not be packets.
    """
    register(packets.sparkSession)
    owner, number = columns
    named = packets.select(F.col(owner).cast("string").alias("capture"), F.col(number).alias("__number"), "pkt")
    dealt = named.repartition("capture") if one_file else named.repartitionByRange("capture", "__number")
    ordered = dealt.sortWithinPartitions("capture", "__number")
    ordered.select("capture", "pkt").write.format("packets").mode(mode).option("records", "any" if any_length else "packets").save(path)
