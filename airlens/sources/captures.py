"""Captures: transport-stream files, RTP dumps and Ethernet frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.binary import be16, bits, tail, u8
from airlens.functions.once import evaluate_once
from airlens.operators.rtp import rtp_header
from airlens.operators.services import in_ranges
from airlens.sources import packet_files

PACKET = 188
RTP_HEADER = 12
HEAD_BYTES = RTP_HEADER + 7 * PACKET + RTP_HEADER + 1 + 2 * PACKET


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``capture, content``, each at most 2 GB; ``read_ts`` reads packets of files of any size."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("capture"), "content")


def split_packets(files: DataFrame, stride: Column | int = PACKET, header: Column | int = 0) -> DataFrame:
    """Packets ``capture, pkt_no, pkt`` of aligned content: records of ``stride`` bytes with ``header`` bytes in front."""
    stride = F.lit(stride) if isinstance(stride, int) else stride
    header = F.lit(header) if isinstance(header, int) else header
    per = ((stride - header) / PACKET).cast("bigint")
    laid = files.withColumn("__stride", stride).withColumn("__header", header).withColumn("__per", per)
    whole = F.floor(F.octet_length("content") / F.col("__stride")) * F.col("__per")
    rest = F.floor((F.octet_length("content") % F.col("__stride") - F.col("__header")) / PACKET)
    count = (whole + F.greatest(rest, F.lit(0))).cast("bigint")
    numbered = laid.withColumn("__n", count).filter("__n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("pkt_no"))
    at = F.floor(F.col("pkt_no") / F.col("__per")) * F.col("__stride") + F.col("__header") + F.pmod("pkt_no", "__per") * PACKET
    return numbered.select("capture", "pkt_no", F.substring("content", (at + 1).cast("int"), F.lit(PACKET)).alias("pkt"))


def resync_packets(files: DataFrame) -> DataFrame:
    """Packets of unaligned content (SRC-1): where a packet does not start with the sync byte, skip to the next one.

    A tail shorter than a packet is held back. One file is one chunk.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for capture, content in zip(batch["capture"], batch["content"]):
                data, at, rows = bytes(content), 0, []
                while True:
                    at = data.find(b"\x47", at)
                    if at < 0 or at + PACKET > len(data):
                        break
                    rows.append(data[at : at + PACKET])
                    at += PACKET
                yield pd.DataFrame({"capture": capture, "pkt_no": range(len(rows)), "pkt": rows})

    return files.mapInPandas(cut, "capture string, pkt_no bigint, pkt binary")


def read_ts(spark: SparkSession, path: str, aligned: bool = True, range_bytes: int = packet_files.RANGE_BYTES) -> DataFrame:
    """Packets of transport-stream files of any size, ``capture, pkt_no, pkt``, one capture per file (SRC-1, SRC-2).

    Raw packets and RTP records are told apart by each file's head. Unaligned files are looked through for sync bytes.
    """
    packet_files.register(spark)
    if not aligned:
        return packet_files.resynced(spark, path, range_bytes)
    return spark.read.format("packets").option("rangeBytes", range_bytes).load(path)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """The first 2.7 kB of every file, ``capture, size, content``: what ``detect_framing`` needs."""
    packet_files.register(spark)
    return spark.read.format("packet_heads").load(path)


def detect_framing(files: DataFrame, col: str = "content") -> DataFrame:
    """Framing of each file: raw packets, or RTP records of 1 to 7 packets with their stride (SRC-2)."""
    p, size = F.col(col), F.octet_length(col)
    sync = lambda at: F.coalesce(u8(p, at) == 0x47, F.lit(False))
    raw = (size >= 3 * PACKET) & sync(0) & sync(PACKET) & sync(2 * PACKET)
    fits = F.filter(
        F.array(*[F.lit(n) for n in range(1, 8)]),
        lambda n: (size >= n * PACKET + 2 * RTP_HEADER + 1) & sync(n * PACKET + 2 * RTP_HEADER)
        & F.forall(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(u8(p, k * PACKET + RTP_HEADER) == 0x47, F.lit(False))),
    )
    per_record = F.when(~raw & (size >= RTP_HEADER + PACKET) & (bits(u8(p, 0), 6, 3) == 2), F.try_element_at(fits, F.lit(1)))
    return files.withColumn("framing", F.when(per_record.isNotNull(), "rtp").otherwise("raw")).withColumn(
        "stride", F.coalesce(per_record * PACKET + RTP_HEADER, F.lit(PACKET)).cast("int")
    )


def deframed_packets(files: DataFrame) -> DataFrame:
    """Packets of raw or RTP-framed files, whichever each is."""
    known = detect_framing(files)
    return split_packets(known, F.col("stride"), F.when(F.col("framing") == "rtp", RTP_HEADER).otherwise(0))


EXTENSIONS = (0, 43, 60)  # fixed values: IPv6 extension headers with a length field
FRAGMENT, UDP = 44, 17


def _udp_offset_v6(p: Column, start: Column, first: Column) -> Column:
    """Offset of the UDP header behind IPv6 extension headers; null when the chain ends elsewhere."""

    def step(acc: Column, _i: Column) -> Column:
        known = acc["next"].isin(*EXTENSIONS)
        size = F.when(known, (u8(p, acc["at"] + 1) + 1) * 8).when(acc["next"] == FRAGMENT, 8)
        readable = F.octet_length(p) >= acc["at"] + F.when(known, 2).otherwise(8)
        moves = size.isNotNull() & readable
        return F.struct(
            F.when(moves, acc["at"] + size).otherwise(acc["at"]).alias("at"),
            F.when(moves, u8(p, acc["at"])).when(acc["next"] == UDP, UDP).otherwise(-1).alias("next"),
        )

    # a header takes 8 bytes or more, so the frame length bounds the walk
    steps = F.sequence(F.lit(0), F.floor(F.octet_length(p) / 8).cast("int"))
    end = F.aggregate(steps, F.struct(start.alias("at"), first.alias("next")), step)
    return F.when(end["next"] == UDP, end["at"])


def _address_v6(p: Column, at: Column) -> Column:
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(be16(p, at + i * 2))))
    return F.array_join(groups, ":")


def decode_frames(frames: DataFrame, ranges: DataFrame | None = None, col: str = "frame") -> DataFrame:
    """RTP packets carrying transport stream out of Ethernet frames, sent to one of ``ranges(cidr)`` (SRC-3).

    One VLAN tag, IPv4 or IPv6 with extension headers, UDP. IPv6 addresses are written in full.
    """
    p, size = F.col(col), F.octet_length(col)
    tagged = be16(p, 12) == 0x8100
    kind = F.when(tagged, be16(p, 16)).otherwise(be16(p, 12))
    ip = F.when(tagged, 18).otherwise(14)
    rest = [c for c in frames.columns if c != col]
    framed = frames.filter(size >= 14).select(*rest, p, kind.alias("__kind"), ip.alias("__ip"))
    at = F.col("__ip")
    ihl = bits(u8(p, at), 0, 15) * 4
    v4 = (F.col("__kind") == 0x0800) & (size >= at + 20) & (bits(u8(p, at), 4, 15) == 4) & (ihl >= 20) & (u8(p, at + 9) == UDP) & (size >= at + ihl + 8)
    v6 = (F.col("__kind") == 0x86DD) & (size >= at + 40) & (bits(u8(p, at), 4, 15) == 6)
    udp = F.when(v4, at + ihl).when(v6, _udp_offset_v6(p, at + 40, u8(p, at + 6)))
    dotted = F.concat_ws(".", *[u8(p, at + 16 + i).cast("string") for i in range(4)])
    traffic = F.when(v4, u8(p, at + 1)).otherwise(bits(u8(p, at), 0, 15) * 16 + bits(u8(p, at + 1), 4, 15))
    found = evaluate_once(framed, "__udp", udp).filter(F.col("__udp").isNotNull() & (size >= F.col("__udp") + 8))
    opened = found.select(
        *rest, F.when(v4, 4).otherwise(6).alias("family"), F.when(v4, dotted).otherwise(_address_v6(p, at + 24)).alias("address"), be16(p, F.col("__udp") + 2).alias("port"),
        traffic.bitwiseAND(F.lit(0xFC)).alias("dscp"), tail(p, F.col("__udp") + 8).alias("datagram"),
    )
    inside = opened if ranges is None else in_ranges(opened, "address", ranges)
    parsed = rtp_header(evaluate_once(inside, "datagram", F.col("datagram"))).filter("is_ts")
    return parsed.select(*rest, "family", "address", "port", "dscp", "ssrc", "seq", "rtp_ts", tail(F.col("datagram"), F.col("payload_off")).alias("payload"))
