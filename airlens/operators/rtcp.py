"""Feedback datagrams: one row per request, termination, loss entry and receiver name (PRJ-6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.binary import be16, be32, be64, bits, u8
from airlens.functions.once import evaluate_once

# fixed values: packet types, formats and parameter types
PT_FEEDBACK, PT_SDES = 205, 202
FMT_NACK, FMT_RAMS = 1, 6
RAMS_REQUEST, RAMS_TERMINATION = 1, 3
TLV_SSRC, TLV_MIN_FILL, TLV_MAX_FILL, TLV_MAX_RATE, TLV_FIRST_SEQ = 1, 2, 3, 4, 61
ITEM_CNAME = 1

EVENT = (
    "kind string, sender_ssrc bigint, media_ssrc bigint, entry int, pid int, blp int, truncated boolean, ignore_media_ssrc boolean, "
    "min_fill_ms bigint, max_fill_ms bigint, max_bps decimal(20,0), first_seq bigint, malformed boolean, cname string"
)


def _walk(steps: Column, start: Column, kind: str, next_: Callable) -> Column:
    """Items of a chain of records: ``next_(at) -> (fits, size, item)`` until one does not fit; with the end of the walk."""

    def step(acc: Column, _i: Column) -> Column:
        fits, size, item = next_(acc["at"])
        fits = ~acc["over"] & F.coalesce(fits, F.lit(False))
        return F.struct(
            F.when(fits, acc["at"] + size).otherwise(acc["at"]).alias("at"), (~fits).alias("over"),
            F.when(fits, F.concat(acc["items"], F.array(item))).otherwise(acc["items"]).alias("items"),
        )

    begin = F.struct(start.alias("at"), F.lit(False).alias("over"), F.array().cast(f"array<struct<{kind}>>").alias("items"))
    return F.aggregate(steps, begin, step)


def packets(p: Column) -> Column:
    """Packets of a compound datagram as ARRAY<STRUCT<type, fmt, body>>; a bad version or an overrun ends it."""

    def one(at: Column):
        size = (be16(p, at + 2) + 1) * 4
        item = F.struct(u8(p, at + 1).alias("type"), bits(u8(p, at), 0, 31).alias("fmt"), F.substring(p, at + 1, size).alias("body"))
        return (bits(u8(p, at), 6, 3) == 2) & (at + size <= F.octet_length(p)), size, item

    return _walk(F.sequence(F.lit(1), F.floor(F.octet_length(p) / 4).cast("int")), F.lit(0), "type:int,fmt:int,body:binary", one)["items"]


def parameters(b: Column) -> Column:
    """Type and value pairs behind the 16 header bytes, padded to four, and ``at`` where they end."""

    def one(at: Column):
        size = be16(b, at + 2)
        item = F.struct(u8(b, at).alias("type"), F.substring(b, at + 5, size).alias("value"))
        return at + 4 + size <= F.octet_length(b), F.floor((size + 7) / 4).cast("int") * 4, item

    return _walk(F.sequence(F.lit(0), F.floor(F.octet_length(b) / 4).cast("int")), F.lit(16), "type:int,value:binary", one)


def receiver_names(b: Column, chunks: Column) -> Column:
    """Source and name of each of ``chunks`` descriptions that gives one, as ARRAY<STRUCT<ssrc, name>>.

    A step takes either a source or one of its items: two bytes or more each, and one step more ends a description.
    """
    size = F.octet_length(b)

    def step(acc: Column, _i: Column) -> Column:
        at, inside = acc["at"], acc["inside"]
        opens = ~inside & (acc["left"] > 0) & (at + 4 <= size)
        fits = F.coalesce((u8(b, at) != 0) & (at + 2 + u8(b, at + 1) <= size), F.lit(False))
        item, closes = inside & fits, inside & ~fits
        end = at + F.when(at < size, 1).otherwise(0)
        named = item & (u8(b, at) == ITEM_CNAME) & acc["name"].isNull()
        padded = acc["begin"] + F.floor((end - acc["begin"] + 3) / 4).cast("int") * 4
        found = F.array(F.struct(be32(b, acc["begin"]).alias("ssrc"), acc["name"].alias("name")))
        return F.struct(
            F.when(opens, at + 4).when(item, at + 2 + u8(b, at + 1)).when(closes, padded).otherwise(at).alias("at"),
            F.when(opens, at).otherwise(acc["begin"]).alias("begin"),
            F.when(opens, True).when(closes, False).otherwise(inside).alias("inside"),
            F.when(closes, acc["left"] - 1).when(inside | opens, acc["left"]).otherwise(0).alias("left"),
            F.when(named, F.substring(b, at + 3, u8(b, at + 1))).when(inside, acc["name"]).alias("name"),
            F.when(closes & acc["name"].isNotNull(), F.concat(acc["items"], found)).otherwise(acc["items"]).alias("items"),
        )

    begin = F.struct(
        F.lit(4).alias("at"), F.lit(4).alias("begin"), F.lit(False).alias("inside"), chunks.alias("left"), F.lit(None).cast("binary").alias("name"),
        F.array().cast("array<struct<ssrc:bigint,name:binary>>").alias("items"),
    )
    return F.aggregate(F.sequence(F.lit(0), size), begin, step)["items"]


def rtcp_explode(df: DataFrame, col: str = "datagram") -> DataFrame:
    """Rows of ``df`` multiplied by the events in their datagram; datagrams without events vanish.

    ``truncated`` is always false: entries are bounded by the packet's length field alone.
    """
    rest = [c for c in df.columns if c != col]
    split = df.select(*rest, F.explode(packets(F.col(col))).alias("__p")).select(*rest, "__p.*")
    b, size = F.col("body"), F.octet_length("body")
    feedback = F.col("type") == PT_FEEDBACK
    nulls = {name: F.lit(None).cast(kind) for name, kind in (part.split(" ") for part in EVENT.split(", "))}

    def events(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select(*rest, *[(values.get(name, null)).cast(null_type).alias(name) for (name, null), null_type in zip(nulls.items(), types, strict=True)])

    types = [part.split(" ")[1] for part in EVENT.split(", ")]
    ends = {"sender_ssrc": be32(b, 4), "media_ssrc": be32(b, 8)}
    count = F.floor((size - 12) / 4).cast("int")
    nacks = split.filter(feedback & (F.col("fmt") == FMT_NACK) & (count > 0)).withColumn("entry", F.explode(F.sequence(F.lit(0), count - 1)))
    lost = events(nacks, kind=F.lit("nack"), entry=F.col("entry"), pid=be16(b, F.col("entry") * 4 + 12), blp=be16(b, F.col("entry") * 4 + 14), truncated=F.lit(False), **ends)

    rams = evaluate_once(split.filter(feedback & (F.col("fmt") == FMT_RAMS) & (size >= 16)), "__t", parameters(b))
    items = F.col("__t.items")

    def value(kind: int, read: Callable, width: int) -> Column:
        """Value of the last parameter of a kind that is long enough."""
        return read(F.try_element_at(F.filter(items, lambda t: (t["type"] == kind) & (F.octet_length(t["value"]) >= width)), F.lit(-1))["value"], 0)

    requests = events(
        rams.filter(u8(b, 12) == RAMS_REQUEST), kind=F.lit("request"), ignore_media_ssrc=F.exists(items, lambda t: t["type"] == TLV_SSRC),
        min_fill_ms=value(TLV_MIN_FILL, be32, 4), max_fill_ms=value(TLV_MAX_FILL, be32, 4), max_bps=value(TLV_MAX_RATE, be64, 8), **ends,
    )
    # a header that is whole, with a value that is not
    bad = F.col("__t.at") + 4 <= size
    endings = events(rams.filter(u8(b, 12) == RAMS_TERMINATION), kind=F.lit("termination"), malformed=bad, first_seq=value(TLV_FIRST_SEQ, be32, 4), **ends)

    described = split.filter(F.col("type") == PT_SDES).withColumn("__n", F.explode(receiver_names(b, F.col("fmt"))))
    names = events(described, kind=F.lit("name"), sender_ssrc=F.col("__n.ssrc"), cname=F.make_valid_utf8(F.col("__n.name").cast("string")))
    return lost.unionByName(requests).unionByName(endings).unionByName(names)
