"""Line-based lists: services, channel mapping, reverse map, packages and regional cells.

Readers take ``doc, pos, line`` rows. ``pos`` orders the lines of a document; it need not be dense. Every reader keeps
bad lines with an ``error`` text instead of dropping them; ``strict`` turns them into a failure of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.text import xml_unescape
from airlens.operators.ordered import Lag, row_number, scan
from airlens.operators.services import parse_mcast_uri


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("doc"), F.monotonically_increasing_id().alias("pos"), F.rtrim(F.lit("\r"), F.col("value")).alias("line")
    )


def strict(rows: DataFrame) -> DataFrame:
    """Fail on the first row with an error, else drop the error column."""
    guard = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("doc"), F.col("error"), F.col("line")))).otherwise(F.col("line"))
    return rows.withColumn("line", guard).filter("line IS NOT NULL").drop("error", "line")


def _number(text: Column, default: Column) -> Column:
    """Leading digits of a text as a number, 0 without digits; ``default`` where the text is missing."""
    digits = F.regexp_extract(text, r"^\s*\+?(\d+)", 1)
    return F.when(text.isNull(), default).otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(0))).cast("int")


def _entries(rows: DataFrame, name: Column, uri: Column, triplet: tuple[Column, Column, Column], defaults=(1, 1, None)) -> DataFrame:
    """Numbered services; a missing service id becomes the number of the entry."""
    numbered = row_number(rows, ["doc"], ["pos"], "ord")
    tsid, onid, sid = triplet
    own = F.col("ord") if defaults[2] is None else F.lit(defaults[2])
    out = numbered.withColumn("__u", parse_mcast_uri(uri)).select(
        "doc", "ord", "line", name.alias("name"), uri.alias("uri"), "__u.rtp", "__u.family", "__u.address", "__u.port",
        _number(tsid, F.lit(defaults[0])).alias("tsid"), _number(onid, F.lit(defaults[1])).alias("onid"), _number(sid, own.cast("int")).alias("sid"),
        F.when(F.col("__u").isNull(), "bad uri").alias("error"),
    )
    return out


def parse_services_csv(lines: DataFrame, defaults=(1, 1, None)) -> DataFrame:
    """``name,uri[,tsid,onid,sid]``; further fields ignored (SRC-6). The matching tool's reader uses defaults 0, 0, 0."""
    field = lambda i: F.try_element_at(F.split("line", ",", -1), F.lit(i))
    rows = lines.filter("line <> ''")
    out = _entries(rows, field(1), F.coalesce(field(2), F.lit("")), (field(3), field(4), field(5)), defaults)
    return out.withColumn("error", F.when(F.instr("line", ",") == 0, "expected name,uri").otherwise(F.col("error")))


def parse_services_m3u(lines: DataFrame) -> DataFrame:
    """``#EXTINF`` line with attributes and a name after its last comma, then the address line (SRC-6)."""
    is_info = F.col("line").startswith("#EXTINF:")
    kept = lines.filter("line <> ''").filter(is_info | ~F.col("line").startswith("#"))
    paired = scan(kept, ["doc"], ["pos"], __info=Lag(F.when(is_info, F.col("line")).otherwise("")))
    rows = paired.filter(~is_info & (F.col("__info") != ""))
    info = F.col("__info")
    attr = lambda n: F.when(info.rlike(rf'\b{n}="[^"]*"'), F.regexp_extract(info, rf'\b{n}="([^"]*)"', 1))
    own = attr("sid")
    sid = F.when(own.try_cast("bigint") != 0, own)  # a zero service id counts as missing
    return _entries(rows, F.substring_index(info, ",", -1), F.col("line"), (attr("tsid"), attr("onid"), sid)).withColumn(
        "error", F.col("error")
    )


TRACK = "location string, title string, extension struct<_tsid string, _onid string, _sid string>"


def read_services_xspf(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of playlist documents (SRC-6)."""
    tracks = spark.read.format("xml").option("rowTag", "track").schema(TRACK).load(path)
    return parse_tracks(tracks.select(F.col("_metadata.file_path").alias("doc"), F.monotonically_increasing_id().alias("pos"), F.struct("location", "title", "extension").alias("t")))


def parse_tracks(tracks: DataFrame) -> DataFrame:
    """Services from ``doc, pos, t`` where t is a parsed track."""
    rows = tracks.withColumn("line", F.coalesce(F.col("t.location"), F.lit("")))
    return _entries(rows, F.coalesce("t.title", F.lit("")), F.col("line"), (F.col("t.extension._tsid"), F.col("t.extension._onid"), F.col("t.extension._sid")))


SERVICE = (
    "ServiceLocation struct<IPMulticastAddress struct<_Address string, _Port int, _Streaming string>>, TextualIdentifier struct<_ServiceName string>,"
    " DVBTriplet struct<_OrigNetId int, _TSId int, _ServiceId int>"
)


def read_services_xml(spark: SparkSession, path: str) -> DataFrame:
    """Services of announcement documents (SRC-6)."""
    return spark.read.format("xml").option("rowTag", "SingleService").schema(SERVICE).load(path).transform(announced_services)


def announced_services(rows: DataFrame) -> DataFrame:
    """Flat services from parsed announcement entries."""
    at = "ServiceLocation.IPMulticastAddress"
    family = F.when(F.col(f"{at}._Address").contains(":"), 6).otherwise(4)
    return rows.select(
        F.col("TextualIdentifier._ServiceName").alias("name"), (F.col(f"{at}._Streaming") == "rtp").alias("rtp"), family.alias("family"),
        F.col(f"{at}._Address").alias("address"), F.col(f"{at}._Port").alias("port"), F.col("DVBTriplet._TSId").alias("tsid"),
        F.col("DVBTriplet._OrigNetId").alias("onid"), F.col("DVBTriplet._ServiceId").alias("sid"),
    )


def parse_mapping(lines: DataFrame) -> DataFrame:
    """``id,uri,tsid,onid,sid`` split at the last four commas (SRC-7)."""
    pattern = r"^(.*),([^,]*),([^,]*),([^,]*),([^,]*)$"
    rows = row_number(lines.filter("line <> '' AND NOT line LIKE '#%'"), ["doc"], ["pos"], "ord")
    g = lambda i: F.regexp_extract("line", pattern, i)
    return rows.select(
        "doc", "ord", "line", g(1).alias("id"), g(2).alias("uri"), _number(g(3), F.lit(0)).alias("tsid"), _number(g(4), F.lit(0)).alias("onid"),
        _number(g(5), F.lit(0)).alias("sid"), F.when(~F.col("line").rlike(pattern), "expected id,uri,tsid,onid,sid").alias("error"),
    )


def parse_revmap(lines: DataFrame) -> DataFrame:
    """``uri,id`` split at the first comma (SRC-8)."""
    rows = row_number(lines.filter("line <> '' AND NOT line LIKE '#%'"), ["doc"], ["pos"], "ord")
    at = F.instr("line", ",")
    return rows.select(
        "doc", "ord", "line", F.substring("line", F.lit(1), at - 1).alias("uri"), F.substring("line", at + 1, F.length("line")).alias("id"),
        F.when(at == 0, "expected uri,id").alias("error"),
    )


def parse_packages(lines: DataFrame) -> DataFrame:
    """``id,name,lang,visible,svc1|svc2``; visible unless it says otherwise; a package needs a service (SRC-9)."""
    rows = row_number(lines.filter("line <> ''"), ["doc"], ["pos"], "ord")
    parts = F.split("line", ",", -1)
    field = lambda i: F.try_element_at(parts, F.lit(i))
    names = F.filter(F.split(F.coalesce(field(5), F.lit("")), r"\|"), lambda n: n != "")
    error = (
        F.when(F.size(parts) < 5, "expected id,name,lang,visible,services").when(~field(1).rlike(r"^\s*\+?\d*$"), "bad package id")
        .when(F.length(field(3)) != 3, "bad lang").when(F.size(names) == 0, "package has no services")
    )
    return rows.select(
        "doc", "ord", "line", _number(field(1), F.lit(0)).alias("id"), field(2).alias("name"), field(3).alias("lang"),
        ((field(4) == "") | field(4).startswith("1")).alias("visible"), names.alias("service_names"), error.alias("error"),
    )


def parse_cells(lines: DataFrame) -> DataFrame:
    """``id,country,type:value,...`` from the outside in; one to eight address parts (SRC-10)."""
    rows = row_number(lines.filter("line <> ''"), ["doc"], ["pos"], "ord")
    tokens = F.filter(F.split("line", ","), lambda t: t != "")
    chain = F.slice(tokens, 3, 1 << 30)
    ca = F.transform(chain, lambda t: F.struct(F.substring_index(t, ":", 1).try_cast("int").alias("type"), F.substring(t, F.instr(t, ":") + 1, F.length(t)).alias("value")))
    country = F.try_element_at(tokens, F.lit(2))
    error = (
        F.when(F.coalesce(F.length(country), F.lit(0)) != 2, "bad country code").when(F.exists(chain, lambda t: ~t.rlike(r"^\d*:")), "bad address entry")
        .when(F.size(chain) == 0, "cell has no address entries").when(F.size(chain) > 8, "too many address entries")
    )
    return rows.select("doc", "ord", "line", F.try_element_at(tokens, F.lit(1)).alias("id"), country.alias("country"), ca.alias("ca"), error.alias("error"))


def unescape_fields(rows: DataFrame, *columns: str) -> DataFrame:
    """Decode XML references in text columns that were cut out of markup by hand."""
    return rows.withColumns({c: xml_unescape(F.col(c)) for c in columns})
