"""Guide documents: XMLTV and broadcast-guide XML, read with the built-in XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.guide_time import xmltv_to_iso
from airlens.functions.once import evaluate_once
from airlens.operators.guide import attach_programme_text

CHANNEL = "_id string, `display-name` array<string>"
PROGRAMME = "_start string, _stop string, _channel string, title array<string>, desc array<string>, category array<string>"


def _load(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    fields = [f"`{f.name}`" for f in rows.schema.fields]
    return rows.select(F.col("_metadata.file_path").alias("doc"), F.monotonically_increasing_id().alias("ord"), F.struct(*fields).alias("e"))


def channels_of(rows: DataFrame) -> DataFrame:
    """Channels from parsed elements ``doc, ord, e``; elements without id are skipped."""
    names = F.coalesce(F.filter(F.col("e.display-name"), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    return rows.filter("e._id IS NOT NULL").select("doc", "ord", F.col("e._id").alias("id"), names.alias("names"))


def programmes_of(rows: DataFrame) -> DataFrame:
    """Programmes from parsed elements: start and channel required, a bad stop becomes empty, first texts only."""
    first = lambda c: F.coalesce(F.try_element_at(F.col(f"e.{c}"), F.lit(1)), F.lit(""))
    timed = evaluate_once(rows, "start", xmltv_to_iso(F.col("e._start"))).filter("start IS NOT NULL AND e._channel IS NOT NULL")
    return timed.select(
        "doc", "ord", F.col("e._channel").alias("channel_id"), "start", F.coalesce(xmltv_to_iso(F.col("e._stop")), F.lit("")).alias("stop"),
        first("title").alias("title"), first("desc").alias("desc"), first("category").alias("category"),
    )


def read_xmltv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Channels and programmes of XMLTV files (SRC-4)."""
    return channels_of(_load(spark, path, "channel", CHANNEL)), programmes_of(_load(spark, path, "programme", PROGRAMME))


def parse_xmltv(rows: DataFrame, col: str, tag: str) -> DataFrame:
    """The same from one element text per row ``doc, ord, col``; ``tag`` is channel or programme."""
    schema = CHANNEL if tag == "channel" else PROGRAMME
    parsed = evaluate_once(rows.select("doc", "ord", col), "e", F.from_xml(F.col(col), schema))
    return channels_of(parsed) if tag == "channel" else programmes_of(parsed)


TEXT = "_programId string, BasicDescription struct<Title string, Synopsis string, Genre array<struct<Name string>>>"
SERVICE = "_serviceId string, Name array<string>, ServiceURL array<struct<_VALUE string, _name string>>"
SCHEDULE = "_serviceIDRef string, ScheduleEvent array<struct<Program struct<_crid string>, PublishedStartTime string, PublishedEndTime string>>"


def programme_text_of(rows: DataFrame) -> DataFrame:
    """Programme texts ``crid, title, desc, category`` from parsed elements."""
    b = "e.BasicDescription"
    text = lambda c: F.coalesce(c, F.lit(""))
    genre = F.try_element_at(F.col(f"{b}.Genre"), F.lit(1))["Name"]
    return rows.filter("e._programId IS NOT NULL").select(
        "doc", "ord", F.col("e._programId").alias("crid"), text(F.col(f"{b}.Title")).alias("title"), text(F.col(f"{b}.Synopsis")).alias("desc"), text(genre).alias("category")
    )


def guide_channels_of(rows: DataFrame) -> DataFrame:
    """Channels with address and triplet from parsed service elements."""
    named = lambda n: F.try_element_at(F.filter(F.col("e.ServiceURL"), lambda u: u["_name"] == n), F.lit(1))["_VALUE"]
    part = lambda i: F.regexp_extract(F.coalesce(named("DTT"), F.lit("")), r"^dvb://(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    return rows.filter("e._serviceId IS NOT NULL").select(
        "doc", "ord", F.col("e._serviceId").alias("id"), F.coalesce("e.Name", F.array().cast("array<string>")).alias("names"), named("IPTV").alias("uri"),
        part(2).alias("tsid"), part(1).alias("onid"), part(3).alias("sid"),
    )


def schedule_events_of(rows: DataFrame) -> DataFrame:
    """Schedule events from parsed schedules: reference and start required, end optional."""
    events = rows.filter("e._serviceIDRef IS NOT NULL").select("doc", "ord", F.col("e._serviceIDRef").alias("channel_id"), F.posexplode("e.ScheduleEvent").alias("pos", "ev"))
    return events.select(
        "doc", "ord", "pos", "channel_id", F.col("ev.Program._crid").alias("crid"), F.col("ev.PublishedStartTime").alias("start"),
        F.coalesce("ev.PublishedEndTime", F.lit("")).alias("stop"),
    ).filter("crid IS NOT NULL AND start IS NOT NULL")


def read_guide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Channels and programmes of broadcast-guide files, schedule joined to text by reference (SRC-5)."""
    texts = programme_text_of(_load(spark, path, "ProgramInformation", TEXT))
    channels = guide_channels_of(_load(spark, path, "ServiceInformation", SERVICE))
    events = schedule_events_of(_load(spark, path, "Schedule", SCHEDULE))
    return channels, attach_programme_text(events, texts)
