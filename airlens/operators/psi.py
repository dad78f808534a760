"""Table sections: assembly from packets, parsing, stream classes, program lists and table rewriting.

Sections are at most 4096 bytes and repeat endlessly, so every parser first reduces them to distinct or latest
ones; parsing itself is column expressions over a few bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.binary import be16, bits, concat_bytes, crc32_mpeg2, tail, to_bytes, u8
from airlens.functions.once import evaluate_once
from airlens.functions.text import dvb_text
from airlens.operators.ordered import DEFAULT_SPAN, Lag, LastKnown, PriorKnown, RunningSum, asof_state, changes, row_number, scan
from airlens.session import cut_lineage

SECTION_BYTES = 4098  # follows from the 12-bit length field: 4095 bytes behind a header of 3
# fixed values: table ids, pids and descriptor tags
PAT, CAT, PMT, NIT, SDT = 0x00, 0x01, 0x02, 0x40, 0x42
PID_PAT, PID_CAT, PID_NIT, PID_SDT, PID_EIT, PID_RST, PID_TDT, PID_NULL = 0x0000, 0x0001, 0x0010, 0x0011, 0x0012, 0x0013, 0x0014, 0x1FFF
TAG_CA, TAG_LANGUAGE, TAG_NETWORK, TAG_SERVICE, TAG_TELETEXT, TAG_SUBTITLE = 0x09, 0x0A, 0x40, 0x48, 0x56, 0x59
TAG_SCRAMBLING, TAG_AC3, TAG_APPLICATION, TAG_EAC3 = 0x65, 0x6A, 0x6F, 0x7A
TABLE_PIDS = (PID_PAT, PID_CAT, PID_NIT, PID_SDT)
PACKET_SECTION = 183  # fixed value: longest section that one packet holds behind its header and pointer
# fixed values: pids whose class never depends on tables
FIXED_CLASSES = {
    PID_PAT: "PAT", PID_CAT: "CAT", PID_NIT: "NIT", PID_SDT: "SDT", PID_EIT: "EIT",
    PID_RST: "SI", PID_TDT: "SI", PID_NULL: "null",
}
# fixed values: class and codec by stream type
STREAM_TYPES = {
    0x01: ("video", "mpeg2video"), 0x02: ("video", "mpeg2video"), 0x1B: ("video", "h264"), 0x24: ("video", "hevc"),
    0x03: ("audio", "mp2"), 0x04: ("audio", "mp2"), 0x0F: ("audio", "aac"), 0x11: ("audio", "aac_latm"),
    0x81: ("audio", "ac3"), 0x87: ("audio", "eac3"),
}


def assemble_sections(packets: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Complete sections from packets ``capture, pid, pkt_no, pusi, payload`` (WIN-9).

    A start packet skips its pointer field; one section per start; one cut short by the next start is dropped. Filter to table pids first: it is the largest saving there is.
    Most sections fit in the packet they start in and are read from it where it stands; only pids with a longer one are
    put in order.
    """
    rows = _section_parts(packets)
    whole = rows.filter("whole").select("capture", "pid", F.col("pkt_no").alias("first_pkt_no"), F.col("pkt_no").alias("last_pkt_no"), u8(F.col("part"), 0).alias("table_id"), F.col("part").alias("bytes"))
    longer = cut_lineage(rows.filter("begins AND NOT whole AND NOT bad").select("capture", "pid").distinct())
    return whole if longer.isEmpty() else whole.unionByName(_assemble_longer(rows.join(longer, ["capture", "pid"], "left_semi"), span))


def _section_parts(packets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What each packet adds to a section: ``capture, pid, pkt_no, *keep, begins, bad, whole, part``; ``whole`` ones are cut to their section."""
    rows = packets.select("capture", "pid", "pkt_no", *keep, (F.col("pusi") != 0).alias("begins"), "payload")
    rows = evaluate_once(rows, "payload", F.col("payload")).filter("octet_length(payload) > 0")  # read many times below
    rows = evaluate_once(rows, "__skip", F.when(F.col("begins"), u8(F.col("payload"), 0) + 1).otherwise(0))
    bad_start = F.col("begins") & (F.col("__skip") > F.octet_length("payload"))
    rows = rows.select("capture", "pid", "pkt_no", *keep, "begins", bad_start.alias("bad"), tail(F.col("payload"), F.col("__skip")).alias("__part"))
    rows = evaluate_once(rows, "part", F.when(F.col("bad"), F.lit(None)).otherwise(F.col("__part"))).drop("__part")
    rows = evaluate_once(rows, "__size", F.when(F.col("begins"), bits(be16(F.col("part"), 1), 0, 0xFFF) + 3))
    whole = F.coalesce(F.octet_length("part") >= F.col("__size"), F.lit(False))
    cut = F.when(whole, F.substring("part", F.lit(1), F.col("__size"))).otherwise(F.col("part"))
    return rows.select("capture", "pid", "pkt_no", *keep, "begins", "bad", whole.alias("whole"), cut.alias("part"))


def section_starts(packets: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Starts of sections, written down in one pass: ``capture, pid, pkt_no, whole, last_pkt_no, bytes, pkt``.

    ``packets``: ``capture, pid, pkt_no, pusi, payload, pkt``. ``bytes`` is the section that begins there if it is complete and its
    checksum holds, else null; ``whole`` ones end in the packet itself. The packet is kept only where rewriting may have to pass it
    unchanged. Only if a section takes several packets are they read again.
    """
    starts = _section_parts(packets, ("pkt",)).filter("begins")
    starts = evaluate_once(starts, "bytes", F.when(F.col("whole"), F.col("part")))
    starts = evaluate_once(starts, "bytes", F.when(crc32_mpeg2(F.col("bytes")) == 0, F.col("bytes")))
    size, table = F.octet_length("bytes"), u8(F.col("bytes"), 0)
    fits = size.between(16, PACKET_SECTION) & F.when(F.col("pid") == PID_PAT, table == PAT).otherwise((table == PMT) & (bits(be16(F.col("bytes"), 10), 0, 0xFFF) + 16 <= size))
    found = cut_lineage(starts.select(
        "capture", "pid", "pkt_no", "whole", (~F.col("whole") & ~F.col("bad")).alias("longer"), F.col("pkt_no").alias("last_pkt_no"), "bytes",
        F.when(~F.coalesce(fits, F.lit(False)), F.col("pkt")).alias("pkt"),
    ))
    longer = found.filter("longer").select("capture", "pid")
    found = found.drop("longer")
    if longer.isEmpty():
        return found
    more = _assemble_longer(_section_parts(packets).join(longer.distinct(), ["capture", "pid"], "left_semi"), span)
    more = more.filter(crc32_mpeg2(F.col("bytes")) == 0).select("capture", "pid", F.col("first_pkt_no").alias("pkt_no"), F.col("last_pkt_no").alias("__last"), F.col("bytes").alias("__bytes"))
    both = found.join(more, ["capture", "pid", "pkt_no"], "left")
    return cut_lineage(both.select(
        "capture", "pid", "pkt_no", "whole", F.coalesce("__last", "last_pkt_no").alias("last_pkt_no"), F.coalesce("bytes", "__bytes").alias("bytes"), "pkt",
    ))


def sections_of_starts(starts: DataFrame) -> DataFrame:
    """The sections among ``section_starts``, as ``psi_tables`` takes them."""
    return starts.filter("bytes IS NOT NULL").select("capture", "pid", F.col("pkt_no").alias("first_pkt_no"), "last_pkt_no", "bytes")


def _assemble_longer(rows: DataFrame, span: int) -> DataFrame:
    """Sections of more than one packet from all ``rows`` of their pids."""
    held = rows.withColumn("part", F.when(~F.col("whole"), F.col("part")))
    grouped = scan(held, ["capture", "pid"], ["pkt_no"], span, start=RunningSum(F.col("begins").cast("bigint")))
    # Each packet behind the start adds a byte or more, so packets past the longest section can never matter.
    rank = F.row_number().over(Window.partitionBy("capture", "pid", "start").orderBy("pkt_no"))
    bounded = grouped.filter("start > 0").withColumn("rank", rank).filter(F.col("rank") <= SECTION_BYTES + 1)
    parts = bounded.groupBy("capture", "pid", "start").agg(
        F.array_sort(F.collect_list(F.struct("pkt_no", "part"))).alias("parts"), F.bool_or(F.col("bad") | F.col("whole")).alias("other")
    )
    joined = evaluate_once(parts.filter("NOT other"), "bytes", concat_bytes(F.col("parts.part")))
    size = bits(be16(F.col("bytes"), 1), 0, 0xFFF) + 3
    complete = joined.withColumn("size", size).filter(F.octet_length("bytes") >= F.col("size"))

    def advance(acc: Column, part: Column) -> Column:
        more = acc["seen"] < F.col("size")
        return F.struct(
            (acc["seen"] + F.when(more, F.octet_length(part["part"])).otherwise(0)).alias("seen"),
            F.when(more, part["pkt_no"]).otherwise(acc["last"]).alias("last"),
        )

    end = F.aggregate("parts", F.struct(F.lit(0).alias("seen"), F.lit(-1).cast("bigint").alias("last")), advance)
    return complete.select(
        "capture", "pid", F.col("parts")[0]["pkt_no"].alias("first_pkt_no"), end["last"].alias("last_pkt_no"),
        u8(F.col("bytes"), 0).alias("table_id"), F.substring("bytes", F.lit(1), F.col("size")).alias("bytes"),
    )


def _distinct(sections: DataFrame) -> DataFrame:
    return sections.groupBy("capture", "pid", "bytes").agg(F.min("first_pkt_no").alias("first_pkt_no"), F.max("last_pkt_no").alias("last_pkt_no"))


def _distinct_sections(packets: DataFrame, span: int, wanted: DataFrame | None = None) -> DataFrame:
    """Distinct sections of packets, written down; of pids that are not reserved only those in ``wanted(capture, pid)``.

    One pass over the packets, and one more if a section takes several: starts fold into distinct contents before anything is joined.
    """
    rows = _section_parts(packets)
    starts = rows.filter("begins AND NOT bad").select(
        "capture", "pid", F.when(F.col("whole"), F.col("part")).alias("bytes"), F.col("pkt_no").alias("first_pkt_no"), F.col("pkt_no").alias("last_pkt_no")
    )
    found = _distinct(starts)
    if wanted is not None:
        found = found.join(wanted.withColumn("__wanted", F.lit(True)), ["capture", "pid"], "left").filter(F.col("pid").isin(*TABLE_PIDS) | F.col("__wanted")).drop("__wanted")
    found = cut_lineage(found)
    whole = found.filter("bytes IS NOT NULL")
    longer = found.filter("bytes IS NULL").select("capture", "pid")
    if longer.isEmpty():
        return whole
    more = _assemble_longer(rows.join(longer, ["capture", "pid"], "left_semi"), span).drop("table_id")
    return cut_lineage(_distinct(whole.unionByName(more)))


def valid_sections(sections: DataFrame, table_id: int, min_size: int = 12, distinct: bool = False) -> DataFrame:
    """Sections of one table whose checksum holds, each distinct content once with its last position; ``distinct`` ones are taken as they are."""
    ok = sections.filter((u8(F.col("bytes"), 0) == table_id) & (F.octet_length("bytes") >= min_size))
    if distinct:
        return ok.filter(crc32_mpeg2(F.col("bytes")) == 0).select("capture", "pid", "bytes", "first_pkt_no", "last_pkt_no")
    # `body` repeats the key as an aggregate so that the checksum filter stays above the deduplication
    once = ok.groupBy("capture", "pid", "bytes").agg(
        F.min("first_pkt_no").alias("first_pkt_no"), F.max("last_pkt_no").alias("last_pkt_no"), F.max("bytes").alias("body")
    )
    return once.filter(crc32_mpeg2(F.col("body")) == 0).drop("body")


def _walk(data: Column, start: Column, end: Column, head: int, length: Callable[[Column], Column], item: Callable[[Column, Column], Column]) -> Column:
    """Entries of ``head`` bytes and a body, up to the first that does not fit, each as ``item(at, length)``.

    The steps only note where entries begin and stop behind the last one. Fields are read once an entry.
    """
    def step(ats: Column, _i: Column) -> Column:
        at = F.element_at(ats, -1)
        return F.when(at < end, F.concat(ats, F.array(at + head + length(at)))).otherwise(ats)

    slots = F.sequence(F.lit(0), F.greatest(F.floor((end - start) / head).cast("int"), F.lit(0)))

    def read(ats: Column) -> Column:
        fit = F.filter(F.sequence(F.lit(0), F.size(ats) - 1), lambda i: F.get(ats, i + 1) <= end)
        return F.transform(fit, lambda i: item(F.get(ats, i), F.get(ats, i + 1) - F.get(ats, i) - head))

    return _let(F.aggregate(slots, F.array(start.cast("int")), step), lambda ats: F.when(ats.isNotNull(), read(ats)))


def descriptors(loop: Column) -> Column:
    """Tag-length-value loop as ARRAY<STRUCT<tag, body>>; stops at the first overrun (FN-16)."""
    return _let(loop, _descriptors)  # the walk reads it at every step


def _descriptors(loop: Column) -> Column:
    item = lambda at, length: F.struct(u8(loop, at).alias("tag"), F.substring(loop, at + 3, length).alias("body"))
    walked = _walk(loop, F.lit(0), F.octet_length(loop), 2, lambda at: u8(loop, at + 1), item)
    # most loops hold one descriptor or none
    return F.when(u8(loop, 1) + 2 == F.octet_length(loop), F.array(item(F.lit(0), u8(loop, 1)))).otherwise(walked)


def find_descriptor(items: Column, tag: int) -> Column:
    """Body of the first descriptor with ``tag``; null when absent."""
    return F.try_element_at(F.filter(items, lambda d: d["tag"] == tag), F.lit(1))["body"]


def classify_es(stream_type: Column, items: Column) -> tuple[Column, Column, Column]:
    """Class, codec and language of an elementary stream (PRJ-14)."""
    return _classify(stream_type, lambda tag: find_descriptor(items, tag))


def _classify(stream_type: Column, find: Callable[[int], Column]) -> tuple[Column, Column, Column]:
    """``classify_es``, with ``find(tag)`` the body of the first such descriptor."""
    has = lambda tag: find(tag).isNotNull()
    cls, codec = F.lit("data"), F.lit("none")
    private = stream_type == 0x06
    cls = (
        F.when(private & has(TAG_TELETEXT), "teletext").when(private & has(TAG_SUBTITLE), "subtitle")
        .when(private & (has(TAG_AC3) | has(TAG_EAC3)), "audio").when((stream_type == 0x05) & has(TAG_APPLICATION), "AIT")
    )
    codec = F.when(private & ~has(TAG_TELETEXT) & ~has(TAG_SUBTITLE), F.when(has(TAG_AC3), "ac3").when(has(TAG_EAC3), "eac3"))
    for number, (kind, name) in STREAM_TYPES.items():
        cls = F.when(stream_type == number, kind).otherwise(cls)
        codec = F.when(stream_type == number, name).otherwise(codec)
    language = find(TAG_LANGUAGE)
    subtitle = find(TAG_SUBTITLE)
    lang = F.when(F.octet_length(language) >= 3, F.substring(language, 1, 3)).when(
        (cls == "subtitle") & (F.octet_length(subtitle) >= 8), F.substring(subtitle, 1, 3)
    )
    return F.coalesce(cls, F.lit("data")), F.coalesce(codec, F.lit("none")), lang.cast("string")


def teletext_page(items: Column) -> Column:
    """Page, type and language of a teletext descriptor; the first subtitle entry (2 or 5) wins, else the first."""
    body = find_descriptor(items, TAG_TELETEXT)
    entries = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.octet_length(body) / 5).cast("int") - 1, F.lit(0))), lambda i: i * 5 + 5 <= F.octet_length(body)),
        lambda i: F.struct(
            bits(u8(body, i * 5 + 3), 3, 31).alias("type"),
            (F.when(bits(u8(body, i * 5 + 3), 0, 7) == 0, 8).otherwise(bits(u8(body, i * 5 + 3), 0, 7)) * 100
             + bits(u8(body, i * 5 + 4), 4, 15) * 10 + bits(u8(body, i * 5 + 4), 0, 15)).alias("page"),
            F.substring(body, i * 5 + 1, F.lit(3)).cast("string").alias("lang"),
        ),
    )
    subtitles = F.filter(entries, lambda e: e["type"].isin(2, 5))
    return F.coalesce(F.try_element_at(subtitles, F.lit(1)), F.try_element_at(entries, F.lit(1)))


def _es_loop(section: Column, start: Column) -> Column:
    """Elementary-stream entries of a PMT as ARRAY<STRUCT<stream_type, pid, desc>>: all that the section holds.

    An entry takes five bytes or more, so the section's length bounds the steps.
    """
    item = lambda at, length: F.struct(
        u8(section, at).alias("stream_type"), bits(be16(section, at + 1), 0, 0x1FFF).alias("pid"), F.substring(section, at + 6, length).alias("desc")
    )
    return _walk(section, start, F.octet_length(section) - 4, 5, lambda at: bits(be16(section, at + 3), 0, 0xFFF), item)


def parse_pat(sections: DataFrame, distinct: bool = False) -> DataFrame:
    """Program list ``capture, tsid, program_number, pmt_pid``: first entry per pmt pid over all valid PATs; 0 = network."""
    b = F.col("bytes")
    valid = valid_sections(sections.filter(F.col("pid") == PID_PAT), PAT, distinct=distinct).filter(F.octet_length("bytes") >= 16)
    slots = F.sequence(F.lit(8), F.octet_length(b) - 8, F.lit(4))
    entries = valid.select("capture", "first_pkt_no", "last_pkt_no", be16(b, 3).alias("tsid"), b, F.explode(slots).alias("at"))
    parsed = entries.select(
        "capture", "first_pkt_no", "last_pkt_no", "at", "tsid", be16(b, F.col("at")).alias("program_number"), bits(be16(b, F.col("at") + 2), 0, 0x1FFF).alias("pmt_pid")
    )
    return parsed.groupBy("capture", "pmt_pid").agg(
        F.min_by("program_number", F.struct("first_pkt_no", "at")).alias("program_number"), F.max_by("tsid", "last_pkt_no").alias("tsid"),
        F.min("first_pkt_no").alias("first_pkt_no"),
    ).select("capture", "tsid", "program_number", "pmt_pid", "first_pkt_no")


def latest_pmt(sections: DataFrame, programs: DataFrame, distinct: bool = False) -> DataFrame:
    """Last valid PMT per program; its program number must match the program list."""
    listed = programs.filter("program_number <> 0").select("capture", F.col("pmt_pid").alias("pid"), "program_number")
    valid = valid_sections(sections, PMT, 16, distinct).withColumn("program_number", be16(F.col("bytes"), 3))
    matched = valid.join(listed, ["capture", "pid", "program_number"])
    last = matched.groupBy("capture", "pid", "program_number").agg(F.max_by("bytes", "last_pkt_no").alias("bytes"), F.min("last_pkt_no").alias("first_pmt_pkt_no"))
    b = F.col("bytes")
    info = bits(be16(b, 10), 0, 0xFFF)
    items = F.col("items")
    ca = find_descriptor(items, TAG_CA)
    mode = find_descriptor(items, TAG_SCRAMBLING)
    return evaluate_once(last, "items", descriptors(F.substring(b, F.lit(13), info))).select(
        "capture", "program_number", F.col("pid").alias("pmt_pid"), "first_pmt_pkt_no", bits(be16(b, 8), 0, 0x1FFF).alias("pcr_pid"),
        F.when(F.octet_length(ca) >= 4, be16(ca, 0)).alias("pmt_ca_system_id"), F.when(F.octet_length(ca) >= 4, bits(be16(ca, 2), 0, 0x1FFF)).alias("pmt_ca_pid"),
        F.when(F.octet_length(mode) >= 1, u8(mode, 0)).alias("scrambling_mode"), (info + 12).alias("loop_at"), "bytes",
    )


def parse_es(pmt: DataFrame) -> DataFrame:
    """Elementary streams of each program in table order, classified, audio numbered from 1 (WIN-17)."""
    loops = pmt.select("capture", "program_number", "pmt_pid", F.posexplode(_es_loop(F.col("bytes"), F.col("loop_at"))).alias("es_ordinal", "e"))
    items = evaluate_once(loops, "items", descriptors(F.col("e.desc")))
    # each descriptor is looked up once, and the class is read many times
    tags = (TAG_CA, TAG_LANGUAGE, TAG_TELETEXT, TAG_SUBTITLE, TAG_AC3, TAG_APPLICATION, TAG_EAC3)
    first = evaluate_once(items, "first", F.struct(*[find_descriptor(F.col("items"), tag).alias(f"tag_{tag}") for tag in tags]))
    find = lambda tag: F.col(f"first.tag_{tag}")
    kind = evaluate_once(first, "kind", F.struct(*[c.alias(n) for n, c in zip(("cls", "codec", "lang"), _classify(F.col("e.stream_type"), find), strict=True)]))
    cls, codec, lang = F.col("kind.cls"), F.col("kind.codec"), F.col("kind.lang")
    ca, sub = find(TAG_CA), find(TAG_SUBTITLE)
    rows = kind.select(
        "capture", "program_number", "pmt_pid", "es_ordinal", F.col("e.pid").alias("pid"), F.col("e.stream_type").alias("stream_type"),
        cls.alias("cls"), codec.alias("codec"), lang.alias("lang"),
        F.when(F.octet_length(ca) >= 4, bits(be16(ca, 2), 0, 0x1FFF)).alias("ca_pid"), F.when(F.octet_length(ca) >= 4, be16(ca, 0)).alias("ca_system_id"),
        F.when(cls == "teletext", teletext_page(F.col("items"))).alias("ttx"),
        F.when((cls == "subtitle") & (F.octet_length(sub) >= 8), F.struct(u8(sub, 3).alias("type"), be16(sub, 4).alias("composition_page"), be16(sub, 6).alias("ancillary_page"))).alias("sub"),
        F.col("e.desc").alias("desc"),
    )
    return audio_index(rows, ["capture", "program_number"])


def audio_index(es: DataFrame, keys: list[str] = ["capture"]) -> DataFrame:
    """1-based number among the audio streams of a program, 0 for others (WIN-17). The 12-bit section length bounds a program's streams."""
    is_audio = (F.col("cls") == "audio").cast("int")
    running = F.sum(is_audio).over(Window.partitionBy(*keys).orderBy("es_ordinal"))
    return es.withColumn("audio_index", F.when(F.col("cls") == "audio", running).otherwise(0).cast("int"))


def parse_sdt(sections: DataFrame, distinct: bool = False) -> DataFrame:
    """Service and provider names from the actual-stream service table; the last valid entry of a service wins."""
    b = F.col("bytes")
    valid = valid_sections(sections.filter(F.col("pid") == PID_SDT), SDT, distinct=distinct)
    item = lambda at, length: F.struct(be16(b, at).alias("service_id"), F.substring(b, at + 6, length).alias("desc"))
    loop = _walk(b, F.lit(11), F.octet_length(b) - 4, 5, lambda at: bits(be16(b, at + 3), 0, 0xFFF), item)
    rows = valid.select("capture", "last_pkt_no", be16(b, 8).alias("onid"), F.explode(loop).alias("s"))
    body = find_descriptor(descriptors(F.col("s.desc")), TAG_SERVICE)
    texts = evaluate_once(rows, "d", body).select("capture", "last_pkt_no", "onid", F.col("s.service_id").alias("service_id"), "d")
    # one step at a time: each reads the one before it several times
    texts = evaluate_once(texts, "plen", u8(F.col("d"), 1))
    texts = evaluate_once(texts, "slen", u8(F.col("d"), F.col("plen") + 2))
    texts = evaluate_once(texts, "provider", F.when(F.col("plen") + 2 <= F.octet_length("d"), F.substring("d", F.lit(3), F.col("plen"))))
    texts = evaluate_once(texts, "service", F.when(F.col("plen") + F.col("slen") + 3 <= F.octet_length("d"), F.substring("d", F.col("plen") + 4, F.col("slen"))))
    texts = evaluate_once(texts, "provider_name", dvb_text(F.col("provider")))
    texts = evaluate_once(texts, "service_name", dvb_text(F.col("service")))
    return texts.groupBy("capture", "service_id").agg(
        F.max_by("onid", "last_pkt_no").alias("onid"),
        F.max_by("service_name", F.when(F.col("service_name").isNotNull(), F.col("last_pkt_no"))).alias("service_name"),
        F.max_by("provider_name", F.when(F.col("provider_name").isNotNull(), F.col("last_pkt_no"))).alias("provider_name"),
    )


def parse_nit(sections: DataFrame, distinct: bool = False) -> DataFrame:
    """Network name per capture."""
    b = F.col("bytes")
    valid = valid_sections(sections.filter(F.col("pid") == PID_NIT), NIT, distinct=distinct)
    length = bits(be16(b, 8), 0, 0xFFF)
    # one step at a time: the walk reads its loop at every step, the text its bytes several times
    loops = evaluate_once(valid, "size", length).filter(F.col("size") + 10 <= F.octet_length(b))
    loops = evaluate_once(loops, "loop", F.substring(b, F.lit(11), F.col("size")))
    names = evaluate_once(loops, "name", find_descriptor(descriptors(F.col("loop")), TAG_NETWORK)).filter("name IS NOT NULL")
    named = names.withColumn("network_name", dvb_text(F.col("name")))
    return named.groupBy("capture").agg(F.max_by("network_name", "last_pkt_no").alias("network_name"))


def parse_cat(sections: DataFrame, distinct: bool = False) -> DataFrame:
    """First conditional-access entry of the last valid CAT per capture."""
    b = F.col("bytes")
    valid = valid_sections(sections.filter(F.col("pid") == PID_CAT), CAT, distinct=distinct)
    last = valid.groupBy("capture").agg(F.max_by("bytes", "last_pkt_no").alias("bytes"))
    loops = evaluate_once(last, "loop", F.substring(b, F.lit(9), F.octet_length(b) - 12))
    entries = evaluate_once(loops, "ca", find_descriptor(descriptors(F.col("loop")), TAG_CA))
    ca = F.col("ca")
    long = F.octet_length(ca) >= 4
    return entries.select("capture", F.when(long, be16(ca, 0)).alias("ca_system_id"), F.when(long, bits(be16(ca, 2), 0, 0x1FFF)).alias("emm_pid"))


def tables_of_packets(packets: DataFrame, span: int = DEFAULT_SPAN) -> dict[str, DataFrame]:
    """``psi_tables`` from packets ``capture, pid, pkt_no, pusi, payload``: only pids that carry tables are assembled.

    The program list comes first (pid 0); it names the other table pids. Their numbers, 2^13 at most, drop most other packets,
    the bulk of a capture, where they stand; the rest go by capture and pid once their sections are folded.
    """
    listed = _distinct_sections(packets.filter(F.col("pid") == PID_PAT), span)
    pat = cut_lineage(parse_pat(listed, True))
    numbers = [r[0] for r in pat.select("pmt_pid").distinct().collect()]  # 13 bits
    named = packets.filter((F.col("pid") != PID_PAT) & F.col("pid").isin(*TABLE_PIDS, *numbers))
    others = _distinct_sections(named, span, pat.select("capture", F.col("pmt_pid").alias("pid")))
    return _tables(listed.unionByName(others), pat)


def psi_tables(sections: DataFrame) -> dict[str, DataFrame]:
    """All parsed tables of a set of captures (UDF-2): pat, pmt, es, sdt, nit, cat and the joined ``programs``.

    Tables repeat many times a second, so their distinct sections are written down once and all parsers read those.
    """
    sections = cut_lineage(_distinct(sections))
    return _tables(sections, cut_lineage(parse_pat(sections, True)))


def _tables(sections: DataFrame, pat: DataFrame) -> dict[str, DataFrame]:
    pmt = cut_lineage(latest_pmt(sections, pat, True))
    sdt = parse_sdt(sections, True)
    return {
        "pat": pat, "pmt": pmt, "es": parse_es(pmt), "sdt": sdt, "nit": parse_nit(sections, True), "cat": parse_cat(sections, True),
        "programs": service_list(pat, pmt, sdt),
    }


def service_list(pat: DataFrame, pmt: DataFrame, sdt: DataFrame) -> DataFrame:
    """Programs of the list with their table state and names (JOIN-13)."""
    listed = pat.filter("program_number <> 0").select("capture", "tsid", "program_number", "pmt_pid")
    resolved = pmt.select("capture", "program_number", "pmt_pid", F.lit(True).alias("resolved")).distinct()
    names = sdt.select("capture", F.col("service_id").alias("program_number"), "onid", "service_name", "provider_name")
    return (
        listed.join(resolved, ["capture", "program_number", "pmt_pid"], "left").join(names, ["capture", "program_number"], "left")
        .select("capture", "tsid", "onid", "program_number", "pmt_pid", F.coalesce("resolved", F.lit(False)).alias("resolved"), "service_name", "provider_name")
    )


def all_programs_named(programs: DataFrame) -> DataFrame:
    """Per capture: every program resolved and named (AGG-6)."""
    return programs.groupBy("capture").agg(F.bool_and(F.col("resolved") & (F.coalesce(F.length("service_name"), F.lit(0)) > 0)).alias("all_named"))


def program_kind(programs: DataFrame) -> DataFrame:
    """Several programs or one per capture (AGG-8)."""
    return programs.groupBy("capture").agg(F.count(F.lit(1)).alias("programs")).withColumn("kind", F.when(F.col("programs") > 1, "MPTS").otherwise("SPTS"))


def es_summary(es: DataFrame, keys: list[str] = ["capture"]) -> DataFrame:
    """Audio count and subtitle label per program (AGG-7)."""
    per = es.groupBy(*keys).agg(
        F.count_if(F.col("cls") == "audio").alias("audio_count"), F.bool_or(F.col("cls") == "teletext").alias("ttx"), F.bool_or(F.col("cls") == "subtitle").alias("sub")
    )
    return per.withColumn("label", F.when(F.col("ttx") & F.col("sub"), "ttx+sub").when(F.col("ttx"), "txt").when(F.col("sub"), "sub").otherwise("-"))


def fixed_class(pid: Column) -> Column:
    """Class of the pids every stream reserves, else null."""
    out = F.lit(None).cast("string")
    for number, name in FIXED_CLASSES.items():
        out = F.when(pid == number, name).otherwise(out)
    return out


def classify_pid(pat: DataFrame, pmt: DataFrame, es: DataFrame) -> DataFrame:
    """Class of every pid the tables mention (PRJ-13): reserved pids first, then network, PMT, stream, ECM, clock."""
    def ranked(df: DataFrame, pid: str, cls: Column, rank: int) -> DataFrame:
        return df.select("capture", F.col(pid).alias("pid"), cls.alias("cls"), F.lit(rank).alias("rank")).filter("pid IS NOT NULL AND pid <> 0")

    ecm = pmt.select("capture", F.col("pmt_ca_pid").alias("pid")).unionByName(es.select("capture", F.col("ca_pid").alias("pid"))).filter(f"pid <> {PID_NULL}")
    rows = (
        ranked(pat.filter("program_number = 0"), "pmt_pid", F.lit("NIT"), 1)
        .unionByName(ranked(pat.filter("program_number <> 0"), "pmt_pid", F.lit("PMT"), 2))
        .unionByName(ranked(es, "pid", F.col("cls"), 3))
        .unionByName(ranked(ecm, "pid", F.lit("ECM"), 4))
        .unionByName(ranked(pmt, "pcr_pid", F.lit("PCR"), 5))
    )
    best = rows.groupBy("capture", "pid").agg(F.min(F.struct("rank", "cls")).alias("best"))
    return best.select("capture", "pid", F.coalesce(fixed_class(F.col("pid")), F.col("best.cls")).alias("cls"))


# fixed values: strip names a class maps to
STRIP_BY_CLASS = {"NUL": "null", "NIT": "NIT", "EIT": "EIT", "CAT": "CAT", "AIT": "AIT", "ECM": "ECM"}
STRIP_DEFAULT = frozenset({"NUL", "NIT", "AIT", "EIT"})


def strip_filter(packets: DataFrame, classes: DataFrame, mask: frozenset[str] = STRIP_DEFAULT, emm: DataFrame | None = None) -> DataFrame:
    """Packets whose pid class is not stripped (PRJ-8).

    ``classes(capture, pid, cls)`` holds at most one row per pid; ``emm(capture, emm_pid)`` is needed only for "EMM".
    """
    named = packets.join(classes.select("capture", "pid", F.col("cls").alias("__cls")), ["capture", "pid"], "left")
    cls = F.coalesce(fixed_class(F.col("pid")), F.col("__cls"), F.lit("unknown"))
    drop = cls.isin([name for key, name in STRIP_BY_CLASS.items() if key in mask]) if mask & STRIP_BY_CLASS.keys() else F.lit(False)
    if mask & {"TDT", "TOT"}:
        drop = drop | (F.col("pid") == PID_TDT)
    if "RST" in mask:
        drop = drop | (F.col("pid") == PID_RST)
    if "sync" in packets.columns:
        drop = drop | (F.col("sync") != 0x47)
    kept = named.filter(~drop).drop("__cls")
    if "EMM" in mask and emm is not None:
        kept = kept.join(emm.select("capture", F.col("emm_pid").alias("pid")).filter("pid > 0"), ["capture", "pid"], "left_anti")
    return kept.select(*packets.columns)


def section_table_id(packets: DataFrame, payload: str = "payload") -> Column:
    """Table id a start packet opens, null when it opens none."""
    p = F.col(payload)
    pointer = u8(p, 0)
    return F.when((F.col("pusi") != 0) & (pointer + 1 < F.octet_length(p)), u8(p, pointer + 1))


def strip_by_table_id(packets: DataFrame, table_id: int = 0x4C, span: int = DEFAULT_SPAN) -> DataFrame:
    """Drop packets from a section start of ``table_id`` to the next section start of that pid (PRJ-9)."""
    marked = packets.withColumn("__tid", section_table_id(packets))
    latched = scan(marked, ["capture", "pid"], ["pkt_no"], span, __latched=LastKnown(F.col("__tid")))
    return latched.filter(F.coalesce(F.col("__latched") != table_id, F.lit(True))).select(*packets.columns)


def select_audio(packets: DataFrame, es: DataFrame, classes: DataFrame, track: int | None, drop_subtitles: bool, first_pmt: DataFrame) -> DataFrame:
    """Keep one audio stream by its 1-based number and optionally drop subtitles (PRJ-10).

    Pids the tables do not explain are held back until ``first_pmt(capture, first_pmt_pkt_no)``.
    """
    numbered = es.filter("cls = 'audio'").select("capture", "pid", "audio_index")
    joined = (
        packets.join(numbered, ["capture", "pid"], "left").join(classes.select("capture", "pid", "cls"), ["capture", "pid"], "left")
        .join(first_pmt, "capture", "left")
    )
    cls = F.coalesce(fixed_class(F.col("pid")), F.col("cls"))
    other_audio = F.coalesce(F.col("audio_index") != F.lit(track), F.lit(False)) if track is not None else F.lit(False)
    subtitle = F.coalesce(cls.isin("teletext", "subtitle"), F.lit(False)) if drop_subtitles else F.lit(False)
    selective = track is not None or drop_subtitles
    early = F.lit(selective) & cls.isNull() & F.coalesce(F.col("pkt_no") < F.col("first_pmt_pkt_no"), F.lit(True))
    return joined.filter(~other_audio & ~subtitle & ~early).select(*packets.columns)


def bad_track(es: DataFrame, track: int) -> DataFrame:
    """Captures that have fewer audio streams than the wanted number."""
    return es.groupBy("capture").agg(F.count_if(F.col("cls") == "audio").alias("audio_count")).withColumn("bad_track", F.lit(track) > F.col("audio_count"))


def program_selection(programs: DataFrame, sel: int | str = "auto") -> DataFrame:
    """Outcome of a program choice per capture (PRJ-20): whole, all, chosen, ambiguous or unknown_pid."""
    n = F.count(F.lit(1))
    hit = F.bool_or(F.col("pmt_pid") == F.lit(sel if isinstance(sel, int) else -1))
    choice = F.when(n == 1, "whole")
    if sel == "auto":
        choice = choice.otherwise("ambiguous")
    elif sel == "all":
        choice = choice.otherwise("all")
    else:
        choice = choice.when(hit, "chosen").otherwise("unknown_pid")
    return programs.groupBy("capture").agg(n.alias("programs"), choice.alias("outcome"))


def select_program(packets: DataFrame, programs: DataFrame, es: DataFrame, sel: int | str = "auto") -> DataFrame:
    """Packets of the chosen program: its table and stream pids plus the reserved ones (PRJ-20)."""
    outcome = program_selection(programs, sel)
    whole = packets.join(outcome.filter("outcome IN ('whole', 'all')"), "capture", "left_semi")
    if not isinstance(sel, int):
        return whole
    chosen = outcome.filter("outcome = 'chosen'").select("capture")
    wanted = (
        es.filter(F.col("pmt_pid") == sel).select("capture", "pid")
        .unionByName(programs.filter(F.col("pmt_pid") == sel).select("capture", F.col("pmt_pid").alias("pid"))).distinct()
    )
    part = packets.join(chosen, "capture", "left_semi")
    reserved = F.col("pid") < 0x20
    return whole.unionByName(part.filter(reserved)).unionByName(part.filter(~reserved).join(wanted, ["capture", "pid"], "left_semi"))


def cas_mode(programs: DataFrame) -> DataFrame:
    """Protection scheme of each program and its cipher (PRJ-16).

    Needs ``pmt_ca_system_id, ecm_pid, emm_pid, scrambling_mode, has_cat``; nulls and zeros mean absent.
    """
    present = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    scheme = (
        F.when(F.col("pmt_ca_system_id") == 0x2610, "biss-ca").when(F.col("pmt_ca_system_id") == 0x2602, "biss1e")
        .when(F.col("has_cat") & present("ecm_pid") & present("emm_pid") & present("scrambling_mode"), "classic").otherwise("none")
    )
    cipher = F.when(F.col("scrambling_mode").isin(1, 2), "csa").when(F.col("scrambling_mode") == 0x10, "cissa").otherwise("unknown")
    return programs.withColumn("cas_mode", scheme).withColumn("cipher", F.when(scheme == "classic", cipher).when(scheme == "biss-ca", "cissa"))


def section_counts(results: DataFrame, keys: list[str] = ["capture"]) -> DataFrame:
    """Sections and errors per table (AGG-16). ``results``: keys, ``table_name, size``; size 0 is an error."""
    return results.groupBy(*keys, "table_name").agg(F.count_if(F.col("size") > 0).alias("sections"), F.count_if(F.col("size") <= 0).alias("errors"))


def content_changes(df: DataFrame, keys: list[str], order: list[str], body: Column, first_counts: bool, span: int = DEFAULT_SPAN) -> DataFrame:
    """Rows whose body differs from the row before (WIN-13); ``first_counts`` decides about the first row."""
    hashed = df.withColumn("__body", body)
    seen = scan(hashed, keys, order, span, __prev=Lag(F.struct(F.col("__body").alias("b"))))
    changed = F.when(F.col("__prev").isNull(), F.lit(first_counts)).otherwise(~F.col("__prev.b").eqNullSafe(F.col("__body")))
    return seen.filter(changed).drop("__prev", "__body")


def table_version(df: DataFrame, keys: list[str], order: list[str], body: Column, span: int = DEFAULT_SPAN) -> DataFrame:
    """Version number of a table: plus one modulo 32 at every content change (WIN-14)."""
    counted = scan(df, keys, order, span, version=changes(body))
    return counted.withColumn("version", F.pmod("version", F.lit(32)).cast("int"))


def ecm_activity(sections: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """ECM and EMM sections, and key-period transitions: new content within a parity (AGG-15).

    ``sections``: ``capture, pid, kind ('ecm'|'emm'), table_id, first_pkt_no, bytes``.
    """
    counts = sections.groupBy("capture").agg(F.count_if(F.col("kind") == "ecm").alias("ecm"), F.count_if(F.col("kind") == "emm").alias("emm"))
    parity = sections.filter("kind = 'ecm' AND table_id IN (128, 129)").select("capture", "pid", "table_id", "first_pkt_no", F.md5("bytes").alias("body"))
    new = content_changes(parity, ["capture", "pid", "table_id"], ["first_pkt_no"], F.col("body"), True, span)
    return counts.join(new.groupBy("capture").agg(F.count(F.lit(1)).alias("transitions")), "capture", "left").na.fill(0, ["transitions"])


EMM_GROUP_PAYLOAD = 64  # fixed value: bytes after the header in a group key message


def latest_emm(sections: DataFrame, services: int | None = None, group_payload: int = EMM_GROUP_PAYLOAD, span: int = DEFAULT_SPAN) -> DataFrame:
    """Latest group message per service and latest unique message, with versions counted by content (WIN-21).

    ``sections``: ``capture, first_pkt_no, bytes``. With ``services``, those beyond as many in order of arrival are
    dropped and reported by ``dropped``; by default none is.
    """
    size = F.octet_length("bytes")
    service = F.when(size - 3 == group_payload, be16(F.col("bytes"), 3)).otherwise(-1)
    rows = sections.filter(size >= 3).withColumn("service_id", service)
    versions = content_changes(rows.select("capture", "service_id", "first_pkt_no", F.md5("bytes").alias("h")), ["capture", "service_id"], ["first_pkt_no"], F.col("h"), True, span)
    latest = rows.groupBy("capture", "service_id").agg(
        F.max_by("bytes", "first_pkt_no").alias("bytes"), F.min("first_pkt_no").alias("since"), F.count(F.lit(1)).alias("seen")
    ).join(versions.groupBy("capture", "service_id").agg(F.count(F.lit(1)).alias("versions")), ["capture", "service_id"])
    # at most 65536 services per capture reach this rank
    rank = F.row_number().over(Window.partitionBy("capture", F.col("service_id") >= 0).orderBy("since"))
    over = F.lit(False) if services is None else (F.col("service_id") >= 0) & (F.col("rank") > services)
    return latest.withColumn("rank", rank).select(
        "capture", "service_id", F.when(~over, F.col("bytes")).alias("bytes"), F.when(over, 0).otherwise(F.col("versions")).alias("versions"),
        F.when(over, F.col("seen")).otherwise(0).alias("dropped"),
    )


def latest_event_sections(sections: DataFrame, cap: int | None = None) -> DataFrame:
    """Latest content per (service, table, section number) (WIN-22); with ``cap``, keys beyond it per service are dropped and counted."""
    keys = ["service_id", "table_id", "section_number"]
    per = sections.groupBy(*keys).agg(F.max_by("bytes", "arrival").alias("bytes"), F.min("arrival").alias("since"), F.count(F.lit(1)).alias("seen"))
    # a service has at most 256 x 256 distinct keys
    rank = F.row_number().over(Window.partitionBy("service_id").orderBy("since"))
    kept = F.lit(True) if cap is None else F.col("rank") <= cap
    return per.withColumn("rank", rank).select(*keys, F.when(kept, F.col("bytes")).alias("bytes"), F.when(kept, 0).otherwise(F.col("seen")).alias("dropped"))


# fixed values: output pid layout and stream types
PROGRAM_BLOCK, BLOCK_SIZE, PMT_BASE = 0x100, 32, 0x1000
OUT_STREAM_TYPE = {"mpeg2video": 0x02, "h264": 0x1B, "hevc": 0x24, "mp2": 0x03, "aac": 0x0F, "aac_latm": 0x11, "ac3": 0x81, "eac3": 0x87}


def map_output_pids(es: DataFrame, program_idx: str, src_pcr_pid: str | None = None, strip_data: bool = False, ca: DataFrame | None = None) -> DataFrame:
    """Output pids of each program's streams (WIN-18).

    The first supported video takes the block's base pid, other supported streams follow in order; later videos are
    skipped. At most 31 streams fit: the rest get no pid and ``mapped`` false. ``ca(program_idx, ecm_pid, emm_pid)``
    adds pass-through pids after the streams.
    """
    cap = BLOCK_SIZE - 1
    keys = Window.partitionBy(program_idx)
    supported = F.col("cls").isin("video", "audio") & (F.col("codec") != "none") | F.col("cls").isin("teletext", "subtitle")
    if not strip_data:
        supported = supported | (F.col("cls") == "data")
    video = F.col("cls") == "video"
    # the section length bounds a program's streams, so these windows are small by definition
    rows = es.filter(supported).withColumn("nth", F.row_number().over(Window.partitionBy(program_idx, video).orderBy("es_ordinal")))
    rows = rows.filter(~video | (F.col("nth") == 1)).withColumn("videos", F.max(video.cast("int")).over(keys))
    base = F.col(program_idx) * BLOCK_SIZE + PROGRAM_BLOCK
    fits = video | (F.col("nth") + F.col("videos") <= cap)
    typed = F.lit(None).cast("int")
    for codec, number in OUT_STREAM_TYPE.items():
        typed = F.when(F.col("codec") == codec, number).otherwise(typed)
    if "stream_type" in es.columns:
        typed = F.when(F.col("cls") == "data", F.col("stream_type")).otherwise(typed)
    out = rows.select(
        program_idx, F.col("pid").alias("in_pid"), F.when(video, base).when(fits, base + F.col("nth")).cast("int").alias("out_pid"),
        F.when(F.col("cls").isin("teletext", "subtitle"), 6).otherwise(typed).alias("out_stream_type"),
        F.when(video, 0).otherwise(F.col("nth") + 1).alias("out_ordinal"), F.lit(0).alias("is_ca"), fits.alias("mapped"),
    )
    if ca is not None:
        used = out.filter("mapped").groupBy(program_idx).agg(
            F.count_if(F.col("out_ordinal") > 0).alias("others"), F.count(F.lit(1)).alias("n")
        )
        both = ca.join(used, program_idx).select(
            program_idx, "others", "n", F.posexplode(F.array_compact(F.array(
                F.when(F.col("ecm_pid") > 0, F.struct(F.col("ecm_pid").alias("pid"), F.lit(1).alias("k"))),
                F.when(F.col("emm_pid") > 0, F.struct(F.col("emm_pid").alias("pid"), F.lit(2).alias("k"))),
            ))).alias("i", "c"),
        )
        room = F.col("n") + F.col("i") < cap
        out = out.unionByName(both.select(
            program_idx, F.col("c.pid").alias("in_pid"), F.when(room, F.col(program_idx) * BLOCK_SIZE + PROGRAM_BLOCK + 1 + F.col("others") + F.col("i")).cast("int").alias("out_pid"),
            F.lit(0).alias("out_stream_type"), (F.col("others") + F.col("i") + 2).cast("int").alias("out_ordinal"), F.col("c.k").alias("is_ca"), room.alias("mapped"),
        ))
    if src_pcr_pid:
        pcr = es.groupBy(program_idx).agg(F.first(src_pcr_pid).alias("__pcr"))
        first_pid = F.min(F.when(F.col("mapped"), F.struct("out_ordinal", "out_pid"))).over(keys)["out_pid"]
        clock = F.min(F.when((F.col("in_pid") == F.col("__pcr")) & F.col("mapped"), F.struct("out_ordinal", "out_pid"))).over(keys)["out_pid"]
        out = out.join(pcr, program_idx, "left").withColumn("pcr_pid", F.coalesce(clock, first_pid)).drop("__pcr")
    return out


def merge_programs(packets: DataFrame, pid_map: DataFrame, programs: DataFrame, span: int = DEFAULT_SPAN) -> tuple[DataFrame, DataFrame]:
    """Several one-program captures as one stream: remapped packets and the combined program list (SET-2).

    ``programs``: ``capture, program_idx, program_number``; ``pid_map``: result of ``map_output_pids`` on program_idx.
    """
    indexed = packets.join(programs.select("capture", "program_idx"), "capture")
    mapped = indexed.join(pid_map.filter("mapped").select("program_idx", F.col("in_pid").alias("pid"), "out_pid"), ["program_idx", "pid"])
    stamped = scan(mapped, ["out_pid"], ["pkt_no"], span, out_cc=RunningSum(F.col("has_payload").cast("bigint")))
    stream = stamped.withColumn("out_cc", F.pmod("out_cc", F.lit(16)).cast("int"))
    listing = programs.select("program_number", (F.col("program_idx") + PMT_BASE).cast("int").alias("pmt_pid"))
    return stream, listing


def scan_report(packets: DataFrame, datagrams: DataFrame, programs: DataFrame) -> DataFrame:
    """Per address: what a probe saw (AGG-5).

    ``packets``: ``capture, pkt_no``; ``datagrams``: ``capture, arrival, rtp_wrapped``; ``programs``: ``service_list`` rows.
    One row per resolved program, or one row without program.
    """
    seen = packets.groupBy("capture").agg(F.count(F.lit(1)).alias("pkts"))
    wrapped = datagrams.groupBy("capture").agg(F.min_by("rtp_wrapped", "arrival").alias("rtp_wrapped"))
    resolved = programs.filter("resolved").select(
        "capture", "tsid", "onid", F.col("program_number").alias("sid"),
        F.when(F.length("service_name") > 0, F.col("service_name")).otherwise("(no SDT)").alias("name"),
    )
    report = wrapped.join(seen, "capture", "left").join(resolved, "capture", "left").na.fill(0, ["pkts"])
    kind = F.when(F.col("pkts") == 0, "NONE").when(F.col("sid").isNotNull(), "NAMED").otherwise("UNNAMED")
    return report.select("capture", kind.alias("kind"), "pkts", "rtp_wrapped", "tsid", "onid", "sid", "name")


# ---- table rewriting -------------------------------------------------------------------------------------------


def _let(value: Column, expr: Callable[[Column], Column]) -> Column:
    """``expr`` of a value that is worked out once, however often ``expr`` reads it."""
    return F.transform(F.array(value), expr)[0]


def _finish(head: Column, body: Column) -> Column:
    """Section from its first three bytes and the rest: new length and checksum."""
    first_two = lambda b: to_bytes(bits(be16(head, 1), 12, 15) * 4096 + F.octet_length(b) + 4, 2)
    section = _let(body, lambda b: F.concat(F.substring(head, 1, 1), first_two(b), b))
    return _let(section, lambda s: F.concat(s, to_bytes(crc32_mpeg2(s), 4)))


def _shorter(section: Column, body: Column) -> Column:
    """``section`` with what is left of its body; as it is, checksum and all, when that is everything."""
    return _let(body, lambda b: F.when(F.octet_length(b) + 7 == F.octet_length(section), section).otherwise(_finish(section, b)))


def rewrite_pat(section: Column) -> Column:
    """PAT without its network entry."""
    entries = F.filter(
        F.transform(F.sequence(F.lit(9), F.octet_length(section) - 7, F.lit(4)), lambda at: F.substring(section, at, F.lit(4))),
        lambda e: be16(e, 0) != 0,
    )
    body = F.concat(F.substring(section, 4, 5), concat_bytes(entries))
    return F.when((F.octet_length(section) >= 16) & (u8(section, 0) == PAT), _shorter(section, body))


def _without_ca(loop: Column) -> Column:
    """Descriptors of a loop but those of access, up to the first overrun. A loop of one descriptor needs no walk."""
    item = lambda at, length: F.struct(u8(loop, at).alias("tag"), F.substring(loop, at + 1, length + 2).alias("raw"))
    walked = _walk(loop, F.lit(0), F.octet_length(loop), 2, lambda at: u8(loop, at + 1), item)
    kept = F.filter(walked, lambda d: d["tag"] != TAG_CA)
    one = u8(loop, 1) + 2 == F.octet_length(loop)
    many = concat_bytes(F.transform(kept, lambda d: d["raw"]))
    return F.when(F.octet_length(loop) == 0, loop).when(one, F.when(u8(loop, 0) == TAG_CA, F.substring(loop, 1, 0)).otherwise(loop)).otherwise(many)


def rewrite_pmt(section: Column, dropped: Column, strip_ecm: bool, strip_emm: bool) -> Column:
    """PMT without the streams whose pid is in ``dropped`` and, if asked, without access descriptors.

    Null, as for other tables, when the program's descriptors overrun the section. What is kept is copied as it stands.
    """
    end = F.octet_length(section) - 4
    with_length = lambda upper, body: _let(body, lambda b: F.concat(to_bytes(bits(upper, 12, 15) * 4096 + F.octet_length(b), 2), b))

    def entry(e: Column) -> Column:
        if not strip_ecm:
            return e["raw"]
        desc = _let(F.substring(e["raw"], F.lit(6), F.octet_length(e["raw"])), _without_ca)
        same = F.octet_length(e["raw"]) - 5  # nothing was dropped from descriptors of that length
        changed = lambda d: F.concat(F.substring(e["raw"], 1, 3), with_length(be16(e["raw"], 3), d))
        return _let(desc, lambda d: F.when(F.octet_length(d) == same, e["raw"]).otherwise(changed(d)))

    def rewritten(info: Column) -> Column:
        item = lambda at, length: F.struct(bits(be16(section, at + 1), 0, 0x1FFF).alias("pid"), F.substring(section, at + 1, length + 5).alias("raw"))
        loop = _walk(section, info + 12, end, 5, lambda at: bits(be16(section, at + 3), 0, 0xFFF), item)
        kept = F.filter(loop, lambda e: ~F.array_contains(dropped, e["pid"]))
        program = F.substring(section, F.lit(13), info)
        program = _let(program, _without_ca) if strip_emm else program
        body = F.concat(F.substring(section, 4, 7), with_length(be16(section, 10), program), concat_bytes(F.transform(kept, entry)))
        return F.when(info + 12 <= end, _shorter(section, body))

    table = (F.octet_length(section) >= 16) & (u8(section, 0) == PMT)
    return F.when(table, _let(bits(be16(section, 10), 0, 0xFFF), rewritten))


def section_packet(pid: Column, cc: Column, section: Column) -> Column:
    """One 188-byte packet holding a section that fits, padded; null when it does not."""
    head = F.concat(F.unhex(F.lit("47")), to_bytes(pid + 0x4000, 2), to_bytes(cc + 0x10, 1), F.unhex(F.lit("00")))
    pad = F.unhex(F.repeat(F.lit("FF"), F.greatest(PACKET_SECTION - F.octet_length(section), F.lit(0))))
    return F.when(F.octet_length(section) <= PACKET_SECTION, F.concat(head, section, pad))


def rewrite_tables(
    packets: DataFrame,
    starts: DataFrame,
    pmt_pids: DataFrame,
    dropped_pids: DataFrame,
    mask: frozenset[str] = STRIP_DEFAULT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Replacement packets for the PAT and PMT pids (UDF-7); the caller unions them with the stripped stream.

    ``packets``: ``capture, pid, pkt_no, pkt``; ``starts``: their ``section_starts``; ``dropped_pids(capture, pids ARRAY<INT>)``
    are the streams to remove. Only section starts are replaced, by the table known at that packet: its own section, or the
    last one before it when its own is broken or ends in a later packet. Continuation packets and starts before the first
    table are dropped; a table that does not fit one packet passes unchanged.
    """
    listed = pmt_pids.groupBy("capture").agg(F.collect_set("pmt_pid").alias("__pmts"))  # 13 bits
    about = cut_lineage(listed.join(dropped_pids.select("capture", "pids"), "capture", "full"))
    wanted = F.array_contains("__pmts", F.col("pid"))
    wanted = (wanted | (F.col("pid") == PID_PAT)) if "NIT" in mask else (wanted & (F.col("pid") != PID_PAT))
    tables = starts.join(about, "capture", "left").filter(wanted).drop("__pmts", "last_pkt_no")
    keys, own = ["capture", "pid"], F.col("whole") & F.col("bytes").isNotNull()
    if starts.filter(~own).isEmpty():
        numbered = row_number(tables, keys, ["pkt_no"], "n", span)
    else:  # a section over several packets is known from the next start on
        seen = scan(tables, keys, ["pkt_no"], span, __prior=PriorKnown(F.col("bytes")))
        known = seen.withColumn("bytes", F.when(own, F.col("bytes")).otherwise(F.col("__prior"))).drop("__prior")
        numbered = row_number(known.filter("bytes IS NOT NULL"), keys, ["pkt_no"], "n", span)
    dropped = F.coalesce(F.col("pids"), F.array().cast("array<int>"))
    section = F.when(F.col("pid") == PID_PAT, rewrite_pat(F.col("bytes"))).otherwise(rewrite_pmt(F.col("bytes"), dropped, "ECM" in mask, "EMM" in mask))
    rebuilt = section_packet(F.col("pid"), F.pmod(F.col("n"), F.lit(16)), F.col("section"))
    out = evaluate_once(numbered, "section", section).select("capture", "pid", "pkt_no", F.coalesce(rebuilt, F.col("pkt")).alias("pkt"))
    return out if "NIT" in mask else out.unionByName(packets.filter(F.col("pid") == PID_PAT).select("capture", "pid", "pkt_no", "pkt"))
