"""Queries over readers and column functions: encode the given tables in each format, then read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.functions import guide_time, text
from airlens.functions.binary import concat_bytes
from airlens.operators import guide, services
from airlens.operators.ordered import row_number
from airlens.operators.psi import descriptors, find_descriptor
from airlens.functions.binary import be16, be32, be64, crc32_mpeg2, seq_delta16
from airlens.functions.once import evaluate_once
from airlens.plans.guides import MAPPED, TEXTS, mapped, text_programmes
from airlens.plans.packets import packets, raw_packets
from airlens.plans.registry import query
from airlens.session import checkpoint_root
from airlens.sources import captures, guides, lists, packet_files


def lines(df: DataFrame, expr: str) -> DataFrame:
    return df.selectExpr("'doc' AS doc", "ord AS pos", f"{expr} AS line")


def dense(col: str = "ord") -> str:
    return f"CAST(ROW_NUMBER() OVER (ORDER BY {col}) AS BIGINT)"


@query("read_services_csv", f"SELECT {dense()} AS ord, name, uri, tsid, CASE WHEN ord % 2 = 0 THEN onid ELSE 1 END AS onid, CAST(CASE WHEN ord % 2 = 0 THEN sid ELSE {dense()} END AS INT) AS sid, CAST(5000 + ord % 1000 AS INT) AS port FROM fx_services")
def _(fx):
    src = lines(fx.services, "if(ord % 2 = 0, concat_ws(',', name, uri, tsid, onid, sid), concat_ws(',', name, uri))")
    return lists.parse_services_csv(src).select("ord", "name", "uri", "tsid", "onid", "sid", "port")


@query("read_services_m3u", f"SELECT {dense()} AS ord, name, uri, tsid, onid, CAST(CASE WHEN ord % 3 = 0 THEN {dense()} ELSE sid END AS INT) AS sid FROM fx_services")
def _(fx):
    info = """concat('#EXTINF:-1 tsid="', tsid, '" onid="', onid, '" sid="', if(ord % 3 = 0, 0, sid), '",', name)"""
    both = fx.services.selectExpr("'doc' AS doc", "ord", f"array({info}, '# note', '', uri, 'udp://1.1.1.1:1') AS rows")
    src = both.select("doc", "ord", F.posexplode("rows").alias("i", "line")).selectExpr("doc", "ord * 5 + i AS pos", "line")
    return lists.parse_services_m3u(src).select("ord", "name", "uri", "tsid", "onid", "sid")


@query("read_services_xspf", f"SELECT {dense()} AS ord, name, uri, tsid, onid, sid FROM fx_services")
def _(fx):
    rows = services.service_lines(fx.services, "xspf").selectExpr("'doc' AS doc", "ord AS pos", "line")
    parsed = rows.select("doc", "pos", F.from_xml("line", lists.TRACK).alias("t"))
    return lists.parse_tracks(parsed).select("ord", "name", "uri", "tsid", "onid", "sid")


@query("read_services_xml", "SELECT name, TRUE AS rtp, 4 AS family, regexp_extract(uri, '//(.*):', 1) AS address, CAST(5000 + ord % 1000 AS INT) AS port, tsid, onid, sid FROM fx_services")
def _(fx):
    rows = services.service_lines(fx.services, "xml", ret={"addr": "10.0.0.1", "port": 4000, "rtx_time_ms": 2000, "rtx_pt": 99})
    return lists.announced_services(rows.select(F.from_xml("line", lists.SERVICE).alias("e")).select("e.*"))


@query("read_mapping", f"SELECT {dense()} AS ord, CONCAT('x,', id) AS id, uri, tsid, onid, sid FROM fx_mapping")
def _(fx):
    return lists.parse_mapping(lines(fx.mapping, "concat('x,', concat_ws(',', id, uri, tsid, onid, sid))")).select("ord", "id", "uri", "tsid", "onid", "sid")


@query("read_revmap", f"SELECT {dense()} AS ord, uri, CONCAT('a,', id) AS id FROM fx_mapping")
def _(fx):
    return lists.parse_revmap(lines(fx.mapping, "concat(uri, ',a,', id)")).select("ord", "uri", "id")


@query("read_packages", f"""SELECT {dense('s_suppkey')} AS ord, CAST(s_suppkey AS INT) AS id, s_name AS name, 'eng' AS lang, s_suppkey % 3 <> 2 AS visible, CONCAT_WS('|', s_name, CAST(s_nationkey AS VARCHAR)) AS names FROM supplier""")
def _(fx):
    src = fx.table("supplier").selectExpr("'doc' AS doc", "s_suppkey AS pos", "concat_ws(',', s_suppkey, s_name, 'eng', element_at(array('', '1', '0'), cast(s_suppkey % 3 + 1 as int)), concat(s_name, '||', s_nationkey)) AS line")
    out = lists.parse_packages(src)
    return out.select("ord", "id", "name", "lang", "visible", F.array_join("service_names", "|").alias("names"))


@query("read_cells", f"""SELECT {dense('c_custkey')} AS ord, CONCAT('c', c_custkey) AS id, 'FR' AS country, CONCAT('1=', c_mktsegment, ';3=a:', c_nationkey) AS chain FROM customer""")
def _(fx):
    src = fx.table("customer").selectExpr("'doc' AS doc", "c_custkey AS pos", "concat('c', c_custkey, ',FR,1:', c_mktsegment, ',3:a:', c_nationkey) AS line")
    chain = F.array_join(F.transform("ca", lambda c: F.concat(c["type"].cast("string"), F.lit("="), c["value"])), ";")
    return lists.parse_cells(src).select("ord", "id", "country", chain.alias("chain"))


@query("read_xmltv_channels", "SELECT ord, id, CONCAT_WS('|', name1, name2) AS names FROM fx_channels")
def _(fx):
    src = guide.xmltv_lines(fx.channels, text_programmes(fx)).filter("part = 1").selectExpr("'doc' AS doc", "ord", "line")
    return guides.parse_xmltv(src, "line", "channel").select("ord", "id", F.array_join("names", "|").alias("names"))


@query("read_xmltv_programmes", f"""WITH {TEXTS} SELECT ord, channel_id, start, stop, CASE WHEN title = '' THEN '(untitled)' ELSE title END AS title, "desc", category FROM tp""")
def _(fx):
    src = guide.xmltv_lines(fx.channels, text_programmes(fx)).filter("part = 2").selectExpr("'doc' AS doc", "ord", "line")
    return guides.parse_xmltv(src, "line", "programme").select("ord", "channel_id", "start", "stop", "title", "desc", "category")


@query("read_guide_text", f"""WITH {TEXTS}, {MAPPED} SELECT ord, CONCAT('crid://guide.invalid/', channel_id, '/', translate(substr(start, 1, 19), '-:T', '')) AS crid, title, "desc", category FROM tp WHERE channel_id IN (SELECT id FROM mp WHERE uri IS NOT NULL)""")
def _(fx):
    rows = guide.guide_lines(mapped(fx), text_programmes(fx)).filter("part = 1").select(F.lit("doc").alias("doc"), "ord", F.from_xml("line", guides.TEXT).alias("e"))
    return guides.programme_text_of(rows).select("ord", "crid", "title", "desc", "category")


@query("read_guide_events", f"""WITH {TEXTS}, {MAPPED}, e AS (SELECT ord, channel_id, CONCAT('crid://guide.invalid/', channel_id, '/', translate(substr(start, 1, 19), '-:T', '')) AS crid, start, stop, title, "desc", category
 FROM tp WHERE channel_id IN (SELECT id FROM mp WHERE uri IS NOT NULL)),
t AS (SELECT crid, arg_min(title, ord) AS title, arg_min("desc", ord) AS "desc", arg_min(category, ord) AS category FROM e GROUP BY crid)
SELECT e.channel_id, e.crid, e.start, e.stop, t.title, t."desc", t.category FROM e JOIN t ON e.crid = t.crid""")
def _(fx):
    lines_ = guide.guide_lines(mapped(fx), text_programmes(fx))
    texts = guides.programme_text_of(lines_.filter("part = 1").select(F.lit("doc").alias("doc"), "ord", F.from_xml("line", guides.TEXT).alias("e")))
    # each event in a schedule element of its own: a channel's schedule is no single value
    owner = mapped(fx).selectExpr("ord", "id")
    one = lines_.filter("part = 2 AND line LIKE '<ScheduleEvent>%'").join(owner, "ord")
    element = F.concat(F.lit('<Schedule serviceIDRef="'), text.xml_escape(F.col("id")), F.lit('">'), "line", F.lit("</Schedule>"))
    events = guides.schedule_events_of(one.select(F.lit("doc").alias("doc"), "ord", F.from_xml(element, guides.SCHEDULE).alias("e")))
    return guide.attach_programme_text(events, texts).select("channel_id", "crid", "start", "stop", "title", "desc", "category")


@query("read_guide_channels", f"WITH {MAPPED} SELECT ord, id, CONCAT_WS('|', name1, name2) AS names, uri, tsid, onid, sid FROM mp WHERE uri IS NOT NULL")
def _(fx):
    rows = guide.guide_lines(mapped(fx), text_programmes(fx)).filter("part = 3").select(F.lit("doc").alias("doc"), "ord", F.from_xml("line", guides.SERVICE).alias("e"))
    return guides.guide_channels_of(rows).select("ord", "id", F.array_join("names", "|").alias("names"), "uri", "tsid", "onid", "sid")


def packet_folder(fx) -> str:
    """A new folder where all machines see it."""
    return f"{checkpoint_root(fx.spark)}/packets-{uuid.uuid4().hex}"


PKT_FIELDS = ("pkt_no", "cast(conv(hex(substring(pkt, 2, 2)), 16, 10) as int) % 8192 AS pid", "cast(conv(hex(substring(pkt, 4, 1)), 16, 10) as int) % 16 AS cc")
#: As live packets end to end: packet numbers of a capture from 0 on.
IN_FILES = "SELECT capture, CAST(ROW_NUMBER() OVER (PARTITION BY capture ORDER BY pkt_no) - 1 AS BIGINT) AS pkt_no, pid, cc FROM fx_packets"


@query("split_packets", """SELECT capture, pkt_no // 2000 AS file_no, CAST(ROW_NUMBER() OVER (PARTITION BY capture, pkt_no // 2000 ORDER BY pkt_no) - 1 AS BIGINT) AS pkt_no, pid, cc
FROM fx_packets""")
def _(fx):
    """Packet files, one set for every 2,000 packet numbers of a capture, written and read back by ranges of 20 kB."""
    folder = packet_folder(fx)
    packet_files.write_packets(raw_packets(fx).selectExpr("concat(capture, '/', pkt_no div 2000) AS capture", "pkt_no", "pkt"), folder)
    out = captures.read_ts(fx.spark, folder, range_bytes=20_000)
    return out.selectExpr("cast(split(capture, '/')[0] as int) AS capture", "cast(split(capture, '/')[1] as bigint) AS file_no", *PKT_FIELDS)


OWNER = "cast(regexp_extract(capture, 'capture=([0-9]+)/', 1) as int) AS capture"


@query("resync_packets", IN_FILES)
def _(fx):
    """Unaligned files: 1 to 9 stray bytes in front of every 50th packet; where packets begin, ranges of 20 kB tell together."""
    folder = packet_folder(fx)
    stray = F.when(F.col("pkt_no") % 50 == 0, F.expr("unhex(repeat('A5', cast(pkt_no div 50 % 9 + 1 as int)))")).otherwise(F.expr("x''"))
    packet_files.write_packets(raw_packets(fx).select("capture", "pkt_no", F.concat(stray, "pkt").alias("pkt")), folder, any_length=True, one_file=True)
    return captures.read_ts(fx.spark, folder, aligned=False, range_bytes=20_000).selectExpr(OWNER, *PKT_FIELDS)


@query("rtp_packet_files", IN_FILES)
def _(fx):
    """Files of RTP records of seven packets, told from raw ones by their heads and read by ranges of 20 kB."""
    folder = packet_folder(fx)
    numbered = row_number(raw_packets(fx).select("capture", "pkt_no", "pkt"), ["capture"], ["pkt_no"])
    records = numbered.groupBy("capture", F.expr("(rn - 1) div 7").alias("pkt_no")).agg(F.array_sort(F.collect_list(F.struct("rn", "pkt"))).alias("p"))
    framed = records.select("capture", "pkt_no", F.concat(F.unhex(F.lit("8021" + "00" * 10)), concat_bytes(F.col("p.pkt"))).alias("pkt"))
    packet_files.write_packets(framed, folder, any_length=True, one_file=True)
    return captures.read_ts(fx.spark, f"{folder}/*/*.ts", range_bytes=20_000).selectExpr("cast(capture as int) AS capture", *PKT_FIELDS)


@query("detect_framing", """SELECT event_id, CASE WHEN event_id % 9 BETWEEN 1 AND 7 THEN 'rtp' ELSE 'raw' END AS framing, CAST(CASE WHEN event_id % 9 BETWEEN 1 AND 7 THEN 12 + 188 * (event_id % 9) ELSE 188 END AS INT) AS stride,
CASE WHEN event_id % 9 BETWEEN 1 AND 7 THEN event_id % 9 + 1 ELSE 4 END AS packets FROM fx_base""")
def _(fx):
    rtp = "concat('80210001', repeat('00', 8), repeat(concat('47', repeat('AA', 187)), cast(event_id % 9 as int)), '80210002', repeat('00', 8), '47', repeat('AA', 187))"
    raw = "repeat(concat('47', repeat('AA', 187)), 4)"
    files = fx.base.selectExpr("event_id", "cast(event_id as string) AS capture", f"unhex(if(event_id % 9 BETWEEN 1 AND 7, {rtp}, {raw})) AS content")
    n = captures.deframed_packets(files).groupBy("capture").agg(F.count(F.lit(1)).alias("packets"))
    return captures.detect_framing(files).join(n, "capture").select("event_id", "framing", "stride", "packets")


@query("decode_frames", """SELECT arrival, CASE WHEN arrival % 3 = 2 THEN 6 ELSE 4 END AS family, CASE WHEN arrival % 3 = 2 THEN CONCAT('ff0e:0:0:0:0:0:0:', lower(to_hex(arrival % 256))) ELSE CONCAT('239.1.2.', arrival % 256) END AS address,
CAST(5000 + channel AS INT) AS port, CAST(arrival % 64 * 4 AS INT) AS dscp, ssrc, CAST(seq AS INT) AS seq, rtp_ts, CAST(6 AS INT) AS payload_len FROM fx_rtp WHERE arrival % 256 < 128""")
def _(fx):
    h = lambda e, w: f"lpad(hex(cast({e} as bigint)), {2 * w}, '0')"
    eth = "repeat('00', 12) || if(arrival % 2 = 0, '81000064', '')"
    rtp = f"concat('8021', {h('seq', 2)}, {h('rtp_ts', 4)}, {h('ssrc', 4)}, '470102030405')"
    udp = f"concat('1000', {h('5000 + channel', 2)}, '00000000')"
    v4 = f"concat('0800', '45', {h('arrival % 64 * 4 + 1', 1)}, repeat('00', 7), '11', '0000', '0A000001', 'EF0102', {h('arrival % 256', 1)}, {udp}, {rtp})"
    v6 = f"concat('86DD', {h('6 * 4096 + arrival % 64 * 4 * 16', 2)}, '0000', '0000', '00', '40', repeat('00', 16), 'FF0E', repeat('00', 13), {h('arrival % 256', 1)}, '3C01', repeat('00', 14), '1100', repeat('00', 6), {udp}, {rtp})"
    frames = fx.rtp.select("arrival", F.expr(f"unhex(concat({eth}, if(arrival % 3 = 2, {v6}, {v4})))").alias("frame"))
    frames = evaluate_once(frames, "frame", F.col("frame"))
    ranges = fx.spark.createDataFrame([("239.1.2.0/25",), ("ff0e::/121",)], "cidr string")
    return captures.decode_frames(frames, ranges).select("arrival", "family", "address", "port", "dscp", "ssrc", "seq", "rtp_ts", F.octet_length("payload").alias("payload_len"))


# ---- column functions ----


@query("big_endian", "SELECT event_id, CAST(event_id % 65536 AS INT) AS a, us % 4294967296 AS b, CAST(us AS VARCHAR) AS c, CAST((user_id - event_id % 65536 + 32768 + 65536) % 65536 - 32768 AS BIGINT) AS delta FROM fx_base")
def _(fx):
    h = lambda e, w: f"lpad(hex({e}), {2 * w}, '0')"
    p = F.expr(f"unhex(concat('FF', {h('event_id % 65536', 2)}, {h('us % 4294967296', 4)}, {h('us', 8)}))")
    rows = fx.base.withColumn("p", p)
    return rows.select("event_id", be16(F.col("p"), 1).alias("a"), be32(F.col("p"), 3).alias("b"), be64(F.col("p"), 7).cast("string").alias("c"), seq_delta16(F.col("user_id"), F.expr("event_id % 65536")).alias("delta"))


@query("xml_escape", """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')) AS escaped, md5(text) AS back FROM documents""")
def _(fx):
    esc = text.xml_escape(F.col("text"))
    return fx.table("documents").select("doc_id", F.md5(esc).alias("escaped"), F.md5(text.xml_unescape(esc)).alias("back"))


@query("xml_unescape_numeric", "SELECT event_id, CONCAT('a', chr(CAST(33 + event_id % 8000 AS INT)), '&', chr(CAST(33 + user_id AS INT)), '&#x;') AS out FROM fx_base")
def _(fx):
    src = F.expr("concat('a&#', 33 + event_id % 8000, ';&amp;&#x', hex(33 + user_id), ';&#x;')")
    return fx.base.select("event_id", text.xml_unescape(src).alias("out"))


@query("percent_encode", "SELECT c_custkey, CONCAT('a%20b%2Ac~d%2B%C3%A9%2F', c_custkey, '%23', replace(c_name, '#', '%23')) AS out FROM customer")
def _(fx):
    return fx.table("customer").select("c_custkey", text.percent_encode(F.expr("concat('a b*c~d+é/', c_custkey, '#', c_name)")).alias("out"))


@query("build_crid", f"""WITH {TEXTS} SELECT ord, CONCAT('crid://guide.invalid/', channel_id, '/', translate(substr(start, 1, 19), '-:T', '')) AS crid FROM tp""")
def _(fx):
    return text_programmes(fx).select("ord", guide_time.build_crid(F.col("channel_id"), F.col("start")).alias("crid"))


@query("guide_times", """WITH t AS (SELECT event_id, strftime(make_timestamp(us // 1000000 * 1000000), '%Y%m%d%H%M%S') AS c, CAST(us // 60000000 + 58444 * 0 + 58445280 - 28416000 * 0 AS BIGINT) AS x, us FROM fx_base),
o AS (SELECT *, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' +0000' WHEN 2 THEN ' +0130' ELSE ' -0500' END AS off, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+01:30' ELSE '-05:00' END AS iso_off,
 CASE event_id % 4 WHEN 2 THEN 90 WHEN 3 THEN -300 ELSE 0 END AS om FROM t)
SELECT event_id, CONCAT(substr(c, 1, 4), '-', substr(c, 5, 2), '-', substr(c, 7, 2), 'T', substr(c, 9, 2), ':', substr(c, 11, 2), ':', substr(c, 13, 2), iso_off) AS iso, CONCAT(c, off) AS back,
 us // 60000000 + 58445280 - om AS mjd_min, (us // 60000000 - om) * 60 AS unix_s FROM o""")
def _(fx):
    compact = F.concat(F.expr("date_format(timestamp_seconds(us div 1000000), 'yyyyMMddHHmmss')"), F.expr("element_at(array('', ' +0000', ' +0130', ' -0500'), cast(event_id % 4 + 1 as int))"))
    rows = evaluate_once(fx.base.select("event_id", compact.alias("c")), "c", F.col("c"))
    rows = evaluate_once(evaluate_once(rows, "iso", guide_time.xmltv_to_iso(F.col("c"))), "mjd_min", guide_time.iso_to_minutes(F.col("iso")))
    return rows.select("event_id", "iso", guide_time.iso_to_xmltv(F.col("iso")).alias("back"), "mjd_min", guide_time.minutes_to_unix(F.col("mjd_min")).alias("unix_s"))


@query("escape_label", r"""SELECT event_id, CONCAT('a\\', event_type, '\"', chr(92), 'n', user_id) AS out FROM fx_base""")
def _(fx):
    return fx.base.select("event_id", text.escape_label(F.concat(F.lit("a\\"), "event_type", F.lit('"\n'), F.col("user_id").cast("string"))).alias("out"))


@query("split_composite_label", "SELECT event_id, event_type AS input, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS reason FROM fx_base")
def _(fx):
    label = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("\x1f"), F.col("user_id").cast("string")))
    first, second = text.split_composite_label(label)
    return fx.base.select("event_id", first.alias("input"), second.alias("reason"))


@query("split_title", """SELECT i, station, CASE WHEN instr(stream_title, ' - ') > 0 THEN split_part(stream_title, ' - ', 1) ELSE '' END AS artist, CASE WHEN instr(stream_title, ' - ') > 0 THEN split_part(stream_title, ' - ', 2) ELSE stream_title END AS title FROM fx_titles""")
def _(fx):
    block = F.concat(F.lit("StreamUrl='';StreamTitle='"), "stream_title", F.lit("';x';"))
    artist, title = text.split_title(F.col("t"))
    return fx.titles.withColumn("t", text.stream_title(block)).select("i", "station", artist.alias("artist"), title.alias("title"))


@query("eit_title", """WITH s AS (SELECT i, CASE WHEN instr(stream_title, ' - ') > 0 THEN split_part(stream_title, ' - ', 1) ELSE '' END AS a, CASE WHEN instr(stream_title, ' - ') > 0 THEN split_part(stream_title, ' - ', 2) ELSE stream_title END AS t FROM fx_titles)
SELECT i, CASE WHEN a = '' THEN t ELSE CONCAT(a, ' ', t) END AS name FROM s""")
def _(fx):
    artist, title = text.split_title(F.col("stream_title"))
    return fx.titles.select("i", text.eit_title(artist, title).alias("name"))


@query("small_formats", """SELECT event_id, CASE WHEN s // 3600 > 0 THEN printf('%2d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%2d:%02d', s // 60, s % 60) END AS dur, printf('0x%08x', event_id * 7919) AS cas,
replace(CONCAT('a,', event_type, ',b'), ',', '') AS safe, CONCAT('/', user_id, '/x%/', event_id % 70000) AS path, CASE event_id % 3 WHEN 1 THEN 'given' WHEN 2 THEN event_type END AS name, user_id * 5 // 100 AS kbps,
CAST(CASE WHEN event_id % 2 = 0 THEN LEAST(user_id * 3, 100) ELSE user_id * 3 END AS BIGINT) AS target
FROM (SELECT *, LEAST(event_id * 50, 359999) AS s FROM fx_base) z""")
def _(fx):
    return fx.base.select(
        "event_id", text.fmt_dur(F.col("event_id") * 50).alias("dur"), text.super_cas_hex(F.col("event_id") * 7919).alias("cas"),
        text.csv_safe_name(F.concat(F.lit("a,"), "event_type", F.lit(",b"))).alias("safe"),
        text.expand_template(F.lit("/%g/x%%/%p%q/never"), F.col("user_id").cast("string"), F.col("event_id") % 70000).alias("path"),
        text.resolve_name(F.expr("element_at(array('drop', 'override', 'pass'), cast(event_id % 3 + 1 as int))"), F.lit("given"), F.col("event_type")).alias("name"),
        text.feedback_kbps(F.col("user_id") * 1000).alias("kbps"),
        text.burst_target(F.col("user_id"), F.lit(3), F.when(F.col("event_id") % 2 == 0, 100).otherwise(0)).cast("bigint").alias("target"),
    )


@query("dvb_text", "SELECT event_id, CONCAT(event_type, ' ', user_id) AS out FROM fx_base")
def _(fx):
    prefix = "element_at(array('', '05', '100001', '1F02'), cast(event_id % 4 + 1 as int))"
    return fx.base.select("event_id", text.dvb_text(F.expr(f"unhex(concat({prefix}, hex(event_type), '0A', hex(cast(user_id as string))))")).alias("out"))


@query("find_descriptor", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS body FROM fx_base")
def _(fx):
    h = lambda e: f"concat(lpad(hex(length({e})), 2, '0'), hex({e}))"
    loop = f"unhex(concat('0A0465', '6E6700', if(event_id % 4 = 0, '', concat('48', {h('event_type')})), '48', '0141', '7F', 'FF00'))"
    items = descriptors(F.expr(loop))
    found = find_descriptor(F.col("items"), 0x48)
    rows = fx.base.select("event_id", items.alias("items"))
    # without the first 0x48 entry the second one is found
    return rows.select("event_id", F.when(found.cast("string") != "A", found.cast("string")).alias("body"))


@query(
    "crc32_mpeg2",
    """WITH h AS (SELECT doc_id, string_split(hex(encode(COALESCE(text, ''))), '') AS h FROM documents),
n AS (SELECT doc_id, list_transform(list_filter(h, lambda c: c <> ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS n FROM h),
-- a nibble a step: the top four bits of the sum choose what is added, the remainder of the nibble times x to the 32
t AS (SELECT list_transform(range(16), lambda v: list_reduce(list_prepend(v << 28, range(4)), lambda c, i: xor((c << 1) & 4294967295, CASE WHEN c >> 31 = 1 THEN 79764919 ELSE 0 END))) AS t)
SELECT doc_id, CAST(list_reduce(list_prepend(4294967295::BIGINT, n), lambda c, v: xor((c << 4) & 4294967295, t[xor(c >> 28, v) + 1])) AS BIGINT) AS crc, CAST(0 AS BIGINT) AS residue FROM n, t""",
)
def _(fx):
    """The checksum of every text, and of the text with its checksum behind it, which is 0."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    crc = crc32_mpeg2(body)
    return fx.table("documents").select("doc_id", crc.alias("crc"), crc32_mpeg2(F.concat(body, F.unhex(F.lpad(F.hex(crc), 8, "0")))).alias("residue"))
