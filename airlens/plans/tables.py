"""Queries over table sections and stream lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.fixtures import Fixtures
from airlens.functions.binary import to_bytes, u8
from airlens.functions.once import evaluate_once
from airlens.operators import psi, ts
from airlens.plans.packets import packets
from airlens.plans.registry import query
from airlens.session import cut_lineage


def table_packets(fx: Fixtures) -> DataFrame:
    decoded = ts.ts_payload(ts.ts_header(fx.order_packets.drop("pid")))
    return decoded.select("capture", "pid", "pkt_no", "pusi", "payload", "pkt")


def sections(fx: Fixtures) -> DataFrame:
    """Known sections with their positions, as the assembler would deliver them."""
    return fx.order_sections.select("capture", "pid", F.col("pkt_no").alias("first_pkt_no"), F.col("pkt_no").alias("last_pkt_no"), "bytes")


@query(
    "assemble_sections",
    """WITH len AS (SELECT capture, COUNT(*) AS n, SUM(CASE variant WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 9 WHEN 4 THEN 7 WHEN 5 THEN 10 WHEN 6 THEN 5 ELSE 0 END) AS d FROM fx_order_es GROUP BY 1),
s AS (SELECT p.capture, 0 AS pid, 0 AS table_id, CASE WHEN p.capture % 2 = 0 THEN 20 ELSE 16 END AS size FROM fx_order_programs p
UNION ALL SELECT p.capture, 17, 66, 12 + 3 + 5 + 5 + length(service_name) + length(provider_name) FROM fx_order_programs p WHERE service_name IS NOT NULL
UNION ALL SELECT p.capture, p.pmt_pid, 2, CAST(16 + 5 * n + d AS INT) FROM fx_order_programs p JOIN len ON p.capture = len.capture)
SELECT capture, pid, table_id, CAST(size AS INT) AS size, TRUE AS crc_ok FROM s, range(2)""",
)
def _(fx):
    out = psi.assemble_sections(table_packets(fx))
    return out.select("capture", "pid", "table_id", F.octet_length("bytes").alias("size"), (psi.crc32_mpeg2(F.col("bytes")) == 0).alias("crc_ok"))


@query(
    "service_list",
    """SELECT capture, tsid, CASE WHEN service_name IS NOT NULL THEN 1 END AS onid, program_number, pmt_pid, TRUE AS resolved, service_name, provider_name FROM fx_order_programs""",
)
def _(fx):
    return psi.tables_of_packets(table_packets(fx).select("capture", "pid", "pkt_no", "pusi", "payload"))["programs"]


@query(
    "service_list_mixed",
    """SELECT capture, tsid, CASE WHEN service_name IS NOT NULL THEN 1 END AS onid, program_number, pmt_pid, TRUE AS resolved, service_name, provider_name FROM fx_order_programs""",
)
def _(fx):
    """The same among packets of a pid that carries no tables, one a line item."""
    tables = table_packets(fx).select("capture", "pid", "pkt_no", "pusi", "payload")
    media = fx.table("lineitem").select(
        F.col("l_suppkey").cast(tables.schema["capture"].dataType).alias("capture"), F.lit(8190).cast(tables.schema["pid"].dataType).alias("pid"),
        F.expr("1000000000 + l_orderkey * 8 + l_linenumber").cast(tables.schema["pkt_no"].dataType).alias("pkt_no"),
        F.expr("if(l_linenumber = 1, 1, 0)").cast(tables.schema["pusi"].dataType).alias("pusi"), F.lit(bytes(184)).alias("payload"),
    )
    return psi.tables_of_packets(tables.unionByName(media))["programs"]


@query("psi_elementary_streams", """SELECT o.capture, p.program_number, p.pmt_pid, es_ordinal, pid, stream_type, cls, codec, lang,
 CAST(CASE WHEN cls = 'audio' THEN SUM(CASE WHEN cls = 'audio' THEN 1 ELSE 0 END) OVER (PARTITION BY o.capture ORDER BY es_ordinal) ELSE 0 END AS INT) AS audio_index,
 CASE WHEN cls = 'teletext' THEN 188 END AS page, CASE WHEN cls = 'subtitle' THEN 1 END AS composition_page
 FROM fx_order_es_class o JOIN fx_order_programs p ON o.capture = p.capture""")
def _(fx):
    es = psi.psi_tables(sections(fx))["es"]
    return es.select(
        "capture", "program_number", "pmt_pid", "es_ordinal", "pid", "stream_type", "cls", "codec", "lang", "audio_index",
        F.col("ttx.page").alias("page"), F.col("sub.composition_page").alias("composition_page"),
    )


@query("all_programs_named", "SELECT capture, service_name IS NOT NULL AS all_named FROM fx_order_programs")
def _(fx):
    return psi.all_programs_named(psi.psi_tables(sections(fx))["programs"])


def order_programs(fx: Fixtures) -> DataFrame:
    """Captures with several programs: orders of one customer."""
    return fx.table("orders").selectExpr("o_custkey AS capture", "CAST(1 + o_orderkey % 60000 AS INT) AS program_number", "CAST(32 + o_orderkey % 8000 AS INT) AS pmt_pid")


@query("program_kind", "SELECT o_custkey AS capture, COUNT(*) AS programs, CASE WHEN COUNT(*) > 1 THEN 'MPTS' ELSE 'SPTS' END AS kind FROM orders GROUP BY 1")
def _(fx):
    return psi.program_kind(order_programs(fx))


def single_sections(fx: Fixtures, pid: int, body: str) -> DataFrame:
    """One table section an order, in the order of their keys, with a checksum that fails for every ninth."""
    head = f"unhex(concat('{'40' if pid == psi.PID_NIT else '01'}', 'B000'))"
    made = fx.table("orders").select(F.expr("o_custkey AS capture"), F.expr("o_orderkey"), F.expr(body).alias("body"))
    made = evaluate_once(evaluate_once(made, "body", F.col("body")), "bytes", psi._finish(F.expr(head), F.col("body")))
    last = F.octet_length("bytes") - 1
    flipped = F.concat(F.substring("bytes", F.lit(1), last), to_bytes(F.lit(255) - u8(F.col("bytes"), last), 1))
    damaged = F.when(F.col("o_orderkey") % 9 == 0, flipped).otherwise(F.col("bytes"))
    made = evaluate_once(made, "bytes", damaged)
    return made.select("capture", F.lit(pid).alias("pid"), F.col("o_orderkey").alias("first_pkt_no"), F.col("o_orderkey").alias("last_pkt_no"), "bytes")


@query("network_names", """SELECT o_custkey AS capture, CONCAT('net ', arg_max(o_orderkey, o_orderkey), ' ', repeat('n', 80)) AS network_name FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1""")
def _(fx):
    name = "concat('net ', o_orderkey, ' ', repeat('n', 80))"
    body = f"unhex(concat('0001C10000', lpad(hex(61440 + length({name}) + 2), 4, '0'), '40', lpad(hex(length({name})), 2, '0'), hex({name}), 'F000'))"
    return psi.parse_nit(single_sections(fx, psi.PID_NIT, body))


@query("conditional_access", """SELECT o_custkey AS capture, CAST(arg_max(1536 + o_orderkey % 200, o_orderkey) AS INT) AS ca_system_id, CAST(arg_max(o_orderkey % 8191, o_orderkey) AS INT) AS emm_pid
FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1""")
def _(fx):
    body = "unhex(concat('FFFFC10000', '0904', lpad(hex(1536 + o_orderkey % 200), 4, '0'), lpad(hex(57344 + o_orderkey % 8191), 4, '0')))"
    return psi.parse_cat(single_sections(fx, psi.PID_CAT, body))


@query("program_selection", """SELECT o_custkey AS capture, COUNT(*) AS programs, CASE WHEN COUNT(*) = 1 THEN 'whole' WHEN bool_or(32 + o_orderkey % 8000 = 777) THEN 'chosen' ELSE 'unknown_pid' END AS outcome FROM orders GROUP BY 1""")
def _(fx):
    return psi.program_selection(order_programs(fx), 777)


@query("select_program", """SELECT p.capture, p.pid, p.pkt_no FROM fx_packets p WHERE p.pid IN (257, 258)""")
def _(fx):
    programs = fx.es.filter("es_ordinal < 2").selectExpr("capture", "pid AS pmt_pid", "es_ordinal + 1 AS program_number")
    es = fx.es.filter("es_ordinal = 2").selectExpr("capture", "257 AS pmt_pid", "pid")
    return psi.select_program(packets(fx), programs, es, 257).select("capture", "pid", "pkt_no")


@query("es_summary", """SELECT capture, COUNT(*) FILTER (cls = 'audio') AS audio_count, bool_or(cls = 'teletext') AS ttx, bool_or(cls = 'subtitle') AS sub,
 CASE WHEN bool_or(cls = 'teletext') AND bool_or(cls = 'subtitle') THEN 'ttx+sub' WHEN bool_or(cls = 'teletext') THEN 'txt' WHEN bool_or(cls = 'subtitle') THEN 'sub' ELSE '-' END AS label
 FROM fx_order_es_class GROUP BY 1""")
def _(fx):
    return psi.es_summary(psi.psi_tables(sections(fx))["es"])


@query("classify_es", "SELECT capture, pid, cls, codec, lang FROM fx_order_es_class")
def _(fx):
    desc = {1: "0A04656E6700", 2: "0A04656E6700", 3: "6A01000A04656E6700", 4: "5605656E671188", 5: "5908656E671000010002", 6: "6F03000000"}
    pick = "CASE variant " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in desc.items()) + " ELSE '' END"
    rows = fx.order_es.withColumn("items", psi.descriptors(F.unhex(F.expr(pick)))).withColumn(
        "stream_type", F.expr("CASE variant WHEN 0 THEN 27 WHEN 1 THEN 3 WHEN 2 THEN 15 WHEN 6 THEN 5 ELSE 6 END"))
    cls, codec, lang = psi.classify_es(F.col("stream_type"), F.col("items"))
    return rows.select("capture", "pid", cls.alias("cls"), codec.alias("codec"), lang.alias("lang"))


@query("classify_pid", """WITH r AS (SELECT capture, 16 AS pid, 'NIT' AS cls, 1 AS k FROM fx_order_programs WHERE capture % 2 = 0
UNION ALL SELECT capture, pmt_pid, 'PMT', 2 FROM fx_order_programs UNION ALL SELECT capture, pid, cls, 3 FROM fx_order_es_class
UNION ALL SELECT capture, MIN(pid), 'PCR', 5 FROM fx_order_es_class GROUP BY 1)
SELECT capture, pid, arg_min(cls, k) AS cls FROM r GROUP BY 1, 2""")
def _(fx):
    t = psi.psi_tables(sections(fx))
    return psi.classify_pid(t["pat"], t["pmt"], t["es"])


@query("audio_index", """SELECT capture, pid, CAST(CASE WHEN cls = 'audio' THEN SUM(CASE WHEN cls = 'audio' THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY es_ordinal) ELSE 0 END AS INT) AS audio_index FROM fx_es""")
def _(fx):
    return psi.audio_index(fx.es).select("capture", "pid", "audio_index")


@query("map_output_pids", """WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture, cls = 'video' ORDER BY es_ordinal) AS nth FROM fx_order_es_class WHERE cls <> 'AIT'),
k AS (SELECT * FROM s WHERE cls <> 'video' OR nth = 1),
m AS (SELECT capture, pid AS in_pid, CAST(capture * 32 + 256 + CASE WHEN cls = 'video' THEN 0 ELSE nth END AS INT) AS out_pid,
 CASE WHEN cls IN ('teletext', 'subtitle') THEN 6 WHEN codec = 'h264' THEN 27 WHEN codec = 'mp2' THEN 3 WHEN codec = 'aac' THEN 15 WHEN codec = 'ac3' THEN 129 END AS out_stream_type,
 CASE WHEN cls = 'video' THEN 0 ELSE nth + 1 END AS o FROM k)
SELECT capture, in_pid, out_pid, out_stream_type, TRUE AS mapped,
 COALESCE(MAX(CASE WHEN in_pid = pcr THEN out_pid END) OVER (PARTITION BY capture), FIRST_VALUE(out_pid) OVER (PARTITION BY capture ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pcr_pid
FROM m JOIN (SELECT capture AS c2, MIN(pid) AS pcr FROM fx_order_es_class GROUP BY 1) q ON m.capture = q.c2""")
def _(fx):
    t = psi.psi_tables(sections(fx))
    es = t["es"].join(t["pmt"].select("capture", "pcr_pid"), "capture")
    return psi.map_output_pids(es, "capture", "pcr_pid").select("capture", "in_pid", "out_pid", "out_stream_type", "mapped", "pcr_pid")


@query("merge_programs", """WITH m AS (SELECT capture, pid, capture * 32 + 256 + CASE WHEN cls = 'video' THEN 0 ELSE ROW_NUMBER() OVER (PARTITION BY capture, cls = 'video' ORDER BY es_ordinal) END AS out_pid FROM fx_es)
SELECT CAST(m.out_pid AS INT) AS out_pid, p.pkt_no, CAST(SUM(has_payload) OVER (PARTITION BY m.out_pid ORDER BY pkt_no) % 16 AS INT) AS out_cc
FROM fx_packets p JOIN m ON p.capture = m.capture AND p.pid = m.pid""")
def _(fx):
    programs = fx.es.select("capture").distinct().selectExpr("capture", "capture AS program_idx", "capture + 1 AS program_number")
    es = fx.es.join(programs, "capture")
    stream, _listing = psi.merge_programs(packets(fx), psi.map_output_pids(es, "program_idx"), programs)
    return stream.select("out_pid", "pkt_no", "out_cc")


@query("merged_program_list", "SELECT DISTINCT capture + 1 AS program_number, capture + 4096 AS pmt_pid FROM fx_packets")
def _(fx):
    programs = fx.es.select("capture").distinct().selectExpr("capture", "capture AS program_idx", "capture + 1 AS program_number")
    return psi.merge_programs(packets(fx), psi.map_output_pids(fx.es.join(programs, "capture"), "program_idx"), programs)[1]


CLASSES = "fx_packets p LEFT JOIN fx_es e ON p.capture = e.capture AND p.pid = e.pid"


@query("strip_filter", f"SELECT p.capture, p.pid, pkt_no FROM {CLASSES} WHERE COALESCE(cls, '') NOT IN ('data', 'video')")
def _(fx):
    # the view has no AIT or ECM streams: let its data stream be an AIT and its video stream an ECM
    classes = fx.es.replace({"data": "AIT", "video": "ECM"}, subset=["cls"])
    return psi.strip_filter(packets(fx), classes, frozenset({"NUL", "AIT", "ECM"})).select("capture", "pid", "pkt_no")


@query("strip_by_table_id", """WITH t AS (SELECT capture, pid, pkt_no, CASE WHEN has_payload = 1 AND pkt_no % 5 = 0 THEN pkt_no % 3 END AS tid FROM fx_packets)
SELECT capture, pid, pkt_no FROM (SELECT *, LAST_VALUE(tid IGNORE NULLS) OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS l FROM t) z WHERE COALESCE(l, -1) <> 1""")
def _(fx):
    pusi = F.when((F.col("has_payload") == 1) & (F.col("pkt_no") % 5 == 0), 1).otherwise(0)
    body = F.when(F.col("pkt_no") % 3 == 1, F.unhex(F.lit("004C00"))).otherwise(F.unhex(F.lit("004200")))
    src = packets(fx).withColumn("pusi", pusi).withColumn("payload", F.when(F.col("has_payload") == 1, body))
    return psi.strip_by_table_id(src).select("capture", "pid", "pkt_no")


@query("select_audio", f"""WITH m AS (SELECT capture AS c, MIN(pkt_no) + (MAX(pkt_no) - MIN(pkt_no)) // (capture + 2) AS first FROM fx_packets GROUP BY capture)
SELECT p.capture, p.pid, pkt_no FROM {CLASSES} JOIN m ON m.c = p.capture WHERE COALESCE(cls, '') <> 'teletext' AND (COALESCE(cls, '') <> 'audio' OR p.pid = 258)
 AND (p.pid <> 261 OR (p.capture < 3 AND pkt_no >= first))""")
def _(fx):
    """The tables do not explain pid 261: it is held back until the first program map, which the last capture never sees."""
    es = psi.audio_index(fx.es)
    low, high = F.min("pkt_no"), F.max("pkt_no")
    maps = packets(fx).groupBy("capture").agg((low + F.floor((high - low) / (F.col("capture") + 2))).cast("bigint").alias("first_pmt_pkt_no")).filter("capture < 3")
    return psi.select_audio(packets(fx), es, es.filter("pid <> 261"), 2, True, maps).select("capture", "pid", "pkt_no")


@query("bad_track", "SELECT capture, COUNT(*) FILTER (cls = 'audio') AS audio_count, 2 > COUNT(*) FILTER (cls = 'audio') AS bad_track FROM fx_order_es_class GROUP BY 1")
def _(fx):
    return psi.bad_track(psi.psi_tables(sections(fx))["es"], 2)


@query("cas_mode", """WITH p AS (SELECT o_orderkey AS capture, CASE o_orderkey % 4 WHEN 0 THEN 9744 WHEN 1 THEN 9730 ELSE 1 END AS sys, o_custkey % 3 AS ecm, o_custkey % 5 AS emm,
 CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 0 END AS mode, o_orderstatus <> 'P' AS has_cat FROM orders)
SELECT capture, CASE WHEN sys = 9744 THEN 'biss-ca' WHEN sys = 9730 THEN 'biss1e' WHEN has_cat AND ecm <> 0 AND emm <> 0 AND mode <> 0 THEN 'classic' ELSE 'none' END AS cas_mode,
 CASE WHEN sys = 9744 THEN 'cissa' WHEN sys = 9730 THEN NULL WHEN has_cat AND ecm <> 0 AND emm <> 0 AND mode <> 0 THEN CASE mode WHEN 1 THEN 'csa' ELSE 'cissa' END END AS cipher FROM p""")
def _(fx):
    rows = fx.table("orders").selectExpr(
        "o_orderkey AS capture", "CASE o_orderkey % 4 WHEN 0 THEN 9744 WHEN 1 THEN 9730 ELSE 1 END AS pmt_ca_system_id", "o_custkey % 3 AS ecm_pid",
        "o_custkey % 5 AS emm_pid", "CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 0 END AS scrambling_mode", "o_orderstatus <> 'P' AS has_cat",
    )
    return psi.cas_mode(rows).select("capture", "cas_mode", "cipher")


@query("section_counts", """SELECT capture, CASE pid WHEN 256 THEN 'pat' WHEN 257 THEN 'pmt' ELSE 'other' END AS table_name, COUNT(*) FILTER (pkt_no % 7 > 0) AS sections,
 COUNT(*) FILTER (pkt_no % 7 = 0) AS errors FROM fx_packets GROUP BY 1, 2""")
def _(fx):
    return psi.section_counts(packets(fx).selectExpr("capture", "CASE pid WHEN 256 THEN 'pat' WHEN 257 THEN 'pmt' ELSE 'other' END AS table_name", "pkt_no % 7 AS size"))


@query("content_changes", """SELECT station, i, stream_title FROM (SELECT *, LAG(stream_title) OVER (PARTITION BY station ORDER BY i) AS p FROM fx_titles) z WHERE p IS NULL OR p <> stream_title""")
def _(fx):
    return psi.content_changes(fx.titles, ["station"], ["i"], F.col("stream_title"), True).select("station", "i", "stream_title")


@query("pmt_updates", """SELECT capture, pid, pkt_no FROM (SELECT *, LAG(tsc) OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS p FROM fx_packets) z WHERE p <> tsc""")
def _(fx):
    return psi.content_changes(packets(fx), ["capture", "pid"], ["pkt_no"], F.col("tsc"), False).select("capture", "pid", "pkt_no")


@query("table_version", """SELECT station, i, CAST(SUM(CASE WHEN p <> stream_title THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY i) % 32 AS INT) AS version
FROM (SELECT *, LAG(stream_title) OVER (PARTITION BY station ORDER BY i) AS p FROM fx_titles) z""")
def _(fx):
    return psi.table_version(fx.titles, ["station"], ["i"], F.col("stream_title")).select("station", "i", "version")


@query("ecm_activity", """WITH s AS (SELECT capture, pid, pkt_no, tsc, pus // 10000000 AS body FROM fx_packets),
e AS (SELECT *, LAG(body) OVER (PARTITION BY capture, pid, tsc ORDER BY pkt_no) AS pb FROM s WHERE tsc >= 2),
t AS (SELECT capture, COUNT(*) AS transitions FROM e WHERE pb IS NULL OR pb <> body GROUP BY 1)
SELECT s.capture, COUNT(*) FILTER (tsc >= 2) AS ecm, COUNT(*) FILTER (tsc < 2) AS emm, ANY_VALUE(transitions) AS transitions FROM s JOIN t ON s.capture = t.capture GROUP BY 1""")
def _(fx):
    s = packets(fx).selectExpr("capture", "pid", "pkt_no AS first_pkt_no", "if(tsc >= 2, 'ecm', 'emm') AS kind", "126 + tsc AS table_id", "cast(cast(arrival_us div 10000000 as string) as binary) AS bytes")
    return psi.ecm_activity(s)


@query("latest_emm", """WITH s AS (SELECT capture, pid, pkt_no, CASE WHEN pkt_no % 10 = 0 THEN -1 ELSE pid END AS svc, pus // 20000000 AS body FROM fx_packets),
c AS (SELECT *, LAG(body) OVER (PARTITION BY capture, svc ORDER BY pkt_no) AS pb FROM s),
g AS (SELECT capture, svc, COUNT(*) FILTER (pb IS NULL OR pb <> body) AS versions, COUNT(*) AS seen, MIN(pkt_no) AS since, arg_max(body, pkt_no) AS body FROM c GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture, svc >= 0 ORDER BY since) AS rk FROM g)
SELECT capture, CAST(svc AS INT) AS service_id, CASE WHEN svc < 0 OR rk <= 4 THEN versions ELSE 0 END AS versions, CASE WHEN svc < 0 OR rk <= 4 THEN 0 ELSE seen END AS dropped,
 CASE WHEN svc < 0 OR rk <= 4 THEN body END AS body FROM r""")
def _(fx):
    body = "lpad(hex(arrival_us div 20000000), 16, '0')"
    group = f"concat('820040', lpad(hex(pid), 4, '0'), {body}, repeat('00', 54))"
    unique = f"concat('820020', {body}, repeat('00', 10))"
    s = packets(fx).selectExpr("capture", "pkt_no AS first_pkt_no", f"unhex(if(pkt_no % 10 = 0, {unique}, {group})) AS bytes")
    out = psi.latest_emm(s, services=4)
    at = F.when(F.col("service_id") < 0, 4).otherwise(6)
    return out.select("capture", "service_id", "versions", "dropped", F.conv(F.hex(F.substring("bytes", at, F.lit(8))), 16, 10).cast("bigint").alias("body"))


@query("latest_event_sections", """WITH k AS (SELECT CAST(user_id AS INT) AS service_id, CAST(78 + event_id % 2 AS INT) AS table_id, CAST(floor(value) AS INT) % 32 AS section_number,
 arg_max(event_type, event_id) AS body FROM fx_base GROUP BY 1, 2, 3)
SELECT service_id, table_id, section_number, body, CAST(0 AS BIGINT) AS dropped FROM k""")
def _(fx):
    s = fx.base.selectExpr("CAST(user_id AS INT) AS service_id", "CAST(78 + event_id % 2 AS INT) AS table_id", "CAST(floor(value) AS INT) % 32 AS section_number", "event_id AS arrival", "event_type AS bytes")
    return psi.latest_event_sections(s).withColumnRenamed("bytes", "body")


@query("scan_report", """WITH n AS (SELECT l_orderkey AS c, COUNT(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), p AS (SELECT * FROM fx_order_programs WHERE capture % 13 <> 0)
SELECT n.c AS capture, CASE WHEN n.c % 11 = 0 THEN 'NONE' WHEN p.capture IS NULL THEN 'UNNAMED' ELSE 'NAMED' END AS kind, CASE WHEN n.c % 11 = 0 THEN 0 ELSE n END AS pkts, n.c % 3 = 0 AS rtp_wrapped, p.tsid,
 CASE WHEN service_name IS NOT NULL THEN 1 END AS onid, program_number AS sid, CASE WHEN p.capture IS NOT NULL THEN COALESCE(service_name, '(no SDT)') END AS name
FROM n LEFT JOIN p ON p.capture = n.c""")
def _(fx):
    """Every eleventh address gave datagrams but no packets, every thirteenth packets but no tables."""
    programs = psi.psi_tables(sections(fx).filter("capture % 13 <> 0"))["programs"]
    seen = fx.order_es.filter("capture % 11 <> 0").selectExpr("capture", "line AS pkt_no")
    datagrams = fx.order_es.selectExpr("capture", "line AS arrival", "capture % 3 = 0 AS rtp_wrapped")
    return psi.scan_report(seen, datagrams, programs)


def rewritten(fx: Fixtures) -> DataFrame:
    """Replacement packets of the orders' tables, without their application streams."""
    pk = table_packets(fx)
    starts = psi.section_starts(pk)
    t = psi.psi_tables(psi.sections_of_starts(starts))
    applications = t["es"].filter("cls = 'AIT'").groupBy("capture").agg(F.collect_set("pid").alias("pids"))
    return psi.rewrite_tables(pk, starts, t["pat"].filter("program_number <> 0"), applications)


@query("rewrite_tables", """WITH len AS (SELECT capture, COUNT(*) FILTER (variant <> 6) AS n, SUM(CASE variant WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 9 WHEN 4 THEN 7 WHEN 5 THEN 10 ELSE 0 END) AS d FROM fx_order_es GROUP BY 1)
SELECT p.capture, 0 AS pid, CAST(r.range * 1000 AS BIGINT) AS pkt_no, 16 AS size, TRUE AS crc_ok, CAST(r.range + 1 AS INT) AS cc FROM fx_order_programs p, range(2) r
UNION ALL SELECT p.capture, p.pmt_pid, CAST(r.range * 1000 + 200 AS BIGINT), CAST(16 + 5 * n + d AS INT), TRUE, CAST(r.range + 1 AS INT) FROM fx_order_programs p JOIN len ON p.capture = len.capture, range(2) r""")
def _(fx):
    out = rewritten(fx)
    section = F.expr("substring(pkt, 6, cast(conv(hex(substring(pkt, 7, 2)), 16, 10) as int) % 4096 + 3)")
    return out.select("capture", "pid", "pkt_no", F.octet_length(section).alias("size"), (psi.crc32_mpeg2(section) == 0).alias("crc_ok"), F.expr("cast(conv(hex(substring(pkt, 4, 1)), 16, 10) as int) % 16").alias("cc"))


@query("rewrite_tables_contents", """SELECT o.capture, p.program_number, p.pmt_pid, pid, stream_type, cls, codec, lang, CASE WHEN cls = 'teletext' THEN 188 END AS page, CASE WHEN cls = 'subtitle' THEN 1 END AS composition_page
 FROM fx_order_es_class o JOIN fx_order_programs p ON o.capture = p.capture WHERE cls <> 'AIT'""")
def _(fx):
    """The rewritten packets read again, tables and all: every stream is in them as it was, but for the dropped ones."""
    out = rewritten(fx)
    again = ts.ts_payload(ts.ts_header(cut_lineage(out.select("capture", "pkt_no", "pkt")))).select("capture", "pid", "pkt_no", "pusi", "payload")
    es = psi.tables_of_packets(again)["es"]
    return es.select("capture", "program_number", "pmt_pid", "pid", "stream_type", "cls", "codec", "lang", F.col("ttx.page").alias("page"), F.col("sub.composition_page").alias("composition_page"))
