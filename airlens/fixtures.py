"""Broadcast-shaped tables derived from the generic test tables, for the registered queries.

Every view grows with its input table. Packet time is compressed (30 days to about 259 s) so packet-scale
rules see realistic spacing. Sequence-like columns use the chunked scan, so no view needs a whole key in a task.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.binary import crc32_mpeg2, to_bytes
from airlens.functions.once import evaluate_once
from airlens.operators.ordered import RunningSum, row_number, scan

SECTION_CHARS = 1452


class Fixtures:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream of its files."""
        pattern = f"{self.folder}/{name}.parque[t]"  # a pattern may name one file; a plain path must be a folder
        return self.spark.readStream.schema(self.table(name).schema).parquet(pattern)

    @cached_property
    def base(self) -> DataFrame:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            "event_id", us.alias("us"), F.expr("unix_micros(cast(ts as timestamp)) div 10000").alias("pus"), "user_id", "event_type", "value"
        )

    @cached_property
    def packets(self) -> DataFrame:
        flat = self.base.selectExpr(
            "CAST(user_id % 4 AS INT) AS capture",
            "CAST(256 + event_id % 6 AS INT) AS pid",
            "event_id AS pkt_no",
            "pus",
            "CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END AS has_payload",
            "CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 1 ELSE 0 END AS disc",
            "CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS tsc",
            "(pus * 27 + CASE WHEN event_id % 53 = 0 THEN 99999999999 ELSE 0 END) % 2576980377600 AS pcr27",
        )
        counted = scan(flat, ["capture", "pid"], ["pkt_no"], n_pl=RunningSum(F.col("has_payload").cast("bigint")))
        return counted.selectExpr(
            "capture", "pid", "pkt_no", "pus", "has_payload", "disc", "tsc", "pcr27",
            "CAST((n_pl + CASE WHEN pkt_no % 97 = 0 THEN 3 ELSE 0 END) % 16 AS INT) AS cc",
        )

    @cached_property
    def es(self) -> DataFrame:
        return self.base.selectExpr("CAST(user_id % 4 AS INT) AS capture", "CAST(event_id % 6 AS INT) AS es_ordinal").distinct().selectExpr(
            "capture", "256 + es_ordinal AS pid", "es_ordinal",
            "CASE es_ordinal WHEN 0 THEN 'video' WHEN 3 THEN 'teletext' WHEN 5 THEN 'data' ELSE 'audio' END AS cls",
            "CASE es_ordinal WHEN 0 THEN 'h264' WHEN 1 THEN 'mp2' WHEN 2 THEN 'ac3' WHEN 4 THEN 'aac' ELSE 'none' END AS codec",
        )

    @cached_property
    def rtp(self) -> DataFrame:
        flat = self.base.selectExpr(
            "CAST(user_id % 10 AS INT) AS channel", "1000 + user_id % 10 AS ssrc", "event_id AS arrival", "pus",
            "((pus % 1000000000000) * 9 DIV 100) % 4294967296 AS rtp_ts",
            "CAST(188 * (1 + event_id % 7) AS INT) AS payload_len",
            "CASE WHEN event_id % 25 = 0 THEN 1 ELSE 0 END AS is_rap",
        )
        return row_number(flat, ["channel"], ["arrival"]).selectExpr(
            "channel", "ssrc", "arrival", "pus",
            "(65400 + rn + CASE WHEN arrival % 41 = 0 THEN 2 ELSE 0 END) % 65536 AS seq",
            "rtp_ts", "payload_len", "is_rap",
        )

    @cached_property
    def nacks(self) -> DataFrame:
        return self.base.filter("event_type = 'error'").selectExpr(
            "CAST(user_id % 10 AS INT) AS channel", "CONCAT('client-', CAST(user_id AS STRING)) AS session",
            "event_id AS arrival", "pus", "(65400 + event_id % 1000) % 65536 AS pid", "(event_id * 7919) % 65536 AS blp",
        )

    @cached_property
    def receivers(self) -> DataFrame:
        return self.base.selectExpr(
            "CAST(user_id % 5 AS INT) AS channel", "event_id AS arrival", "us", "5000 + user_id % 40 AS ssrc",
            "CONCAT('10.0.0.', CAST(event_id % 2 AS STRING)) AS addr",
            "CASE WHEN event_type IN ('click', 'view') THEN CONCAT('cn', CAST(event_id % 3 AS STRING)) END AS cname",
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.base.selectExpr(
            "event_type AS component", "CONCAT('inst-', CAST(user_id AS STRING)) AS metrics_id", "event_id AS arrival",
            "us AS recv_us", "(us - 1704067200000000) DIV 864000000000 AS process_start",
            "CASE WHEN event_id % 13 = 0 THEN event_id - 500 ELSE event_id END AS sequence",
            "CAST(1 + event_id % 5 AS INT) AS id", "CAST(round(value * 100) AS BIGINT) AS val",
        )

    @cached_property
    def channels(self) -> DataFrame:
        # every tenth bears an id and names that nothing else knows
        return self.table("customer").selectExpr(
            "c_custkey AS ord", "CONCAT(IF(c_custkey % 10 = 9, 'off_', 'ch_'), CAST(c_custkey AS STRING)) AS id",
            "ARRAY(CONCAT(IF(c_custkey % 10 = 9, 'off ', ''), lower(c_name)), CONCAT(IF(c_custkey % 10 = 9, 'Off ', 'Channel '), CAST(c_custkey AS STRING))) AS names",
        )

    @cached_property
    def services(self) -> DataFrame:
        # every fourth bears a name that no channel has
        return self.table("customer").selectExpr(
            "c_custkey AS ord",
            "CASE c_custkey % 4 WHEN 1 THEN CONCAT('Channel ', CAST(c_custkey AS STRING), ' HD') WHEN 3 THEN CONCAT('Spare ', CAST(c_custkey AS STRING)) ELSE c_name END AS name",
            "CONCAT('rtp://239.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey DIV 250 % 250 AS STRING), '.', CAST(c_custkey % 250 + 1 AS STRING),"
            " ':', CAST(5000 + c_custkey % 1000 AS STRING)) AS uri",
            "1 AS tsid", "c_nationkey AS onid", "CAST(c_custkey % 60000 + 100 AS INT) AS sid",
        )

    @cached_property
    def mapping(self) -> DataFrame:
        """Every third line names a channel that is not there."""
        return self.table("customer").selectExpr(
            "c_custkey AS ord", "CONCAT(CASE WHEN c_custkey % 3 = 0 THEN 'gone_' ELSE 'ch_' END, CAST(c_custkey AS STRING)) AS id",
            "CONCAT('rtp://239.1.', CAST(c_custkey DIV 250 % 250 AS STRING), '.', CAST(c_custkey % 250 + 1 AS STRING), ':5000') AS uri",
            "1 AS tsid", "2 AS onid", "CAST(c_custkey % 60000 + 100 AS INT) AS sid",
        )

    @cached_property
    def programmes(self) -> DataFrame:
        return self.base.selectExpr(
            "event_id AS ord", "CONCAT('ch_', CAST(user_id AS STRING)) AS channel_id", "us DIV 60000000 AS start_min",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE us DIV 60000000 + CAST(floor(value) AS BIGINT) END AS stop_min",
            "event_type AS category",
        )

    @cached_property
    def doc_sections(self) -> DataFrame:
        """Whole documents in sections; of every fifth some sections are lost, which is what the assembly has to notice."""
        docs = self.table("documents").filter("length(text) > 0").selectExpr(
            "doc_id", "text", f"(length(text) - 1) DIV {SECTION_CHARS} AS last_sec"
        )
        cut = docs.withColumn("sec", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_sec")))
        return cut.filter("doc_id % 5 <> 0 OR (doc_id + sec) % 11 <> 0").selectExpr(
            "doc_id AS segment_id", "2 AS payload_id", "CAST(doc_id % 4 AS INT) AS version",
            "CAST(sec AS INT) AS section_number", "CAST(last_sec AS INT) AS last_section_number",
            f"substr(text, CAST(sec * {SECTION_CHARS} + 1 AS INT), {SECTION_CHARS}) AS payload",
            "doc_id * 1000 + sec AS arrival",
        )

    @cached_property
    def text_rows(self) -> DataFrame:
        return self.base.selectExpr(
            "CAST(user_id % 3 AS INT) AS capture", "event_id AS i", "pus DIV 1000 AS ts_ms", "event_type AS text"
        )

    @cached_property
    def titles(self) -> DataFrame:
        return self.base.selectExpr(
            "CAST(user_id % 6 AS INT) AS station", "event_id AS i", "pus",
            "CASE WHEN event_id % 9 = 0 THEN event_type ELSE CONCAT('Artist ', CAST(user_id % 2 AS STRING), ' - ', event_type) END AS stream_title",
        )

    # Orders as captures: one program per order whose streams are its lines; sections and packets as real bytes.

    @cached_property
    def order_es(self) -> DataFrame:
        # dealt by order at once: all that follows groups and joins by it
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
        lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
        return lines.selectExpr("l_orderkey AS capture", "l_linenumber AS line", "256 + l_linenumber AS pid", "CAST(part % 7 AS INT) AS variant")

    @cached_property
    def order_sections(self) -> DataFrame:
        desc = {1: "0A04656E6700", 2: "0A04656E6700", 3: "6A01000A04656E6700", 4: "5605656E671188", 5: "5908656E671000010002", 6: "6F03000000"}
        types = {0: "1B", 1: "03", 2: "0F", 3: "06", 4: "06", 5: "06", 6: "05"}
        pick = lambda table: "CASE variant " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " ELSE '' END"
        entry = self.order_es.selectExpr("capture", "line", "pid", f"{pick(types)} AS t", f"{pick(desc)} AS d").selectExpr(
            "capture", "line", "pid", "concat(t, lpad(hex(57344 + pid), 4, '0'), lpad(hex(61440 + length(d) div 2), 4, '0'), d) AS entry"
        )
        loops = entry.groupBy("capture").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "entry"))), lambda e: e["entry"]), "").alias("loop"),
            F.min("pid").alias("pcr_pid"),
        )
        orders = self.table("orders").selectExpr(
            "o_orderkey AS capture", "CAST(1 + o_orderkey % 60000 AS INT) AS program", "CAST(4096 + o_orderkey % 1000 AS INT) AS pmt_pid",
            "CAST(o_custkey % 65536 AS INT) AS tsid", "concat('Service ', o_custkey) AS name", "o_orderpriority AS provider",
            "o_orderkey % 5 <> 0 AS has_sdt", "o_orderkey % 2 = 0 AS has_nit",
        )
        both = orders.join(loops, "capture")
        hex4 = lambda e: f"lpad(hex({e}), 4, '0')"
        ascii_ = lambda e: f"concat(lpad(hex(length({e})), 2, '0'), hex({e}))"
        bodies = both.selectExpr(
            "capture", "pmt_pid",
            f"concat({hex4('tsid')}, 'C10000', if(has_nit, '0000E010', ''), {hex4('program')}, {hex4('57344 + pmt_pid')}) AS pat",
            f"concat({hex4('program')}, 'C10000', {hex4('57344 + pcr_pid')}, 'F000', loop) AS pmt",
            f"if(has_sdt, concat({hex4('tsid')}, 'C10000', '0001FF', {hex4('program')}, 'FC', {hex4('32768 + 5 + length(name) + length(provider)')},"
            f" '48', lpad(hex(3 + length(name) + length(provider)), 2, '0'), '01', {ascii_('provider')}, {ascii_('name')}), NULL) AS sdt",
        )
        rows = bodies.select("capture", F.explode(F.array(
            F.struct(F.lit(0).alias("pid"), F.lit("00").alias("tid"), F.col("pat").alias("body"), F.lit(0).cast("bigint").alias("pkt_no")),
            F.struct(F.lit(17).alias("pid"), F.lit("42").alias("tid"), F.col("sdt").alias("body"), F.lit(1).cast("bigint").alias("pkt_no")),
            F.struct(F.col("pmt_pid").alias("pid"), F.lit("02").alias("tid"), F.col("pmt").alias("body"), F.lit(2).cast("bigint").alias("pkt_no")),
        )).alias("s")).filter("s.body IS NOT NULL").select("capture", "s.*")
        head = F.unhex(F.concat(F.col("tid"), F.expr("lpad(hex(45056 + length(body) div 2 + 4), 4, '0')"), F.col("body")))
        body = evaluate_once(rows.select("capture", "pid", "pkt_no", head.alias("bytes")), "bytes", F.col("bytes"))
        return evaluate_once(body, "bytes", F.concat("bytes", to_bytes(crc32_mpeg2(F.col("bytes")), 4)))

    @cached_property
    def order_packets(self) -> DataFrame:
        """Each section repeated twice, cut into 188-byte packets of 184 payload bytes."""
        twice = self.order_sections.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
        framed = twice.withColumn("data", F.concat(F.unhex(F.lit("00")), F.col("bytes")))
        cut = framed.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr("(octet_length(data) - 1) div 184"))))
        chunk = F.expr("substring(data, part * 184 + 1, 184)")
        pad = F.unhex(F.repeat(F.lit("FF"), 184 - F.octet_length("chunk")))
        head = F.concat(F.unhex(F.lit("47")), to_bytes(F.col("pid") + F.when(F.col("part") == 0, 0x4000).otherwise(0), 2), to_bytes(F.lit(0x10) + F.col("part") % 16, 1))
        built = cut.withColumn("chunk", chunk).select(
            "capture", "pid", F.expr("repeat * 1000 + pkt_no * 100 + part").alias("pkt_no"), F.concat(head, "chunk", pad).alias("pkt")
        )
        return evaluate_once(built, "pkt", F.col("pkt"))


# The same views for the comparison SQL (DuckDB dialect).
VIEW_SQL = {
    "fx_base": "SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 10000 AS pus, user_id, event_type, value FROM events",
    "fx_packets": """SELECT capture, pid, pkt_no, pus, has_payload, disc, tsc, pcr27,
  CAST((n_pl + CASE WHEN pkt_no % 97 = 0 THEN 3 ELSE 0 END) % 16 AS INT) AS cc
FROM (SELECT CAST(user_id % 4 AS INT) AS capture, CAST(256 + event_id % 6 AS INT) AS pid, event_id AS pkt_no, pus,
    CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END AS has_payload,
    CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 1 ELSE 0 END AS disc,
    CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS tsc,
    (pus * 27 + CASE WHEN event_id % 53 = 0 THEN 99999999999 ELSE 0 END) % 2576980377600 AS pcr27,
    SUM(CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 4, event_id % 6 ORDER BY event_id) AS n_pl
  FROM fx_base) z""",
    "fx_es": """SELECT CAST(c AS INT) AS capture, CAST(256 + i AS INT) AS pid, CAST(i AS INT) AS es_ordinal,
  CASE i WHEN 0 THEN 'video' WHEN 3 THEN 'teletext' WHEN 5 THEN 'data' ELSE 'audio' END AS cls,
  CASE i WHEN 0 THEN 'h264' WHEN 1 THEN 'mp2' WHEN 2 THEN 'ac3' WHEN 4 THEN 'aac' ELSE 'none' END AS codec
FROM (SELECT DISTINCT user_id % 4 AS c, event_id % 6 AS i FROM fx_base) z""",
    "fx_rtp": """SELECT CAST(user_id % 10 AS INT) AS channel, 1000 + user_id % 10 AS ssrc, event_id AS arrival, pus,
  (65400 + ROW_NUMBER() OVER (PARTITION BY user_id % 10 ORDER BY event_id) + CASE WHEN event_id % 41 = 0 THEN 2 ELSE 0 END) % 65536 AS seq,
  ((pus % 1000000000000) * 9 // 100) % 4294967296 AS rtp_ts,
  CAST(188 * (1 + event_id % 7) AS INT) AS payload_len,
  CASE WHEN event_id % 25 = 0 THEN 1 ELSE 0 END AS is_rap FROM fx_base""",
    "fx_nacks": """SELECT CAST(user_id % 10 AS INT) AS channel, CONCAT('client-', CAST(user_id AS VARCHAR)) AS session, event_id AS arrival, pus,
  (65400 + event_id % 1000) % 65536 AS pid, (event_id * 7919) % 65536 AS blp FROM fx_base WHERE event_type = 'error'""",
    "fx_receivers": """SELECT CAST(user_id % 5 AS INT) AS channel, event_id AS arrival, us, 5000 + user_id % 40 AS ssrc,
  CONCAT('10.0.0.', CAST(event_id % 2 AS VARCHAR)) AS addr,
  CASE WHEN event_type IN ('click', 'view') THEN CONCAT('cn', CAST(event_id % 3 AS VARCHAR)) END AS cname FROM fx_base""",
    "fx_snapshots": """SELECT event_type AS component, CONCAT('inst-', CAST(user_id AS VARCHAR)) AS metrics_id, event_id AS arrival, us AS recv_us,
  (us - 1704067200000000) // 864000000000 AS process_start,
  CASE WHEN event_id % 13 = 0 THEN event_id - 500 ELSE event_id END AS sequence,
  CAST(1 + event_id % 5 AS INT) AS id, CAST(round(value * 100) AS BIGINT) AS val FROM fx_base""",
    "fx_channels": """SELECT c_custkey AS ord, CONCAT(CASE WHEN c_custkey % 10 = 9 THEN 'off_' ELSE 'ch_' END, CAST(c_custkey AS VARCHAR)) AS id,
  CONCAT(CASE WHEN c_custkey % 10 = 9 THEN 'off ' ELSE '' END, lower(c_name)) AS name1,
  CONCAT(CASE WHEN c_custkey % 10 = 9 THEN 'Off ' ELSE 'Channel ' END, CAST(c_custkey AS VARCHAR)) AS name2 FROM customer""",
    "fx_services": """SELECT c_custkey AS ord,
  CASE c_custkey % 4 WHEN 1 THEN CONCAT('Channel ', CAST(c_custkey AS VARCHAR), ' HD') WHEN 3 THEN CONCAT('Spare ', CAST(c_custkey AS VARCHAR)) ELSE c_name END AS name,
  CONCAT('rtp://239.', CAST(c_nationkey AS VARCHAR), '.', CAST(c_custkey // 250 % 250 AS VARCHAR), '.', CAST(c_custkey % 250 + 1 AS VARCHAR),
   ':', CAST(5000 + c_custkey % 1000 AS VARCHAR)) AS uri,
  1 AS tsid, c_nationkey AS onid, CAST(c_custkey % 60000 + 100 AS INT) AS sid FROM customer""",
    "fx_mapping": """SELECT c_custkey AS ord, CONCAT(CASE WHEN c_custkey % 3 = 0 THEN 'gone_' ELSE 'ch_' END, CAST(c_custkey AS VARCHAR)) AS id,
  CONCAT('rtp://239.1.', CAST(c_custkey // 250 % 250 AS VARCHAR), '.', CAST(c_custkey % 250 + 1 AS VARCHAR), ':5000') AS uri,
  1 AS tsid, 2 AS onid, CAST(c_custkey % 60000 + 100 AS INT) AS sid FROM customer""",
    "fx_programmes": """SELECT event_id AS ord, CONCAT('ch_', CAST(user_id AS VARCHAR)) AS channel_id, us // 60000000 AS start_min,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE us // 60000000 + CAST(floor(value) AS BIGINT) END AS stop_min,
  event_type AS category FROM fx_base""",
    "fx_doc_sections": f"""SELECT doc_id AS segment_id, 2 AS payload_id, CAST(doc_id % 4 AS INT) AS version, CAST(sec AS INT) AS section_number,
  CAST((length(text) - 1) // {SECTION_CHARS} AS INT) AS last_section_number,
  substr(text, CAST(sec * {SECTION_CHARS} + 1 AS INT), {SECTION_CHARS}) AS payload, doc_id * 1000 + sec AS arrival
FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // {SECTION_CHARS} + 1)) AS sec FROM documents WHERE length(text) > 0) z
WHERE doc_id % 5 <> 0 OR (doc_id + sec) % 11 <> 0""",
    "fx_text_rows": "SELECT CAST(user_id % 3 AS INT) AS capture, event_id AS i, pus // 1000 AS ts_ms, event_type AS text FROM fx_base",
    "fx_order_es": """SELECT l_orderkey AS capture, l_linenumber AS line, 256 + l_linenumber AS pid, CAST(MAX(l_partkey) % 7 AS INT) AS variant,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS es_ordinal FROM lineitem GROUP BY 1, 2""",
    "fx_order_es_class": """SELECT *, CASE variant WHEN 0 THEN 27 WHEN 1 THEN 3 WHEN 2 THEN 15 WHEN 6 THEN 5 ELSE 6 END AS stream_type,
  CASE variant WHEN 0 THEN 'video' WHEN 4 THEN 'teletext' WHEN 5 THEN 'subtitle' WHEN 6 THEN 'AIT' ELSE 'audio' END AS cls,
  CASE variant WHEN 0 THEN 'h264' WHEN 1 THEN 'mp2' WHEN 2 THEN 'aac' WHEN 3 THEN 'ac3' ELSE 'none' END AS codec,
  CASE WHEN variant IN (1, 2, 3, 5) THEN 'eng' END AS lang FROM fx_order_es""",
    "fx_order_programs": """SELECT o_orderkey AS capture, CAST(o_custkey % 65536 AS INT) AS tsid, CAST(1 + o_orderkey % 60000 AS INT) AS program_number,
  CAST(4096 + o_orderkey % 1000 AS INT) AS pmt_pid, CASE WHEN o_orderkey % 5 <> 0 THEN CONCAT('Service ', o_custkey) END AS service_name,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS provider_name
 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "fx_titles": """SELECT CAST(user_id % 6 AS INT) AS station, event_id AS i, pus,
  CASE WHEN event_id % 9 = 0 THEN event_type ELSE CONCAT('Artist ', CAST(user_id % 2 AS VARCHAR), ' - ', event_type) END AS stream_title FROM fx_base""",
}
