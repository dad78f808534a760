"""Streaming queries: rows are replayed as micro-batches with an end, and the table they were written to is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.fixtures import Fixtures
from airlens.functions.binary import crc32_mpeg2
from airlens.plans.guides import CUES
from airlens.plans.packets import packets
from airlens.plans.registry import query
from airlens.plans.streams import EXACT_RATE, REPAIRED, repair_rows
from airlens.session import checkpoint_root
from airlens.streaming import operators as st

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
FILES = 4


def replay(rows: DataFrame, closing: DataFrame, operate: Callable[[DataFrame], DataFrame], mode: str = "append", *, order: str, batches: int = 3) -> DataFrame:
    """What ``operate`` makes of ``rows`` as a stream: micro-batches in the order of the integer column ``order``, then the
    ``closing`` rows, one that ends each key or one so late that all windows close. Everything lies in the shared folder."""
    spark = rows.sparkSession
    root = f"{checkpoint_root(spark)}/live-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.lit(batches - 1), F.expr(f"(`{order}` - {low or 0}) div {(high or 0) // batches - (low or 0) // batches + 1}"))
    held = rows.withColumn("__part", part)
    held.write.partitionBy("__part").parquet(f"{root}/rows")
    held = spark.read.schema(held.schema).parquet(f"{root}/rows")
    for one in [*(held.where(F.col("__part") == i).drop("__part") for i in range(batches)), closing.select(rows.columns)]:
        one.repartition(FILES).write.mode("append").parquet(f"{root}/in")  # files are taken by age
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/in")
    result = operate(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        run = result.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    run.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/out").select(result.columns)


def live(name: str, oracle: str | None, order: str, last: tuple[str, ...] = ()):
    """Register a query whose function gives the rows, their closing rows and the operator. Of rows that replace each other
    those that are ``last`` for these keys are the result."""

    def decorate(fn: Callable[[Fixtures], tuple[DataFrame, DataFrame, Callable]]):
        def run(fx: Fixtures) -> DataFrame:
            found = replay(*fn(fx), order=order)
            return found.groupBy(*last).agg(F.max_by(F.struct(*found.columns), order).alias("r")).select("r.*") if last else found

        query(name, oracle)(run)
        return fn

    return decorate


def closed(rows: DataFrame, keys: list[str], **later: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``ends`` false, and for each key a row with ``ends`` true: its last one with the columns of ``later``
    (expressions over it) changed."""
    open_ = rows.withColumn("ends", F.lit(False))
    order = next(iter(later))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return open_, last.withColumns({c: F.expr(e).cast(rows.schema[c].dataType) for c, e in later.items()}).withColumn("ends", F.lit(True))


def far(rows: DataFrame, time: str, order: str) -> DataFrame:
    """One row a day after all others: the watermark passes every end."""
    return rows.orderBy(F.desc(order)).limit(1).withColumn(time, F.col(time) + 86_400_000_000)


@live(
    "metric_store_stream",
    """WITH RECURSIVE s AS (SELECT event_type AS component, CONCAT('inst-', user_id) AS metrics_id, event_id AS arrival, us AS recv_us, (us - 1704067200000000) // 864000000000 AS process_start,
 CASE WHEN event_id % 13 = 0 THEN event_id - 500 ELSE event_id END AS sequence FROM fx_base),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY component, metrics_id ORDER BY recv_us, arrival) AS rn FROM s),
f AS (SELECT component, metrics_id, rn, true AS accepted, NULL::STRUCT(arrival BIGINT, process_start BIGINT, sequence BIGINT, recv_us BIGINT) AS gone,
 {'arrival': arrival, 'process_start': process_start, 'sequence': sequence, 'recv_us': recv_us} AS held FROM n WHERE rn = 1
UNION ALL SELECT n.component, n.metrics_id, n.rn, e.gone OR n.process_start <> held.process_start OR n.sequence > held.sequence, CASE WHEN e.gone THEN held END,
 CASE WHEN e.gone OR n.process_start <> held.process_start OR n.sequence > held.sequence THEN {'arrival': n.arrival, 'process_start': n.process_start, 'sequence': n.sequence, 'recv_us': n.recv_us} ELSE held END
 FROM f JOIN n ON n.component = f.component AND n.metrics_id = f.metrics_id AND n.rn = f.rn + 1, LATERAL (SELECT n.recv_us - held.recv_us > 86400000000 AS gone) e),
o AS (SELECT component, metrics_id, 'accepted' AS event, held AS r FROM f WHERE accepted
UNION ALL SELECT component, metrics_id, 'expired', gone FROM f WHERE gone IS NOT NULL
UNION ALL SELECT component, metrics_id, 'expired', arg_max(held, rn) FROM f GROUP BY 1, 2)
SELECT component, metrics_id, event, r.arrival, r.process_start, r.sequence, r.recv_us FROM o""",
    "recv_us",
)
def _(fx):
    rows = fx.base.selectExpr(
        "event_type AS component", "concat('inst-', user_id) AS metrics_id", "event_id AS arrival", "us AS recv_us",
        "(us - 1704067200000000) div 864000000000 AS process_start", "if(event_id % 13 = 0, event_id - 500, event_id) AS sequence",
    )
    late = rows.agg(F.max("recv_us")).first()[0] or 0  # the end is a day and more after the last row
    return *closed(rows, ["component", "metrics_id"], arrival="arrival + 1000000000", recv_us=f"{late} + 100000000000"), lambda s: st.metric_store(s, 86_400)


@live("rtp_repair_stream", f"WITH RECURSIVE {REPAIRED} SELECT channel, run, seq, source FROM repaired", "arrival")
def _(fx):
    return *closed(repair_rows(fx), ["channel"], arrival="arrival + 1000000000", arrival_us="arrival_us + 10000000"), st.rtp_repair


@live(
    "doc_reassembly_stream",
    """WITH d AS (SELECT payload_id, segment_id, version, last_section_number, string_agg(payload, '' ORDER BY section_number) AS document FROM fx_doc_sections
GROUP BY payload_id, segment_id, version, last_section_number HAVING COUNT(*) = last_section_number + 1)
SELECT payload_id, segment_id, version, CAST(length(document) AS INT) AS size, sha256(document) AS sha FROM d WHERE segment_id % 7 <> 0""",
    "arrival",
)
def _(fx):
    """Binary sections, the last one with the checksum of its document, which is wrong for every seventh document."""
    cut = fx.doc_sections.withColumn("payload", F.encode("payload", "UTF-8"))
    crc = fx.table("documents").filter("length(text) > 0").select(F.col("doc_id").alias("segment_id"), crc32_mpeg2(F.encode("text", "UTF-8")).alias("crc"))
    wrong = F.when(F.col("segment_id") % 7 == 0, F.expr("crc ^ 1")).otherwise(F.col("crc"))
    last = F.col("section_number") == F.col("last_section_number")
    rows = cut.join(crc, "segment_id").withColumn("crc_present", last).withColumn("crc", F.when(last, wrong))
    facts = ("payload_id", "segment_id", "version", "octet_length(document) AS octets", "length(decode(document, 'UTF-8')) AS size", "sha2(document, 256) AS sha")
    return rows, rows.limit(0), lambda s: st.doc_reassembly(s).selectExpr(*facts).drop("octets")


def rates(fx: Fixtures) -> DataFrame:
    return fx.rtp.selectExpr("channel", "arrival", "pus AS arrival_us", "payload_len")


@live("bitrate_stream", "SELECT channel, pus // 2000000 * 2000000 AS window_us, CAST(SUM(payload_len) * 8 AS BIGINT) AS bits FROM fx_rtp GROUP BY 1, 2", "arrival")
def _(fx):
    return rates(fx), far(rates(fx), "arrival_us", "arrival"), st.bitrate_stream


@live("bitrate_stream_exact", f"WITH RECURSIVE {EXACT_RATE} SELECT channel, open_s, close_s, bytes, bytes * 8 / (close_s - open_s) AS bps FROM r", "arrival")
def _(fx):
    return rates(fx), rates(fx).limit(0), st.bitrate_stream_exact


@live(
    "channel_activity_stream",
    """WITH f AS (SELECT *, CASE WHEN pus - LAG(pus) OVER (PARTITION BY channel ORDER BY arrival) > 500000 THEN 1 ELSE 0 END AS s FROM fx_rtp),
n AS (SELECT *, SUM(s) OVER (PARTITION BY channel ORDER BY arrival) AS g FROM f)
SELECT channel, MIN(pus) AS first_us, MAX(pus) AS last_us, COUNT(*) AS rows FROM n GROUP BY channel, g""",
    "arrival",
)
def _(fx):
    return rates(fx), far(rates(fx), "arrival_us", "arrival"), lambda s: st.activity_stream(s, ["channel"], "arrival_us", 500_000)


@live(
    "client_session_stream",
    """WITH f AS (SELECT *, CASE WHEN us - LAG(us) OVER (PARTITION BY channel, ssrc ORDER BY arrival) > 300000000 THEN 1 ELSE 0 END AS s FROM fx_receivers),
n AS (SELECT *, SUM(s) OVER (PARTITION BY channel, ssrc ORDER BY arrival) AS g FROM f)
SELECT channel, ssrc, MIN(us) AS first_us, MAX(us) AS last_us, COUNT(*) AS rows FROM n GROUP BY channel, ssrc, g""",
    "arrival",
)
def _(fx):
    rows = fx.receivers.select("channel", "ssrc", "us", "arrival")
    return rows, far(rows, "us", "arrival"), lambda s: st.activity_stream(s, ["channel", "ssrc"], "us", 300_000_000)


@live(
    "integrity_stream",
    """WITH l AS (SELECT *, LAG(cc) OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS pc FROM fx_packets WHERE has_payload = 1),
e AS (SELECT capture, pid, COUNT(*) FILTER (pc IS NOT NULL AND disc = 0 AND cc <> (pc + 1) % 16) AS continuity_errors FROM l GROUP BY 1, 2),
p0 AS (SELECT *, LAG(pcr27) OVER w AS lp, LAG(pus) OVER w AS lu FROM fx_packets WINDOW w AS (PARTITION BY capture, pid ORDER BY pkt_no)),
p1 AS (SELECT *, (pcr27 - lp + 2576980377600) % 2576980377600 AS d, (pus - lu) * 27 AS w FROM p0),
t AS (SELECT capture, pid, MAX(pkt_no) AS pkt_no, COUNT(*) AS packets, CAST(SUM(disc) AS BIGINT) AS discontinuities,
 COUNT(*) FILTER (lp IS NOT NULL AND NOT (w > 0 AND d > 0 AND d < 60 * 27000000 AND d < w * 5 + 13500000 AND d * 10 > w * 2 - 27000000)) AS pcr_discontinuities FROM p1 GROUP BY 1, 2)
SELECT t.capture, t.pid, pkt_no, packets, COALESCE(continuity_errors, 0) AS continuity_errors, discontinuities, pcr_discontinuities FROM t LEFT JOIN e ON t.capture = e.capture AND t.pid = e.pid""",
    "pkt_no",
    ("capture", "pid"),
)
def _(fx):
    rows = packets(fx).select("capture", "pid", "pkt_no", "arrival_us", "has_payload", "disc", "cc", "pcr27")
    return rows, rows.limit(0), st.integrity_stream, "update"


SEEN = """e AS (SELECT user_id AS capture, us, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k, CASE event_type WHEN 'signup' THEN 'pat' WHEN 'view' THEN 'pmt' ELSE 'sdt' END AS kind,
 CAST(1 + event_id % 3 AS INT) AS n, CAST(100 + event_id % 3 AS INT) AS pid, CONCAT('Service ', event_id % 3) AS name FROM fx_base),
lim AS (SELECT capture, MIN(us) + 864000000000 AS t FROM e GROUP BY 1), i AS (SELECT e.* FROM e JOIN lim ON e.capture = lim.capture WHERE us - 1 < t),
p AS (SELECT capture, n, MIN(k) AS pat, MIN(pid) AS pid FROM i WHERE kind = 'pat' GROUP BY 1, 2),
r AS (SELECT p.capture, p.n, p.pid, pat, MIN(k) FILTER (kind = 'pmt') AS pmt, MIN(k) FILTER (kind = 'sdt') AS sdt FROM p LEFT JOIN i ON i.capture = p.capture AND i.n = p.n AND k > pat GROUP BY 1, 2, 3, 4),
c AS (SELECT i.capture, i.k, COUNT(r.n) AS known, COUNT(r.n) FILTER (GREATEST(pmt, sdt) <= i.k AND pmt IS NOT NULL AND sdt IS NOT NULL) AS ready FROM i LEFT JOIN r ON r.capture = i.capture AND r.pat <= i.k GROUP BY 1, 2),
d AS (SELECT capture, MIN(k) AS k FROM c WHERE known > 0 AND known = ready GROUP BY 1)"""


@live(
    "service_discovery_stream",
    f"""WITH {SEEN} SELECT r.capture, CASE WHEN d.k IS NULL THEN 'timeout' ELSE 'complete' END AS outcome, r.n AS program_number, r.pid AS pmt_pid, COALESCE(r.pmt <= COALESCE(d.k, r.pmt), false) AS resolved,
 (SELECT arg_max(i.name, i.k) FROM i WHERE i.capture = r.capture AND i.n = r.n AND i.kind = 'sdt' AND i.k > r.pat AND i.k <= COALESCE(d.k, i.k)) AS service_name
FROM r LEFT JOIN d ON d.capture = r.capture WHERE d.k IS NULL OR r.pat <= d.k""",
    "us",
)
def _(fx):
    rows = fx.base.selectExpr(
        "user_id AS capture", "us", "event_id AS ord", "case event_type when 'signup' then 'pat' when 'view' then 'pmt' else 'sdt' end AS kind",
        "cast(1 + event_id % 3 as int) AS program_number", "cast(100 + event_id % 3 as int) AS pmt_pid", "concat('Service ', event_id % 3) AS service_name",
    )
    return *closed(rows, ["capture"], us="us + 1", ord="ord + 1000000000"), lambda s: st.service_discovery(s, 864_000)


@live("dedupe_segments_stream", "SELECT DISTINCT 2 AS payload_id, user_id AS segment_id, event_id % 4 AS version FROM fx_base", "arrival")
def _(fx):
    rows = fx.base.selectExpr("2 AS payload_id", "user_id AS segment_id", "event_id % 4 AS version", "us AS arrival_us", "event_id AS arrival")
    return rows, rows.limit(0), lambda s: st.dedupe_segments(s, horizon="40 days").drop("arrival_us", "arrival")


@live("cue_stream", f"WITH {CUES} SELECT * FROM cues", "i")
def _(fx):
    return *closed(fx.text_rows, ["capture"], i="i + 1000000000", ts_ms="ts_ms + 1"), lambda s: st.cue_stream(s, 100)
