"""Queries over transport-stream packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.fixtures import Fixtures
from airlens.functions.binary import to_bytes
from airlens.functions.once import evaluate_once
from airlens.operators import ts
from airlens.operators.greedy import throttle
from airlens.plans.registry import query


def packets(fx: Fixtures) -> DataFrame:
    return fx.packets.withColumnRenamed("pus", "arrival_us")


def raw_packets(fx: Fixtures) -> DataFrame:
    """The packet view as real 188-byte packets: adaptation field with flags and clock, then padding payload."""
    base = F.expr("pcr27 DIV 300")
    ext = F.expr("pcr27 % 300")
    # afc 3 (field + payload) or 2 (field only); 7-byte field: flags, 6 clock bytes
    b1 = to_bytes(F.col("pid").cast("bigint") + F.when(F.col("pkt_no") % 5 == 0, 0x4000).otherwise(0), 2)
    b3 = F.col("tsc") * 64 + F.when(F.col("has_payload") == 1, 0x30).otherwise(0x20) + F.col("cc")
    flags = F.col("disc") * 128 + F.when(F.col("pkt_no") % 25 == 0, 0x40).otherwise(0) + F.lit(0x10)
    clock = F.concat(
        to_bytes(F.shiftright(base, 1), 4),
        to_bytes((base % 2) * 128 + F.lit(0x7E) + F.expr("(pcr27 % 300) DIV 256"), 1),
        to_bytes(ext % 256, 1),
    )
    pkt = F.concat(F.unhex(F.lit("47")), b1, to_bytes(b3, 1), F.unhex(F.lit("07")), to_bytes(flags, 1), clock, to_bytes(F.col("pkt_no"), 8), F.unhex(F.repeat(F.lit("FF"), 168)))
    return evaluate_once(packets(fx), "pkt", pkt)


CC_SQL = """prev AS (SELECT *, LAG(cc) OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS prev_cc FROM fx_packets WHERE has_payload = 1),
cc AS (SELECT *, CASE WHEN prev_cc IS NOT NULL AND disc = 0 AND cc <> (prev_cc + 1) % 16 THEN 1 ELSE 0 END AS cc_error FROM prev)"""

PCR_SQL = """p0 AS (SELECT *, LAG(pcr27) OVER (PARTITION BY capture ORDER BY pkt_no) AS lp, LAG(pus) OVER (PARTITION BY capture ORDER BY pkt_no) AS lu FROM fx_packets),
p1 AS (SELECT *, (pcr27 - lp + 2576980377600) % 2576980377600 AS d, (pus - lu) * 27 AS w FROM p0),
pcr AS (SELECT *, CASE WHEN lp IS NULL OR (w > 0 AND d > 0 AND d < 60 * 27000000 AND d < w * 5 + 13500000 AND d * 10 > w * 2 - 27000000) THEN 0 ELSE 1 END AS pcr_jump FROM p1)"""


@query(
    "ts_integrity",
    f"""WITH {CC_SQL}, {PCR_SQL},
t AS (SELECT capture, COUNT(*) AS packets, CAST(SUM(disc) AS BIGINT) AS discontinuities FROM fx_packets GROUP BY 1),
c AS (SELECT capture, CAST(SUM(cc_error) AS BIGINT) AS continuity_errors FROM cc GROUP BY 1),
j AS (SELECT capture, CAST(SUM(pcr_jump) AS BIGINT) AS pcr_discontinuities FROM pcr GROUP BY 1)
SELECT t.capture, packets, CAST(0 AS BIGINT) AS sync_errors, continuity_errors, discontinuities, pcr_discontinuities
FROM t JOIN c USING (capture) JOIN j USING (capture)""",
)
def _(fx):
    return ts.ts_integrity(packets(fx))


@query("continuity_errors", f"WITH {CC_SQL} SELECT capture, pid, pkt_no, cc, prev_cc, cc_error FROM cc")
def _(fx):
    return ts.continuity_errors(packets(fx)).select("capture", "pid", "pkt_no", "cc", "prev_cc", "cc_error")


@query("pcr_discontinuities", f"WITH {PCR_SQL} SELECT capture, pkt_no, pcr27, pcr_jump FROM pcr")
def _(fx):
    return ts.pcr_discontinuities(packets(fx)).select("capture", "pkt_no", "pcr27", "pcr_jump")


@query(
    "ts_header",
    """SELECT capture, pkt_no, 71 AS sync, pid, CASE WHEN pkt_no % 5 = 0 THEN 1 ELSE 0 END AS pusi, tsc,
CASE WHEN has_payload = 1 THEN 3 ELSE 2 END AS afc, cc, has_payload FROM fx_packets""",
)
def _(fx):
    return ts.ts_header(raw_packets(fx).select("capture", "pkt_no", "pkt")).drop("pkt")


@query(
    "ts_payload",
    """SELECT capture, pkt_no, CASE WHEN has_payload = 1 THEN 176 END AS payload_len,
CASE WHEN has_payload = 1 THEN printf('%016X', pkt_no) END AS first8 FROM fx_packets""",
)
def _(fx):
    out = ts.ts_payload(raw_packets(fx))
    return out.select("capture", "pkt_no", F.octet_length("payload").alias("payload_len"), F.hex(F.substring("payload", 1, 8)).alias("first8"))


@query(
    "adaptation",
    "SELECT capture, pkt_no, disc, CASE WHEN pkt_no % 25 = 0 THEN 1 ELSE 0 END AS random_access, pcr27 FROM fx_packets",
)
def _(fx):
    return ts.adaptation(raw_packets(fx).select("capture", "pkt_no", "pkt")).drop("pkt")


@query(
    "ts_integrity_raw",
    f"""WITH RECURSIVE good AS (SELECT * FROM fx_packets WHERE pkt_no % 101 <> 0),
{CC_SQL.replace("fx_packets", "good")}, {PCR_SQL.replace("fx_packets", "good")},
t AS (SELECT capture, COUNT(*) FILTER (pkt_no % 101 <> 0) AS packets, COUNT(*) FILTER (pkt_no % 101 = 0) AS sync_errors, CAST(SUM(CASE WHEN pkt_no % 101 <> 0 THEN disc ELSE 0 END) AS BIGINT) AS discontinuities FROM fx_packets GROUP BY 1),
c AS (SELECT capture, CAST(SUM(cc_error) AS BIGINT) AS continuity_errors FROM cc GROUP BY 1),
j AS (SELECT capture, CAST(SUM(pcr_jump) AS BIGINT) AS pcr_discontinuities FROM pcr GROUP BY 1)
SELECT t.capture, packets, sync_errors, continuity_errors, discontinuities, pcr_discontinuities
FROM t JOIN c USING (capture) JOIN j USING (capture)""",
)
def _(fx):
    """Whole packets; one in 101 has lost its sync byte, and what else it says does not count."""
    damaged = F.when(F.col("pkt_no") % 101 == 0, F.concat(F.unhex(F.lit("00")), F.expr("substring(pkt, 2, 187)"))).otherwise(F.col("pkt"))
    raw = raw_packets(fx).select("capture", "pkt_no", "arrival_us", damaged.alias("pkt"))
    return ts.ts_integrity(ts.adaptation(ts.ts_header(raw)).drop("pkt"))


@query(
    "pes_header",
    """SELECT capture, pkt_no, pkt_no % 3 <> 0 AS pes_start, pkt_no % 3 <> 0 AND pkt_no % 2 = 0 AS has_pts,
CASE WHEN pkt_no % 3 <> 0 AND pkt_no % 2 = 0 THEN (pus * 9 // 100) % 8589934592 END AS pts FROM fx_packets""",
)
def _(fx):
    src = packets(fx).withColumn("pts_in", F.expr("(arrival_us * 9 DIV 100) % 8589934592"))
    pts = F.concat(
        to_bytes(F.lit(0x21) + F.expr("(pts_in DIV 1073741824) * 2"), 1),
        to_bytes(F.expr("((pts_in DIV 32768) % 32768) * 2 + 1"), 2),
        to_bytes(F.expr("(pts_in % 32768) * 2 + 1"), 2),
    )
    start = F.when(F.col("pkt_no") % 3 == 0, F.unhex(F.lit("000002"))).otherwise(F.unhex(F.lit("000001")))
    flag = F.when(F.col("pkt_no") % 2 == 0, F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("00")))
    unit = F.concat(start, F.unhex(F.lit("E0000080")), flag, F.unhex(F.lit("05")), pts, F.unhex(F.lit("000000")))
    return ts.pes_header(src.withColumn("payload", unit)).select("capture", "pkt_no", "pes_start", "has_pts", "pts")


@query(
    "pts_unwrap",
    """WITH r AS (SELECT capture, pid, pkt_no, (pus * 9 // 100) % 65536 AS raw FROM fx_packets),
l AS (SELECT *, LAG(raw) OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS pr FROM r)
SELECT capture, pid, pkt_no, CAST(SUM(CASE WHEN pr IS NULL THEN raw ELSE (raw - pr + 32768 + 65536) % 65536 - 32768 END)
  OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS BIGINT) AS ext FROM l""",
)
def _(fx):
    raw = packets(fx).selectExpr("capture", "pid", "pkt_no", "(arrival_us * 9 DIV 100) % 65536 AS raw")
    return ts.unwrap(raw, ["capture", "pid"], ["pkt_no"], "raw", 16).drop("raw")


@query(
    "elapsed_ticks",
    """WITH r AS (SELECT capture, pkt_no, (pcr27 // 300) % 16777216 AS raw FROM fx_packets),
l AS (SELECT *, LAG(raw) OVER (PARTITION BY capture ORDER BY pkt_no) AS pr FROM r)
SELECT capture, pkt_no, CAST(SUM(CASE WHEN pr IS NULL THEN 0 WHEN raw >= pr THEN raw - pr WHEN pr - raw > 8388608 THEN 16777216 - pr + raw ELSE 0 END)
  OVER (PARTITION BY capture ORDER BY pkt_no) AS BIGINT) AS elapsed FROM l""",
)
def _(fx):
    raw = packets(fx).selectExpr("capture", "pkt_no", "(pcr27 DIV 300) % 16777216 AS raw")
    return ts.elapsed_ticks(raw, ["capture"], ["pkt_no"], "raw", 24).drop("raw")


@query(
    "media_drift",
    """WITH RECURSIVE r AS (SELECT capture, pkt_no, pus, (pcr27 // 300) % 8589934592 AS raw FROM fx_packets),
l AS (SELECT *, raw - LAG(raw) OVER (PARTITION BY capture ORDER BY pkt_no) AS step, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY pkt_no) AS rn FROM r),
e AS (SELECT *, SUM(CASE WHEN step >= 0 THEN step WHEN -step > 4294967296 THEN 8589934592 + step ELSE 0 END) OVER (PARTITION BY capture ORDER BY pkt_no) AS t FROM l),
x AS (SELECT capture, pkt_no, rn, COALESCE(t, 0) AS elapsed, pus - COALESCE(t, 0) * 100 // 9 AS x FROM e),
m AS (SELECT capture, rn, x AS base, CAST(0 AS HUGEINT) AS drift, false AS resync FROM x WHERE rn = 1
UNION ALL SELECT x.capture, x.rn, CASE WHEN x.x - m.base > 2000000 THEN x.x ELSE m.base END, x.x - m.base, x.x - m.base > 2000000 FROM m JOIN x ON x.capture = m.capture AND x.rn = m.rn + 1)
SELECT x.capture, x.pkt_no, CAST(x.elapsed AS BIGINT) AS elapsed, CAST(m.drift AS BIGINT) AS drift_us, m.resync FROM m JOIN x ON x.capture = m.capture AND x.rn = m.rn""",
)
def _(fx):
    raw = packets(fx).selectExpr("capture", "pkt_no", "arrival_us", "(pcr27 DIV 300) % 8589934592 AS raw")
    return ts.media_drift(raw, ["capture"], ["pkt_no"], "raw", 33).select("capture", "pkt_no", "elapsed", "drift_us", "resync")


@query(
    "restamp_cc",
    """SELECT capture, pid, pkt_no, CAST(SUM(has_payload) OVER (PARTITION BY capture, pid ORDER BY pkt_no) % 16 AS INT) AS out_cc FROM fx_packets""",
)
def _(fx):
    return ts.restamp_cc(packets(fx)).select("capture", "pid", "pkt_no", "out_cc")


@query(
    "remux_counters",
    """SELECT p.capture, COUNT(*) FILTER (e.pid IS NOT NULL) AS passed, COUNT(*) FILTER (e.pid IS NULL) AS dropped
FROM fx_packets p LEFT JOIN (SELECT * FROM fx_es WHERE cls <> 'data') e ON p.capture = e.capture AND p.pid = e.pid GROUP BY 1""",
)
def _(fx):
    return ts.remux_counters(packets(fx), fx.es.filter("cls <> 'data'"))


@query(
    "scramble_stats",
    """WITH s AS (SELECT capture, pid, tsc, LAG(tsc) OVER (PARTITION BY capture, pid ORDER BY pkt_no) AS pt FROM fx_packets WHERE tsc >= 2),
f AS (SELECT capture, pid, COUNT(*) FILTER (pt <> tsc) AS parity_flips FROM s GROUP BY 1, 2)
SELECT p.capture, p.pid, COUNT(*) FILTER (tsc = 0) AS clear, COUNT(*) FILTER (tsc = 1) AS reserved, COUNT(*) FILTER (tsc = 2) AS even,
 COUNT(*) FILTER (tsc = 3) AS odd, COALESCE(ANY_VALUE(parity_flips), 0) AS parity_flips
FROM fx_packets p LEFT JOIN f ON p.capture = f.capture AND p.pid = f.pid GROUP BY 1, 2""",
)
def _(fx):
    return ts.scramble_stats(packets(fx))


@query(
    "repetition_audit",
    """WITH n(table_name, nominal_us) AS (VALUES ('pat', 100000), ('pmt', 100000), ('cat', 100000), ('sdt', 2000000), ('nit', 10000000), ('eit', 1000000), ('ait', 500000)),
s AS (SELECT capture, pkt_no, pus, CASE pid WHEN 256 THEN 'pat' WHEN 257 THEN 'pmt' WHEN 258 THEN 'sdt' WHEN 259 THEN 'nit' WHEN 260 THEN 'eit' ELSE 'ait' END AS table_name FROM fx_packets),
g AS (SELECT *, pus - LAG(pus) OVER (PARTITION BY capture, table_name ORDER BY pkt_no) AS gap FROM s)
SELECT capture, g.table_name, COUNT(*) AS sections, MAX(gap) AS max_gap_us, CAST(SUM(gap) AS BIGINT) // GREATEST(COUNT(gap), 1) AS mean_gap_us,
 COUNT(*) FILTER (gap > nominal_us) AS late FROM g JOIN n ON g.table_name = n.table_name GROUP BY 1, 2""",
)
def _(fx):
    kind = F.expr("CASE pid WHEN 256 THEN 'pat' WHEN 257 THEN 'pmt' WHEN 258 THEN 'sdt' WHEN 259 THEN 'nit' WHEN 260 THEN 'eit' ELSE 'ait' END")
    sections = packets(fx).select("capture", "pkt_no", "arrival_us", kind.alias("table_name"))
    nominal = fx.spark.createDataFrame(list(ts.NOMINAL_INTERVALS_US.items()), "table_name string, nominal_us bigint")
    return ts.repetition_audit(sections, nominal)


BUDGET_SQL = """n AS (SELECT capture, pkt_no, pus, COUNT(*) OVER (PARTITION BY capture ORDER BY pkt_no) AS k,
 pus - FIRST_VALUE(pus) OVER (PARTITION BY capture ORDER BY pkt_no) AS el FROM fx_packets),
b AS (SELECT *, CAST(k AS HUGEINT) * 1504 * 1000000 - CAST(el AS HUGEINT) * 14000 AS surplus FROM n)"""


@query(
    "bitrate_budget",
    f"""WITH {BUDGET_SQL} SELECT capture, pkt_no, surplus > 28000000000 AS overage,
CAST(CASE WHEN surplus < 0 THEN (-surplus) // 1504000000 ELSE 0 END AS BIGINT) AS stuffing_due FROM b""",
)
def _(fx):
    return ts.bitrate_budget(packets(fx).select("capture", "pkt_no", "arrival_us"), 14000).drop("arrival_us")


@query(
    "overage_alerts",
    f"""WITH RECURSIVE {BUDGET_SQL}, o AS (SELECT capture, pkt_no, pus FROM b WHERE surplus > 28000000000),
s AS (SELECT capture, pus, MIN(pkt_no) AS pkt_no FROM o GROUP BY 1, 2),
e AS (SELECT capture, MIN(pus) AS pus FROM s GROUP BY 1
 UNION ALL SELECT capture, nx FROM (SELECT e.capture, (SELECT MIN(s.pus) FROM s WHERE s.capture = e.capture AND s.pus >= e.pus + 30000000) AS nx FROM e) z WHERE nx IS NOT NULL)
SELECT e.capture, s.pkt_no, e.pus AS arrival_us FROM e JOIN s ON e.capture = s.capture AND e.pus = s.pus""",
)
def _(fx):
    return ts.overage_alerts(ts.bitrate_budget(packets(fx).select("capture", "pkt_no", "arrival_us"), 14000)).select("capture", "pkt_no", "arrival_us")


@query(
    "throttle",
    """WITH RECURSIVE s AS (SELECT capture, pid, pus, MIN(pkt_no) AS pkt_no FROM fx_packets GROUP BY 1, 2, 3),
e AS (SELECT capture, pid, MIN(pus) AS pus FROM s GROUP BY 1, 2
 UNION ALL SELECT capture, pid, nx FROM (SELECT e.capture, e.pid, (SELECT MIN(s.pus) FROM s WHERE s.capture = e.capture AND s.pid = e.pid AND s.pus >= e.pus + 5000000) AS nx FROM e) z WHERE nx IS NOT NULL)
SELECT e.capture, e.pid, e.pus AS arrival_us, s.pkt_no FROM e JOIN s ON e.capture = s.capture AND e.pid = s.pid AND e.pus = s.pus""",
)
def _(fx):
    rows = packets(fx).select("capture", "pid", "arrival_us", "pkt_no")
    return throttle(rows, ["capture", "pid"], ["arrival_us", "pkt_no"], 5_000_000, span=60_000_000)


@query(
    "take_duration",
    """SELECT capture, pkt_no FROM (SELECT *, MIN(pus) OVER (PARTITION BY capture) AS st FROM fx_packets) z WHERE pus - st < 60000000""",
)
def _(fx):
    return ts.take_duration(packets(fx), ["capture"], "arrival_us", 60).select("capture", "pkt_no")


@query(
    "output_edge_events",
    """WITH o AS (SELECT capture AS output, pkt_no, disc = 0 AND tsc <> 3 AS ok FROM fx_packets),
l AS (SELECT *, LAG(ok) OVER (PARTITION BY output ORDER BY pkt_no) AS pk, CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY output ORDER BY pkt_no) AS BIGINT) AS errors FROM o)
SELECT output, pkt_no, ok, errors, CASE WHEN ok THEN 'recovered' ELSE 'failed' END AS edge FROM l
WHERE (NOT ok AND COALESCE(pk, TRUE)) OR (ok AND pk = FALSE)""",
)
def _(fx):
    res = packets(fx).select(F.col("capture").alias("output"), "pkt_no", "disc", "tsc")
    out = ts.edge_events(res, ["output"], ["pkt_no"], (F.col("disc") == 0) & (F.col("tsc") != 3))
    return out.select("output", "pkt_no", "ok", "errors", "edge")


@query(
    "capture_stats",
    """SELECT capture, COUNT(*) * 188 AS bytes, MAX(pus) - MIN(pus) AS elapsed_us, LEAST((MAX(pus) - MIN(pus)) // 6000000, 100) AS percent FROM fx_packets GROUP BY 1""",
)
def _(fx):
    return ts.capture_stats(packets(fx), 600)


@query(
    "output_stats",
    """SELECT capture AS output, COUNT(*) FILTER (disc <> 0 OR tsc = 3) AS errors, arg_max(disc = 0 AND tsc <> 3, pkt_no) AS up FROM fx_packets GROUP BY 1""",
)
def _(fx):
    return ts.output_stats(packets(fx).selectExpr("capture AS output", "pkt_no AS arrival", "disc = 0 AND tsc <> 3 AS ok"))


@query(
    "packets_with_class",
    """WITH ch AS (SELECT capture, pid, pkt_no, CASE pkt_no % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'data' END AS cls FROM fx_packets WHERE pkt_no % 89 = 7)
SELECT p.capture, p.pid, p.pkt_no, ch.cls FROM fx_packets p ASOF LEFT JOIN ch ON p.capture = ch.capture AND p.pid = ch.pid AND p.pkt_no >= ch.pkt_no""",
)
def _(fx):
    p = packets(fx).select("capture", "pid", "pkt_no")
    changes = p.filter("pkt_no % 89 = 7").withColumn("cls", F.expr("CASE pkt_no % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'data' END"))
    return ts.packets_with_class(p, changes)
