"""Queries over RTP streams, repair and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.fixtures import Fixtures
from airlens.functions.binary import fnv1a64, ipv4_octets
from airlens.operators import repair, rtcp, rtp
from airlens.operators.ordered import asof_state
from airlens.plans.registry import query


def packets(fx: Fixtures) -> DataFrame:
    return fx.rtp.withColumnRenamed("pus", "arrival_us")


def hex_bytes(expr: str, width: int) -> str:
    return f"lpad(hex(cast({expr} as bigint)), {2 * width}, '0')"


HEADER = (
    "concat(lpad(hex(128 + arrival % 3 + if(arrival % 4 = 0, 16, 0)), 2, '0'), '21', "
    + ", ".join([hex_bytes("seq", 2), hex_bytes("rtp_ts", 4), hex_bytes("ssrc", 4)])
    + ", repeat('00000001', cast(arrival % 3 as int)), if(arrival % 4 = 0, 'ABCD0001DEADBEEF', ''))"
)


@query(
    "rtp_header",
    """SELECT channel, arrival, TRUE AS is_rtp, 33 AS pt, CAST(seq AS INT) AS seq, rtp_ts, ssrc, CAST(12 + arrival % 3 * 4 + CASE WHEN arrival % 4 = 0 THEN 8 ELSE 0 END AS INT) AS payload_off,
arrival % 2 = 0 AS is_ts FROM fx_rtp""",
)
def _(fx):
    src = packets(fx).withColumn("datagram", F.expr(f"unhex(concat({HEADER}, if(arrival % 2 = 0, '47', '00'), '00'))")).select("channel", "arrival", "datagram")
    return rtp.rtp_header(src).drop("datagram")


@query(
    "rtx_unwrap",
    "SELECT channel, arrival, ssrc, CAST(rtp_ts % 65536 AS INT) AS osn, printf('%08X', arrival) AS payload FROM fx_rtp WHERE arrival % 5 <> 0",
)
def _(fx):
    body = HEADER.replace("'21'", "if(arrival % 5 = 0, '21', '63')")
    src = packets(fx).withColumn("datagram", F.expr(f"unhex(concat({body}, {hex_bytes('rtp_ts % 65536', 2)}, {hex_bytes('arrival', 4)}))")).select("channel", "arrival", "datagram")
    return rtp.rtx_unwrap(src, 99).withColumn("payload", F.hex("payload"))


GAPS = """l AS (SELECT *, LAG(seq) OVER (PARTITION BY channel ORDER BY arrival) AS ps FROM fx_rtp),
x AS (SELECT *, SUM(CASE WHEN ps IS NULL THEN seq ELSE (seq - ps + 98304) % 65536 - 32768 END) OVER (PARTITION BY channel ORDER BY arrival) AS ext FROM l),
m AS (SELECT *, MAX(ext) OVER (PARTITION BY channel ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x),
g AS (SELECT *, CAST(CASE WHEN top IS NULL THEN 0 ELSE ext - top - 1 END AS BIGINT) AS delta FROM m)"""


@query(
    "rtp_gaps",
    f"WITH {GAPS} SELECT channel, arrival, CAST(ext AS BIGINT) AS ext, delta, CASE WHEN delta < 0 THEN 'stale' WHEN delta = 0 THEN 'ok' WHEN delta < 32 THEN 'gap' ELSE 'resync' END AS verdict FROM g",
)
def _(fx):
    return rtp.rtp_gaps(packets(fx)).select("channel", "arrival", "ext", "delta", "verdict")


@query("missing_sequences", f"WITH {GAPS} SELECT channel, arrival, CAST((seq - delta + k + 65536) % 65536 AS INT) AS seq FROM g, range(31) r(k) WHERE delta > 0 AND delta < 32 AND k < delta")
def _(fx):
    return rtp.missing_sequences(rtp.rtp_gaps(packets(fx))).select("channel", "arrival", "seq")


# every 41st packet skips ahead; longer gaps come from dropping stretches of the stream
def lossy(fx: Fixtures) -> DataFrame:
    return packets(fx).filter("arrival % 257 > 97")


LOSSY = GAPS.replace("FROM fx_rtp", "FROM fx_rtp WHERE arrival % 257 > 97")


@query(
    "nack_pack",
    f"""WITH {LOSSY}, k AS (SELECT *, i FROM g, range(31) r(i) WHERE delta > 0 AND delta < 32 AND i < delta),
e AS (SELECT channel, arrival, CAST(i // 17 AS INT) AS entry, CAST((ANY_VALUE(seq) - ANY_VALUE(delta) + (i // 17) * 17 + 65536) % 65536 AS INT) AS pid,
 CAST(SUM(CASE WHEN i % 17 = 0 THEN 0 ELSE 1 << CAST(i % 17 - 1 AS INT) END) AS INT) AS blp, CAST(COUNT(*) AS INT) AS lost FROM k GROUP BY channel, arrival, i // 17)
SELECT * FROM e""",
)
def _(fx):
    return rtp.nack_pack(rtp.rtp_gaps(lossy(fx)))


@query(
    "nack_expand",
    "SELECT channel, arrival, CAST((pid + i) % 65536 AS INT) AS seq FROM fx_nacks, range(17) r(i) WHERE i = 0 OR (blp // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 1",
)
def _(fx):
    return rtp.nack_expand(fx.nacks).select("channel", "arrival", "seq")


@query("channel_bitrate", "SELECT channel, pus // 2000000 * 2000000 AS window_us, CAST(SUM(payload_len) * 8 AS BIGINT) AS bits FROM fx_rtp GROUP BY 1, 2")
def _(fx):
    return rtp.channel_bitrate(packets(fx))


# closing packets: the first packet of the first second that is two or more after the last close
EXACT_RATE = """p AS (SELECT channel, arrival, pus // 1000000 AS s, payload_len FROM fx_rtp),
q AS (SELECT channel, s, MIN(arrival) AS arrival FROM p GROUP BY 1, 2),
e AS (SELECT channel, MIN(s) AS s, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS o FROM q GROUP BY 1
 UNION ALL SELECT channel, nx, n + 1, s FROM (SELECT e.channel, e.s, e.n, (SELECT MIN(q.s) FROM q WHERE q.channel = e.channel AND q.s >= e.s + 2) AS nx FROM e) z WHERE nx IS NOT NULL),
k AS (SELECT e.channel, e.n, e.o, e.s, q.arrival AS hi, LAG(q.arrival) OVER (PARTITION BY e.channel ORDER BY e.n) AS lo FROM e JOIN q ON e.channel = q.channel AND e.s = q.s),
r AS (SELECT k.channel, k.n AS window_no, k.o AS open_s, k.s AS close_s, CAST(SUM(payload_len) AS BIGINT) AS bytes FROM k JOIN p ON k.channel = p.channel AND p.arrival <= k.hi AND (p.arrival > k.lo OR k.n = 1)
 WHERE k.n > 0 GROUP BY 1, 2, 3, 4)"""


@query("channel_bitrate_exact", f"WITH RECURSIVE {EXACT_RATE} SELECT channel, window_no, open_s, close_s, bytes, bytes * 8 / (close_s - open_s) AS bps FROM r")
def _(fx):
    return rtp.channel_bitrate_exact(packets(fx))


@query(
    "rap_groups",
    """WITH n AS (SELECT *, CAST(SUM(is_rap) OVER (PARTITION BY channel ORDER BY arrival) AS BIGINT) AS rap_no FROM fx_rtp),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel, rap_no ORDER BY arrival DESC) AS back FROM n WHERE rap_no > 0),
g AS (SELECT channel, rap_no, MIN(arrival) AS rap_arrival, LEAST(COUNT(*), 20) AS count, arg_min(rtp_ts, back) AS l, MAX(back) AS mx FROM r GROUP BY 1, 2)
SELECT g.channel, g.rap_no, rap_arrival, count, CASE WHEN count < 2 THEN 0 ELSE ((l - r.rtp_ts + 4294967296) % 4294967296) * 1000 // 90000 END AS depth_ms
FROM g JOIN r ON g.channel = r.channel AND g.rap_no = r.rap_no AND r.back = g.count""",
)
def _(fx):
    return rtp.rap_groups(packets(fx), 20)


COLLISIONS = """p AS (SELECT *, LAG(addr) OVER w AS pa, LAST_VALUE(cname IGNORE NULLS) OVER (PARTITION BY channel, ssrc ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc
 FROM fx_receivers WINDOW w AS (PARTITION BY channel, ssrc ORDER BY arrival)),
c AS (SELECT *, CASE WHEN cname IS NOT NULL AND pc IS NOT NULL THEN cname <> pc ELSE COALESCE(addr <> pa, FALSE) END AS collided FROM p)"""


@query("receiver_collisions", f"WITH {COLLISIONS} SELECT channel, ssrc, arrival, collided FROM c")
def _(fx):
    return rtp.receiver_collisions(fx.receivers).select("channel", "ssrc", "arrival", "collided")


@query(
    "recent_collisions",
    f"WITH {COLLISIONS} SELECT channel, ssrc, MAX(us) AS last_us FROM c WHERE collided GROUP BY 1, 2 HAVING 1706000000000000 - MAX(us) <= 86400000000",
)
def _(fx):
    return rtp.recent_collisions(rtp.receiver_collisions(fx.receivers), 1706000000000000, 86_400_000_000)


@query(
    "channel_activity",
    """WITH f AS (SELECT *, CASE WHEN pus - LAG(pus) OVER (PARTITION BY channel ORDER BY arrival) > 500000 THEN 1 ELSE 0 END AS s FROM fx_rtp),
n AS (SELECT *, CAST(1 + SUM(s) OVER (PARTITION BY channel ORDER BY arrival) AS BIGINT) AS generation FROM f)
SELECT channel, generation, MIN(pus) AS first_us, MAX(pus) AS last_us, COUNT(*) AS rows FROM n GROUP BY 1, 2""",
)
def _(fx):
    return rtp.activity_sessions(packets(fx), ["channel"], "arrival_us", ["arrival"], 500_000)


@query(
    "client_sessions",
    """WITH f AS (SELECT *, CASE WHEN us - LAG(us) OVER (PARTITION BY channel, ssrc ORDER BY arrival) > 300000000 THEN 1 ELSE 0 END AS s FROM fx_receivers),
n AS (SELECT *, CAST(1 + SUM(s) OVER (PARTITION BY channel, ssrc ORDER BY arrival) AS BIGINT) AS generation FROM f)
SELECT channel, ssrc, generation, MIN(us) AS first_us, MAX(us) AS last_us, COUNT(*) AS rows FROM n GROUP BY 1, 2, 3""",
)
def _(fx):
    return rtp.activity_sessions(fx.receivers, ["channel", "ssrc"], "us", ["arrival"], 300_000_000)


@query("active_sessions", "SELECT channel, ssrc, MAX(us) AS last_us FROM fx_receivers GROUP BY 1, 2 HAVING 1706600000000000 - MAX(us) <= 36000000000")
def _(fx):
    return rtp.active_sessions(fx.receivers, ["channel", "ssrc"], "us", 1706600000000000, 36_000)


@query(
    "repair_lookup",
    """WITH s AS (SELECT channel, arrival, CAST((pid + i) % 65536 AS INT) AS seq FROM fx_nacks, range(17) r(i) WHERE i = 0 OR (blp // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 1),
p AS (SELECT channel, seq % 2000 AS slot, arrival, seq FROM fx_rtp)
SELECT s.channel, s.arrival, s.seq, COALESCE(p.seq = s.seq, FALSE) AS repairable FROM (SELECT *, seq % 2000 AS slot FROM s) s ASOF LEFT JOIN p ON s.channel = p.channel AND s.slot = p.slot AND s.arrival >= p.arrival""",
)
def _(fx):
    asked = rtp.nack_expand(fx.nacks).select("channel", "arrival", "seq")
    return repair.repair_lookup(asked, packets(fx), 2000)


@query(
    "repair_match",
    f"""WITH {GAPS}, k AS (SELECT channel, ssrc, arrival, pus, (seq - delta + k + 65536) % 65536 AS seq FROM g, range(31) r(k) WHERE delta > 0 AND delta < 32 AND k < delta),
x2 AS (SELECT channel, ssrc + CASE WHEN arrival % 3 = 0 THEN 1 ELSE 0 END AS ssrc, (seq + 65534) % 65536 AS osn, pus + (arrival % 5) * 80000 AS rtx_us FROM fx_rtp WHERE arrival % 41 = 0)
SELECT k.channel, k.ssrc, CAST(k.seq AS INT) AS seq, k.pus AS gap_us, MIN(rtx_us) AS rtx_us FROM k JOIN x2 ON k.channel = x2.channel AND k.ssrc = x2.ssrc AND k.seq = x2.osn AND rtx_us BETWEEN k.pus AND k.pus + 200000 GROUP BY 1, 2, 3, 4""",
)
def _(fx):
    p = packets(fx)
    lost = rtp.missing_sequences(rtp.rtp_gaps(p)).join(p.select("channel", "arrival", "ssrc", F.col("arrival_us").alias("gap_us")), ["channel", "arrival"])
    rtx = p.filter("arrival % 41 = 0").selectExpr("channel", "ssrc + if(arrival % 3 = 0, 1, 0) AS ssrc", "cast((seq + 65534) % 65536 as int) AS osn", "arrival_us + (arrival % 5) * 80000 AS rtx_us")
    return repair.repair_match(lost.select("channel", "ssrc", "seq", "gap_us"), rtx)


def repair_rows(fx) -> DataFrame:
    """Originals, and retransmissions of one in 41 of the numbers two back, some of them for another sender."""
    p = packets(fx).withColumn("arrival", F.col("arrival") * 10).selectExpr("channel", "'original' AS kind", "arrival", "arrival_us", "ssrc", "cast(seq as int) AS seq", "payload_len")
    again = p.filter("arrival % 410 = 0").selectExpr("channel", "'repair' AS kind", "arrival + 5 AS arrival", "arrival_us", "ssrc + if(arrival % 30 = 0, 1, 0) AS ssrc", "cast((seq + 65534) % 65536 as int) AS seq", "payload_len")
    return p.unionByName(again)


#: The hold-and-repair window row by row; an open place of the window is an empty text.
REPAIRED = """a AS (SELECT channel, true AS original, arrival * 10 AS arrival, pus AS us, ssrc, CAST(seq AS INT) AS seq FROM fx_rtp
UNION ALL SELECT channel, false, arrival * 10 + 5, pus, ssrc + CASE WHEN arrival * 10 % 30 = 0 THEN 1 ELSE 0 END, CAST((seq + 65534) % 65536 AS INT) FROM fx_rtp WHERE arrival % 41 = 0),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY arrival) AS rn FROM a),
w AS (SELECT channel, 0::BIGINT AS rn, NULL::BIGINT AS ssrc, -1::BIGINT AS run, 0 AS expected, []::VARCHAR[] AS hold, 0::BIGINT AS deadline, []::STRUCT(run BIGINT, seq INT, source VARCHAR)[] AS outs FROM (SELECT DISTINCT channel FROM a)
UNION ALL SELECT channel, rn, ssrc, run, (exp4 + k) % 65536, hold4[k + 1 :], due, outs || list_transform(range(k), lambda i: {'run': run, 'seq': CAST((exp4 + i) % 65536 AS INT), 'source': CASE WHEN hold4[i + 1] = '' THEN 'lost' ELSE hold4[i + 1] END})
FROM (SELECT *, CASE WHEN len(hold4) = 0 THEN 0 WHEN us > due OR NOT list_contains(hold4, '') THEN len(hold4) ELSE list_position(hold4, '') - 1 END AS k
FROM (SELECT *,
 CASE WHEN NOT original THEN CASE WHEN ssrc = sender AND ahead >= 0 AND ahead < held AND hold2[ahead + 1] = '' THEN list_transform(hold2, lambda x, i: CASE WHEN i = ahead + 1 THEN 'repaired' ELSE x END) ELSE hold2 END
 WHEN ahead < 0 THEN hold2
 WHEN held > 0 AND NOT flush THEN CASE WHEN ahead = held THEN list_append(hold2, 'ok') WHEN hold2[ahead + 1] = '' THEN list_transform(hold2, lambda x, i: CASE WHEN i = ahead + 1 THEN 'reordered' ELSE x END) ELSE hold2 END
 WHEN ahead3 = 0 OR ahead3 >= 32 THEN [] ELSE list_append(list_transform(range(ahead3), lambda i: ''), 'gap') END AS hold4,
 CASE WHEN direct THEN (seq + 1) % 65536 WHEN flush THEN (exp2 + held) % 65536 ELSE exp2 END AS exp4,
 CASE WHEN original AND ahead >= 0 AND (held = 0 OR flush) AND NOT direct THEN us + 200000 ELSE deadline END AS due,
 outs2 || CASE WHEN flush THEN list_transform(range(held), lambda i: {'run': run, 'seq': CAST((exp2 + i) % 65536 AS INT), 'source': CASE WHEN hold2[i + 1] = '' THEN 'lost' ELSE hold2[i + 1] END}) ELSE [] END
 || CASE WHEN direct THEN [{'run': run, 'seq': seq, 'source': CASE WHEN ahead3 = 0 THEN 'ok' ELSE 'resync' END}] ELSE [] END AS outs
FROM (SELECT *, CASE WHEN flush THEN ahead - held ELSE ahead END AS ahead3, original AND ahead >= 0 AND (held = 0 OR flush) AND (CASE WHEN flush THEN ahead - held ELSE ahead END = 0 OR CASE WHEN flush THEN ahead - held ELSE ahead END >= 32) AS direct
FROM (SELECT *, original AND held > 0 AND ahead >= held AND NOT (ahead = held AND held < 32) AS flush
FROM (SELECT *, len(hold2) AS held, ((seq - exp2 + 32768) % 65536 + 65536) % 65536 - 32768 AS ahead
FROM (SELECT n.channel, n.rn, n.original, n.us, n.seq, n.ssrc AS sender, e.fresh, e.gone, w.deadline,
 CASE WHEN e.fresh THEN n.ssrc ELSE w.ssrc END AS ssrc, w.run + CASE WHEN e.fresh THEN 1 ELSE 0 END AS run, CASE WHEN e.fresh THEN n.seq WHEN e.gone THEN CAST((w.expected + len(w.hold)) % 65536 AS INT) ELSE w.expected END AS exp2,
 CASE WHEN e.fresh OR e.gone THEN [] ELSE w.hold END AS hold2,
 CASE WHEN e.fresh OR e.gone THEN list_transform(range(len(w.hold)), lambda i: {'run': w.run, 'seq': CAST((w.expected + i) % 65536 AS INT), 'source': CASE WHEN w.hold[i + 1] = '' THEN 'lost' ELSE w.hold[i + 1] END}) ELSE [] END AS outs2
 FROM w JOIN n ON n.channel = w.channel AND n.rn = w.rn + 1, LATERAL (SELECT n.original AND (w.ssrc IS NULL OR w.ssrc <> n.ssrc) AS fresh, len(w.hold) > 0 AND n.us - 1 >= w.deadline AS gone) e) s1) s2) s3) s4) s5) s6),
z AS (SELECT channel, arg_max({'run': run, 'expected': expected, 'hold': hold}, rn) AS l FROM w GROUP BY channel),
repaired AS (SELECT channel, o.run, o.seq, o.source FROM (SELECT channel, unnest(outs) AS o FROM w)
UNION ALL SELECT channel, l.run, CAST((l.expected + i) % 65536 AS INT), CASE WHEN l.hold[i + 1] = '' THEN 'lost' ELSE l.hold[i + 1] END FROM z, range(len(l.hold)) r(i))"""


@query("rtp_repair", f"WITH RECURSIVE {REPAIRED} SELECT channel, run, seq, source FROM repaired")
def _(fx):
    rows = repair_rows(fx)
    found = repair.rtp_repair(rows.filter("kind = 'original'"), rows.filter("kind = 'repair'").withColumnRenamed("seq", "osn"))
    return found.select("channel", "run", "seq", "source")


@query(
    "burst_admission",
    """WITH q AS (SELECT CAST(user_id % 10 AS INT) AS channel, event_id AS arrival, event_type = 'view' AS ign, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 20) AS BIGINT) END AS mn,
 CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value * 30) AS BIGINT) * (event_id % 5) END AS mx, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS bps FROM fx_base),
s AS (SELECT channel, arrival, is_rap = 1 AS has_rap, pus % 3000 AS depth_ms, payload_len * 20 AS nominal FROM fx_rtp),
j AS (SELECT q.*, s.has_rap, s.depth_ms, s.nominal, COALESCE(s.channel < 9, false) AS known FROM q ASOF LEFT JOIN s ON q.channel = s.channel AND q.arrival >= s.arrival)
SELECT channel, arrival, CASE WHEN arrival % 17 = 0 THEN 505 WHEN known AND channel = 3 THEN 506 WHEN NOT known THEN CASE WHEN ign THEN 510 ELSE 509 END WHEN mn > 8000 THEN 401
 WHEN mx = 0 THEN 402 WHEN mn > mx THEN 400 WHEN NOT has_rap THEN 508 WHEN depth_ms < mn THEN 507 WHEN bps <= nominal THEN 403 ELSE 200 END AS response FROM j""",
)
def _(fx):
    asked = fx.base.selectExpr(
        "CAST(user_id % 10 AS INT) AS channel", "event_id AS arrival", "event_type = 'view' AS ignore_media_ssrc",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 20) AS BIGINT) END AS min_fill_ms",
        "CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value * 30) AS BIGINT) * (event_id % 5) END AS max_fill_ms",
        "CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS max_bps",
        "event_id % 17 <> 0 AS client_allowed", "user_id % 10 <> 3 AS channel_allowed",
    )
    state = packets(fx).selectExpr("channel", "arrival", "is_rap = 1 AS has_rap", "arrival_us % 3000 AS depth_ms", "payload_len * 20 AS nominal_bps", "channel < 9 AS known")
    joined = asof_state(asked, state, ["channel"], "arrival", ["known", "has_rap", "depth_ms", "nominal_bps"])
    return repair.burst_admission(joined, 8000).select("channel", "arrival", "response")


@query(
    "nack_pressure",
    """SELECT session, arrival, n AS nack_count, CASE WHEN n >= 6 THEN 'terminated' WHEN n = 3 THEN 'adapted' ELSE 'none' END AS action
FROM (SELECT *, COUNT(*) OVER (PARTITION BY session ORDER BY arrival) AS n FROM fx_nacks) z""",
)
def _(fx):
    return repair.nack_pressure(fx.nacks, 6).select("session", "arrival", "nack_count", "action")


@query(
    "retransmit_totals",
    "SELECT CAST(user_id % 10 AS INT) AS channel, COUNT(*) AS packets, CAST(SUM(188 * (1 + event_id % 7)) AS BIGINT) AS bytes, COUNT(DISTINCT user_id) AS sessions FROM fx_base GROUP BY 1",
)
def _(fx):
    return repair.retransmit_totals(fx.base.selectExpr("CAST(user_id % 10 AS INT) AS channel", "user_id AS session", "188 * (1 + event_id % 7) AS payload_len"))


FNV = """p AS (SELECT ord, name, onid, ord // 250 % 250 AS o3, ord % 250 + 1 AS o4, 5000 + ord % 1000 AS port FROM fx_services),
h0 AS (SELECT *, (CAST(xor(CAST(1469598103934665603 AS UBIGINT), CAST(239 AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS h FROM p),
h1 AS (SELECT * REPLACE ((CAST(xor(CAST(h AS UBIGINT), CAST(onid AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS h) FROM h0),
h2 AS (SELECT * REPLACE ((CAST(xor(CAST(h AS UBIGINT), CAST(o3 AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS h) FROM h1),
h3 AS (SELECT * REPLACE ((CAST(xor(CAST(h AS UBIGINT), CAST(o4 AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS h) FROM h2),
h4 AS (SELECT * REPLACE ((CAST(xor(CAST(h AS UBIGINT), CAST(2 AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS h) FROM h3),
h5 AS (SELECT * REPLACE ((CAST(xor(CAST(h AS UBIGINT), CAST(port AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS h) FROM h4)"""


@query(
    "resolve_channel",
    f"""WITH {FNV}, s AS (SELECT CAST(h % 384 AS INT) AS slot, arg_min(name, ord) AS by_port FROM h5 GROUP BY 1),
q AS (SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 40000 + event_id % 500 END AS INT) AS dp, user_id AS ssrc FROM fx_base)
SELECT event_id AS request, COALESCE(s.by_port, p.name) AS channel FROM q LEFT JOIN s ON q.dp - 40000 = s.slot LEFT JOIN p ON q.ssrc = p.ord""",
)
def _(fx):
    channels = fx.services.selectExpr("ord", "name AS channel", "regexp_extract(uri, 'rtp://(.*):', 1) AS address", "cast(regexp_extract(uri, ':([0-9]+)$', 1) as int) AS port", "ord AS ssrc")
    asked = fx.base.selectExpr("event_id AS request", "cast(if(event_id % 2 = 0, 40000 + event_id % 500, null) as int) AS dest_port", "user_id AS media_ssrc")
    return repair.resolve_channel(asked, channels, 40000, 384).select("request", "channel")


@query("fnv1a64", f"WITH {FNV} SELECT ord, CAST(h AS VARCHAR) AS hash FROM h5")
def _(fx):
    rows = fx.services.selectExpr("ord", "regexp_extract(uri, 'rtp://(.*):', 1) AS address", "cast(regexp_extract(uri, ':([0-9]+)$', 1) as int) AS port")
    return rows.select("ord", fnv1a64(ipv4_octets(F.col("address")), F.lit(2), F.col("port")).cast("string").alias("hash"))


@query(
    "rtcp_explode",
    """SELECT arrival, 'nack' AS kind, CAST(7 AS BIGINT) AS sender_ssrc, CAST(channel AS BIGINT) AS media_ssrc, CAST(e AS INT) AS entry, CAST((pid + e * 17) % 65536 AS INT) AS pid, CAST(blp AS INT) AS blp, NULL::VARCHAR AS cname, NULL::BIGINT AS min_fill_ms
 FROM fx_nacks, range(3) r(e) WHERE e <= arrival % 3
UNION ALL SELECT arrival, 'name', 9, NULL, NULL, NULL, NULL, session, NULL FROM fx_nacks
UNION ALL SELECT arrival, 'request', 7, channel, NULL, NULL, NULL, NULL, pid FROM fx_nacks WHERE arrival % 2 = 0""",
)
def _(fx):
    entry = lambda e: f"if({e} <= arrival % 3, concat({hex_bytes(f'(pid + {e} * 17) % 65536', 2)}, {hex_bytes('blp', 2)}), '')"
    report = "'80C80006' || repeat('00', 24)"
    nack = f"concat('81CD', {hex_bytes('3 + arrival % 3', 2)}, '00000007', {hex_bytes('channel', 4)}, {entry(0)}, {entry(1)}, {entry(2)})"
    padded = "4 - (6 + length(session)) % 4 + 6 + length(session)"
    names = f"concat('81CA', {hex_bytes(f'({padded}) div 4', 2)}, '00000009', '01', {hex_bytes('length(session)', 1)}, hex(session), repeat('00', 4 - (6 + length(session)) % 4))"
    rams = f"if(arrival % 2 = 0, concat('86CD0005', '00000007', {hex_bytes('channel', 4)}, '01000000', '02000004', {hex_bytes('pid', 4)}), '')"
    src = fx.nacks.select("arrival", F.expr(f"unhex(concat({report}, {nack}, {names}, {rams}))").alias("datagram"))
    out = rtcp.rtcp_explode(src)
    return out.select(
        "arrival", "kind", "sender_ssrc", "media_ssrc", "entry", "pid", "blp", "cname", "min_fill_ms"
    )
