"""Transport-stream packets: header decoding, integrity, counters and clock rules.

Raw form: ``capture, pkt_no, arrival_us, pkt BINARY``. Decoded form adds ``pid, pusi, afc, cc, tsc, ...``; the
integrity operators need only decoded columns, so payload bytes are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.binary import be, be16, bits, signed_delta, tail, u8
from airlens.operators.greedy import greedy_marks
from airlens.operators.ordered import CHUNK, DEFAULT_SPAN, First, Lag, LastKnown, PriorKnown, RunningSum, StepSum, asof_state, scan
from airlens.session import cut_lineage

SYNC = 0x47
PACKET_BYTES = 188
PACKET_BITS = PACKET_BYTES * 8
PCR_MODULUS = (1 << 33) * 300
PCR_HZ = 27_000_000


def ts_header(df: DataFrame, pkt: str = "pkt") -> DataFrame:
    """Header fields of each packet (PRJ-1)."""
    p = F.col(pkt)
    word = be16(p, 1)
    b3 = u8(p, 3)
    return df.select(
        "*",
        u8(p, 0).alias("sync"),
        bits(word, 0, 0x1FFF).alias("pid"),
        bits(word, 14, 1).alias("pusi"),
        bits(b3, 6, 3).alias("tsc"),
        bits(b3, 4, 3).alias("afc"),
        bits(b3, 0, 15).alias("cc"),
        bits(b3, 4, 1).alias("has_payload"),
    )


def ts_payload(df: DataFrame, pkt: str = "pkt") -> DataFrame:
    """Payload bytes, null when the packet carries none (PRJ-2)."""
    p = F.col(pkt)
    afc = bits(u8(p, 3), 4, 3)
    start = F.when(afc == 1, F.lit(4)).when(afc == 3, u8(p, 4) + 5)
    return df.withColumn("payload", F.when(start < PACKET_BYTES, tail(p, start)))


def adaptation(df: DataFrame, pkt: str = "pkt") -> DataFrame:
    """Discontinuity flag, random-access flag and 27 MHz clock of the adaptation field (PRJ-3)."""
    p = F.col(pkt)
    has_af = bits(u8(p, 3), 5, 1) == 1
    length, flags = u8(p, 4), u8(p, 5)
    has_pcr = has_af & (length >= 7) & (bits(flags, 4, 1) == 1)
    pcr = be(p, 6, 4) * 2 + bits(u8(p, 10), 7, 1)
    ext = bits(u8(p, 10), 0, 1) * 256 + u8(p, 11)
    return df.select(
        "*",
        F.when(has_af & (length >= 1), bits(flags, 7, 1)).otherwise(0).alias("disc"),
        F.when(has_af & (length >= 1), bits(flags, 6, 1)).otherwise(0).alias("random_access"),
        F.when(has_pcr, pcr * 300 + ext).alias("pcr27"),
    )


def pes_header(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Start-code check, PTS flag and 33-bit PTS of a unit's first bytes (PRJ-18)."""
    p = F.col(payload)
    ok = F.coalesce((be(p, 0, 3) == 1) & (F.octet_length(p) >= 9), F.lit(False))
    has_pts = ok & (bits(u8(p, 7), 7, 1) == 1) & (F.octet_length(p) >= 14)
    high = bits(u8(p, 9), 1, 7).cast("bigint") * (1 << 30)
    mid = bits(be16(p, 10), 1, 0x7FFF).cast("bigint") * (1 << 15)
    low = bits(be16(p, 12), 1, 0x7FFF).cast("bigint")
    return df.select("*", ok.alias("pes_start"), F.coalesce(has_pts, F.lit(False)).alias("has_pts"), F.when(has_pts, high + mid + low).alias("pts"))


def continuity_errors(packets: DataFrame, keys: list[str] = ["capture", "pid"], span: int = DEFAULT_SPAN) -> DataFrame:
    """Payload-bearing packets with the previous counter and an error flag (WIN-2).

    A repeated counter is an error; a discontinuity flag excuses the packet that carries it.
    """
    prev = scan(packets.filter("has_payload = 1"), keys, ["pkt_no"], span, prev_cc=Lag(F.col("cc")))
    return prev.withColumn("cc_error", _cc_error(F.col("cc"), F.col("disc"), F.col("prev_cc")))


def pcr_discontinuities(pcr: DataFrame, keys: list[str] = ["capture"], time_us: str = "arrival_us", span: int = DEFAULT_SPAN) -> DataFrame:
    """Clock samples with the plausibility verdict against the wall time between samples (WIN-3).

    All comparisons are in integer ticks: one microsecond of wall time is 27 ticks.
    """
    prev = scan(pcr.filter("pcr27 IS NOT NULL"), keys, ["pkt_no"], span, prev_pcr=Lag(F.col("pcr27")), prev_us=Lag(F.col(time_us)))
    return prev.withColumn("pcr_jump", _jump(F.col("pcr27"), F.col(time_us), F.col("prev_pcr"), F.col("prev_us")))


def _cc_error(cc: Column, disc: Column, prev: Column) -> Column:
    return (prev.isNotNull() & (disc == 0) & (cc != (prev + 1).bitwiseAND(F.lit(15)))).cast("int")


def _jump(clock: Column, us: Column, prev_clock: Column, prev_us: Column) -> Column:
    """1 where a clock sample is not plausible against the one before it."""
    d = F.pmod(clock - prev_clock, F.lit(PCR_MODULUS))
    wall = (us - prev_us) * 27
    plausible = (wall > 0) & (d > 0) & (d < 60 * PCR_HZ) & (d < wall * 5 + PCR_HZ // 2) & (d * 10 > wall * 2 - PCR_HZ)
    return F.when(prev_clock.isNull(), 0).otherwise((~plausible).cast("int"))


def ts_integrity(packets: DataFrame, clock_pids: DataFrame | None = None, span: int = DEFAULT_SPAN) -> DataFrame:
    """Counters per capture: packets, sync, continuity, signalled and clock discontinuities (AGG-1).

    ``clock_pids(capture, pid)`` names the pid whose clock is judged (at most one row per capture); without it
    every sample of a capture counts. A missing ``sync`` column means all packets are in sync.

    Packets are read, dealt and sorted once: chunks of a capture count what lies inside them and note their first and last
    counter of each pid and their first and last clock sample; a small table of these settles the borders.
    """
    good = F.col("sync") == SYNC if "sync" in packets.columns else F.lit(True)
    clocked = F.col("pcr27").isNotNull() & good
    rows = packets
    if clock_pids is not None:
        rows = rows.join(clock_pids.select("capture", "pid", F.lit(True).alias("__clocked")), ["capture", "pid"], "left")
        clocked = clocked & F.col("__clocked").isNotNull()
    slim = rows.select(
        "capture", "pid", "pkt_no", good.cast("int").alias("good"), "disc", F.expr(f"pkt_no div {span}").alias(CHUNK),
        F.when(good & (F.col("has_payload") == 1), F.struct("pkt_no", "cc", "disc")).alias("c"), F.when(clocked, F.struct("pkt_no", "pcr27", F.col("arrival_us").alias("us"))).alias("p"),
    )
    before = lambda *keys: Window.partitionBy(*keys).orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, -1)
    # both windows and the sums below stand on one exchange by capture and chunk
    dealt = slim.repartition("capture", CHUNK)
    seen = dealt.withColumn("__p", F.last("p", ignorenulls=True).over(before("capture", CHUNK))).withColumn("__c", F.last("c", ignorenulls=True).over(before("capture", CHUNK, "pid")))
    inner_cc = F.when(F.col("c").isNotNull(), _cc_error(F.col("c.cc"), F.col("c.disc"), F.col("__c.cc")))
    inner_jump = F.when(F.col("p").isNotNull(), _jump(F.col("p.pcr27"), F.col("p.us"), F.col("__p.pcr27"), F.col("__p.us")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    chunks = cut_lineage(
        seen.groupBy("capture", CHUNK, "pid").agg(
            F.sum("good").alias("packets"), F.sum(1 - F.col("good")).alias("sync_errors"), zero(F.sum(F.when(F.col("good") == 1, F.col("disc")))).alias("discontinuities"),
            zero(F.sum(inner_cc)).alias("cc"), zero(F.sum(inner_jump)).alias("jumps"), F.min("c").alias("c_head"), F.max("c").alias("c_tail"), F.min("p").alias("p_head"), F.max("p").alias("p_tail"),
        )
    )
    totals = chunks.groupBy("capture").agg(*[F.sum(c).alias(c) for c in ("packets", "sync_errors", "discontinuities", "cc", "jumps")])
    pids = chunks.where("c_head IS NOT NULL").withColumn("__c", F.lag("c_tail.cc").over(Window.partitionBy("capture", "pid").orderBy(CHUNK)))
    cc = pids.groupBy("capture").agg(F.sum(_cc_error(F.col("c_head.cc"), F.col("c_head.disc"), F.col("__c"))).alias("__cc"))
    clocks = chunks.where("p_head IS NOT NULL").groupBy("capture", CHUNK).agg(F.min("p_head").alias("head"), F.max("p_tail").alias("tail"))
    clocks = clocks.withColumn("__p", F.lag("tail").over(Window.partitionBy("capture").orderBy(CHUNK)))
    pcr = clocks.groupBy("capture").agg(F.sum(_jump(F.col("head.pcr27"), F.col("head.us"), F.col("__p.pcr27"), F.col("__p.us"))).alias("__p"))
    return (
        totals.join(cc, "capture", "left").join(pcr, "capture", "left")
        .select(
            "capture", "packets", "sync_errors", (F.col("cc") + zero(F.col("__cc"))).alias("continuity_errors"), "discontinuities",
            (F.col("jumps") + zero(F.col("__p"))).alias("pcr_discontinuities"),
        )
    )


def unwrap(df: DataFrame, keys: list[str], order: list[str], col: str, width: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """Extended counter: the raw first value plus every signed modular step (WIN-4)."""
    return scan(df, keys, order, span, ext=StepSum(F.col(col).cast("bigint"), lambda x, prev: signed_delta(x, prev, width), lambda x: x))


def elapsed_ticks(df: DataFrame, keys: list[str], order: list[str], col: str, width: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """Forward-only elapsed ticks: wraps are followed, small steps back ignored (WIN-5)."""

    def step(x: Column, prev: Column) -> Column:
        back = prev - x
        wrapped = F.when(back > (1 << (width - 1)), F.lit(1 << width) - back).otherwise(0)
        return F.when(back <= 0, -back).otherwise(wrapped)

    return scan(df, keys, order, span, elapsed=StepSum(F.col(col).cast("bigint"), step, lambda x: F.lit(0)))


def media_drift(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    col: str,
    width: int,
    hz: int = 90_000,
    time_us: str = "arrival_us",
    resync_us: int = 2_000_000,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Wall time minus media time since the last baseline, and the rows that set a new baseline (WIN-6).

    With x = wall - media since the start, drift against the baseline is x - x(baseline), and a baseline is set
    where that exceeds ``resync_us``: the greedy marking rule.
    """
    ticks = cut_lineage(elapsed_ticks(df, keys, order, col, width, span))
    lag_us = ticks.withColumn("__x", F.col(time_us) - F.expr(f"elapsed * 100 div {hz // 10_000}"))
    marked = greedy_marks(lag_us, keys, order, "__x", resync_us, strict=True, span=span, name="resync")
    # a resync row reports the drift that caused it, so its base is the one before it
    base = F.when(F.col("resync"), F.col("__x"))
    based = scan(marked, keys, order, span, __base=LastKnown(base), __prior=PriorKnown(base))
    drift = F.col("__x") - F.when(F.col("resync"), F.coalesce(F.col("__prior"), F.col("__x"))).otherwise(F.col("__base"))
    return based.select(*df.columns, "elapsed", drift.alias("drift_us"), (F.col("resync") & F.col("__prior").isNotNull()).alias("resync"))


def restamp_cc(packets: DataFrame, keys: list[str] = ["capture", "pid"], span: int = DEFAULT_SPAN) -> DataFrame:
    """Fresh continuity counters: payload-bearing packets so far, modulo 16 (WIN-19)."""
    counted = scan(packets, keys, ["pkt_no"], span, out_cc=RunningSum(F.col("has_payload").cast("bigint")))
    return counted.withColumn("out_cc", F.pmod("out_cc", F.lit(16)).cast("int"))


def remux_counters(packets: DataFrame, pid_map: DataFrame, strip_eit: bool = False, eit_pid: int = 0x12) -> DataFrame:
    """Packets passed and dropped per capture under a pid map ``capture, pid, out_pid`` (AGG-2)."""
    mapped = packets.join(pid_map.select("capture", "pid", F.lit(True).alias("mapped")), ["capture", "pid"], "left")
    passed = F.when(F.col("pid") == eit_pid, F.lit(not strip_eit)).otherwise(F.col("mapped").isNotNull())
    return mapped.groupBy("capture").agg(
        F.count_if(passed).alias("passed"), F.count_if(~passed).alias("dropped")
    )


def scramble_stats(packets: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Scrambling-control counts and parity flips per pid (AGG-14).

    A flip is an even packet after an odd one (or the reverse) with any clear packets between them ignored.
    """
    scrambled = scan(packets.filter("tsc >= 2").select("capture", "pid", "pkt_no", "tsc"), ["capture", "pid"], ["pkt_no"], span, prev=Lag(F.col("tsc")))
    flips = scrambled.groupBy("capture", "pid").agg(F.count_if(F.col("prev") != F.col("tsc")).alias("parity_flips"))
    counts = packets.groupBy("capture", "pid").agg(
        F.count_if(F.col("tsc") == 0).alias("clear"),
        F.count_if(F.col("tsc") == 1).alias("reserved"),
        F.count_if(F.col("tsc") == 2).alias("even"),
        F.count_if(F.col("tsc") == 3).alias("odd"),
    )
    return counts.join(flips, ["capture", "pid"], "left").na.fill(0, ["parity_flips"])


def repetition_audit(sections: DataFrame, intervals: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Largest and mean gap between repeats of a table against its nominal interval (WIN-15).

    ``sections``: ``capture, table_name, pkt_no, arrival_us``; ``intervals``: ``table_name, nominal_us``.
    """
    gaps = scan(sections, ["capture", "table_name"], ["pkt_no"], span, __prev=Lag(F.col("arrival_us")))
    gaps = gaps.withColumn("gap", F.col("arrival_us") - F.col("__prev"))
    per = gaps.groupBy("capture", "table_name").agg(
        F.count(F.lit(1)).alias("sections"), F.max("gap").alias("max_gap_us"),
        F.expr("sum(gap) div greatest(count(gap), 1)").alias("mean_gap_us"),
    )
    # `intervals` is a fixed dimension of at most one row per table kind.
    per_gap = gaps.join(intervals, "table_name").groupBy("capture", "table_name").agg(
        F.count_if(F.col("gap") > F.col("nominal_us")).alias("late")
    )
    return per.join(per_gap, ["capture", "table_name"])


# fixed values: nominal repetition of each table in microseconds
NOMINAL_INTERVALS_US = {"pat": 100_000, "pmt": 100_000, "cat": 100_000, "sdt": 2_000_000, "nit": 10_000_000, "eit": 1_000_000, "ait": 500_000}


def bitrate_budget(
    packets: DataFrame,
    target_bps: int,
    keys: list[str] = ["capture"],
    overage_us: int = 2_000_000,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """How far a stream runs ahead of its target rate, and the stuffing packets due when behind (WIN-16).

    Whole bits only: seconds and microseconds are multiplied apart, so long captures cannot overflow, and
    rounding down the bits due changes neither verdict.
    """
    counted = scan(packets, keys, ["pkt_no"], span, n=RunningSum(F.lit(1).cast("bigint")), start_us=First(F.col("arrival_us")))
    timed = counted.withColumn("__us", F.col("arrival_us") - F.col("start_us"))
    due = F.expr(f"(__us div 1000000) * {target_bps}L + ((__us % 1000000) * {target_bps}L) div 1000000")
    behind = due - F.col("n") * PACKET_BITS
    return timed.withColumn("__behind", behind).select(
        *packets.columns,
        (-F.col("__behind") > F.lit(target_bps * overage_us // 1_000_000)).alias("overage"),
        F.expr(f"CASE WHEN __behind > 0 THEN __behind div {PACKET_BITS} ELSE 0L END").alias("stuffing_due"),
    )


def overage_alerts(budget: DataFrame, keys: list[str] = ["capture"], cooldown_us: int = 30_000_000, span: int = DEFAULT_SPAN) -> DataFrame:
    """Overage rows that raise an alert: at most one per cooldown (WIN-16)."""
    over = budget.filter("overage")
    marked = greedy_marks(over, keys, ["pkt_no"], "arrival_us", cooldown_us, span=span, name="alert")
    return marked.filter("alert").drop("alert")


def packets_with_class(packets: DataFrame, changes: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Class of each packet's pid as known at that packet (JOIN-7).

    ``changes``: ``capture, pid, pkt_no, cls``, one row per (re)classification.
    """
    return asof_state(packets, changes, ["capture", "pid"], "pkt_no", ["cls"], span)


def take_duration(df: DataFrame, keys: list[str], time_us: str, seconds: float) -> DataFrame:
    """Rows until ``seconds`` have passed since the key's first row; 0 keeps everything (PRJ-21)."""
    if not seconds:
        return df
    starts = df.groupBy(*keys).agg(F.min(time_us).alias("__start"))
    return df.join(starts, keys).filter(F.col(time_us) - F.col("__start") < int(seconds * 1_000_000)).drop("__start")


def edge_events(results: DataFrame, keys: list[str], order: list[str], ok: Column, span: int = DEFAULT_SPAN) -> DataFrame:
    """Rows where an output starts failing or recovers, with the running error count (WIN-24)."""
    flagged = results.withColumn("ok", ok)
    seen = scan(flagged, keys, order, span, __prev=Lag(F.col("ok")), errors=RunningSum((~F.col("ok")).cast("bigint")))
    edge = F.when(~F.col("ok") & F.coalesce(F.col("__prev"), F.lit(True)), "failed").when(F.col("ok") & (F.col("__prev") == F.lit(False)), "recovered")
    return seen.withColumn("edge", edge).filter("edge IS NOT NULL").drop("__prev")


def capture_stats(packets: DataFrame, limit_s: int = 0) -> DataFrame:
    """Bytes, elapsed time and share of the duration limit per capture (AGG-19)."""
    elapsed = F.max("arrival_us") - F.min("arrival_us")
    percent = F.least(F.floor(elapsed / F.lit(max(limit_s, 1) * 10_000)), F.lit(100)) if limit_s else F.lit(None)
    return packets.groupBy("capture").agg(
        (F.count(F.lit(1)) * PACKET_BYTES).alias("bytes"), elapsed.alias("elapsed_us"), percent.cast("bigint").alias("percent")
    )


def output_stats(results: DataFrame) -> DataFrame:
    """Errors and current up flag per output (AGG-19). ``results``: ``output, arrival, ok``."""
    return results.groupBy("output").agg(
        F.count_if(~F.col("ok")).alias("errors"), F.max_by("ok", "arrival").alias("up")
    )
