"""Loss repair: feedback lookup, retransmission matching, delivery outcomes, burst admission and pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.once import evaluate_once
from airlens.operators.ordered import DEFAULT_SPAN, Lead, RunningSum, asof_state, scan
from airlens.operators.rtp import GAP_MAX, missing_sequences, rtp_gaps
from airlens.operators.services import resolve_slot
from airlens.session import cut_lineage



def repair_lookup(nack_seqs: DataFrame, packets: DataFrame, ring: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """Whether each requested number is still in the repair ring (JOIN-9).

    It is when the last packet stored in slot ``seq % ring`` up to the request carries that number.
    """
    slot = F.pmod(F.col("seq"), F.lit(ring))
    asked = nack_seqs.withColumn("__slot", slot)
    stored = packets.select("channel", slot.alias("__slot"), "arrival", F.col("seq").cast("int").alias("__stored"))
    found = asof_state(asked, stored, ["channel", "__slot"], "arrival", ["__stored"], span)
    return found.select(*nack_seqs.columns, F.coalesce(F.col("__stored") == F.col("seq"), F.lit(False)).alias("repairable"))


def repair_match(gaps: DataFrame, rtx: DataFrame, wait_us: int = 200_000) -> DataFrame:
    """Retransmissions that arrive in time for a lost number (JOIN-10).

    ``gaps``: ``channel, ssrc, seq, gap_us``; ``rtx``: ``channel, ssrc, osn, rtx_us``. Time is cut into buckets one wait
    long, so a number that wraps around many times still meets only its own neighbourhood.
    """
    bucket = F.expr(f"gap_us div {wait_us}")
    wanted = gaps.withColumn("__b", F.explode(F.array(bucket, bucket + 1)))
    offered = rtx.select("channel", "ssrc", F.col("osn").alias("seq"), "rtx_us", F.expr(f"rtx_us div {wait_us}").alias("__b"))
    hit = wanted.join(offered, ["channel", "ssrc", "seq", "__b"]).filter((F.col("rtx_us") >= F.col("gap_us")) & (F.col("rtx_us") <= F.col("gap_us") + wait_us))
    return hit.groupBy("channel", "ssrc", "seq", "gap_us").agg(F.min("rtx_us").alias("rtx_us"))


def rtp_repair(
    originals: DataFrame, rtx: DataFrame, wait_us: int = 200_000, span: int = DEFAULT_SPAN, hold_bytes: int | None = None, window: int = GAP_MAX
) -> DataFrame:
    """Every delivered or lost number of each channel with its source, in delivery order ``run, ext`` (batch of STR-2).

    ``originals``: ``channel, arrival, arrival_us, ssrc, seq, payload_len``; ``rtx``: ``channel, arrival, arrival_us, ssrc, osn,
    payload_len``, both numbered by one ``arrival`` order. Sources: ok, gap (the packet that revealed one), resync,
    reordered (late original), repaired (retransmission), lost.

    No fold is needed: while a gap is open its window ends at the highest number seen, and each new gap replaces
    the open one whatever its state. So a gap lives until the earliest of its deadline, the next gap, run or
    oversize packet, and the packet that would overfill the ``window``; a lost number is delivered by the
    first late original or retransmission within that life.
    """
    # five branches below read the verdicts
    judged = cut_lineage(rtp_gaps(originals, span=span, gap_max=window).select("channel", "run", "arrival", "arrival_us", "ssrc", "seq", "ext", "delta", "verdict", "payload_len"))
    small = F.lit(True) if hold_bytes is None else F.col("payload_len") <= hold_bytes
    opens = (F.col("verdict") == "gap") & small
    direct = judged.filter("verdict <> 'stale'").select(
        "channel", "run", "ext", F.col("seq").cast("int").alias("seq"), F.when((F.col("verdict") == "gap") & ~small, "resync").otherwise(F.col("verdict")).alias("source")
    )
    # what ends a gap: another packet ahead of the window, a new run, or an oversize packet in order
    first_of_run = judged.groupBy("channel", "run").agg(F.min("arrival").alias("arrival")).withColumn("__starts", F.lit(True))
    ends = judged.join(first_of_run, ["channel", "run", "arrival"], "left").filter((F.col("delta") > 0) | F.col("__starts") | ((F.col("delta") == 0) & ~small))
    bounded = scan(ends.drop("__starts"), ["channel"], ["arrival"], span, __end=Lead(F.col("arrival")))
    gaps = bounded.filter(opens).select(
        "channel", "run", "ssrc", "ext", "seq", "delta", "arrival", "verdict", F.col("arrival").alias("gap_arrival"), F.col("arrival_us").alias("gap_us"), "__end"
    )
    gaps = cut_lineage(gaps)
    lost = missing_sequences(gaps).join(gaps.select("channel", "run", "arrival", "ssrc", "gap_us", "__end"), ["channel", "run", "arrival"]).withColumnRenamed("arrival", "gap_arrival")

    # the packet that would need one place more than there are for this number
    over = judged.filter("delta = 0").select("channel", "run", (F.col("ext") - window).alias("ext"), F.col("arrival").alias("__over"))
    late = judged.filter("verdict = 'stale'").filter(small).groupBy("channel", "run", "ext").agg(F.min(F.struct("arrival", "arrival_us")).alias("__late"))
    placed = cut_lineage(lost.join(over, ["channel", "run", "ext"], "left").join(late, ["channel", "run", "ext"], "left"))

    bucket = F.expr(f"gap_us div {wait_us}")
    wanted = placed.withColumn("__b", F.explode(F.array(bucket, bucket + 1))).select("channel", "run", "ext", "ssrc", "seq", "gap_arrival", "gap_us", "__b")
    offered = rtx.filter(small).select("channel", "ssrc", F.col("osn").alias("seq"), F.col("arrival").alias("__a"), F.col("arrival_us").alias("__us"), F.expr(f"arrival_us div {wait_us}").alias("__b"))
    repairs = (
        wanted.join(offered, ["channel", "ssrc", "seq", "__b"])
        .filter((F.col("__a") > F.col("gap_arrival")) & (F.col("__us") <= F.col("gap_us") + wait_us))
        .groupBy("channel", "run", "ext").agg(F.min("__a").alias("__rtx"))
    )
    never = F.lit(1 << 62)
    in_time = F.when(F.col("__late.arrival_us") <= F.col("gap_us") + wait_us, F.col("__late.arrival"))
    filled = placed.join(repairs, ["channel", "run", "ext"], "left").withColumn("__late_at", F.coalesce(in_time, never)).withColumn("__rtx_at", F.coalesce("__rtx", never))
    fill = F.least("__late_at", "__rtx_at")
    # the window overfills at the first such packet whose number is still open
    overfill = F.when(F.col("__over") < fill, F.col("__over"))
    closing = filled.withColumn("__fill", fill).groupBy("channel", "run", "gap_arrival").agg(F.min(overfill).alias("__overfill"))
    judged_lost = filled.withColumn("__fill", fill).join(closing, ["channel", "run", "gap_arrival"])
    life = F.least(F.coalesce("__end", never), F.coalesce("__overfill", never))
    # a fill and the end never share an arrival: one arrival is one packet
    source = F.when((F.col("__fill") >= life) | (F.col("__fill") == never), "lost").when(F.col("__late_at") <= F.col("__rtx_at"), "reordered").otherwise("repaired")
    return direct.unionByName(judged_lost.select("channel", "run", "ext", "seq", source.alias("source")))


def burst_admission(requests: DataFrame, bound_ms: int = 0, enabled: bool = True) -> DataFrame:
    """Answer code of each fast-channel-change request; first rule that matches wins (PRJ-17).

    Needs the request columns ``ignore_media_ssrc, min_fill_ms, max_fill_ms, max_bps, client_allowed, channel_allowed`` and the
    channel state joined as of the request: ``known, has_rap, depth_ms, nominal_bps``.
    """
    if not enabled:
        return requests.withColumn("response", F.lit(504))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    bound = F.col("min_fill_ms") > bound_ms if bound_ms > 0 else F.lit(False)
    code = (
        F.when(no(F.col("client_allowed")), 505)
        .when(F.col("known") & no(F.col("channel_allowed")), 506)
        .when(no(F.col("known")), F.when(F.col("ignore_media_ssrc"), 510).otherwise(509))
        .when(bound, 401)
        .when(F.col("max_fill_ms") == 0, 402)
        .when(F.col("min_fill_ms") > F.col("max_fill_ms"), 400)
        .when(no(F.col("has_rap")), 508)
        .when(F.col("depth_ms") < F.col("min_fill_ms"), 507)
        .when(F.col("max_bps") <= F.col("nominal_bps"), 403)
        .otherwise(200)
    )
    return requests.withColumn("response", code)


def nack_pressure(nacks: DataFrame, threshold: int = 5, keys: list[str] = ["session"], order: list[str] = ["arrival"], span: int = DEFAULT_SPAN) -> DataFrame:
    """Requests per burst session and what they trigger (AGG-13): halve the rate once at half the threshold, stop at it."""
    counted = scan(nacks, keys, order, span, nack_count=RunningSum(F.lit(1).cast("bigint")))
    action = F.lit("none")
    if threshold > 0:
        action = F.when(F.col("nack_count") >= threshold, "terminated")
        if threshold // 2 > 0:
            action = action.when(F.col("nack_count") == threshold // 2, "adapted")
        action = action.otherwise("none")
    return counted.withColumn("action", action)


def retransmit_totals(rtx: DataFrame) -> DataFrame:
    """Packets, bytes and sessions served by retransmission per channel (AGG-18). ``rtx``: ``channel, session, payload_len``."""
    return rtx.groupBy("channel").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("payload_len").cast("bigint").alias("bytes"), F.count_distinct("session").alias("sessions")
    )


def requested_slot(base_port: int, max_channels: int) -> Column:
    """Table slot that a request's dedicated port names. Without one the request gets a number of its own below zero, which no
    channel has: as nulls they would all meet in one task of a join."""
    slot = F.col("dest_port") - base_port
    return F.when(slot.between(0, max_channels - 1), slot).otherwise(-1 - F.pmod(F.xxhash64("request", "media_ssrc"), F.lit(1 << 30)))


def resolve_channel(requests: DataFrame, channels: DataFrame, base_port: int, max_channels: int) -> DataFrame:
    """Channel of each request, by dedicated port or else by media ssrc (JOIN-14).

    ``channels``: ``ord, channel, address, port, ssrc``; a slot belongs to its first occupant. ``requests``: ``request,
    dest_port, media_ssrc`` and, if they have it, ``ignore_media_ssrc``: such a request goes by its port alone.
    """
    # the join's filter on its key would hash every address a second time
    slotted = evaluate_once(channels, "__slot", resolve_slot(F.col("address"), F.col("port"), max_channels))
    by_slot = slotted.groupBy("__slot").agg(F.min_by("channel", "ord").alias("by_port"))
    by_ssrc = channels.groupBy("ssrc").agg(F.min_by("channel", "ord").alias("by_ssrc"))
    asked = requests.withColumn("__slot", requested_slot(base_port, max_channels))
    joined = asked.join(by_slot, "__slot", "left").join(by_ssrc, asked["media_ssrc"] == by_ssrc["ssrc"], "left")
    by_ssrc = F.col("by_ssrc")
    if "ignore_media_ssrc" in requests.columns:
        by_ssrc = F.when(~F.coalesce("ignore_media_ssrc", F.lit(False)), by_ssrc)
    return joined.select(*requests.columns, F.coalesce("by_port", by_ssrc).alias("channel"))
