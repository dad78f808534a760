"""Subtitle cues from teletext rows, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.operators.ordered import DEFAULT_SPAN, Lag, Lead, StepSum, scan
from airlens.session import cut_lineage

# fixed values: row gap that starts a new subtitle, shortest last cue, longest cue (ms)
GAP_MS, MIN_MS, MAX_MS = 500, 1200, 5000


def teletext_cues(rows: DataFrame, keys: list[str] = ["capture"], order: list[str] = ["i"], page: int | None = None, lead_ms: int = 0, span: int = DEFAULT_SPAN, max_rows: int | None = None) -> DataFrame:
    """Cues ``start_ms, end_ms, text`` from rows ``ts_ms, text`` in arrival order (WIN-20).

    Rows more than 500 ms apart start a new subtitle; a repeated row within one is dropped; a subtitle equal to the
    one on screen is a repeat. A cue ends where the next begins, after at most 5 s; the last one stays at least 1.2 s.
    ``max_rows`` keeps as many distinct rows of a subtitle; by default all.
    """
    shown = rows.withColumn("text", F.rtrim("text")).filter("text <> ''")
    last_ms = rows.groupBy(*keys).agg(F.max_by("ts_ms", order[0]).alias("__last_ms"))
    if page is not None:
        shown = shown.filter(~F.ltrim("text").rlike(f"^{page}"))
    grouped = scan(shown, keys, order, span, grp=StepSum(F.col("ts_ms"), lambda x, prev: (x - prev > GAP_MS).cast("bigint"), lambda x: F.lit(1)))
    once = grouped.groupBy(*keys, "grp", "text").agg(F.min(order[0]).alias("__i"), F.min_by("ts_ms", order[0]).alias("__ms"))
    # the first row of a subtitle is the first of its text
    begun = F.min_by("__ms", "__i").alias("start_ms")
    kept = once
    if max_rows is not None:
        rank = F.row_number().over(Window.partitionBy(*keys, "grp").orderBy("__i"))
        kept = once.withColumn("__rank", rank).filter(F.col("__rank") <= max_rows)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__i", F.ltrim("text").alias("t")))), lambda s: s["t"])
    texts = kept.groupBy(*keys, "grp").agg(F.array_join(F.filter(lines, lambda t: t != ""), "\n").alias("text"), begun).filter("text <> ''")
    # two scans below stand on the subtitles: they are few, the rows are read no more
    subtitles = cut_lineage(texts)
    fresh = scan(subtitles, keys, ["grp"], span, __prev=Lag(F.col("text"))).filter(~F.col("__prev").eqNullSafe(F.col("text")))
    followed = scan(cut_lineage(fresh), keys, ["grp"], span, __next=Lead(F.col("start_ms"))).join(last_ms, keys)
    hold = F.greatest(F.col("__last_ms"), F.col("start_ms") + MIN_MS)
    end = F.least(F.coalesce("__next", hold), F.col("start_ms") + MAX_MS)
    return followed.filter(end > F.col("start_ms")).select(
        *keys, F.greatest(F.col("start_ms") - lead_ms, F.lit(0)).alias("start_ms"), (end - lead_ms).alias("end_ms"), "text"
    )


def clip_cues(cues: DataFrame, starts: DataFrame, keys: list[str] = ["capture"]) -> DataFrame:
    """Cues relative to a recording start ``t0``: earlier ones go, overlapping ones are cut."""
    both = cues.join(starts, keys).filter(F.col("end_ms") > F.col("t0"))
    return both.withColumn("start_ms", F.greatest(F.col("start_ms") - F.col("t0"), F.lit(0))).withColumn("end_ms", F.col("end_ms") - F.col("t0")).drop("t0")


def _clock(ms):
    part = lambda unit, size: F.floor(ms / unit % size).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), (ms % 1000).cast("int"))


def cue_lines(cues: DataFrame) -> DataFrame:
    """One SubRip block body per cue (SNK-6); numbering is left to the writer, which knows the order."""
    line = F.concat(_clock(F.col("start_ms")), F.lit(" --> "), _clock(F.col("end_ms")), F.lit("\n"), "text")
    return cues.withColumn("line", line)
