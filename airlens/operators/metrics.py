"""Metric snapshots: datagram decoding, latest state per instance, and the text exposition."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens.functions.binary import U64, be64, u8
from airlens.functions.text import escape_label, split_composite_label
from airlens.operators import metric_catalog
from airlens.operators.ordered import DEFAULT_SPAN, RunPriorMax, scan

# fixed values: wire layout and limits
HEADER_BYTES, ID_BYTES, VERSION = 60, 32, 1
COMPONENTS = {i: f"component{i}" for i in range(1, 10)}


def metric_defs(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: 88 rows."""
    return spark.createDataFrame(metric_catalog.rows(), "def_ord int, id int, name string, kind string, label_name string, help string")


def _read(datagrams: pa.Array) -> pa.Array:
    return entries_of(datagrams)


ENTRIES = "array<struct<ord: int, id: int, label: string, raw: binary>>"


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as binary values."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def entries_of(datagrams: pa.Array) -> pa.Array:
    """Entries behind the header of each datagram: id, length of the label, label up to its first zero byte, value.

    A cut-off entry ends them. All datagrams of a batch step from entry to entry together.
    """
    n = len(datagrams)
    offsets = np.frombuffer(datagrams.buffers()[1], np.int32)[datagrams.offset : datagrams.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    held = datagrams.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    rows, at, end = np.arange(n), offsets[:-1] + HEADER_BYTES, offsets[1:]
    found = []
    while True:
        more = at + 11 <= end
        rows, at, end = rows[more], at[more], end[more]
        if not len(rows):
            break
        size = data[at + 2].astype(np.int64)
        whole = at + 11 + size <= end
        rows, at, end, size = rows[whole], at[whole], end[whole], size[whole]
        found.append((rows, np.full(len(rows), len(found), np.int32), at, size))
        at = at + 11 + size
    rows, order, at, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    by_row = np.argsort(rows, kind="stable")
    rows, order, at, size = rows[by_row], order[by_row], at[by_row], size[by_row]
    zeros = np.append(np.flatnonzero(data == 0), len(data))
    label = _gathered(data, at + 3, np.minimum(zeros[np.searchsorted(zeros, at + 3)] - at - 3, size))
    try:
        text = label.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no text are marked
        text = pa.array([x.decode("utf-8", "replace") for x in label.to_pylist()], pa.string())
    ids = data[at].astype(np.int32) * 256 + data[at + 1]
    flat = pa.StructArray.from_arrays([pa.array(order, pa.int32()), pa.array(ids, pa.int32()), text, _gathered(data, at + 3 + size, np.full(len(at), 8))], names=["ord", "id", "label", "raw"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), flat)


def decode_snapshots(
    datagrams: DataFrame, col: str = "datagram", components: dict[int, str] | None = None, max_entries: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Header, verdict and entries of each snapshot datagram (SRC-11).

    ``status`` is ok, malformed or version; a cut-off entry keeps the ones before it. Values are unsigned 64-bit.
    ``components`` names the sender kinds. ``max_entries`` drops and counts entries beyond it, ``max_bytes`` makes larger
    datagrams malformed; by default nothing is cut.
    """
    components = COMPONENTS if components is None else components
    p = F.col(col)
    number = u8(p, 1)
    names = F.create_map(*[F.lit(x) for pair in components.items() for x in pair])
    ident = F.split(F.decode(F.substring(p, 5, ID_BYTES - 1), "UTF-8"), "\x00")[0]
    status = (
        F.when(F.octet_length(p) > (F.lit(1 << 31) if max_bytes is None else max_bytes), "malformed").when(u8(p, 0) != VERSION, "version")
        .when((F.octet_length(p) < HEADER_BYTES) | ~number.isin(*components) | (ident == ""), "malformed").otherwise("ok")
    )
    # entries are read only where the header is good
    read = F.arrow_udf(_read, ENTRIES)
    rest = [c for c in datagrams.columns if c != col]
    ok = datagrams.withColumn("status", status)
    good = F.col("status") == "ok"
    head = lambda c: F.when(good, c)
    decoded = ok.select(
        *rest, "status", head(names[number]).alias("component"), head(ident).alias("metrics_id"), head(be64(p, 36)).alias("process_start"),
        head(be64(p, 44)).alias("sequence"), head(be64(p, 52)).alias("snapshot_time"), read(head(p)).alias("__e"),
    )
    value = F.transform("__e", lambda e: F.struct(e["ord"].alias("ord"), e["id"].alias("id"), e["label"].alias("label"), F.conv(F.hex(e["raw"]), 16, 10).cast(U64).alias("value")))
    if max_entries is None:
        return decoded.withColumn("entries", value).withColumn("dropped_entries", F.lit(0)).drop("__e")
    return decoded.withColumn("entries", F.slice(value, 1, max_entries)).withColumn("dropped_entries", F.greatest(F.size("__e") - max_entries, F.lit(0))).drop("__e")


INSTANCE = ["component", "metrics_id"]


def accepted_snapshots(snapshots: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Each snapshot with ``accepted``: first of its instance, after a restart, or newer than all accepted (WIN-1).

    A run is a stretch of one process start; rejected rows never change it, so a running maximum per run is exact.
    """
    top = scan(snapshots, INSTANCE, ["arrival"], span, __top=RunPriorMax(F.col("process_start"), F.col("sequence")))
    return top.withColumn("accepted", F.col("__top").isNull() | (F.col("sequence") > F.col("__top"))).drop("__top")


def latest_snapshots(snapshots: DataFrame, now_us: int | None = None, expiry_s: int = 30, span: int = DEFAULT_SPAN) -> DataFrame:
    """Last accepted snapshot per instance, without those older than ``expiry_s`` at ``now_us`` (WIN-1)."""
    accepted = accepted_snapshots(snapshots, span).filter("accepted").drop("accepted")
    rest = [c for c in accepted.columns if c not in INSTANCE]
    latest = accepted.groupBy(*INSTANCE).agg(F.max_by(F.struct(*rest), "arrival").alias("s"), F.min("arrival").alias("first_arrival")).select(*INSTANCE, "s.*", "first_arrival")
    return latest if now_us is None else latest.filter(F.lit(now_us) - F.col("recv_us") <= expiry_s * 1_000_000)


def snapshot_stats(decoded: DataFrame, max_instances: int | None = None, span: int = DEFAULT_SPAN) -> DataFrame:
    """One row of totals: received, rejected by reason and dropped entries (AGG-9).

    ``decoded``: rows with ``status, arrival, process_start, sequence, dropped_entries`` and the instance columns. With
    ``max_instances``, snapshots of later instances count as full.
    """
    bad = decoded.agg(F.count_if(F.col("status") == "malformed").alias("malformed"), F.count_if(F.col("status") == "version").alias("version"))
    judged = accepted_snapshots(decoded.filter("status = 'ok'"), span)
    full = F.lit(False)
    if max_instances is not None:
        first = judged.groupBy(*INSTANCE).agg(F.min("arrival").alias("__first"))
        admitted = first.orderBy("__first").limit(max_instances).select(*INSTANCE, F.lit(True).alias("__in"))
        judged = judged.join(admitted, INSTANCE, "left")
        full = F.col("__in").isNull()
    counted = judged.agg(
        F.count_if(F.col("accepted") & ~full).alias("received"), F.count_if(~F.col("accepted") & ~full).alias("stale"), F.count_if(full).alias("full"),
        F.coalesce(F.sum(F.when(F.col("accepted") & ~full, F.col("dropped_entries"))), F.lit(0)).cast("bigint").alias("dropped_entries"),
    )
    return counted.crossJoin(bad)  # one row each


def join_metric_defs(samples: DataFrame, defs: DataFrame) -> DataFrame:
    """Samples with their family; unknown ids are skipped (JOIN-11)."""
    return samples.join(defs, "id")


def group_families(samples: DataFrame, defs: DataFrame) -> DataFrame:
    """Families that have samples, in catalogue order (AGG-11). Samples stay rows: a family may hold most of them."""
    return join_metric_defs(samples, defs).groupBy("def_ord", "id", "name", "kind").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(*INSTANCE).alias("instances"))


def _base_labels() -> Column:
    return F.concat(F.lit('component="'), "component", F.lit('",headend_id="'), escape_label(F.col("metrics_id")), F.lit('"'))


@F.pandas_udf(T.StringType())
def _three_digits(value: pd.Series) -> pd.Series:
    """``%.3f`` as C prints it: from the exact value of the double, where ``format_string`` rounds its shortest decimal form."""
    return value.map("{:.3f}".format, na_action="ignore")


def render_openmetrics(samples: DataFrame, defs: DataFrame, instances: DataFrame, stats: DataFrame, now_us: int, prefix: str = "airlens_") -> DataFrame:
    """Exposition lines in order ``part, def_ord, line_kind, slot_ord, entry_ord`` (SNK-4, SRT-3).

    ``samples``: instance columns, ``slot_ord, entry_ord, id, label, value``; ``instances``: instance columns, ``slot_ord,
    recv_us``; ``stats``: the one row of ``snapshot_stats`` plus optional ``http_200, http_404``. Families without samples
    are left out.
    """
    def lines(df: DataFrame, part: int, kind: int, line: Column, def_ord=F.lit(0), slot=F.lit(0), entry=F.lit(0)) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"), def_ord.cast("int").alias("def_ord"), F.lit(kind).alias("line_kind"), slot.cast("bigint").alias("slot_ord"),
            entry.cast("bigint").alias("entry_ord"), line.alias("line"),
        )

    joined = join_metric_defs(samples, defs)
    name = F.concat(F.lit(prefix), F.col("name"))
    families = joined.select("def_ord", "name", "kind", "help").distinct()
    first, second = split_composite_label(F.col("label"))
    own = (
        F.when(F.col("label_name") == "input+reason", F.concat(F.lit(',input="'), escape_label(first), F.lit('",reason="'), escape_label(second), F.lit('"')))
        .when(F.col("label_name") != "", F.concat(F.lit(","), "label_name", F.lit('="'), escape_label(F.coalesce("label", F.lit(""))), F.lit('"'))).otherwise("")
    )
    sample = F.concat(name, F.lit("{"), _base_labels(), own, F.lit("} "), F.col("value").cast("string"))
    order = F.col("def_ord")
    parts = [
        lines(families, 0, 0, F.concat(F.lit("# HELP "), name, F.lit(" "), "help"), order),
        lines(families, 0, 1, F.concat(F.lit("# TYPE "), name, F.lit(" "), "kind"), order),
        lines(joined, 0, 2, sample, order, F.col("slot_ord"), F.col("entry_ord")),
    ]
    age = f"{prefix}metrics_snapshot_age_seconds"
    seconds = _three_digits((F.lit(now_us) - F.col("recv_us")) / 1_000_000)
    any_instance = instances.agg(F.count(F.lit(1)).alias("n"))
    some = any_instance.filter("n > 0")
    parts += [
        lines(some, 1, 0, F.lit(f"# HELP {age} age of the latest snapshot of an instance, in seconds")),
        lines(some, 1, 1, F.lit(f"# TYPE {age} gauge")),
        lines(instances, 1, 2, F.concat(F.lit(age + "{"), _base_labels(), F.lit("} "), seconds), slot=F.col("slot_ord")),
    ]
    reasons = ["malformed", "stale", "full", "version"]
    own_families = [
        ("metrics_instances", "gauge", "instances with a snapshot that has not expired", any_instance, [("", "n")]),
        ("metrics_snapshots_received_total", "counter", "snapshots taken over", stats, [("", "received")]),
        ("metrics_snapshots_rejected_total", "counter", "snapshots turned down, by cause", stats, [(f'{{reason="{r}"}}', r) for r in reasons]),
        ("metrics_snapshot_entries_dropped_total", "counter", "entries left out of snapshots that were taken over", stats, [("", "dropped_entries")]),
    ]
    if {"http_200", "http_404"} <= set(stats.columns):
        own_families.append(("metrics_http_requests_total", "counter", "requests for this page, by status", stats, [(f'{{status="{s}"}}', f"http_{s}") for s in (200, 404)]))
    for i, (suffix, kind, text, source, values) in enumerate(own_families):
        full = prefix + suffix
        entries = F.array(*[F.lit(f"# HELP {full} {text}"), F.lit(f"# TYPE {full} {kind}")], *[F.concat(F.lit(full + labels + " "), F.col(c).cast("string")) for labels, c in values])
        rows = source.select(F.posexplode(entries).alias("pos", "text"))
        parts.append(lines(rows, 2, 0, F.col("text"), F.lit(i), entry=F.col("pos")))
    parts.append(lines(any_instance, 3, 0, F.lit("# EOF")))
    return reduce(DataFrame.unionByName, parts)
