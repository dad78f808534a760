"""Streams against their batch twins and folds."""

import functools
import os
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlens.operators import cues, docs, metrics, repair, rtp, ts
from airlens.plans import live
from airlens.streaming import folds
from airlens.streaming import operators as st


def replay(spark, df, name, transform, order, files=4, mode="append"):
    """Write rows as ordered files, stream them one by one, return what came out."""
    source, check = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    df.orderBy(order).coalesce(1).sortWithinPartitions(order).write.option("maxRecordsPerFile", max(df.count() // files, 1)).mode("overwrite").parquet(source)
    # files are taken by age: make their ages follow their names
    for i, part in enumerate(sorted(p for p in os.listdir(source) if p.startswith("part"))):
        os.utime(os.path.join(source, part), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    query = (
        transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    return spark.table(name)


def rtp_rows(n, seed):
    rnd = random.Random(seed)
    rows, seq, at, ssrc = [], 65500, 0, 1
    for i in range(n):
        at += rnd.choice([1000, 20_000, 60_000, 300_000])
        if rnd.random() < 0.01:
            ssrc, seq = ssrc + 1, rnd.randrange(65536)
        roll = rnd.random()
        if roll < 0.08:
            seq += rnd.choice([2, 3, 5, 20, 31, 32, 40])
        elif roll < 0.16:
            seq -= rnd.choice([1, 2, 3])
        else:
            seq += 1
        size = 1600 if rnd.random() < 0.03 else 1316
        rows.append({"kind": "original", "arrival": 2 * i, "arrival_us": at, "ssrc": ssrc, "seq": seq % 65536, "payload_len": size})
        if rnd.random() < 0.3:
            back = (seq - rnd.choice([1, 2, 3, 4])) % 65536
            rows.append({"kind": "repair", "arrival": 2 * i + 1, "arrival_us": at + 500, "ssrc": ssrc if rnd.random() < 0.9 else 99, "seq": back, "payload_len": 1600 if rnd.random() < 0.05 else 1316})
    return rows


REPAIR_SCHEMA = "channel int, kind string, arrival bigint, arrival_us bigint, ssrc bigint, seq int, payload_len int"


@pytest.mark.parametrize("seed, span", [(1, 50), (2, 7), (3, 1 << 18)])
def test_batch_repair_equals_the_fold(spark, seed, span):
    want, data = [], []
    for channel in (0, 1):
        rows = rtp_rows(300, seed * 10 + channel)
        # the batch form knows no end of stream: close the last gap with a distant packet
        last = rows[-1]
        rows.append({**last, "kind": "original", "arrival": 10_000, "arrival_us": last["arrival_us"] + 10_000_000, "ssrc": 777, "seq": 1, "payload_len": 100})
        want += [(channel, *r) for r in folds.run(folds.RtpRepair(), rows)]
        data += [(channel, r["kind"], r["arrival"], r["arrival_us"], r["ssrc"], r["seq"], r["payload_len"]) for r in rows]
    df = spark.createDataFrame(data, REPAIR_SCHEMA)
    got = repair.rtp_repair(df.filter("kind = 'original'"), df.filter("kind = 'repair'").withColumnRenamed("seq", "osn"), span=span)
    result = [(r.channel, r.run, r.seq, r.source) for r in got.orderBy("channel", "run", "ext").collect()]
    assert result == want


def ended(df, keys, **later):
    """The rows and a closing row for each key."""
    return functools.reduce(lambda a, b: a.unionByName(b), live.closed(df, keys, **later))


def test_repair_stream_equals_the_fold(spark):
    rows = rtp_rows(200, 5)
    df = spark.createDataFrame([(0, r["kind"], r["arrival"], r["arrival_us"], r["ssrc"], r["seq"], r["payload_len"]) for r in rows], REPAIR_SCHEMA)
    got = replay(spark, ended(df, ["channel"], arrival="arrival + 1000"), "repaired", lambda s: st.rtp_repair(s), "arrival").collect()
    assert [(r.run, r.seq, r.source) for r in got] == folds.run(folds.RtpRepair(), rows, {})


def snapshots(spark, n=200, seed=4):
    rnd = random.Random(seed)
    data, at = [], 0
    for i in range(n):
        at += rnd.choice([1_000_000, 5_000_000, 40_000_000])
        data.append((rnd.choice(["sds", "rec"]), rnd.choice(["a", "b"]), i, at, i // 70, i - rnd.choice([0, 0, 0, 30])))
    return data, spark.createDataFrame(data, "component string, metrics_id string, arrival bigint, recv_us bigint, process_start bigint, sequence bigint")


def test_metric_store_stream_equals_the_fold(spark):
    data, df = snapshots(spark)
    want = set()
    for key in {r[:2] for r in data}:
        rows = [{"arrival": r[2], "recv_us": r[3], "process_start": r[4], "sequence": r[5]} for r in data if r[:2] == key]
        want |= {(*key, *o) for o in folds.run(folds.MetricStore(), rows, {"recv_us": 10**12})}
    closing = ended(df, ["component", "metrics_id"], arrival="arrival + 1000", recv_us="1000000000000")
    assert {tuple(r) for r in replay(spark, closing, "store", lambda s: st.metric_store(s), "arrival").collect()} == want


def test_accepted_snapshots_equal_the_fold_without_expiry(spark):
    data, df = snapshots(spark, seed=9)
    want = set()
    for key in {r[:2] for r in data}:
        rows = [{"arrival": r[2], "recv_us": r[3], "process_start": r[4], "sequence": r[5]} for r in data if r[:2] == key]
        want |= {o[1] for o in folds.run(folds.MetricStore(1 << 60), rows)}
    got = {r.arrival for r in metrics.accepted_snapshots(df, span=9).filter("accepted").collect()}
    assert got == want


def test_restart_vectors():
    step = lambda rows: [r[3] for r in folds.run(folds.MetricStore(), rows) if r[0] == "accepted"]
    row = lambda start, seq, us=0: {"arrival": 0, "recv_us": us, "process_start": start, "sequence": seq}
    assert step([row(100, 50), row(200, 1)]) == [50, 1]
    assert step([row(100, 5), row(100, 5), row(100, 4)]) == [5]
    assert step([row(100, 5), row(100, 4, 31_000_000)]) == [5, 4]


def test_document_stream_equals_batch(spark):
    rnd = random.Random(8)
    data = [(2, rnd.randrange(3), v := i // 60, n := rnd.randrange(4), 3, f"{v}-{n};", i) for i in range(180)]
    df = spark.createDataFrame(data, "payload_id int, segment_id int, version int, section_number int, last_section_number int, payload string, arrival bigint")
    batch = {(r.segment_id, r.version, r.document) for r in docs.doc_reassembly(df, span=7).collect()}
    got = {(r.segment_id, r.version, r.document) for r in replay(spark, df, "documents_out", st.doc_reassembly, "arrival").collect()}
    assert got == batch and batch


def test_document_stream_checks_binary_documents_like_batch(spark):
    """Right and wrong checksums, repeats after completion, sections that claim a checksum too early."""
    rnd = random.Random(12)
    rows, at = [], 0
    for version in range(12):
        parts = [rnd.randbytes(rnd.randrange(0, 40)) for _ in range(3)]
        crc = mpeg_crc(b"".join(parts)) ^ (version % 3 == 1)
        order = [0, 1, 2, rnd.randrange(3), 2, 1, 0]
        rnd.shuffle(order)
        for n in order:
            at += 1
            rows.append((1, 5, version, n, 2, bytearray(parts[n]), at, n == 2 or version == 6, crc if n == 2 else None))
    df = spark.createDataFrame(rows, "payload_id int, segment_id int, version int, section_number int, last_section_number int, payload binary, arrival bigint, crc_present boolean, crc bigint")
    batch = {(r.version, bytes(r.document)) for r in docs.doc_reassembly(df, span=3).collect()}
    got = [(r.version, bytes(r.document)) for r in replay(spark, df, "binary_out", st.doc_reassembly, "arrival").collect()]
    assert set(got) == batch and len(got) == len(batch) == 7


def mpeg_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc >> 31 else 0)
    return crc


def test_checksums_of_parts_join():
    rnd = random.Random(13)
    for _ in range(50):
        parts = [rnd.randbytes(rnd.randrange(0, 60)) for _ in range(rnd.randrange(1, 6))]
        assert folds.joined_crc([(folds.part_crc(p), len(p)) for p in parts]) == mpeg_crc(b"".join(parts))


def rtp_stream(spark):
    rnd = random.Random(2)
    data, at = [], 0
    for i in range(300):
        at += rnd.choice([10_000, 400_000, 3_000_000])
        data.append((rnd.randrange(2), i, at, rnd.choice([188, 1316, 1500])))
    return spark.createDataFrame(data, "channel int, arrival bigint, arrival_us bigint, payload_len int")


def test_bitrate_streams_equal_batch(spark):
    df = rtp_stream(spark)
    exact = {(r.channel, r.open_s, r.close_s, r.bytes) for r in rtp.channel_bitrate_exact(df, span=37).collect()}
    assert exact == {(r.channel, r.open_s, r.close_s, r.bytes) for r in replay(spark, df, "rates_exact", st.bitrate_stream_exact, "arrival").collect()}
    tumbling = {tuple(r) for r in rtp.channel_bitrate(df).collect()}
    assert {tuple(r) for r in replay(spark, df.union(live.far(df, "arrival_us", "arrival")), "rates", st.bitrate_stream, "arrival_us").collect()} == tumbling


def test_activity_stream_equals_batch(spark):
    df = rtp_stream(spark)
    batch = {(r.channel, r.first_us, r.last_us, r.rows) for r in rtp.activity_sessions(df, ["channel"], "arrival_us", ["arrival"], 500_000, span=11).collect()}
    late = df.union(live.far(df, "arrival_us", "arrival"))
    got = {(r.channel, r.first_us, r.last_us, r.rows) for r in replay(spark, late, "sessions", lambda s: st.activity_stream(s, ["channel"], "arrival_us", 500_000), "arrival_us").collect()}
    assert got == batch


def test_integrity_stream_equals_batch(spark):
    rnd = random.Random(6)
    data = []
    for i in range(240):
        data.append((0, 256 + i % 2, i, i * 100_000, int(rnd.random() < 0.8), int(rnd.random() < 0.1), rnd.randrange(16), (i * 2_700_000 if rnd.random() < 0.9 else i) if i % 3 == 0 else None))
    df = spark.createDataFrame(data, "capture int, pid int, pkt_no bigint, arrival_us bigint, has_payload int, disc int, cc int, pcr27 bigint")
    rows = replay(spark, df, "integrity", st.integrity_stream, "pkt_no", mode="update")
    assert rows.count() == 2 * 4  # a row a key and micro-batch
    got = rows.groupBy("pid").agg(F.max_by(F.struct("packets", "continuity_errors", "discontinuities", "pcr_discontinuities"), "pkt_no").alias("t"))
    batch = {r.pid: r.n for r in ts.continuity_errors(df, span=13).groupBy("pid").agg(F.sum("cc_error").alias("n")).collect()}
    jumps = {r.pid: r.n for r in ts.pcr_discontinuities(df, ["capture", "pid"], span=13).groupBy("pid").agg(F.sum("pcr_jump").alias("n")).collect()}
    for r in got.collect():
        assert (r.t.packets, r.t.continuity_errors, r.t.pcr_discontinuities) == (120, batch[r.pid], jumps[r.pid])


def test_service_discovery_stream(spark):
    rows = [(1, 0, 0, "pat", 5, 100, None), (1, 1, 1, "pmt", 5, 100, None), (1, 2, 2, "sdt", 5, 0, "One"), (2, 10_000, 3, "pat", 7, 101, None), (3, 9_000_000, 4, "pat", 8, 102, None), (3, 20_000_000, 5, "pmt", 8, 102, None), (4, 40_000_000, 6, "pat", 1, 1, None)]
    rows = [(r[0], r[1] + 10**15, *r[2:]) for r in rows]  # times near 1970 would count as late
    df = spark.createDataFrame(rows, "capture int, us bigint, ord bigint, kind string, program_number int, pmt_pid int, service_name string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a timer fires when its partition gets rows
    try:
        found = replay(spark, df, "found", st.service_discovery, "ord", files=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.capture, r.outcome, r.program_number, r.resolved, r.service_name) for r in found}
    assert {(1, "complete", 5, True, "One"), (2, "timeout", 7, False, None), (3, "timeout", 8, False, None)} <= got


def test_dedupe_stream(spark):
    df = spark.createDataFrame([(2, i % 3, i // 30, i * 1000) for i in range(60)], "payload_id int, segment_id int, version int, arrival_us bigint")
    assert replay(spark, df, "once", st.dedupe_segments, "arrival_us").count() == 6


def cue_rows(seed):
    rnd = random.Random(seed)
    at, rows = 1000, []
    for i in range(150):
        at += rnd.choice([100, 300, 600, 2500, 7000])
        rows.append({"i": i, "ts_ms": at, "text": rnd.choice(["hello", " world ", "x", "  ", "hello"])})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_cues_equal_the_fold(spark, seed):
    rows = cue_rows(seed)
    want = folds.run(folds.Cues(100), rows, {})
    df = spark.createDataFrame([(0, r["i"], r["ts_ms"], r["text"]) for r in rows], "capture int, i bigint, ts_ms bigint, text string")
    got = cues.teletext_cues(df, lead_ms=100, span=17).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == want
    stream = replay(spark, ended(df, ["capture"], i="i + 1000"), f"cues{seed}", lambda s: st.cue_stream(s, 100), "i").collect()
    streamed = sorted((r.start_ms, r.end_ms, r.text) for r in stream)
    assert streamed == want


def test_stretches_give_what_steps_give():
    """Rows taken at once against one by one, with batches cut anywhere."""
    rnd = random.Random(14)
    cases = [(folds.RtpRepair(), rtp_rows(400, 3)), (folds.ExactBitrate(), [{"arrival": i, "arrival_us": i * 300_000 + rnd.randrange(900_000), "payload_len": i} for i in range(300)])]
    cases.append((folds.MetricStore(5_000_000), [{"recv_us": i * 1_000_000 + (i // 50) * 9_000_000, "arrival": i, "process_start": i // 120, "sequence": i - rnd.choice([0, 0, 0, 9])} for i in range(400)]))
    for fold, rows in cases:
        state, out, at = {}, [], 0
        while at < len(rows):
            n = rnd.randrange(1, 60)
            columns = {k: np.array([r[k] for r in rows[at : at + n]]) for k in rows[0]}
            size, i = len(rows[at : at + n]), 0
            while i < size:
                after, some = fold.stretch(state, columns, i, size)
                if after == i:
                    some, after = fold.step(state, rows[at + i]), i + 1
                out, i = out + some, after
            at += size
        assert out == folds.run(fold, rows)


def test_window_state_is_a_map_by_number():
    state, fold = {}, folds.RtpRepair()
    for row in rtp_rows(80, 1):
        fold.step(state, row)
        packed = fold.packed(state)
        assert fold.unpacked(packed)["hold"] == state["hold"] and packed["size"] == len(state["hold"])
        assert all(0 <= n < 65536 and s for n, s in packed["hold"].items())


def test_calls_to_the_state_store_do_not_grow_with_the_keys():
    calls = []

    class Held:
        rows: list = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = rows

        def clear(self):
            calls.append("clear")
            self.rows = []

    class Handle:
        def getListState(self, name, schema):
            return Held()

        def listTimers(self):
            return iter(())

        def registerTimer(self, at):
            calls.append(at)

    fold = folds.MetricStore()
    keyed = st._Keyed(fold, ["event", "arrival", "process_start", "sequence", "recv_us"], True)
    keyed.init(Handle())
    for batch in range(2):
        rows = pd.DataFrame({"arrival": range(900), "recv_us": [batch * 1_000_000 + n for n in range(900)], "process_start": 1, "sequence": batch, st.KEY: [str(n % 300) for n in range(900)], st.GROUP: 7})
        (out,) = keyed.handleInputRows((7,), iter([rows]), None)
        assert len(out) == 300 and set(out[st.KEY]) == {str(n) for n in range(300)}
    assert calls == ["get", 30_001, "put", "get", 31_001, "put"]


def test_parts_of_one_size_are_shifted_alike():
    folds._shift.cache_clear()
    folds.joined_crc([(n, 1452) for n in range(40)])
    assert folds._shift.cache_info().misses == 1
