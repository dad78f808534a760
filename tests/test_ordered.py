"""Chunked scans and greedy marking against plain folds, with chunks small enough to cross many borders."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airlens.operators import bytechain
from airlens.operators import ordered as o
from airlens.operators.compose import inherited_states
from airlens.operators.greedy import _next_marks, greedy_marks
from airlens.operators.ts import bitrate_budget, continuity_errors, elapsed_ticks, media_drift, overage_alerts, pcr_discontinuities, unwrap


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("aab"), i, rnd.choice([None, rnd.randrange(50)]), rnd.randrange(1 << 16)) for i in range(400)]
    return spark.createDataFrame(data, "k string, t bigint, x bigint, raw bigint").cache()


@pytest.mark.parametrize("span", [1, 7, 64, 100000])
def test_scan_equals_windows(rows, span):
    x = F.col("x")
    got = o.scan(
        rows, ["k"], ["t"], span, lag=o.Lag(x), lead=o.Lead(x), total=o.RunningSum(x), top=o.PriorMax(x), known=o.LastKnown(x),
        before=o.PriorKnown(x), head=o.First(x), runs=o.changes(x), ext=o.StepSum(F.col("raw"), lambda a, b: a - b, lambda a: a),
    )
    w = Window.partitionBy("k").orderBy("t")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("__chg", (~x.eqNullSafe(F.lag(x).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("bigint")).select(
        "k", "t", "x", "raw", F.lag(x).over(w), F.lead(x).over(w), F.coalesce(F.sum(x).over(upto), F.lit(0)), F.max(x).over(prior),
        F.last(x, True).over(upto), F.last(x, True).over(prior), F.first(x).over(upto), F.sum("__chg").over(upto), F.col("raw"),
    )
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def fold_marks(values, threshold, strict):
    last, out = None, []
    for v in values:
        hit = last is None or (v - last > threshold if strict else v - last >= threshold)
        if hit:
            last = v
        out.append(hit)
    return out


@pytest.mark.parametrize("rising", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_greedy_marks_equal_a_fold(spark, rising, strict):
    rnd = random.Random(7)
    for span in (5, 50, 10000):
        data, want = [], {}
        for k in "ab":
            v, vals = 0, []
            for i in range(150):
                v = v + rnd.randrange(6) if rising else rnd.randrange(200) + i // 3
                vals.append(v)
                data.append((k, i, v))
            want[k] = fold_marks(vals, 12, strict)
        got = greedy_marks(spark.createDataFrame(data, "k string, i bigint, v bigint"), ["k"], ["i"], "v", 12, strict, span)
        for k in "ab":
            assert [r.marked for r in got.filter(F.col("k") == k).orderBy("i").collect()] == want[k]


@pytest.mark.parametrize("span", [1, 6, 40, 100000])
def test_sums_and_maxima_within_runs(spark, span):
    rnd = random.Random(21)
    data, sums, tops = [], {}, {}
    for k in "ab":
        run, top, total = None, None, 0
        for i in range(300):
            r, v, begins = rnd.choice([0, 0, 0, 1]) + i // 50, rnd.randrange(100), rnd.random() < 0.05
            total = v if begins else total + v
            top = None if r != run else top
            tops[k, i], sums[k, i] = top, total
            run, top = r, v if top is None else max(top, v)
            data.append((k, i, r, v, begins))
    df = spark.createDataFrame(data, "k string, i bigint, r int, v bigint, begins boolean")
    got = o.scan(df, ["k"], ["i"], span, total=o.SinceStart(F.col("v"), F.col("begins")), top=o.RunPriorMax(F.col("r"), F.col("v"))).collect()
    assert {(x.k, x.i): x.total for x in got} == sums
    assert {(x.k, x.i): x.top for x in got} == tops


def test_states_go_down_a_tree_of_maps(spark):
    """Hundreds of chunks with gaps and a null key: clamps x -> min(max(x + a, low), high) compose to clamps."""
    rnd = random.Random(11)
    rows, want = [], {}
    for k in (None, "a", "b"):
        now = 5
        for chunk in sorted(rnd.sample(range(-400, 900), 300)):
            add, low = rnd.randrange(-9, 10), rnd.randrange(-20, 5)
            high = low + rnd.randrange(0, 40)
            rows.append((k, chunk, add, low, high))
            want[k, chunk] = now
            now = min(max(now + add, low), high)

    def follow(state, one):
        return (min(max(state[0] + one[0], one[1]), one[2]),)

    def join(maps):
        add, low, high = maps[0]
        for a, lo, hi in maps[1:]:
            add, low, high = add + a, min(max(low + a, lo), hi), min(max(high + a, lo), hi)
        return int(add), int(low), int(high)

    maps = spark.createDataFrame(rows, "k string, chunk bigint, add bigint, low bigint, high bigint")
    for fan in (2, 7, 64, 2000):
        got = inherited_states(maps, ["k"], "chunk", ("add", "low", "high"), ("x",), (5,), follow, join, fan)
        assert {(r.k, r.chunk): r.x for r in got.collect()} == want
    assert inherited_states(maps.where("false"), ["k"], "chunk", ("add",), ("x",), (5,), follow, join).count() == 0


@pytest.mark.parametrize("rising", [True, False])
def test_greedy_marks_over_hundreds_of_chunks(spark, rising):
    rnd = random.Random(8)
    v, vals = 0, []
    for i in range(1500):
        v = v + rnd.randrange(4) if rising else rnd.randrange(300) + i // 2
        vals.append(v)
    data = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, i bigint, v bigint")
    got = greedy_marks(data, ["k"], ["i"], "v", 9, False, span=4, fan=5)
    assert [r.marked for r in got.orderBy("i").collect()] == fold_marks(vals, 9, False)


def test_next_marks_equal_a_search():
    rnd = random.Random(9)
    for _ in range(200):
        v = np.array([rnd.randrange(30) for _ in range(rnd.randrange(1, 40))], np.int64)
        want = [next((j for j in range(i + 1, len(v)) if v[j] >= v[i] + 5), len(v)) for i in range(len(v))]
        assert _next_marks(v, 5).tolist() == want


def test_byte_chains_over_hundreds_of_pieces(spark):
    """Records of a length byte and as many bytes; records longer than a piece, and a zero that ends the stream."""
    rnd = random.Random(10)
    streams = {k: b"".join(bytes([n]) + rnd.randbytes(n) for n in (rnd.choice([1, 2, 3, 30, 90]) for _ in range(120))) + end for k, end in (("a", b""), ("b", bytes(40)))}

    def step(buf, at):
        return -1 if at >= len(buf) or not buf[at] or at + 1 + buf[at] > len(buf) else at + 1 + buf[at]

    rows = [(k, i, s[i : i + 7]) for k, s in streams.items() for i in range(0, len(s), 7)]
    pieces = bytechain.byte_pieces(spark.createDataFrame(rows, "k string, i bigint, data binary"), ["k"], ["i"], "data", look=100, piece=32)
    got = bytechain.walk_records(pieces, ["k"], 100, lambda key: step, lambda key, buf, at, after: iter([(after - at,)]), "size int", piece=32, fan=4)
    for k, stream in streams.items():
        at, want = 0, []
        while (after := step(stream, at)) >= 0:
            want.append((at, after - at))
            at = after
        assert [(r.at, r.size) for r in got.where(F.col("k") == k).orderBy("at").collect()] == want


def test_media_drift_equals_a_fold(spark):
    rnd = random.Random(3)
    data, want, wall, raw = [], [], 0, 0
    base = last = None
    for i in range(200):
        wall += rnd.randrange(1, 400_000)
        raw = (raw + rnd.randrange(0, 30_000)) % (1 << 16)
        data.append(("c", i, wall, raw))
        if base is None:
            base, ticks, last = wall, 0, raw
            want.append((0, False))
            continue
        if raw >= last:
            ticks += raw - last
        elif last - raw > 1 << 15:
            ticks += (1 << 16) - last + raw
        last = raw
        drift = wall - (base + ticks * 100 // 9)
        want.append((drift, drift > 2_000_000))
        if drift > 2_000_000:
            base, ticks = wall, 0
    got = media_drift(spark.createDataFrame(data, "k string, i bigint, arrival_us bigint, raw bigint"), ["k"], ["i"], "raw", 16, span=16)
    rows = got.orderBy("i").collect()
    assert [r.resync for r in rows] == [w[1] for w in want]
    assert all(abs(r.drift_us - w[0]) <= 1 for r, w in zip(rows, want))  # one rounding of ticks per baseline


def packets(spark, rows):
    return spark.createDataFrame(rows, "capture int, pid int, pkt_no bigint, arrival_us bigint, has_payload int, disc int, cc int, pcr27 bigint")


def test_continuity_vector(spark):
    df = packets(spark, [(0, 257, i, i, 1, d, c, None) for i, (c, d) in enumerate([(0, 0), (1, 0), (5, 0), (9, 1)])])
    assert [r.cc_error for r in continuity_errors(df, span=2).orderBy("pkt_no").collect()] == [0, 0, 1, 0]


def test_duplicate_counter_is_an_error_and_empty_packets_do_not_reset(spark):
    df = packets(spark, [(0, 257, 0, 0, 1, 0, 3, None), (0, 257, 1, 1, 0, 1, 9, None), (0, 257, 2, 2, 1, 0, 3, None)])
    assert [r.cc_error for r in continuity_errors(df).orderBy("pkt_no").collect()] == [0, 1]


def test_clock_vector(spark):
    base = 27_000_000
    df = packets(spark, [(0, 257, i, i * 100_000, 1, 0, 0, p) for i, p in enumerate([base, base + 2_700_000, base * 50])])
    assert [r.pcr_jump for r in pcr_discontinuities(df, span=2).orderBy("pkt_no").collect()] == [0, 0, 1]


@pytest.mark.parametrize(
    "raws, width, want",
    [([100, 250], 32, 150), ([(1 << 32) - 10, 20], 32, 30), ([(1 << 33) - 5, 15], 33, 20), ([1000, 990], 32, 0), ([1000, 990, 1000], 32, 10)],
)
def test_tick_vectors(spark, raws, width, want):
    df = spark.createDataFrame([("k", i, r) for i, r in enumerate(raws)], "k string, i bigint, raw bigint")
    assert elapsed_ticks(df, ["k"], ["i"], "raw", width).orderBy(F.desc("i")).first().elapsed == want


def test_unwrap_goes_both_ways(spark):
    df = spark.createDataFrame([("k", i, r) for i, r in enumerate([65530, 4, 65535, 10])], "k string, i bigint, raw bigint")
    assert [r.ext for r in unwrap(df, ["k"], ["i"], "raw", 16, span=2).orderBy("i").collect()] == [65530, 65540, 65535, 65546]


def test_asof_state_and_first_n(spark):
    ev = spark.createDataFrame([("a", t) for t in (1, 5, 9)] + [("b", 3)], "k string, t bigint")
    st = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 4, "z")], "k string, t bigint, v string")
    got = {(r.k, r.t): r.v for r in o.asof_state(ev, st, ["k"], "t", ["v"], span=3).collect()}
    assert got == {("a", 1): None, ("a", 5): "x", ("a", 9): "y", ("b", 3): None}
    top = o.first_n_per_group(ev, ["k"], ["t"], 2).orderBy("k", "t").collect()
    assert [(r.k, r.t, r["rank"], r.overflow) for r in top] == [("a", 1, 1, 1), ("a", 5, 2, 1), ("b", 3, 1, 0)]


def test_budget_and_alerts(spark):
    df = spark.createDataFrame([(0, i, i * 1000) for i in range(100)], "capture int, pkt_no bigint, arrival_us bigint")
    over = bitrate_budget(df, 15_040, span=7)  # 10 packets per second of budget, 1000 sent
    rows = over.orderBy("pkt_no").collect()
    assert not rows[19].overage and rows[21].overage and all(r.stuffing_due == 0 for r in rows)
    assert overage_alerts(over, cooldown_us=30_000, span=7).count() == 3
