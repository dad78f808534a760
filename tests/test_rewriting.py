"""Rewritten tables: what is replaced by what, and how often packets are read for it."""

import struct

import pytest
from pyspark.sql import functions as F

from airlens.operators import psi
from airlens.plans import catalog  # noqa: F401
from airlens.plans.registry import QUERIES
from airlens.session import cut_lineage
from test_vectors import section

SCHEMA = "capture int, pid int, pkt_no bigint, pusi int, payload binary, pkt binary"
ES = "1be101f000"


def table(table_id: int, body: str) -> bytes:
    data = bytes.fromhex(body)
    return section(bytes([table_id]) + struct.pack(">H", 0xB000 + len(data) + 4) + data)


def pmt(loop: str, info: str = "f000") -> bytes:
    return table(2, "0007c10000e101" + info + loop)


def packets(pid: int, data: bytes, first: int, capture: int = 1):
    data = b"\0" + data
    out = []
    for i in range(0, len(data), 184):
        payload = data[i : i + 184].ljust(184, b"\xff")
        out.append((capture, pid, first + i // 184, int(i == 0), payload, struct.pack(">BHB", 0x47, pid + (0x4000 if i == 0 else 0), 0x1F) + payload))
    return out


def rewritten(spark, rows, span=1 << 18):
    df = spark.createDataFrame(rows, SCHEMA)
    starts = psi.section_starts(df, span)
    pids = spark.createDataFrame([(1, 100)], "capture int, pmt_pid int")
    dropped = spark.createDataFrame([(1, [258])], "capture int, pids array<int>")
    out = psi.rewrite_tables(df, starts, pids, dropped, span=span).orderBy("pid", "pkt_no").collect()
    return {(r.pid, r.pkt_no): bytes(r.pkt) for r in out}


def packet(pid: int, cc: int, data: bytes) -> bytes:
    return (struct.pack(">BHBB", 0x47, 0x4000 + pid, 0x10 + cc, 0) + data).ljust(188, b"\xff")


def test_what_is_kept_is_copied_as_it_stands(spark):
    # reserved bits that are not set stay so; a stream that overruns ends the list
    rows = packets(100, pmt("1b0101 0000" + "05e102f003 6f0100" + ES + "03e103f0ff"), 0)
    rows += packets(0, table(0, "0001c10000 0000e010 0007e064"), 1) + packets(0, table(0, "0001c10000 0007e064"), 2)
    got = rewritten(spark, rows)
    assert got == {
        (0, 1): packet(0, 1, table(0, "0001c10000 0007e064")), (0, 2): packet(0, 2, table(0, "0001c10000 0007e064")),
        (100, 0): packet(100, 1, pmt("1b0101 0000" + ES)),
    }


def test_descriptors_that_overrun_their_table_pass_unchanged(spark):
    rows = packets(100, pmt(ES, "f0ff"), 0)
    assert rewritten(spark, rows) == {(100, 0): rows[0][-1]}


@pytest.mark.parametrize("span", [1 << 18, 2])
def test_broken_and_longer_tables_take_the_last_known_one(spark, span):
    small, long = pmt(ES + "05e102f000"), pmt("03e105f000" * 60)
    broken = pmt(ES)[:-1] + b"\0"
    rows = packets(100, broken, 0) + packets(100, small, 2) + packets(100, broken, 4) + packets(100, long, 6) + packets(100, small, 9) + packets(100, long, 11) + packets(100, broken, 14)
    got = rewritten(spark, rows, span)
    rest = packet(100, 0, pmt(ES))
    at = lambda n: rest[:3] + bytes([0x10 + n]) + rest[4:]
    passed = next(r[-1] for r in rows if r[2] == 14)  # by then the long table is known, which fits no packet
    assert got == {(100, 2): at(1), (100, 4): at(2), (100, 6): at(3), (100, 9): at(4), (100, 11): at(5), (100, 14): passed}


def test_tables_of_one_packet_are_read_once_and_need_no_lookup(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [r for c in (1, 2, 3) for r in packets(0, table(0, "0001c10000 0007e064"), 0, c) + packets(100, pmt(ES), 1, c)]
    df = spark.createDataFrame(rows, SCHEMA).mapInArrow(count, SCHEMA)
    starts = psi.section_starts(df)
    tables = psi.psi_tables(psi.sections_of_starts(starts))
    out = psi.rewrite_tables(df, starts, tables["pat"], tables["es"].groupBy("capture").agg(F.collect_set("pid").alias("pids")))
    assert out.count() == 6
    assert seen.value == 6
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_packets_are_kept_only_where_one_may_pass_unchanged(spark):
    whole = packets(0, table(0, "0001c10000 0007e064"), 0) + packets(100, pmt(ES), 1)
    rest = packets(100, pmt(ES, "f0ff"), 2) + packets(100, pmt(ES)[:-1] + b"\0", 3) + packets(17, table(0x42, "0001c10000 0001ff"), 4) + packets(100, pmt("03e105f000" * 60), 5)
    starts = psi.section_starts(spark.createDataFrame(whole + rest, SCHEMA))
    kept = {r.pkt_no: r.pkt is not None for r in starts.collect()}
    assert kept == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True}


def test_lists_without_entries_and_a_walk_that_stops_behind_its_last_one(spark):
    sections = [pmt(""), pmt(ES), pmt(ES + "05"), pmt(ES + "03e105f0ff"), pmt("03e105f0036f0100" + ES)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sections)], "i int, b binary")
    loops = df.select("i", psi._es_loop(F.col("b"), F.lit(12)).alias("l")).orderBy("i").collect()
    assert [[e.pid for e in r.l] for r in loops] == [[], [257], [257], [257], [261, 257]]
    found = spark.createDataFrame([(i, bytes.fromhex(d)) for i, d in enumerate(["", "0a", "0a00", "0a0165", "0a01650900", "0a0965"])], "i int, d binary")
    items = found.select("i", psi.descriptors(F.col("d")).alias("l")).orderBy("i").collect()
    assert [[(d.tag, bytes(d.body)) for d in r.l] for r in items] == [[], [], [(10, b"")], [(10, b"e")], [(10, b"e"), (9, b"")], []]


def test_rewritten_packets_are_made_once_for_their_readers(spark, monkeypatch, tmp_path):
    from airlens.plans import tables

    written = []
    monkeypatch.setattr(tables, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    order = "o_orderkey bigint, o_custkey bigint, o_orderpriority string"
    spark.createDataFrame([(k, k, "1-URGENT") for k in range(1, 8)], order).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k * n, n) for k in range(1, 8) for n in (1, 2)], "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["rewrite_tables_contents"](spark, str(tmp_path))
    assert "pkt" in written[-1] and found.count() > 7
