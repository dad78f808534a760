"""Queries against their SQL on a few rows with keys and times that the smallest data lacks."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from airlens.operators import bytechain, guide, psi
from airlens.plans import catalog  # noqa: F401
from airlens.plans.registry import ORACLES, QUERIES
from airlens.session import cut_lineage
from tests_compare import compare, duck

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
START = datetime.datetime(2024, 1, 1)


def event(number, user, kind="click", us=None):
    return (number, START + datetime.timedelta(microseconds=number * 1_000_000 if us is None else us), user, kind, 1.5, "{}")


@pytest.fixture
def agree(spark, tmp_path):
    def check(name, customers=(), events=()):
        keys = [(k, f"Customer#{k:09d}", 1, 0.0, "X") for k in customers]
        spark.createDataFrame(keys, CUSTOMER).write.parquet(f"{tmp_path}/made/customer")
        spark.createDataFrame(list(events), EVENTS).write.parquet(f"{tmp_path}/made/events")
        (tmp_path / "in").mkdir()
        for table in ("customer", "events"):
            spark.read.parquet(f"{tmp_path}/made/{table}").coalesce(1).write.parquet(f"{tmp_path}/one/{table}")
            next((tmp_path / "one" / table).glob("part-*.parquet")).rename(tmp_path / "in" / f"{table}.parquet")
        folder = str(tmp_path / "in")
        assert compare(QUERIES[name](spark, folder), duck(folder), ORACLES[name]) == []

    return check


@pytest.mark.parametrize("name", ["apply_revmap_channels", "apply_revmap_programmes"])
def test_lines_whose_addresses_repeat(agree, name):
    agree(name, [4, 10, 62504, 62510], [event(1, 4), event(2, 62504), event(3, 62510)])


def test_a_chain_of_many_renamed_channels(spark):
    n = 130
    channels = spark.createDataFrame([(i, f"c{i}", f"u{i}") for i in range(n)], "ord bigint, id string, uri string")
    lines = spark.createDataFrame([(i, f"u{i}", f"c{i + 1}") for i in range(n)], "ord bigint, uri string, id string")
    programmes = spark.createDataFrame([(0, "c0"), (1, "c77"), (2, "x")], "ord bigint, channel_id string")
    moved = guide.apply_revmap(channels, programmes, lines)[1]
    assert [r.channel_id for r in moved.orderBy("ord").collect()] == [f"c{n}", f"c{n}", "x"]


def test_rows_that_bear_the_page_number(agree):
    agree("teletext_rows", events=[event(1, 777, "purchase"), event(2, 7771, "purchase"), event(3, 99777, "click"), event(6, 777, "click")])


def test_ages_half_way_between_two_milliseconds(agree):
    agree("render_openmetrics", events=[event(n, n, us=n * 997_000_000 + 500 + 1000 * n) for n in range(1, 60)])


def test_numbers_of_more_than_eight_digits(agree):
    agree("small_formats", events=[event(541_999, 1), event(600_001, 2)])


@pytest.mark.parametrize("name", ["metric_store_stream", "service_discovery_stream"])
def test_streams_whose_numbers_fall_with_time(agree, name):
    kinds = ["signup", "view", "click", "error"]
    agree(name, events=[event(n, n % 2, kinds[n // 2 % 4], us=(40 - n) * 7_200_000_000) for n in range(40)])


def test_network_names_work_each_step_out_once(spark, tmp_path):
    spark.createDataFrame([(1, 2), (5, 2)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["network_names"](spark, str(tmp_path))
    assert [r.network_name[:6] for r in found.collect()] == ["net 5 "]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("crc32(") <= 2  # one made, one checked


@pytest.mark.parametrize("name", ["match_names_fuzzy", "mapping_suggestions", "channel_unmatched"])
def test_names_are_never_broadcast(spark, tmp_path, name):
    spark.createDataFrame([(k, f"Customer#{k:09d}", 1, 0.0, "X") for k in range(40)], CUSTOMER).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() > 0
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["guide_times", "guide_window_texts", "read_xmltv_programmes"])
def test_times_are_made_once_and_matched_once(spark, tmp_path, name):
    spark.createDataFrame([event(1, 4), event(2, 5)], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(4, "Customer#4", 1, 0.0, "X")], CUSTOMER).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") <= 2 and plan.count("regexp_extract(") == 0


def test_a_table_cut_off_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert cut_lineage(spark.range(10).mapInArrow(count, "id long")).count() == 10
    assert seen.value == 10


def test_sections_of_one_packet_need_no_order_and_longer_ones_end_there(spark):
    schema = "capture int, pid int, pkt_no long, pusi int, payload binary"
    short, begun, rest = bytes.fromhex("00 40B003 AABBCC FFFF"), bytes.fromhex("00 42B005 0102"), bytes.fromhex("030405 FF")
    alone = psi.assemble_sections(spark.createDataFrame([(1, 0, n, 1, short) for n in range(3)], schema))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    rows = [(1, 0, 1, 1, begun), (1, 0, 2, 1, short), (1, 0, 3, 0, rest), (1, 0, 4, 1, begun), (1, 0, 6, 0, rest)]
    got = psi.assemble_sections(spark.createDataFrame(rows, schema), span=2).orderBy("first_pkt_no").collect()
    assert alone.count() == 3
    assert [(r.first_pkt_no, r.last_pkt_no, bytes(r.bytes).hex()) for r in got] == [(2, 2, "40b003aabbcc"), (4, 6, "42b0050102030405")]


def test_exit_maps_of_many_stretches_join_at_once():
    size, look = 1 << 14, 4145
    maps = [(n, list(range(look + 1)), [(n + 1) * size + (e * 7919) % look for e in range(look + 1)]) for n in range(3, 19)]
    begun = time.perf_counter()
    first, uptos, exits = bytechain.join_exits(maps, size, look)
    assert time.perf_counter() - begun < 2
    for entry in (0, 1, 2000, look):
        at = first * size + entry
        for one in maps:
            at = bytechain.leave(at, *one, size)
        assert bytechain.leave(first * size + entry, first, uptos, exits, size) == at


def test_a_section_reads_its_body_once(spark):
    made = psi._finish(F.unhex(F.lit("40B000")), F.unhex("body"))
    plan = spark.createDataFrame([("00",)], "body string").select(made.alias("x"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("unhex(body") == 1
    assert bytes(plan.first().x)[:4].hex() == "40b00500"
