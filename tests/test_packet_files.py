"""Packet files: ranges of any size give the packets of a plain loop; writes are whole or leave nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from airlens.sources import captures
from airlens.sources import packet_files as pf


def packet(i, fill=None):
    return bytes([0x47]) + i.to_bytes(4, "big") + (bytes([i % 251]) * 183 if fill is None else fill)


def plain_loop(data):
    """The rule itself, byte by byte: a packet where a sync byte stands, the next place otherwise."""
    at, out = 0, []
    while at + 188 <= len(data):
        if data[at] == 0x47:
            out.append(data[at : at + 188])
            at += 188
        else:
            at += 1
    return out


def read(df):
    return [(r.pkt_no, bytes(r.pkt)) for r in df.orderBy("pkt_no").collect()]


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    pf.register(spark)


@pytest.mark.parametrize("range_bytes", [1504, 5000, 1 << 20])
def test_raw_files_by_ranges(spark, tmp_path, range_bytes):
    data = b"".join(packet(i) for i in range(300)) + b"\x47tail"
    (tmp_path / "a.ts").write_bytes(data)
    df = spark.read.format("packets").option("rangeBytes", range_bytes).load(str(tmp_path / "*.ts"))
    assert read(df) == [(i, packet(i)) for i in range(300)]
    assert df.rdd.getNumPartitions() == -(-len(data) // range_bytes)


@pytest.mark.parametrize("per", [1, 3, 7])
@pytest.mark.parametrize("range_bytes", [1504, 1 << 20])
def test_rtp_records_by_ranges(spark, tmp_path, per, range_bytes):
    packets = [packet(i) for i in range(per * 40 + min(per - 1, 2))]  # the last record may be shorter
    records = [b"\x80\x21" + bytes(10) + b"".join(packets[i : i + per]) for i in range(0, len(packets), per)]
    (tmp_path / "a.rtp").write_bytes(b"".join(records))
    df = spark.read.format("packets").option("rangeBytes", range_bytes).load(str(tmp_path / "a.rtp"))
    assert read(df) == list(enumerate(packets))
    assert read(pf.resynced(spark, str(tmp_path / "a.rtp"), range_bytes)) == list(enumerate(packets))
    raw = spark.read.format("packets").option("framing", "raw").load(str(tmp_path / "a.rtp"))
    assert raw.count() == sum(map(len, records)) // 188


@pytest.mark.parametrize("range_bytes", [1504, 1999, 10_000, 1 << 20])
def test_unaligned_files_by_ranges(spark, tmp_path, range_bytes):
    """Garbage between packets, false sync bytes inside them that keep a false chain alive, long stretches without any."""
    rnd = random.Random(5)
    false = bytes([0x47]) * 183
    named = {
        "garbage": b"".join(bytes(rnd.randrange(0, 5)) + packet(i, rnd.randbytes(183)) for i in range(120)),
        "noise": rnd.randbytes(30_000),
        "false": b"\x11\x22\x33" + b"".join(packet(i, false if i % 3 else None) for i in range(100)) + b"\x47" * 400,
        "desert": packet(1) + bytes(20_000) + packet(2) + b"\x47short",
        "start": bytes(187) + b"".join(packet(i) for i in range(30)),
        "none": bytes(5000),
        "tiny": b"\x47",
        "empty": b"",
    }
    for name, data in named.items():
        (tmp_path / name).write_bytes(data)
    got = pf.resynced(spark, str(tmp_path), range_bytes, fan=3).orderBy("capture", "pkt_no").collect()
    for name, data in named.items():
        mine = [(r.pkt_no, bytes(r.pkt)) for r in got if r.capture.endswith("/" + name)]
        assert mine == list(enumerate(plain_loop(data))), name


def test_maps_of_ranges_agree_with_a_walk():
    rnd = random.Random(6)
    for trial in range(40):
        data = bytes(rnd.choice(b"\x47\x47\x00\x01" if trial % 2 else b"\x47" + bytes(range(40))) for _ in range(rnd.randrange(200, 3000)))
        size = rnd.randrange(188, len(data) + 1)
        exits, counts = pf.range_map(data, size)
        for entry in range(0, min(188, size), 7):
            stretches = list(pf._chain(data, size, entry))
            assert (stretches[-1][0], sum(n for _, n in stretches)) == (exits[entry], counts[entry])


def test_framing_from_the_head(spark, tmp_path):
    (tmp_path / "raw").write_bytes(b"".join(packet(i) for i in range(90)))
    (tmp_path / "rtp").write_bytes((b"\x80\x21" + bytes(10) + packet(1) + packet(2)) * 60)
    heads = spark.read.format("packet_heads").load(str(tmp_path))
    found = captures.detect_framing(heads).collect()
    assert {os.path.basename(r.capture): (r.framing, r.stride) for r in found} == {"raw": ("raw", 188), "rtp": ("rtp", 388)}
    assert all(len(r.content) <= 2700 for r in found)


def test_a_packet_file_set_per_capture(spark, tmp_path):
    rows = [(name, i, bytearray(packet(i))) for name, n in (("a", 400), ("b/c=d", 50), ("c", 1), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "capture string, pkt_no bigint, pkt binary").withColumn("pkt_no", F.col("pkt_no") * 10).repartition(5)
    path = str(tmp_path / "out")
    for _ in range(2):  # writing again replaces
        pf.write_packets(df, path)
    back = spark.read.format("packets").option("rangeBytes", 2000).load(path)
    got = {}
    for r in back.orderBy("pkt_no").collect():
        got.setdefault(r.capture, []).append((r.pkt_no, bytes(r.pkt)))
    assert got == {name: [(i, packet(i)) for i in range(n)] for name, n in (("a", 400), ("b/c=d", 50), ("c", 1), (None, 3))}
    assert sorted(os.listdir(path))[0].startswith("capture=") and not [x for x in os.listdir(path) if x.startswith("_temporary")]
    whole = b"".join((tmp_path / "out" / "capture=a" / x).read_bytes() for x in sorted(os.listdir(tmp_path / "out" / "capture=a")) if x[0] != ".")
    assert whole == b"".join(packet(i) for i in range(400))
    pf.write_packets(df.where("capture = 'c'"), path, mode="append")
    assert spark.read.format("packets").load(path).where("capture = 'c'").orderBy("pkt_no").select("pkt_no").collect() == [(0,), (1,)]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([("a", i, bytearray(packet(i))) for i in range(20)], "capture string, pkt_no bigint, pkt binary")
    pf.write_packets(good, path)
    bad = good.union(spark.createDataFrame([("z", 1, bytearray(b"short"))], good.schema))
    with pytest.raises(Exception, match="188 bytes"):
        pf.write_packets(bad, path)
    assert os.listdir(path) == ["capture=a"]
    assert spark.read.format("packets").load(path).count() == 20


def test_an_empty_folder_and_a_missing_one(spark, tmp_path):
    assert spark.read.format("packets").load(str(tmp_path)).count() == 0
    pf.write_packets(spark.createDataFrame([], pf.PACKETS), str(tmp_path / "none"))
    assert spark.read.format("packets").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="missing"):
        spark.read.format("packets").load(str(tmp_path / "missing")).count()


def test_short_ranges_make_no_more_tasks(tmp_path):
    for n in range(300):
        (tmp_path / f"{n:03d}.ts").write_bytes((b"\x47" + b"\x00" * 187) * 40)
    for reader in (pf.PacketReader, pf.MapReader):
        tasks = reader({"path": str(tmp_path), "rangeBytes": "1504"}).partitions()
        assert len(tasks) <= 65
        assert sum(r.high - r.low for t in tasks for r in t.ranges) == 300 * 40 * 188
        assert len([r for t in tasks for r in t.ranges]) == 1500
