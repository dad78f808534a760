"""Hand-made vectors for byte-level and text rules."""

import ipaddress
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airlens.functions import binary, guide_time, text
from airlens.operators import bytechain, cues, docs, guide, media, metrics, psi, repair, rtcp, rtp, services, ts
from airlens.sources import captures, guides, lists, packet_files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def hx(data: str):
    return F.unhex(F.lit(data.replace(" ", "")))


def test_checksums(spark):
    assert one(spark, binary.crc32_mpeg2(F.encode(F.lit("123456789"), "UTF-8"))) == 0x0376E6E7
    h = 1469598103934665603
    for b in (239, 1, 1, 1, 2, 5000):
        h = ((h ^ b) * 1099511628211) % 2**64
    got = binary.fnv1a64(binary.ipv4_octets(F.lit("239.1.1.1")), F.lit(2), F.lit(5000))
    assert int(one(spark, got)) == h


@pytest.mark.parametrize("a, b, want", [(5, 3, 2), (3, 5, -2), (0, 65535, 1), (65535, 0, -1), (32768, 0, -32768)])
def test_sequence_distance(spark, a, b, want):
    assert one(spark, binary.seq_delta16(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(
    "compact, iso",
    [
        ("20201215120000 +0000", "2020-12-15T12:00:00Z"), ("20201215120000 -0000", "2020-12-15T12:00:00-00:00"), ("20201215120000 +0130", "2020-12-15T12:00:00+01:30"),
        ("20201215120000", "2020-12-15T12:00:00"), ("99999999999999", "9999-99-99T99:99:99"), ("2020121512", None), ("x0201215120000", None),
    ],
)
def test_compact_times(spark, compact, iso):
    assert one(spark, guide_time.xmltv_to_iso(F.lit(compact))) == iso


def test_iso_times(spark):
    assert one(spark, guide_time.iso_to_xmltv(F.lit("2020-12-15T12:00:00-05:00"))) == "20201215120000 -0500"
    assert one(spark, guide_time.iso_to_xmltv(F.lit("2020-12-15 12:00:00"))) is None
    assert one(spark, guide_time.iso_to_minutes(F.lit("1970-01-01T00:00:00Z"))) == 40587 * 1440
    assert one(spark, guide_time.iso_to_minutes(F.lit("1970-01-01T01:30:59+01:00"))) == 40587 * 1440 + 30
    assert one(spark, guide_time.minutes_to_unix(F.lit(40587 * 1440 + 1))) == 60


def test_text_rules(spark):
    assert one(spark, text.percent_encode(F.lit("a b*c~d+é/-._"))) == "a%20b%2Ac~d%2B%C3%A9%2F-._"
    assert one(spark, text.xml_unescape(F.lit("&amp;lt; &#233;&#x20AC; &#zz; &lt;"))) == "&lt; é€ &#zz; <"
    assert one(spark, text.dvb_text(hx("100001 41 0A 42"))) == "A B"
    assert one(spark, text.eit_title(F.lit("é" * 200), F.lit("x"))) == "é" * 124 + " "
    assert one(spark, text.fmt_dur(F.lit(400000.0))) == "99:59:59" and one(spark, text.fmt_dur(F.lit(75))) == " 1:15"
    assert one(spark, text.expand_template(F.lit("a%gb%%c%xd"), F.lit("G"), F.lit(1))) == "aGb%c"


@pytest.mark.parametrize(
    "uri, want",
    [
        ("rtp://239.1.1.1:5000", (True, 4, "239.1.1.1", 5000)), ("udp://@239.1.1.1:1", (False, 4, "239.1.1.1", 1)), ("rtp://[ff0e::1]:65535", (True, 6, "ff0e::1", 65535)),
        ("rtp://239.1.1.1:0", None), ("rtp://239.1.1.1:65536", None), ("http://x:1", None), ("rtp://239.1.1.1", None), ("rtp://[]:1", None),
    ],
)
def test_stream_addresses(spark, uri, want):
    got = one(spark, services.parse_mcast_uri(F.lit(uri)))
    assert (tuple(got) if got else None) == want


def test_address_ranges(spark):
    rows = spark.createDataFrame([("239.1.2.3",), ("239.2.0.1",), ("ff0e::1:5",), ("ff0f::1",), ("bad",)], "a string")
    ranges = spark.createDataFrame([("239.1.0.0/16",), ("ff0e::/16",), ("239.1.2.0/24",)], "cidr string")
    assert {r.a for r in services.in_ranges(rows, "a", ranges).collect()} == {"239.1.2.3", "ff0e::1:5"}


def section(body: bytes) -> bytes:
    return body + struct.pack(">I", crc(body))


def crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for b in data:
        value ^= b << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if value & 0x80000000 else value << 1
    return value


def packets_of(pid: int, data: bytes, first: int, pointer: int = 0):
    data = bytes([pointer]) + b"\xff" * pointer + data
    out = []
    for i in range(0, len(data), 184):
        part = data[i : i + 184].ljust(184, b"\xff")
        out.append((0, pid, first + i // 184, int(i == 0), part))
    return out


def test_sections_over_several_packets(spark):
    long = section(b"\x42\xf2\x00" + bytes(509))  # 512 + 4 bytes: three packets
    long = section(b"\x42" + struct.pack(">H", 0xF000 | (len(long) - 3)) + bytes(509))
    broken = packets_of(17, long, 20)[:2]
    rows = packets_of(17, long, 0, pointer=3) + packets_of(16, section(b"\x40\xb0\x09" + bytes(5)), 10) + broken + packets_of(17, long, 30)
    df = spark.createDataFrame(rows, "capture int, pid int, pkt_no bigint, pusi int, payload binary")
    got = sorted((r.pid, r.first_pkt_no, r.last_pkt_no, len(r.bytes)) for r in psi.assemble_sections(df, span=2).collect())
    assert got == [(16, 10, 10, 12), (17, 0, 2, len(long)), (17, 30, 32, len(long))]


def test_bad_checksum_is_no_table(spark):
    good = section(b"\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x05\xe1\x00")
    rows = [(0, 0, 0, 0, good), (1, 0, 0, 0, good[:-1] + b"\x00")]
    df = spark.createDataFrame(rows, "capture int, pid int, first_pkt_no bigint, last_pkt_no bigint, bytes binary")
    assert [(r.capture, r.tsid, r.program_number, r.pmt_pid) for r in psi.parse_pat(df).collect()] == [(0, 1, 5, 256)]


def test_descriptor_walk_stops_at_overrun(spark):
    items = one(spark, psi.descriptors(hx("4801AA 0A03656E67 56FF00")))
    assert [(i.tag, bytes(i.body)) for i in items] == [(0x48, b"\xaa"), (0x0A, b"eng")]


def test_resync(spark):
    pkt = b"\x47" + bytes(187)
    files = spark.createDataFrame([("a", b"\x00\x01" + pkt + b"zz" + pkt + b"\x47short")], "capture string, content binary")
    assert [r.pkt_no for r in captures.resync_packets(files).orderBy("pkt_no").collect()] == [0, 1]


def test_ts_files_and_sinks(spark, tmp_path):
    data = b"".join(b"\x47" + struct.pack(">HB", 256, 0x10 + i % 16) + bytes([i]) * 184 for i in range(50))
    (tmp_path / "a.ts").write_bytes(data)
    aligned = captures.read_ts(spark, str(tmp_path / "*.ts"), range_bytes=2000)
    assert captures.read_ts(spark, str(tmp_path / "*.ts"), aligned=False, range_bytes=2000).count() == 50
    assert [bytes(r.pkt)[4] for r in aligned.orderBy("pkt_no").collect()] == list(range(50))
    assert [(r.framing, r.size) for r in captures.detect_framing(captures.read_heads(spark, str(tmp_path))).collect()] == [("raw", 50 * 188)]
    packet_files.write_packets(aligned.filter("pkt_no % 2 = 0").withColumn("capture", F.lit("kept")), str(tmp_path / "out"))
    kept = captures.read_ts(spark, str(tmp_path / "out"))
    assert [(r.capture, bytes(r.pkt)[4]) for r in kept.orderBy("pkt_no").collect()] == [("kept", i) for i in range(0, 50, 2)]


COMPOUND = (
    "80C80006" + "00" * 24  # sender report, skipped
    + "81CD0004 00000001 00000002 000A0003 00140000"
    + "86CD0007 00000001 00000002 01000000 01000000 02000004 000003E8 04000000"  # last parameter has no value
    + "86CD0005 00000001 00000002 03000000 3D000004 00012345"
    + "81CA0003 00000009 0103616263 000000"
)


def test_feedback_vector(spark):
    data = bytes.fromhex(COMPOUND.replace(" ", ""))
    cut = bytes.fromhex("86CD0004 00000001 00000002 03000000 3D000008".replace(" ", ""))
    many = bytes.fromhex("81CD0023 00000001 00000002".replace(" ", "")) + b"\0\1\0\0" * 33
    long = b"n" * 200
    two = struct.pack(">BBHI", 0x82, 202, 53, 9) + b"\x02\x01z\x01\xc8" + long + b"\0\0\0" + struct.pack(">I", 10)
    df = spark.createDataFrame([(1, data), (2, b"\x40"), (3, cut), (4, many), (5, two), (6, None)], "id int, datagram binary")
    events = {}
    for e in rtcp.rtcp_explode(df).collect():
        events.setdefault(e.id, {}).setdefault(e.kind, []).append(e)
    assert {k: len(v) for k, v in events[1].items()} == {"nack": 2, "request": 1, "termination": 1, "name": 1}
    first = next(e for e in events[1]["nack"] if e.entry == 0)
    assert (first.pid, first.blp, events[1]["request"][0].ignore_media_ssrc, events[1]["request"][0].min_fill_ms) == (10, 3, True, 1000)
    assert events[1]["termination"][0].first_seq == 0x12345 and not events[1]["termination"][0].malformed and events[1]["name"][0].cname == "abc"
    assert events[3]["termination"][0].malformed
    assert len(events[4]["nack"]) == 33 and [(e.sender_ssrc, e.cname) for e in events[5]["name"]] == [(9, long.decode())]
    assert set(events) == {1, 3, 4, 5}


def test_burst_codes(spark):
    rows = [
        (None, None, None, None, True, True, None, None, None, None, 510), (None, None, None, None, False, True, None, None, None, None, 509),
        (True, 9000, None, None, False, True, True, True, 5000, 0, 401), (True, 10, 0, None, False, True, True, True, 5000, 0, 402), (True, 20, 10, None, False, True, True, True, 5000, 0, 400),
        (True, 10, 20, None, False, True, True, False, 5000, 0, 508), (True, 10, 20, None, False, True, True, True, 5, 0, 507), (True, None, None, 100, False, True, True, True, 5, 100, 403),
        (True, None, None, 101, False, True, True, True, 5, 100, 200), (True, None, None, None, False, False, True, True, 5, 100, 505), (True, None, None, None, False, True, False, True, 5, 100, 506),
    ]
    df = spark.createDataFrame(rows, "known boolean, min_fill_ms int, max_fill_ms int, max_bps bigint, ignore_media_ssrc boolean, client_allowed boolean, channel_allowed boolean, has_rap boolean, depth_ms int, nominal_bps bigint, want int")
    assert all(r.response == r.want for r in repair.burst_admission(df, 8000).collect())
    assert {r.response for r in repair.burst_admission(df, enabled=False).collect()} == {504}


def test_gap_vectors(spark):
    seqs = [65534, 65535, 0, 3, 2, 3, 40]
    df = spark.createDataFrame([(0, i, 7, s) for i, s in enumerate(seqs)] + [(0, 7, 8, 500)], "channel int, arrival bigint, ssrc bigint, seq int")
    gaps = rtp.rtp_gaps(df, span=3).orderBy("arrival").collect()
    assert [r.verdict for r in gaps] == ["ok", "ok", "ok", "gap", "stale", "stale", "resync", "ok"]
    assert [(r.pid, r.blp) for r in rtp.nack_pack(rtp.rtp_gaps(df)).collect()] == [(1, 1)]


def frames_bytes():
    def adts(n):
        size = n + 7
        return bytes([0xFF, 0xF1, 0x50, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC]) + bytes(n)

    return b"".join((b"\x01\x02" if i % 5 == 0 else b"") + adts(10 + i * 7 % 90) for i in range(400))


@pytest.mark.parametrize("piece, cut", [(1 << 22, 1000), (9000, 97), (8300, 4000)])
def test_audio_frames_do_not_depend_on_cuts(spark, piece, cut):
    data = frames_bytes()
    rows = [(0, 300, "aac", i, data[i * cut : (i + 1) * cut]) for i in range(-(-len(data) // cut))]
    df = spark.createDataFrame(rows, "capture int, pid int, codec string, pes_no bigint, es binary")
    got = media.audio_frames(df, piece).orderBy("at").collect()
    assert len(got) == 400 and sum(r.consumed + r.skipped for r in got) == len(data)
    stats = media.audio_frame_stats(media.audio_frames(df, piece)).first()
    assert (stats.framing_errors, stats.samples) == (80, 400 * 1024)


@pytest.mark.parametrize(
    "codec, head, want",
    [
        ("mp2", "FFFD8404", (384, 48000, 2, 1152, 2)),
        ("mp2", "FFFB9000", (417, 44100, 2, 1152, 3)),
        ("eac3", "0B77003F0000", (128, 48000, 2, 256, 2)),
    ],
)
def test_frame_headers(codec, head, want):
    assert media.audio_frame(codec, bytes.fromhex(head).ljust(2000, b"\0")) == want


def test_ac3_sizes_follow_the_rule():
    sizes = [media.audio_frame("ac3", bytes([0x0B, 0x77, 0, 0, 1 << 6 | code, 0, 0]))[0] // 2 for code in (0, 1, 2, 3, 36, 37)]
    assert sizes == [69, 70, 87, 88, 1393, 1394]


def test_picture_facts():
    assert media.picture_facts("mpeg2video", bytes.fromhex("000001B3 16012033 00000100 0008FFF8".replace(" ", ""))) == (True, (352, 288))
    # baseline profile, 20 x 15 macroblocks
    bits = "01100111" + "01000010" + "0" * 16 + "1" + "1" + "011" + "010" + "0" + "000010100" + "0001111" + "1" + "1" + "0" + "1"
    sps = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media.h264_size(sps) == (320, 240)


def test_hamming_corrects_one_bit():
    codes = [media.NIBBLES.index(n) for n in range(16)]
    assert sorted(set(media.NIBBLES)) == list(range(-1, 16))
    for value, n in enumerate(media.NIBBLES):
        if n == 7:
            assert min(bin(value ^ c).count("1") for c in range(256) if media.NIBBLES[c] == 7 and c in codes) <= 2


def test_national_characters(spark):
    sent = lambda data: F.lit(bytes(media.REVERSED[b] for b in data))
    assert one(spark, media.row_text(sent(b"\x5b\x5c \x01x  "), F.lit("ger"))) == "ÄÖ  x"
    assert one(spark, media.row_text(sent(b"#"), F.lit(None).cast("string"))) == "£"
    assert one(spark, media.row_text(sent(b"$"), F.lit("cze"))) == "ů"


def test_icy_chain_over_piece_borders(spark):
    def block(t):
        body = f"StreamTitle='{t}';".encode()
        body = body.ljust(-(-len(body) // 16) * 16, b"\0")
        return bytes(100) + bytes([len(body) // 16]) + body

    data = b"".join(block(f"A - {i}") if i % 3 else bytes(100) + b"\0" for i in range(120))
    rows = [(1, i, data[i * 333 : (i + 1) * 333]) for i in range(-(-len(data) // 333))]
    df = spark.createDataFrame(rows, "station int, block_no bigint, data binary")
    got = media.icy_titles(df, 100, piece=5000).orderBy("at").collect()
    assert [r.block for r in got] == [f"StreamTitle='A - {i}';" for i in range(120) if i % 3]


def test_id3(spark):
    frame = lambda n, b: n + struct.pack(">I", len(b)) + b"\0\0" + b
    tag = b"ID3\x03\0\0\0\0\0\0" + frame(b"TPE1", b"\x01\xff\xfe" + "Zoë".encode("utf-16-le")) + frame(b"TIT2", b"\x00caf\xe9") + bytes(20)
    more = b"ID3\x04\0\0\0\0\0\0" + b"TIT2" + bytes([0, 0, 1, 2, 0, 0]) + b"\x03" + b"x" * 129 + b"TPE1" + b"\0\0\0\x7f\0\0"
    df = spark.createDataFrame([(0, tag), (1, b"ID3\x03\0\0\0\0\0\0" + bytes(20)), (2, more), (3, b"ID3"), (4, None)], "i int, tag binary")
    got = {r.i: (r.artist, r.title) for r in media.id3_titles(df).collect()}
    assert got == {0: ("Zoë", "café"), 1: (None, None), 2: ("", "x" * 129), 3: (None, None), 4: (None, None)}


def test_snapshot_verdicts(spark):
    def gram(version=1, component=3, ident=b"inst1", entries=b""):
        return bytes([version, component, 0, 0]) + ident.ljust(32, b"\0") + struct.pack(">QQQ", 100, 1, 5) + entries

    entry = struct.pack(">HB", 30, 2) + b"ab" + struct.pack(">Q", 2**64 - 1)
    rows = [(0, gram(entries=entry + entry[:5])), (1, gram(version=2)), (2, gram(component=10)), (3, gram(ident=b"")), (4, gram()[:50]), (5, gram() + bytes(5000)), (6, b"\x02")]
    out = {r.i: r for r in metrics.decode_snapshots(spark.createDataFrame(rows, "i int, datagram binary"), max_bytes=4096).collect()}
    assert [out[i].status for i in range(7)] == ["ok", "version", "malformed", "malformed", "malformed", "malformed", "version"]
    assert [(e.id, e.label, int(e.value)) for e in out[0].entries] == [(30, "ab", 2**64 - 1)]


def test_document_checksum(spark):
    body = b"hello world"
    rows = [(2, 1, 0, 0, 1, body[:6], 0, False, None), (2, 1, 0, 1, 1, body[6:], 1, True, crc(body)), (2, 2, 0, 0, 0, body, 2, True, crc(body) ^ 1), (2, 3, 0, 0, 0, body, 3, False, None)]
    df = spark.createDataFrame(rows, "payload_id int, segment_id int, version int, section_number int, last_section_number int, payload binary, arrival bigint, crc_present boolean, crc bigint")
    assert {r.segment_id: bytes(r.document) for r in docs.doc_reassembly(df).collect()} == {1: body, 3: body}


XMLTV = """<?xml version="1.0"?><tv>
<channel id="channel1"><display-name>Channel One</display-name><display-name lang="de">Kanal &amp; Eins</display-name></channel>
<programme start="20201215120000 +0000" stop="bad" channel="channel1"><title lang="en">News</title><title>Other</title><desc>Daily</desc></programme>
<programme start="bad" channel="channel1"><title>x</title></programme></tv>"""


def test_xmltv_round_trip(spark, tmp_path):
    (tmp_path / "in.xml").write_text(XMLTV)
    channels, programmes = guides.read_xmltv(spark, str(tmp_path / "in.xml"))
    assert [(r.id, r.names) for r in channels.collect()] == [("channel1", ["Channel One", "Kanal & Eins"])]
    assert [tuple(r)[2:] for r in programmes.collect()] == [("channel1", "2020-12-15T12:00:00Z", "", "News", "Daily", "")]
    sinks.write_xmltv(guide.xmltv_lines(channels, programmes), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    text_out = "".join(p.read_text() for p in parts)
    assert text_out.startswith("<?xml") and text_out.rstrip().endswith("</tv>")
    (tmp_path / "again.xml").write_text(text_out)
    again = guides.read_xmltv(spark, str(tmp_path / "again.xml"))
    assert [r.names for r in again[0].collect()] == [["Channel One", "Kanal & Eins"]] and again[1].count() == 1


def test_guide_round_trip(spark, tmp_path):
    channels = spark.createDataFrame([(1, "c1", ["One"], "rtp://239.1.1.1:5000", 1, 2, 101), (2, "c2", ["Two"], None, None, None, None)], "ord bigint, id string, names array<string>, uri string, tsid int, onid int, sid int")
    shows = spark.createDataFrame([(1, "c1", "2020-12-15T12:00:00Z", "2020-12-15T13:00:00Z", "News", "", "Info"), (2, "c2", "2020-12-15T12:00:00Z", "", "x", "", "")], "ord bigint, channel_id string, start string, stop string, title string, desc string, category string")
    sinks.write_lines(guide.guide_lines(channels, shows), str(tmp_path / "g"), ["part", "ord", "sub"], header=sinks.XML_HEAD + "\n<TVAMain>", footer="</TVAMain>")
    parts = sorted(p for p in (tmp_path / "g").iterdir() if p.name.startswith("part"))
    (tmp_path / "g.xml").write_text("".join(p.read_text() for p in parts))
    back_channels, back_shows = guides.read_guide(spark, str(tmp_path / "g.xml"))
    assert [(r.id, r.names, r.uri, r.tsid, r.onid, r.sid) for r in back_channels.collect()] == [("c1", ["One"], "rtp://239.1.1.1:5000", 1, 2, 101)]
    assert [(r.channel_id, r.start, r.stop, r.title, r.category) for r in back_shows.collect()] == [("c1", "2020-12-15T12:00:00Z", "2020-12-15T13:00:00Z", "News", "Info")]


def text_lines(spark, *rows):
    return spark.createDataFrame([("d", i, r) for i, r in enumerate(rows)], "doc string, pos bigint, line string")


def test_list_errors(spark):
    bad = lists.parse_services_csv(text_lines(spark, "One,rtp://239.1.1.1:5000,7", "broken", "Two,http://x")).orderBy("ord").collect()
    assert [(r.error, r.tsid, r.sid) for r in bad] == [(None, 7, 1), ("expected name,uri", 1, 2), ("bad uri", 1, 3)]
    with pytest.raises(Exception, match="bad uri"):
        lists.strict(lists.parse_services_csv(text_lines(spark, "Two,http://x"))).collect()
    assert [r.error for r in lists.parse_packages(text_lines(spark, "1,a,eng,1,", "x,a,eng,1,s", "1,a,en,1,s", "2,b,eng,0,s|t")).orderBy("ord").collect()] == ["package has no services", "bad package id", "bad lang", None]
    assert [r.error for r in lists.parse_cells(text_lines(spark, "c,DE", "c,DEU,1:x", "c,DE,x", "c,DE,1:x")).orderBy("ord").collect()] == ["cell has no address entries", "bad country code", "bad address entry", None]
    got = lists.parse_mapping(text_lines(spark, "# note", "a,b,rtp://x:1,1,2,3", "short,1")).orderBy("ord").collect()
    assert [(r.id, r.sid, r.error) for r in got] == [("a,b", 3, None), ("", 0, "expected id,uri,tsid,onid,sid")]


def names_frame(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, id string, names array<string>")


def test_name_suggestions(spark):
    channels = names_frame(spark, [(0, "a", ["channel one"]), (1, "b", ["Channel 2"]), (2, "c", ["Mystery Channel"]), (3, "d", []), (4, "e", ["Channel 2 HD plus"])])
    offers = spark.createDataFrame([(0, "Channel One", "rtp://a:1", 1, 2, 3), (1, "Channel 2 HD", "rtp://b:1", 1, 2, 4)], "ord bigint, name string, uri string, tsid int, onid int, sid int")
    lines = {r.ord: r.line for r in guide.mapping_suggestion_lines(guide.suggest_mapping(channels, offers)).collect()}
    assert lines == {
        0: "a,rtp://a:1,1,2,3", 1: "# b (Channel 2) -> closest: Channel 2 HD, rtp://b:1,1,2,4", 2: "# UNMATCHED: c (Mystery Channel)",
        3: "# UNMATCHED: d (?)", 4: "# e (Channel 2 HD plus) -> closest: Channel 2 HD, rtp://b:1,1,2,4",
    }


def test_empty_names_match_everything(spark):
    channels = names_frame(spark, [(0, "a", [""]), (1, "b", ["zzz"])])
    offers = spark.createDataFrame([(5, "x", "u", 1, 1, 1), (7, "", "u", 1, 1, 1)], "ord bigint, name string, uri string, tsid int, onid int, sid int")
    assert {r.id: r.service_ord for r in guide.match_names_fuzzy(channels, offers).collect()} == {"a": 5, "b": 7}


def test_chained_renames_carry_programmes_on(spark):
    channels = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u2"), (3, "c", "u3"), (4, "a", "u4"), (5, "x", "u5")], "ord bigint, id string, uri string")
    shows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x"), (5, "none")], "ord bigint, channel_id string")
    rename = spark.createDataFrame([(1, "u1", "b"), (2, "u2", "c"), (3, "u3", "a"), (4, "u4", "d"), (5, "u2", "z")], "ord bigint, uri string, id string")
    got_channels, got_shows = guide.apply_revmap(channels, shows, rename)
    assert {r.ord: r.id for r in got_channels.collect()} == {1: "b", 2: "c", 3: "a", 4: "d", 5: "x"}
    assert {r.ord: r.channel_id for r in got_shows.collect()} == {1: "d", 2: "d", 3: "d", 4: "x", 5: "none"}


def test_slots_of_both_families_and_ignored_ssrc(spark):
    def fnv(data):
        h = 1469598103934665603
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    rows = [("239.1.2.3", 5000, fnv([239, 1, 2, 3, 2, 5000])), ("ff0e::1:2", 6000, fnv([0xFF, 0x0E, *[0] * 11, 1, 0, 2, 10, 6000]))]
    df = spark.createDataFrame([(a, p) for a, p, _ in rows], "address string, port int")
    got = [int(r.h) for r in df.select(services.channel_hash(F.col("address"), F.col("port")).alias("h")).collect()]
    assert got == [h for *_, h in rows]
    channels = spark.createDataFrame([(1, "six", "ff0e::1:2", 6000, 77)], "ord bigint, channel string, address string, port int, ssrc bigint")
    slot = rows[1][2] % 384
    asked = [(1, 40000 + slot, 0, None), (2, 1, 77, False), (3, 1, 77, True), (4, 40000 + slot, 77, True)]
    requests = spark.createDataFrame(asked, "request int, dest_port int, media_ssrc bigint, ignore_media_ssrc boolean")
    assert {r.request: r.channel for r in repair.resolve_channel(requests, channels, 40000, 384).collect()} == {1: "six", 2: "six", 3: None, 4: "six"}


def test_slot_hash_reads_the_address_once(spark):
    """The hash of many addresses equals arithmetic in Python, and the address is parsed in one place of the plan."""
    rnd = random.Random(8)

    def fnv(data):
        h = 1469598103934665603
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    packed = [bytes(rnd.choice((0, 255, rnd.randrange(256))) for _ in range(rnd.choice((4, 16)))) for _ in range(300)]
    rows = [(str(ipaddress.ip_address(b)), rnd.choice((1, 65535, rnd.randrange(65536))), b) for b in packed]
    bad = ["", "1.2.3", "256.1.1.1", "1.2.3.4.5", "1:2:3", "12345::", "name", None]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(rows)] + [(-i - 1, a, 5000) for i, a in enumerate(bad)], "i int, address string, port int")
    hashed = df.select("i", services.channel_hash(F.col("address"), F.col("port")).alias("h"))
    want = {i: fnv([*b, 2 if len(b) == 4 else 10, p]) for i, (_, p, b) in enumerate(rows)}
    assert max(want.values()) >= 2**63
    assert {r.i: None if r.h is None else int(r.h) for r in hashed.collect()} == want | {-i - 1: None for i in range(len(bad))}
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(\d{1,3}\.){3}") == 1


def test_requests_without_a_port_do_not_share_a_key(spark):
    requests = spark.range(5000).selectExpr("id AS request", "CAST(CASE id % 4 WHEN 1 THEN 40383 WHEN 2 THEN 40384 WHEN 3 THEN 39999 END AS INT) AS dest_port", "id % 10 AS media_ssrc")
    slots = requests.select("dest_port", repair.requested_slot(40000, 384).alias("slot")).collect()
    assert {r.slot for r in slots if r.dest_port == 40383} == {383}
    others = [r.slot for r in slots if r.dest_port != 40383]
    assert max(others) < 0 and len(set(others)) > 3700
    channels = spark.range(5).selectExpr("id AS ord", "CAST(id AS STRING) AS channel", "concat('239.0.0.', id) AS address", "5000 AS port", "id AS ssrc")
    found = repair.resolve_channel(requests, channels, 40000, 384)
    assert found._jdf.queryExecution().optimizedPlan().toString().count(r"(\d{1,3}\.){3}") == 1, "addresses are parsed once"
    assert found.count() == 5000


def test_entries_of_a_batch_equal_a_walk():
    """Cut-off entries, labels with zero bytes and bytes that are no text, nulls, sliced batches."""
    rnd = random.Random(3)

    def walk(data):
        out, at = [], metrics.HEADER_BYTES
        while data is not None and at + 11 <= len(data) and at + 11 + data[at + 2] <= len(data):
            n = data[at + 2]
            out.append({"ord": len(out), "id": data[at] * 256 + data[at + 1], "label": data[at + 3 : at + 3 + n].split(b"\0")[0].decode("utf-8", "replace"), "raw": data[at + 3 + n : at + 11 + n]})
            at += 11 + n
        return out

    for trial in range(60):
        rows = []
        for _ in range(rnd.randrange(0, 12)):
            body = b"".join(rnd.randbytes(2) + bytes([len(x)]) + x + rnd.randbytes(8) for x in (rnd.choice([b"", b"abc", "\u00e9t\u00e9".encode(), b"a\0b", b"x" * 255] + [b"\xff\xfe"] * (trial % 2)) for _ in range(rnd.randrange(0, 6))))
            data = bytes(metrics.HEADER_BYTES) + body
            rows.append(rnd.choice([data, data[: rnd.randrange(0, len(data) + 1)], None]))
        rows = [bytes(80)] + rows
        assert metrics.entries_of(pa.array(rows, pa.binary())).to_pylist() == [walk(r) for r in rows]
        assert metrics.entries_of(pa.array(rows, pa.binary()).slice(1)).to_pylist() == [walk(r) for r in rows[1:]]


def test_units_as_parts_and_units_without_end(spark):
    """A pid that starts once and never again gives parts, its size and no value; other units are joined as ever."""
    head = b"\x00\x00\x01\xe0\x00\x00\x80\x00\x00"
    rows = [(0, 256, i, int(i == 2), (head if i == 2 else b"") + bytes([i]) * 100) for i in range(200)]
    rows += [(0, 257, 1000 + i, int(i % 3 == 0), (head if i % 3 == 0 else b"") + bytes([i]) * 10) for i in range(30)]
    rows += [(0, 258, 2000 + i, int(i in (0, 4)), (b"bad start" if i == 0 else head if i == 4 else b"") + b"x") for i in range(8)]
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "capture int, pid int, pkt_no bigint, pusi int, payload binary")
    for span in (7, 1 << 18):
        units = {(r.pid, r.pes_no): r for r in media.assemble_pes(df, span, unit_bytes=5000).collect()}
        long = units.pop((256, 1))
        assert (long.size, long.es, long.first_pkt_no) == (19_800, None, 2)
        assert {k: bytes(r.es) for k, r in units.items()} == {(258, 2): b"xxxx"} | {(257, n + 1): b"".join(bytes([3 * n + i]) * 10 for i in range(3)) for n in range(10)}
        parts = media.pes_parts(df, span).where("pid = 256").orderBy("at").collect()
        assert [p.at for p in parts] == list(range(0, 19_800, 100)) and b"".join(bytes(p.part) for p in parts) == b"".join(bytes([i]) * 100 for i in range(2, 200))


def test_remux_and_selection_outcomes(spark):
    programs = spark.createDataFrame([(1, 100), (2, 100), (2, 200)], "capture int, pmt_pid int")
    outcome = lambda sel: {r.capture: r.outcome for r in psi.program_selection(programs, sel).collect()}
    assert outcome("auto") == {1: "whole", 2: "ambiguous"} and outcome("all")[2] == "all" and outcome(200)[2] == "chosen" and outcome(5)[2] == "unknown_pid"
    packets = spark.createDataFrame([(0, 0x12), (0, 256), (0, 257)], "capture int, pid int")
    mapped = spark.createDataFrame([(0, 256, 300)], "capture int, pid int, out_pid int")
    assert tuple(ts.remux_counters(packets, mapped).first()) == (0, 2, 1) and tuple(ts.remux_counters(packets, mapped, strip_eit=True).first()) == (0, 1, 2)


def test_pieces_cover_the_stream(spark):
    rows = [(1, i, bytes([i % 256]) * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i bigint, data binary")
    pieces = bytechain.byte_pieces(df, ["k"], ["i"], "data", look=10, piece=500).orderBy("piece", "at").collect()
    whole, joined = b"".join(r[2] for r in rows), {}
    for p in pieces:
        joined[p.piece] = joined.get(p.piece, b"") + bytes(p.part)
    assert all(joined[n] == whole[n * 500 : (n + 1) * 500 + 10] for n in joined) and len(joined) == -(-len(whole) // 500)


# ---- data beyond the buffers of a device: nothing is cut by default ----


def test_forty_streams_in_a_program(spark):
    loop = b"".join(struct.pack(">BHH", 0x03, 0xE000 + 100 + i, 0xF000) for i in range(40))
    body = struct.pack(">BHHBBBHH", 2, 0xB000 + 9 + len(loop) + 4, 7, 0xC1, 0, 0, 0xE064, 0xF000) + loop + bytes(4)
    df = spark.createDataFrame([(body,)], "b binary")
    assert [e.pid for e in df.select(psi._es_loop(F.col("b"), F.lit(12)).alias("l")).first().l] == list(range(100, 140))
    out = df.select(psi.rewrite_pmt(F.col("b"), F.array(F.lit(105)), False, False).alias("b"))
    kept = out.select(psi._es_loop(F.col("b"), F.lit(12)).alias("l")).first().l
    assert [e.pid for e in kept] == [p for p in range(100, 140) if p != 105]


def test_section_of_full_length_from_single_bytes(spark):
    whole = b"\x40\xbf\xff" + bytes(4095)
    rows = [(0, 17, 0, 1, b"\x00")] + [(0, 17, i + 1, 0, whole[i : i + 1]) for i in range(len(whole))]
    got = psi.assemble_sections(spark.createDataFrame(rows, "capture int, pid int, pkt_no long, pusi int, payload binary")).collect()
    assert [(bytes(r.bytes), r.last_pkt_no) for r in got] == [(whole, 4098)]


def test_document_of_seventy_sections(spark):
    rows = [(1, 2, 3, i, 69, f"{i:04d}" * 500, i) for i in range(70)]
    df = spark.createDataFrame(rows, "payload_id int, segment_id int, version int, section_number int, last_section_number int, payload string, arrival long")
    assert docs.doc_reassembly(df).first().document == "".join(r[5] for r in rows)
    assert docs.doc_reassembly(df, max_sections=64).isEmpty() and docs.doc_reassembly(df, max_section=1452).isEmpty()


def test_ten_names_and_long_texts(spark):
    element = "<channel id='c'>" + "".join(f"<display-name>n{i}</display-name>" for i in range(10)) + "</channel>"
    df = spark.createDataFrame([("d", 0, element)], "doc string, ord long, x string")
    assert guides.parse_xmltv(df, "x", "channel").first().names == [f"n{i}" for i in range(10)]
    long = spark.createDataFrame([(b"a" * 100,)], "b binary")
    assert long.select(text.dvb_text(F.col("b")).alias("t")).first().t == "a" * 100
    assert long.select(text.dvb_text(F.col("b"), 63).alias("t")).first().t == "a" * 63


def test_snapshot_of_five_hundred_entries(spark):
    entry = struct.pack(">HB", 30, 100) + b"x" * 100 + struct.pack(">Q", 5)
    data = bytes([1, 2, 0, 0]) + b"id".ljust(32, b"\0") + struct.pack(">QQQ", 100, 1, 5) + entry * 500
    df = spark.createDataFrame([(data,)], "datagram binary")
    row = metrics.decode_snapshots(df).first()
    assert (row.status, len(row.entries), row.dropped_entries, row.entries[499].label) == ("ok", 500, 0, "x" * 100)
    cut = metrics.decode_snapshots(df, max_entries=400).first()
    assert (len(cut.entries), cut.dropped_entries) == (400, 100) and metrics.decode_snapshots(df, max_bytes=4096).first().status == "malformed"


def test_large_payloads_count(spark):
    df = spark.createDataFrame([(1, i, i * 1000, 9000) for i in range(10)], "channel int, arrival long, arrival_us long, payload_len int")
    assert rtp.channel_bitrate(df).first().bits == 10 * 9000 * 8 and rtp.channel_bitrate(df, max_payload=1472).isEmpty()


def test_thirty_rows_of_a_subtitle_and_forty_keys(spark):
    rows = spark.createDataFrame([(0, i, 1000 + i, f"row {i}") for i in range(30)], "capture int, i long, ts_ms long, text string")
    assert cues.teletext_cues(rows).first().text.count("row") == 30 and cues.teletext_cues(rows, max_rows=24).first().text.count("row") == 24
    keys = spark.createDataFrame([(1, 78, i, bytes([i]), i) for i in range(40)], "service_id int, table_id int, section_number int, bytes binary, arrival long")
    assert psi.latest_event_sections(keys).filter("bytes is not null").count() == 40
    assert psi.latest_event_sections(keys, cap=16).filter("bytes is not null").count() == 16
