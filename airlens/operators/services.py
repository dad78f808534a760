"""Service lists, packages and regional cells: addresses, document lines and discovery documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.binary import FAMILY_IPV4, FAMILY_IPV6, U64, fnv1a64, ipv4_to_int
from airlens.functions.once import bound
from airlens.functions.text import csv_safe_name, xml_escape

URI = r"^(rtp|udp)://@?(?:\[([^\]]+)\]|([^:\[]+)):[ ]*\+?([0-9]+)$"


def parse_mcast_uri(uri: Column) -> Column:
    """STRUCT<rtp, family, address, port> of a stream address; null when it is not one (FN-9)."""
    port = F.regexp_extract(uri, URI, 4).try_cast("bigint")
    v6, v4 = F.regexp_extract(uri, URI, 2), F.regexp_extract(uri, URI, 3)
    parsed = F.struct(
        (F.regexp_extract(uri, URI, 1) == "rtp").alias("rtp"), F.when(v6 != "", 6).otherwise(4).alias("family"),
        F.when(v6 != "", v6).otherwise(v4).alias("address"), port.cast("int").alias("port"),
    )
    return F.when(uri.rlike(URI) & port.between(1, 65535), parsed)


def with_address(services: DataFrame) -> DataFrame:
    """Services with their address parts; a bad address becomes nulls."""
    return services.withColumn("__a", parse_mcast_uri(F.col("uri"))).select(*services.columns, "__a.rtp", "__a.family", "__a.address", "__a.port")


def package_services(packages: DataFrame, services: DataFrame) -> DataFrame:
    """Package members in order with the triplet of the first service of that name; unknown names keep nulls (JOIN-6)."""
    first = services.groupBy(F.col("name").alias("service_name")).agg(F.min_by(F.struct("tsid", "onid", "sid"), "ord").alias("__t"))
    members = packages.select("ord", "id", F.posexplode("service_names").alias("pos", "service_name"))
    return members.join(first, "service_name", "left").select("ord", "id", "pos", "service_name", "__t.tsid", "__t.onid", "__t.sid")


def address_bits(address: Column) -> Column:
    """Address as a string of bits: 32 for IPv4, 128 for IPv6; null when neither."""
    v4 = ipv4_to_int(address)
    return F.when(v4.isNotNull(), F.lpad(F.bin(v4), 32, "0")).otherwise(bits_of_groups(address))


def bits_of_groups(address: Column) -> Column:
    """The 128 bits of an IPv6 address; null when it is not one."""
    groups = F.split(address, ":", -1)
    has_gap = address.contains("::")
    halves = F.split(address, "::", -1)
    words = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))
    left, right = words(F.try_element_at(halves, F.lit(1))), words(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    middle = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    full = F.when(has_gap, F.concat(left, middle, right)).otherwise(groups)
    valid6 = address.rlike("^[0-9a-fA-F:]+$") & (F.size(full) == 8) & F.forall(full, lambda w: w.rlike("^[0-9a-fA-F]{1,4}$"))
    bits6 = F.array_join(F.transform(full, lambda w: F.lpad(F.conv(w, 16, 2), 16, "0")), "")
    return F.when(valid6, bits6)


def address_octets(address: Column) -> Column:
    """Byte values of an address, 4 for IPv4, 16 for IPv6; null when neither."""
    v4 = bound(ipv4_to_int(address), lambda v: F.when(v.isNotNull(), F.array(*[F.shiftright(v, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)])))
    v6 = bound(bits_of_groups(address), lambda t: F.when(t.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(t, i * 8 + 1, F.lit(8)), 2, 10).cast("bigint"))))
    return F.coalesce(v4, v6)


def channel_hash(address: Column, port: Column) -> Column:
    """Hash of a channel's address bytes, family and port, IPv4 or IPv6 (FN-14); null when the address is neither."""
    return bound(address_octets(address), lambda octets: fnv1a64(octets, F.when(F.size(octets) == 4, FAMILY_IPV4).otherwise(FAMILY_IPV6), port))


def resolve_slot(address: Column, port: Column, max_channels: int) -> Column:
    """Table slot of a channel."""
    return F.pmod(channel_hash(address, port), F.lit(max_channels).cast(U64)).cast("int")


def resolve_port(address: Column, port: Column, base_port: int, max_channels: int) -> Column:
    """Dedicated port of a channel: base and its slot (FN-14)."""
    return (F.lit(base_port) + resolve_slot(address, port, max_channels)).cast("int")


def in_ranges(df: DataFrame, address: str, ranges: DataFrame) -> DataFrame:
    """Rows whose address, IPv4 or IPv6, lies in one of the ranges ``cidr`` (PRJ-11).

    A range is a prefix of address bits. Every distinct address is cut at the prefix lengths in use (at most 162) and
    looked up by equality, so no address is compared with every range.
    """
    net = ranges.select(address_bits(F.substring_index("cidr", "/", 1)).alias("b"), F.substring_index("cidr", "/", -1).try_cast("int").alias("n"))
    keys = net.filter(F.col("n").between(0, F.length("b"))).select(F.length("b").alias("size"), "n", F.substring("b", F.lit(1), F.col("n")).alias("prefix")).distinct()
    lengths = keys.agg(F.collect_set(F.struct("size", "n"))).scalar()
    seen = df.select(address).distinct().withColumn("__b", address_bits(F.col(address))).withColumn("__n", lengths)
    fitting = F.filter("__n", lambda k: k["size"] == F.length("__b"))
    probes = seen.select(address, "__b", F.explode(fitting).alias("k")).select(address, "k.*", F.substring("__b", F.lit(1), F.col("k.n")).alias("prefix"))
    inside = probes.join(keys, ["size", "n", "prefix"], "left_semi").select(address).distinct()
    return df.join(inside, address, "left_semi").select(*df.columns)


def service_lines(services: DataFrame, fmt: str, extension: str = "urn:airlens:triplet", ret: dict | None = None, fcc: dict | None = None) -> DataFrame:
    """One entry per service as csv, m3u, xspf or announcement xml text (SNK-3).

    ``ret``/``fcc`` add the retransmission and fast-change blocks to xml entries; see ``_retransmission``.
    """
    triplet = F.concat(F.lit('tsid="'), F.col("tsid"), F.lit('" onid="'), F.col("onid"), F.lit('" sid="'), F.col("sid"), F.lit('"'))
    if fmt == "csv":
        line = F.concat_ws(",", csv_safe_name(F.col("name")), "uri", "tsid", "onid", "sid")
    elif fmt == "m3u":
        line = F.concat(F.lit("#EXTINF:-1 "), triplet, F.lit(","), F.col("name"), F.lit("\n"), F.col("uri"))
    elif fmt == "xspf":
        line = F.concat(
            F.lit("<track><location>"), xml_escape(F.col("uri")), F.lit("</location><title>"), xml_escape(F.col("name")),
            F.lit(f'</title><extension application="{extension}" '), triplet, F.lit("/></track>"),
        )
    elif fmt == "xml":
        services = with_address(services)
        line = _announcement(ret, fcc)
    else:
        raise ValueError(f"unknown format {fmt}")
    return services.select("ord", line.alias("line"))


def attr(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))


def _retransmission(ret: dict) -> Column:
    """``ret``: addr, port, rtx_time_ms, rtx_pt, and optionally summary (bool), multicast (bool), multicast_port."""
    rtx = f' rtx-time="{ret["rtx_time_ms"]}" RTPPayloadTypeNumber="{ret["rtx_pt"]}"/>'
    summary = ' dvb-rsi-mc-ret="true"' if ret.get("summary") else ""
    head = f'<RTPRetransmission><RTCPReporting DestinationAddress="{ret["addr"]}" DestinationPort="{ret["port"]}"{summary}/><UnicastRET{rtx}'
    if not ret.get("multicast"):
        return F.lit(head + "</RTPRetransmission>")
    port = F.lit(str(ret["multicast_port"])) if ret.get("multicast_port") else F.col("port")
    return F.concat(F.lit(head + "<MulticastRET"), attr("GroupAddress", F.col("address")), attr("DestinationPort", port), F.lit(rtx + "</RTPRetransmission>"))


def _fast_change(fcc: dict) -> Column:
    """``fcc``: addr, port, rtx_time_ms, rtx_pt, and optionally base_port with max_channels for per-channel ports."""
    port = F.lit(str(fcc["port"]))
    if fcc.get("max_channels"):
        port = F.when(F.col("family").isNotNull(), resolve_port(F.col("address"), F.col("port"), fcc["base_port"], fcc["max_channels"]).cast("string")).otherwise(port)
    return F.concat(
        F.lit("<ServerBasedEnhancementServiceInfo><EnhancementService>FCC</EnhancementService>"),
        F.lit(f'<RTCPReporting DestinationAddress="{fcc["addr"]}"'), attr("DestinationPort", port), F.lit("/><Retransmission_session"),
        attr("DestinationPort", port), F.lit(f' rtx-time="{fcc["rtx_time_ms"]}" RTPPayloadTypeNumber="{fcc["rtx_pt"]}"/></ServerBasedEnhancementServiceInfo>'),
    )


def _announcement(ret: dict | None, fcc: dict | None) -> Column:
    blocks = [b for b in (_retransmission(ret) if ret else None, _fast_change(fcc) if fcc else None) if b is not None]
    closing = F.concat(F.lit(">"), *blocks, F.lit("</IPMulticastAddress>")) if blocks else F.lit("/>")
    return F.concat(
        F.lit("<SingleService><ServiceLocation><IPMulticastAddress"), attr("Address", F.col("address")), attr("Port", F.col("port")),
        attr("Streaming", F.when(F.col("rtp"), "rtp").otherwise("udp")), closing, F.lit("</ServiceLocation><TextualIdentifier"),
        attr("ServiceName", xml_escape(F.col("name"))), F.lit("/><DVBTriplet"), attr("OrigNetId", F.col("onid")), attr("TSId", F.col("tsid")),
        attr("ServiceId", F.col("sid")), F.lit("/></SingleService>"),
    )


def provider_lines(providers: DataFrame) -> DataFrame:
    """Provider entry per row ``domain, version, lang, name, push_addr, push_port, payload_ids`` (SNK-9)."""
    ids = F.array_join(F.transform(F.concat(F.array(F.lit(2)), F.coalesce("payload_ids", F.array().cast("array<int>"))), lambda i: F.concat(F.lit('<PayloadId Id="'), i.cast("string"), F.lit('"/>'))), "")
    line = F.concat(
        F.lit("<ServiceProvider"), attr("DomainName", xml_escape(F.col("domain"))), attr("Version", F.col("version")), F.lit("><Name"),
        attr("Language", F.substring("lang", 1, 3)), F.lit(">"), xml_escape(F.col("name")), F.lit("</Name><Offering><Push"),
        attr("Address", F.col("push_addr")), attr("Port", F.col("push_port")), F.lit(">"), ids, F.lit("</Push></Offering></ServiceProvider>"),
    )
    return providers.select("domain", line.alias("line"))


def package_lines(packages: DataFrame, services: DataFrame) -> DataFrame:
    """Package entry per row of ``packages``: its members with their triplets (SNK-9). A package holds at most 64 members."""
    members = package_services(packages, services)
    triplet = F.concat(F.lit("<DVBTriplet"), attr("OrigNetId", F.col("onid")), attr("TSId", F.col("tsid")), attr("ServiceId", F.col("sid")), F.lit("/>"))
    member = F.concat(F.lit("<Service><TextualID"), attr("ServiceName", xml_escape(F.col("service_name"))), F.lit("/>"), F.coalesce(triplet, F.lit("")), F.lit("</Service>"))
    bodies = members.withColumn("m", member).groupBy("ord", "id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]), "").alias("body")
    )
    head = F.concat(
        F.lit("<Package"), attr("Id", F.col("id")), attr("Visible", F.when(F.col("visible"), "true").otherwise("false")), F.lit("><PackageName"),
        attr("Language", F.substring("lang", 1, 3)), F.lit(">"), xml_escape(F.col("name")), F.lit("</PackageName>"),
    )
    return packages.join(bodies, ["ord", "id"]).select("ord", F.concat(head, "body", F.lit("</Package>")).alias("line"))


def cell_lines(cells: DataFrame) -> DataFrame:
    """Regional cell per row: country and the nested civic address chain, outermost first (SNK-9)."""
    opens = F.array_join(F.transform("ca", lambda c: F.concat(F.lit("<CA"), attr("Type", c["type"]), attr("Value", xml_escape(c["value"])), F.lit(">"))), "")
    closes = F.repeat(F.lit("</CA>"), F.size("ca"))
    line = F.concat(F.lit("<Cell"), attr("Id", xml_escape(F.col("id"))), F.lit("><CountryCode>"), xml_escape(F.col("country")), F.lit("</CountryCode>"), opens, closes, F.lit("</Cell>"))
    return cells.select("ord", line.alias("line"))


def upgrade_lines(managers: DataFrame, firmware: DataFrame) -> DataFrame:
    """Remote management and firmware entries (SNK-9).

    ``managers``: ``ord, location, logo, lang, name``; ``firmware``: ``ord, logo, lang, name, fus_id, address, port``.
    """
    optional = lambda name, col: F.coalesce(attr(name, xml_escape(F.col(col))), F.lit(""))
    rms = F.concat(
        F.lit("<RMSProvider"), attr("RMSLocation", xml_escape(F.col("location"))), optional("LogoURI", "logo"), F.lit("><RMSName"),
        attr("Language", F.substring("lang", 1, 3)), F.lit(">"), xml_escape(F.col("name")), F.lit("</RMSName></RMSProvider>"),
    )
    where = F.concat(F.lit("<MulticastAnnouncementAddress"), attr("Address", F.col("address")), attr("Port", F.col("port")), F.lit("/>"))
    fus = F.concat(
        F.lit("<FUSProvider"), optional("LogoURI", "logo"), F.lit("><FUSName"), attr("Language", F.substring("lang", 1, 3)), F.lit(">"), xml_escape(F.col("name")),
        F.lit("</FUSName><FUSID>"), F.col("fus_id").cast("string"), F.lit("</FUSID><FUSAnnouncement>"), F.coalesce(where, F.lit("")), F.lit("</FUSAnnouncement></FUSProvider>"),
    )
    return managers.select(F.lit(1).alias("part"), "ord", rms.alias("line")).unionByName(firmware.select(F.lit(2).alias("part"), "ord", fus.alias("line")))


def sweep_candidates(bases: DataFrame, low_port: int, high_port: int) -> DataFrame:
    """Addresses 1 to 254 of each base network with every port (PRJ-12). ``bases``: ``network`` such as 239.1.1.0."""
    prefix = F.regexp_extract("network", r"^(.*)\.[0-9]+$", 1)
    hosts = bases.select("network", prefix.alias("__p"), F.explode(F.sequence(F.lit(1), F.lit(254))).alias("host"))
    return hosts.select("network", F.concat_ws(".", "__p", "host").alias("address"), F.explode(F.sequence(F.lit(low_port), F.lit(high_port))).alias("port"))
