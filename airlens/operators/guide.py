"""Programme guides: channel mapping, programme text, windows, statistics, name matching and documents as lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.guide_time import build_crid, iso_to_minutes, iso_to_xmltv, minutes_to_unix
from airlens.functions.once import evaluate_once
from airlens.functions.text import ascii_lower, xml_escape
from airlens.session import cut_lineage


def apply_mapping(channels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Channels with the address of the first mapping line for their id; unmapped ones keep nulls (JOIN-1)."""
    values = [c for c in ("uri", "tsid", "onid", "sid") if c in mapping.columns]
    first = mapping.groupBy("id").agg(F.min_by(F.struct(*values), "ord").alias("__m"))
    kept = [c for c in channels.columns if c not in values]
    return channels.select(*kept).join(first, "id", "left").select(*kept, *[F.col(f"__m.{v}").alias(v) for v in values])


def _last_moves(moves: DataFrame) -> DataFrame:
    """Each move ``(id, ord)`` with the id at the end of its chain; every round doubles how far a move looks ahead."""
    moves = cut_lineage(moves)
    while not moves.filter("next_ord IS NOT NULL").isEmpty():
        ahead = moves.select(F.col("id").alias("__id"), F.col("ord").alias("__ord"), F.col("new_id").alias("__new"), F.col("next_ord").alias("__next"))
        met = moves.join(ahead, (F.col("new_id") == F.col("__id")) & (F.col("next_ord") == F.col("__ord")), "left")
        moves = cut_lineage(met.select("id", "ord", F.coalesce("__new", "new_id").alias("new_id"), F.col("__next").alias("next_ord")))
    return moves


def apply_revmap(channels: DataFrame, programmes: DataFrame, revmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename channels by address and their programmes with them (JOIN-2).

    The first line for an address wins. Channels are renamed one after the other: a programme moves with the first channel
    that bears its id, and where a later channel bears the id it has then, it moves on with that one.
    """
    first = revmap.groupBy("uri").agg(F.min_by("id", "ord").alias("new_id"))
    renamed = channels.join(first, "uri", "left")
    moves = renamed.filter("new_id IS NOT NULL").groupBy("id", "ord").agg(F.min("new_id").alias("new_id"))
    # a move's next: the first later channel that bears the new id
    onward = moves.select(F.col("id").alias("new_id"), F.col("ord").alias("next_ord"))
    chained = moves.join(onward, "new_id", "left").groupBy("id", "ord", "new_id").agg(F.min(F.when(F.col("next_ord") > F.col("ord"), F.col("next_ord"))).alias("next_ord"))
    firsts = moves.groupBy("id").agg(F.min("ord").alias("ord"))
    checked = _last_moves(chained).join(firsts, ["id", "ord"], "left_semi").select(F.col("id").alias("channel_id"), "new_id")
    out_channels = renamed.withColumn("id", F.coalesce("new_id", "id")).select(*channels.columns)
    out_programmes = programmes.join(checked, "channel_id", "left").withColumn("channel_id", F.coalesce("new_id", "channel_id"))
    return out_channels, out_programmes.select(*programmes.columns)


def attach_programme_text(events: DataFrame, progtext: DataFrame) -> DataFrame:
    """Schedule events with title, description and category by programme reference; the first text wins (JOIN-3)."""
    values = [c for c in ("title", "desc", "category") if c in progtext.columns]
    first = progtext.groupBy("crid").agg(F.min_by(F.struct(*values), "ord").alias("__t"))
    return events.join(first, "crid", "left").select(*events.columns, *[F.col(f"__t.{v}").alias(v) for v in values])


def match_names_exact(channels: DataFrame, services: DataFrame) -> DataFrame:
    """First service whose name equals any of a channel's names, letters A to Z folded (JOIN-4)."""
    by_name = services.groupBy(ascii_lower(F.col("name")).alias("__n")).agg(F.min("ord").alias("service_ord"))
    names = channels.select("ord", "id", F.explode("names").alias("__name")).select("ord", "id", ascii_lower(F.col("__name")).alias("__n"))
    return names.join(by_name.hint("merge"), "__n").groupBy("ord", "id").agg(F.min("service_ord").alias("service_ord"))


def _substrings(col: Column, lengths: Column) -> Column:
    """Every distinct substring of ``col`` whose length is in ``lengths``."""
    return F.array_distinct(
        F.flatten(F.transform(
            F.filter(lengths, lambda n: n <= F.length(col)),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(col) - n + 1), lambda at: F.substring(col, at, n)),
        ))
    )


def match_names_fuzzy(channels: DataFrame, services: DataFrame) -> DataFrame:
    """First service whose name contains, or is contained in, any of a channel's names (JOIN-5).

    Containment is an equality join: a name equals one of the other name's substrings. Substrings are taken only at
    the lengths the searched names have, and each side is first reduced to one row per distinct name, so neither a
    nested loop nor a pair per duplicate arises. An empty name is contained in every name.
    Planned sizes leave the substrings out of account, so all joins here merge and nothing is broadcast.
    """
    offered = services.groupBy(ascii_lower(F.col("name")).alias("s")).agg(F.min("ord").alias("service_ord"))
    names = channels.select("ord", "id", F.explode("names").alias("__name")).select("ord", "id", ascii_lower(F.col("__name")).alias("c"))
    wanted = names.select("c").distinct()
    lengths_of = lambda df, c: df.agg(F.array_sort(F.collect_set(F.length(c))).alias("n")).scalar()
    # needle = channel name, searched in service names
    searched = offered.filter("s <> ''").withColumn("__n", lengths_of(wanted.filter("c <> ''"), "c"))
    in_service = searched.select("service_ord", F.explode(_substrings(F.col("s"), F.col("__n"))).alias("c"))
    in_service = in_service.groupBy("c").agg(F.min("service_ord").alias("service_ord"))
    # needle = service name, searched in channel names
    searched = wanted.filter("c <> ''").withColumn("__n", lengths_of(offered.filter("s <> ''"), "s"))
    in_channel = searched.select("c", F.explode(_substrings(F.col("c"), F.col("__n"))).alias("s"))
    in_channel = in_channel.join(offered.hint("merge"), "s").groupBy("c").agg(F.min("service_ord").alias("service_ord"))
    # empty names match everything
    first_service = offered.agg(F.min("service_ord")).scalar()
    empty_service = offered.filter("s = ''").agg(F.min("service_ord")).scalar()
    every = wanted.select("c", F.when(F.col("c") == "", first_service).otherwise(empty_service).alias("service_ord")).filter("service_ord IS NOT NULL")
    best = in_service.unionByName(in_channel).unionByName(every).groupBy("c").agg(F.min("service_ord").alias("service_ord"))
    return names.join(best.hint("merge"), "c").groupBy("ord", "id").agg(F.min("service_ord").alias("service_ord"))


def suggest_mapping(channels: DataFrame, services: DataFrame) -> DataFrame:
    """Best service per channel: exact, else fuzzy, else none."""
    exact = match_names_exact(channels, services).select("id", F.col("service_ord").alias("__e"))
    fuzzy = match_names_fuzzy(channels.join(exact.hint("merge"), "id", "left_anti"), services).select("id", F.col("service_ord").alias("__f"))
    joined = channels.join(exact.hint("merge"), "id", "left").join(fuzzy.hint("merge"), "id", "left")
    chosen = joined.withColumn("service_ord", F.coalesce("__e", "__f")).withColumn(
        "match", F.when(F.col("__e").isNotNull(), "exact").when(F.col("__f").isNotNull(), "fuzzy").otherwise("none")
    )
    found = services.select(F.col("ord").alias("service_ord"), F.col("name").alias("service_name"), "uri", "tsid", "onid", "sid")
    kept = [c for c in channels.columns if c not in ("uri", "tsid", "onid", "sid")]
    return chosen.select(*kept, "match", "service_ord").join(found.hint("merge"), "service_ord", "left").drop("service_ord")


def channel_unmatched(channels: DataFrame, services: DataFrame) -> DataFrame:
    """Channels without exact or fuzzy match (SET-4)."""
    fuzzy = match_names_fuzzy(channels, services)  # an exact match is also a containment
    return channels.join(fuzzy.select("id").hint("merge"), "id", "left_anti")


def mapping_suggestion_lines(suggestions: DataFrame) -> DataFrame:
    """Mapping file lines: live for exact, commented for fuzzy and unmatched (SNK-7)."""
    first_name = F.coalesce(F.try_element_at("names", F.lit(1)), F.lit("?"))
    triplet = F.concat_ws(",", "uri", "tsid", "onid", "sid")
    line = (
        F.when(F.col("match") == "exact", F.concat_ws(",", "id", triplet))
        .when(F.col("match") == "fuzzy", F.concat(F.lit("# "), "id", F.lit(" ("), first_name, F.lit(") -> closest: "), "service_name", F.lit(", "), triplet))
        .otherwise(F.concat(F.lit("# UNMATCHED: "), "id", F.lit(" ("), first_name, F.lit(")")))
    )
    return suggestions.select("ord", line.alias("line"))


def channels_with_events(channels: DataFrame, programmes: DataFrame) -> DataFrame:
    """Channels that have a programme (JOIN-12)."""
    return channels.join(programmes.select(F.col("channel_id").alias("id")), "id", "left_semi")


def orphan_programmes(programmes: DataFrame, channels: DataFrame) -> DataFrame:
    """Programmes of unknown channels (JOIN-12)."""
    return programmes.join(channels.select(F.col("id").alias("channel_id")), "channel_id", "left_anti")


def playable_programmes(programmes: DataFrame, channels: DataFrame) -> DataFrame:
    """Programmes whose channel has an address (PRJ-19)."""
    mapped = channels.filter("uri IS NOT NULL AND uri <> ''").select(F.col("id").alias("channel_id"))
    return programmes.join(mapped, "channel_id", "left_semi")


def with_minutes(programmes: DataFrame) -> DataFrame:
    """Derived start and stop minutes of text times; an unreadable stop becomes null."""
    for text, minutes in (("start", "start_min"), ("stop", "stop_min")):  # the text is read a dozen times, the minutes by every filter
        programmes = evaluate_once(evaluate_once(programmes, text, F.col(text)), minutes, iso_to_minutes(F.col(text)))
    return programmes


def guide_window(programmes: DataFrame, now_min: int, window_min: int) -> DataFrame:
    """Programmes not over yet that start within the window (PRJ-15). Needs ``start_min, stop_min``."""
    end = F.coalesce("stop_min", "start_min")
    return programmes.filter(F.col("start_min").isNotNull() & (end >= now_min) & (F.col("start_min") <= now_min + window_min))


def guide_stats(channels: DataFrame, windowed: DataFrame) -> DataFrame:
    """Services, services with events, events and schedule bounds of a windowed guide (AGG-4), zeros when empty."""
    services = channels.agg(F.count(F.lit(1)).alias("services"))
    known = channels_with_events(channels, windowed).agg(F.count_distinct("id").alias("services_with_events"))
    end = F.coalesce("stop_min", "start_min")
    events = windowed.agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(minutes_to_unix(F.min("start_min")), F.lit(0)).alias("schedule_start"),
        F.coalesce(minutes_to_unix(F.max(end)), F.lit(0)).alias("schedule_end"),
    )
    # each side is one row
    return services.crossJoin(known).crossJoin(events)


def guide_fragments(channels: DataFrame, programmes: DataFrame) -> DataFrame:
    """Programme texts, schedules and services of the mapped channels, in that order (SET-1)."""
    mapped = channels.filter("uri IS NOT NULL AND uri <> ''")
    shown = playable_programmes(programmes, channels)
    texts = shown.select(F.lit(1).alias("grp"), "ord", F.col("channel_id").alias("key"))
    schedules = channels_with_events(mapped, programmes).select(F.lit(2).alias("grp"), "ord", F.col("id").alias("key"))
    services = mapped.select(F.lit(3).alias("grp"), "ord", F.col("id").alias("key"))
    return texts.unionByName(schedules).unionByName(services)


def publication_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and publications with their errors and the last success (AGG-20).

    ``events``: keys, ``arrival, us, kind ('document'|'publication'), ok``.
    """
    of = lambda kind, ok: F.count_if((F.col("kind") == kind) & (F.col("ok") == ok))
    return events.groupBy(*keys).agg(
        of("document", True).alias("documents"), of("document", False).alias("document_errors"),
        of("publication", True).alias("publications"), of("publication", False).alias("publication_errors"),
        F.max(F.when((F.col("kind") == "publication") & F.col("ok"), F.col("us"))).alias("last_success_us"),
    )


# ---- documents as ordered lines --------------------------------------------------------------------------------


def tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>"))


def _optional(present: Column, value: Column) -> Column:
    return F.when(F.coalesce(present, F.lit(False)), value).otherwise("")


def xmltv_lines(channels: DataFrame, programmes: DataFrame) -> DataFrame:
    """Elements of an XMLTV document, one line each, ordered by ``part, ord`` (SNK-1)."""
    has_names = F.size(F.coalesce("names", F.array())) > 0
    names = F.when(has_names, F.col("names")).otherwise(F.array("id"))
    channel = F.concat(
        F.lit('<channel id="'), xml_escape(F.col("id")), F.lit('">'),
        F.array_join(F.transform(names, lambda n: tag("display-name", n)), ""), F.lit("</channel>"),
    )
    for text in ("start", "stop"):  # read a dozen times by its own conversion, and that again by filter and line
        programmes = evaluate_once(evaluate_once(programmes, text, F.col(text)), text, iso_to_xmltv(F.col(text)))
    start, stop = F.col("start"), F.col("stop")
    filled = lambda c: F.length(c) > 0
    title = F.when(filled("title"), F.col("title")).otherwise("(untitled)")
    programme = F.concat(
        F.lit('<programme start="'), start, F.lit('"'), _optional(stop.isNotNull(), F.concat(F.lit(' stop="'), stop, F.lit('"'))),
        F.lit(' channel="'), xml_escape(F.col("channel_id")), F.lit('">'), tag("title", title),
        _optional(filled("desc"), tag("desc", F.col("desc"))), _optional(filled("category"), tag("category", F.col("category"))), F.lit("</programme>"),
    )
    return channels.select(F.lit(1).alias("part"), "ord", channel.alias("line")).unionByName(
        programmes.filter(start.isNotNull()).select(F.lit(2).alias("part"), "ord", programme.alias("line"))
    )


GENRE_SCHEME = "urn:tva:metadata:cs:ContentCS:2011:3.0"  # fixed value: unclassified content


def guide_lines(channels: DataFrame, programmes: DataFrame, authority: str = "guide.invalid", genre: str = GENRE_SCHEME) -> DataFrame:
    """Elements of a broadcast guide document in order ``part, ord, sub`` (SNK-2).

    Only mapped channels and their programmes appear; a schedule needs at least one programme.
    """
    mapped = channels.filter("uri IS NOT NULL AND uri <> ''")
    shown = playable_programmes(programmes, channels)
    crid = build_crid(F.col("channel_id"), F.col("start"), authority)
    filled = lambda c: F.length(c) > 0
    text = F.concat(
        F.lit('<ProgramInformation programId="'), xml_escape(crid), F.lit('"><BasicDescription>'),
        _optional(filled("title"), tag("Title", F.col("title"))), _optional(filled("desc"), tag("Synopsis", F.col("desc"))),
        _optional(filled("category"), F.concat(F.lit(f'<Genre href="{genre}">'), tag("Name", F.col("category")), F.lit("</Genre>"))),
        F.lit("</BasicDescription></ProgramInformation>"),
    )
    event = F.concat(
        F.lit('<ScheduleEvent><Program crid="'), xml_escape(crid), F.lit('"/>'), tag("PublishedStartTime", F.col("start")),
        _optional(filled("stop"), tag("PublishedEndTime", F.col("stop"))), F.lit("</ScheduleEvent>"),
    )
    opened = F.concat(F.lit('<Schedule serviceIDRef="'), xml_escape(F.col("id")), F.lit('">'))
    service = F.concat(
        F.lit('<ServiceInformation serviceId="'), xml_escape(F.col("id")), F.lit('">'),
        F.array_join(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: tag("Name", n)), ""),
        F.lit('<ServiceURL name="IPTV">'), xml_escape(F.col("uri")), F.lit('</ServiceURL><ServiceURL name="DTT">'),
        F.concat(F.lit("dvb://"), F.concat_ws(".", "onid", "tsid", "sid")), F.lit("</ServiceURL></ServiceInformation>"),
    )
    low, high = F.lit(-1).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint")
    by_channel = shown.join(mapped.select(F.col("id").alias("channel_id"), F.col("ord").alias("__c")), "channel_id")
    scheduled = channels_with_events(mapped, programmes)
    parts = [
        shown.select(F.lit(1).alias("part"), "ord", low.alias("sub"), text.alias("line")),
        scheduled.select(F.lit(2).alias("part"), "ord", low.alias("sub"), opened.alias("line")),
        by_channel.select(F.lit(2).alias("part"), F.col("__c").alias("ord"), F.col("ord").alias("sub"), event.alias("line")),
        scheduled.select(F.lit(2).alias("part"), "ord", high.alias("sub"), F.lit("</Schedule>").alias("line")),
        mapped.select(F.lit(3).alias("part"), "ord", low.alias("sub"), service.alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def export_mapping(channels: DataFrame) -> DataFrame:
    """Mapping lines of the channels that have an address (SNK-8)."""
    line = F.concat_ws(",", "id", "uri", "tsid", "onid", "sid")
    return channels.filter("uri IS NOT NULL AND uri <> ''").select("ord", line.alias("line"))
