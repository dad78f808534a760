"""Document fingerprints from closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.once import evaluate_once
from airlens.llm.work import written

#: Texts below hold their characters by place, too, and below the second bound syncmers of characters.
PLACES, CHARACTERS = 100, 400
PARTS = ("places", "characters", "words")


def _hashes(symbols: Column, size: int) -> Column:
    """Hash of every ``size`` symbols in a row (hashes), none if there are fewer."""
    return F.transform(
        F.slice(symbols, 1, F.greatest(F.size(symbols) - (size - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(symbols, i + j) for j in range(1, size)]),
    )


def _placed(inner: Column, reach: int) -> Column:
    """Closed syncmers of ``reach + 1`` inner substrings, with their places: the smallest of these stands first or last.

    Which k-mers are chosen depends on their own symbols alone, so an edit changes only those that it touches.
    """

    def chosen(x: Column, i: Column) -> Column:
        last = F.get(inner, i + reach)
        between = F.least(*[F.get(inner, i + j) for j in range(1, reach)])
        return F.when(F.least(x, last) <= between, F.struct(F.xxhash64(x, F.get(inner, i + reach // 2), last).alias("hash"), i.alias("place")))

    return F.array_compact(F.transform(F.slice(inner, 1, F.greatest(F.size(inner) - reach, F.lit(0))), chosen))


def _closed(inner: Column, reach: int) -> Column:
    """Hashes of the closed syncmers of ``reach + 1`` inner substrings."""
    return _placed(inner, reach)["hash"]


def sketched(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: a struct of the three parts of column ``text`` (not null), each all anchors as (hash, place).

    ``words``: closed syncmers of 6 words over pairs of words, in every text. ``characters``: of 12 characters over groups
    of 4, too, in texts under 400 and in those whose words have 40 characters or more on average. ``places``: every
    character, too, in texts under 100: a few words may hold no syncmer. A part is as long as its text makes it.
    """
    none = F.array().cast("array<bigint>")
    n, words = F.char_length(text), F.split(F.col(text), r"[\x09-\x0D ]+")
    df = evaluate_once(df, "_w", F.transform(words, lambda x: F.xxhash64(x)))
    short = (n < CHARACTERS) | (n > 40 * F.size("_w"))
    df = evaluate_once(df, "_c", F.when(short & (n > 0), F.transform(F.split(F.col(text), ""), lambda x: F.xxhash64(x))).otherwise(none))
    df = evaluate_once(df, "_w", _hashes(F.col("_w"), 2))
    df = evaluate_once(df, "_q", _hashes(F.col("_c"), 4))
    places = F.transform(F.when(n < PLACES, F.col("_c")).otherwise(none), lambda x, i: F.struct(x.alias("hash"), i.alias("place")))
    parts = F.struct(places.alias(PARTS[0]), _placed(F.col("_q"), 8).alias(PARTS[1]), _placed(F.col("_w"), 4).alias(PARTS[2]))
    return evaluate_once(df, name, parts).drop("_w", "_c", "_q")


def as_text(sketch: Column) -> Column:
    """A fingerprint as text: SHA-256 of each part's anchors and places, empty for an empty part, parts parted by colons."""

    def of(part: Column) -> Column:
        listed = F.array_join(F.transform(part, lambda a: F.concat_ws("@", a["hash"].cast("string"), a["place"].cast("string"))), ",")
        return F.when(F.size(part) > 0, F.sha2(listed, 256)).otherwise(F.lit(""))

    return F.concat_ws(":", *[of(sketch[p]) for p in PARTS])


def links(sketch: Column) -> Column:
    """What two texts are matched by, for each part: distinct hashes of an anchor, the one after it and how far that is.

    Equal links are anchors that match and agree in relative position, wherever a text before them got longer or
    shorter. The last anchor stands with the end of the list. ``places`` agree in place itself: their texts are short.
    """

    def of(part: Column) -> Column:
        def link(a: Column, i: Column) -> Column:
            after = F.get(part, i + 1)
            return F.xxhash64(a["hash"], after["hash"], after["place"] - a["place"])

        return F.array_distinct(F.transform(part, link))

    at = F.array_distinct(F.transform(sketch[PARTS[0]], lambda a: F.xxhash64(a["hash"], a["place"])))
    return F.named_struct(F.lit(PARTS[0]), at, *[x for p in PARTS[1:] for x in (F.lit(p), of(sketch[p]))])


def likeness(a: Column, b: Column) -> Column:
    """Share of common links (0 to 1) among those of either: the best of the parts that both have.

    1 for equal links, 0 if no part is in both.
    """

    def of(part: str) -> Column:
        x, y = a[part], b[part]
        both = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)).otherwise(F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*[of(p) for p in PARTS]))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``pos``: places from 0 in the given order, by range partitions and their sizes; and ``total``."""
    # Rows and their marks come from one written table: ranges are sampled, and a second run could cut them elsewhere.
    marked = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    sizes = marked.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row a partition
    ahead = Window.orderBy("part")
    offsets = sizes.select("part", (F.sum("size").over(ahead) - F.col("size")).alias("ahead"), F.sum("size").over(Window.partitionBy()).alias("total"))
    return marked.withColumn("part", part).join(offsets, "part").withColumn("pos", F.col("ahead") + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("part", "mark", "ahead")


def fingerprints(docs: DataFrame, with_links: bool = False) -> DataFrame:
    """Fingerprint of every row of ``docs(doc_id, text)`` and of its edited text, and how near it is to two others.

    The edited text has its last ``floor(n_chars / 3)`` characters replaced by as many first ones of the next document's
    text (or all of it, if it has fewer): the next in descending doc_id, the first after the last. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and with ``with_links`` also ``links``, what ``likeness`` compares.

    Texts are shuffled once, by doc_id and a hash; a third of each and its links are sent on to the document before it. Null text is empty:
    its fingerprint has empty parts. Rows of one doc_id follow each other by a hash of their text; rows equal in both count
    as one document and come out as often as they came in. Null doc_id comes last in the order. One document is its own next.
    """
    lowest = F.lit(-(1 << 63))
    # Both uses of the texts below read the same three columns, so that they share one shuffle.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", lowest).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("h"), text.alias("text"))
    keys = rows.groupBy("id", "h").agg(F.count("*").alias("times"), F.first(F.char_length("text")).alias("n_chars"))
    placed = written(in_order(keys, F.col("id").desc(), F.col("h").desc()))
    before = placed.select("id", "h", "times", "n_chars", F.pmod(F.col("pos") - 1, F.col("total")).alias("pos"))
    givers = before.join(placed.select("pos", F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 3).alias("need")), "pos").drop("pos")
    texts = rows.join(givers, ["id", "h"]).select("id", "h", "text", "times", "n_chars", "to_id", "to_h", "need").dropDuplicates(["id", "h"])
    # The next document's links come with its gift; a text's own anchors are made where they are used.
    gifts = sketched(texts, "text", "next").select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.expr("substring(text, 1, int(need))").alias("gift"), links(F.col("next")).alias("next_links"))
    both = texts.join(gifts, ["id", "h"]).withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))"), "gift"))
    both = both.select("id", "times", "n_chars", "text", "edited", "next_links", F.sha2("edited", 256).alias("edited_sha256"))
    own = sketched(both, "text", "sketch").drop("text")
    own = evaluate_once(own, "own_links", links(F.col("sketch")))
    own = own.withColumn("fingerprint", as_text(F.col("sketch"))).drop("sketch")
    own = sketched(own, "edited", "edited_sketch").drop("edited")
    return (
        own.select(
            F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"),
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            "fingerprint",
            as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
            likeness(F.col("own_links"), links(F.col("edited_sketch"))).alias("near_edited"),
            likeness(F.col("own_links"), F.col("next_links")).alias("near_next"),
            *[F.col("own_links").alias("links")] * with_links,
            F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"),
        )
        .drop("nth")
    )
