"""Writers of line documents and cue files. All write in parallel, one folder per result. Packets: ``packet_files``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str], by: list[str] | None = None, header: str = "", footer: str = "") -> None:
    """Ordered text lines; with ``by`` one folder per document key.

    Lines are range-partitioned on the order, so parts read in name order are the document. Header and footer are
    lines of their own at both ends.
    """
    by = by or []
    framed = lines.select(*by, *order, "line")
    ends = []
    for text, rank in ((header, 0), (footer, 2)):
        if text:
            source = framed.select(*by).distinct() if by else framed.sparkSession.range(1)
            nulls = [F.lit(None).cast(framed.schema[c].dataType).alias(c) for c in order]
            ends.append(source.select(*by, *nulls, F.lit(text).alias("line"), F.lit(rank).alias("__rank")))
    out = framed.withColumn("__rank", F.lit(1))
    for end in ends:
        out = out.unionByName(end)
    keys = [*by, "__rank", *order]
    sorted_lines = out.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*by, F.col("line").alias("value"))
    writer = sorted_lines.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def write_xmltv(lines: DataFrame, path: str, generator: str = "airlens") -> None:
    """XMLTV document from ``xmltv_lines`` (SNK-1)."""
    head = f'{XML_HEAD}\n<!DOCTYPE tv SYSTEM "xmltv.dtd">\n<tv generator-info-name="{generator}">'
    write_lines(lines, path, ["part", "ord"], header=head, footer="</tv>")


def write_openmetrics(lines: DataFrame, path: str) -> None:
    """Exposition text from ``render_openmetrics`` (SNK-4)."""
    write_lines(lines, path, ["part", "def_ord", "line_kind", "slot_ord", "entry_ord"])


def write_cues(lines: DataFrame, path: str) -> None:
    """Cue blocks of each capture in time order, blank line between (SNK-6)."""
    blocks = lines.select("capture", "start_ms", F.concat("line", F.lit("\n")).alias("line"))
    write_lines(blocks, path, ["start_ms"], by=["capture"])
