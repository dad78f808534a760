"""Documents announced in numbered sections: header decoding, reassembly and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens.functions.binary import be, be16, be32, bits, concat_bytes, crc32_mpeg2, tail, u8
from airlens.operators.ordered import DEFAULT_SPAN, changes, scan


def read_doc_sections(df: DataFrame, col: str = "datagram") -> DataFrame:
    """Section header fields and payload of each valid datagram (SRC-12); others are dropped."""
    p = F.col(col)
    payload_id, compr = u8(p, 4), bits(u8(p, 11), 5, 7)
    has_provider = bits(u8(p, 11), 4, 1)
    header = F.lit(12) + has_provider * 4 + bits(u8(p, 11), 0, 15) * 4
    valid = (F.octet_length(p) >= 12) & (bits(u8(p, 0), 6, 3) == 0) & ~((compr != 0) & payload_id.isin(1, 2)) & (F.octet_length(p) >= header)
    crc = bits(u8(p, 0), 0, 1)
    rest = [c for c in df.columns if c != col]
    fields = df.filter(valid).select(
        *rest, payload_id.alias("payload_id"), be16(p, 5).alias("segment_id"), u8(p, 7).alias("version"), be(p, 1, 3).cast("int").alias("total_size"), compr.alias("compr"),
        bits(be16(p, 8), 4, 0xFFF).alias("section_number"), bits(be16(p, 9), 0, 0xFFF).alias("last_section_number"), (crc == 1).alias("crc_present"),
        F.when(has_provider == 1, be32(p, 12)).alias("provider_id"), tail(p, header).alias("__body"),
    )
    body = F.octet_length("__body")
    keep = F.when(F.col("crc_present"), F.greatest(body - 4, F.lit(0))).otherwise(body)
    return fields.withColumn("payload", F.substring("__body", F.lit(1), keep)).withColumn(
        "crc", F.when(F.col("crc_present") & (body >= 4), be32(F.col("__body"), body - 4))
    ).drop("__body")


def doc_reassembly(sections: DataFrame, span: int = DEFAULT_SPAN, max_sections: int | None = None, max_section: int | None = None) -> DataFrame:
    """Complete documents from sections ``payload_id, segment_id, version, section_number, last_section_number, payload, arrival`` (STR-3 over archives).

    A new version or length restarts a document; of a repeated section the first copy counts.
    ``max_sections`` and ``max_section`` (length of one) drop what is larger; by default the 12-bit section number is the bound.
    With ``crc_present`` and ``crc`` the checksum over the whole must match. Payloads may be binary or text.
    """
    key = ["payload_id", "segment_id"]
    with_crc = "crc_present" in sections.columns
    size = F.length("payload")  # bytes of binary, characters of text
    usable = sections.filter(F.col("section_number") <= F.col("last_section_number"))
    if max_sections is not None:
        usable = usable.filter(F.col("last_section_number") < max_sections)
    if max_section is not None:
        usable = usable.filter(size <= max_section)
    if with_crc:
        usable = usable.filter(~F.col("crc_present") | ((F.col("section_number") == F.col("last_section_number")) & F.col("crc").isNotNull()))
    runs = scan(usable, key, ["arrival"], span, run=changes(F.struct("version", "last_section_number")))
    group = [*key, "run", "version", "last_section_number"]
    carried = ["payload", "arrival"] + (["crc_present", "crc"] if with_crc else [])
    # repeats fold into one row per section before any section meets another
    once = runs.groupBy(*group, "section_number").agg(F.min_by(F.struct(*carried), "arrival").alias("s"))
    whole = once.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("section_number", "s"))).alias("parts"), F.max("s.arrival").alias("arrival")
    ).filter(F.size("parts") == F.col("last_section_number") + 1)
    pieces = F.col("parts.s.payload")
    binary = isinstance(sections.schema["payload"].dataType, T.BinaryType)
    docs = whole.withColumn("document", concat_bytes(pieces) if binary else F.array_join(pieces, ""))
    if with_crc and binary:
        last = F.element_at("parts", -1)["s"]
        docs = docs.filter(~last["crc_present"] | (crc32_mpeg2(F.col("document")) == last["crc"]))
    return docs.select(*key, "version", "arrival", "document")


def distinct_segments(sections: DataFrame) -> DataFrame:
    """Every (payload, segment, version) once, with its first arrival (SET-3)."""
    return sections.groupBy("payload_id", "segment_id", "version").agg(F.min("arrival").alias("first_arrival"))


def latest_document(docs: DataFrame) -> DataFrame:
    """The last complete document of every payload and segment (AGG-21)."""
    return docs.groupBy("payload_id", "segment_id").agg(F.max_by("version", "arrival").alias("version"), F.max_by("document", "arrival").alias("document"))
