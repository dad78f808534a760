"""Text column functions: escaping, encodings, labels, titles and small formats."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the five named entities
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def ascii_lower(col: Column) -> Column:
    """Lower case for A to Z only, as the name matching compares."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def xml_escape(col: Column) -> Column:
    for char, entity in ENTITIES.items():
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def code_point(number: Column) -> Column:
    """Character of a code point number."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def xml_unescape(col: Column) -> Column:
    """Decode named and numeric references once, left to right (FN-3)."""
    tokens = F.regexp_extract_all(col, F.lit(r"(?s)(&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&amp;|&lt;|&gt;|&quot;|&apos;|[^&]+|&)"), F.lit(0))

    def decode(token: Column) -> Column:
        out = F.when(token.rlike("^&#[0-9]+;$"), code_point(F.substring(token, 3, F.length(token) - 3).cast("bigint"))).when(
            token.rlike("^&#[xX]"), code_point(F.conv(F.substring(token, 4, F.length(token) - 4), 16, 10).cast("bigint"))
        )
        for char, entity in ENTITIES.items():
            out = out.when(token == entity, char)
        return out.otherwise(token)

    return F.array_join(F.transform(tokens, decode), "")


def percent_encode(col: Column) -> Column:
    """Everything but letters, digits and ``-._~`` as %XX of its bytes (FN-4)."""
    out = F.url_encode(col)
    for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def clamp_bytes(data: Column, size: Column) -> Column:
    """At most ``size`` bytes of UTF-8, never cutting a character."""
    cut = size
    for back in (3, 2, 1, 0):
        at = size - back
        byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
        boundary = byte.bitwiseAND(F.lit(0xC0)) != 0x80
        cut = F.when(boundary, at).otherwise(cut) if back else F.when(F.coalesce(boundary, F.lit(True)), at).otherwise(cut)
    return F.when(F.octet_length(data) <= size, data).otherwise(F.substring(data, F.lit(1), F.greatest(cut, F.lit(0))))


def dvb_text(data: Column, size: int | None = None) -> Column:
    """Broadcast text: charset prefix skipped, control bytes to spaces (FN-10); whole unless ``size`` bounds its bytes."""
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    length = F.octet_length(data)
    skip = (
        F.when((first == 0x10) & (length >= 3), 3).when((first == 0x1F) & (length >= 2), 2)
        .when(first < 0x20, 1).otherwise(0)
    )
    body = F.decode(F.substring(data, skip + 1, length if size is None else F.lit(size)), "ISO-8859-1")
    return F.encode(F.regexp_replace(body, "[\\x00-\\x1f]", " "), "ISO-8859-1").cast("string")


def escape_label(col: Column) -> Column:
    """Backslash, quote and newline of a metric label value (FN-11)."""
    for char, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        col = F.replace(col, F.lit(char), F.lit(escaped))
    return col


LABEL_SEPARATOR = "\x1f"  # fixed value: separator inside a composite label


def split_composite_label(label: Column) -> tuple[Column, Column]:
    """Input and reason parts; no separator means an empty reason (FN-12)."""
    at = F.instr(label, LABEL_SEPARATOR)
    return (
        F.when(at > 0, F.substring(label, F.lit(1), at - 1)).otherwise(label),
        F.when(at > 0, F.substring(label, at + 1, F.length(label))).otherwise(""),
    )


def stream_title(block: Column) -> Column:
    """Value between ``StreamTitle='`` and the next ``';``; null when absent."""
    pattern = "(?s)StreamTitle='(.*?)';"
    return F.when(block.rlike(pattern), F.regexp_extract(block, pattern, 1))


def split_title(col: Column) -> tuple[Column, Column]:
    """Artist and title around the first " - "; without it the whole text is the title (FN-13)."""
    at = F.instr(col, " - ")
    return (
        F.when(at > 0, F.substring(col, F.lit(1), at - 1)).otherwise(""),
        F.when(at > 0, F.substring(col, at + 3, F.length(col))).otherwise(col),
    )


EVENT_NAME_BYTES = 249  # fixed value: longest event name


def eit_title(artist: Column, title: Column, size: int = EVENT_NAME_BYTES) -> Column:
    """Artist and title with a space between, clamped to ``size`` bytes (FN-18)."""
    head = clamp_bytes(F.encode(F.coalesce(artist, F.lit("")), "UTF-8"), F.lit(size))
    text = F.encode(F.coalesce(title, F.lit("")), "UTF-8")
    spaced = F.when((F.octet_length(head) > 0) & (F.octet_length(text) > 0) & (F.octet_length(head) + 1 <= size), F.concat(head, F.encode(F.lit(" "), "UTF-8"))).otherwise(head)
    room = F.lit(size) - F.octet_length(spaced)
    return F.decode(F.concat(spaced, F.when(room > 0, clamp_bytes(text, room)).otherwise(F.unhex(F.lit("")))), "UTF-8")


def fmt_dur(seconds: Column) -> Column:
    """``h:mm:ss`` or ``mm:ss``, clamped to 99:59:59 (FN-15)."""
    s = F.least(F.greatest(F.floor(seconds), F.lit(0)), F.lit(359999)).cast("int")
    h, m, rest = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%2d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%2d:%02d", m, rest))


def super_cas_hex(col: Column) -> Column:
    """``0x`` and eight digits, or all of a number that has more."""
    digits = F.hex(col)
    return F.concat(F.lit("0x"), F.lower(F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), F.lit("0"))))


def csv_safe_name(col: Column) -> Column:
    return F.replace(col, F.lit(","), F.lit(""))


def expand_template(template: Column, group: Column, port: Column) -> Column:
    """%g, %p and %% of a path template; the text ends at the first unknown escape (FN-17)."""
    known = F.regexp_extract(template, "(?s)^((?:[^%]|%[gp%])*)", 1)
    tokens = F.regexp_extract_all(known, F.lit("(?s)(%[gp%]|[^%]+)"), F.lit(0))

    def expand(token: Column) -> Column:
        return F.when(token == "%g", group).when(token == "%p", port.cast("string")).when(token == "%%", "%").otherwise(token)

    return F.array_join(F.transform(tokens, expand), "")


def resolve_name(mode: Column, override: Column, source: Column) -> Column:
    """Name a table carries: none when dropped, the given text, or the source's if not empty (FN-20)."""
    return F.when(mode == "drop", F.lit(None)).when(mode == "override", override).otherwise(F.nullif(source, F.lit("")))


def feedback_kbps(nominal_bps: Column) -> Column:
    """Share of the stream rate left for feedback: 5 %, in kbit/s (FN-19)."""
    return F.floor(nominal_bps * 5 / 100_000).cast("bigint")


def burst_target(nominal_bps: Column, multiplier: Column, client_max: Column) -> Column:
    """Burst rate: nominal times multiplier, capped by a positive client maximum (FN-21)."""
    target = nominal_bps * multiplier
    return F.when(F.coalesce(client_max, F.lit(0)) > 0, F.least(target, client_max)).otherwise(target)
