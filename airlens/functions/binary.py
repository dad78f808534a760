"""Byte-level column expressions: everything here stays inside JVM code generation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
FNV_BASIS = 1469598103934665603  # fixed value: hash start
FNV_FACTOR = 435  # fixed value: hash multiplier 1099511628211 without its 2^40
FAMILY_IPV4, FAMILY_IPV6 = 2, 10  # fixed values: address family numbers mixed into the hash


def be(col: Column, offset: int | Column, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at 0-based ``offset`` (FN-1); null when out of range."""
    pos = (F.lit(offset) if isinstance(offset, int) else offset) + F.lit(1)
    part = F.substring(col, pos, F.lit(width))
    value = F.conv(F.hex(part), 16, 10).cast("bigint" if width < 8 else U64)
    if width == 1:
        return value  # nothing read is already null
    return F.when(F.octet_length(part) == width, value)


def u8(col: Column, offset: int | Column) -> Column:
    return be(col, offset, 1).cast("int")


def be16(col: Column, offset: int | Column) -> Column:
    return be(col, offset, 2).cast("int")


def be32(col: Column, offset: int | Column) -> Column:
    return be(col, offset, 4)


def be64(col: Column, offset: int | Column) -> Column:
    return be(col, offset, 8)


def tail(col: Column, offset: int | Column) -> Column:
    """Bytes from ``offset`` to the end."""
    pos = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(col, pos + 1, F.greatest(F.octet_length(col) - pos, F.lit(0)))


def to_bytes(value: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative integer column."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), width * 2, "0"))


def bits(value: Column, shift: int, mask: int) -> Column:
    """``(value >> shift) & mask``."""
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def seq_delta16(a: Column, b: Column) -> Column:
    """Signed 16-bit difference ``a - b`` (FN-2)."""
    return signed_delta(a, b, 16)


def signed_delta(a: Column, b: Column, width: int) -> Column:
    """Signed modular difference; a step of exactly half the range is negative."""
    half = 1 << (width - 1)
    return F.pmod(a.cast("bigint") - b.cast("bigint") + F.lit(half), F.lit(1 << width)) - F.lit(half)


def fnv1a64(octets: Column, family: Column, port: Column) -> Column:
    """FNV-1a 64 over the address bytes, then the family, then the port (FN-14), as DECIMAL(20,0).

    ``octets`` is an array of byte values. The state is a long of the same bits; products are taken of its halves, which
    stay inside signed arithmetic. The prime is 2^40 + 435, so the low half also comes, 8 bits up, upon the high one.
    """
    half = F.lit((1 << 32) - 1)

    def times_prime(h: Column, product: Column) -> Column:
        high = F.shiftrightunsigned(h, 32) * FNV_FACTOR + F.shiftrightunsigned(product, 32) + F.shiftleft(h.bitwiseAND(half), 8)
        return F.shiftleft(high, 32).bitwiseOR(product.bitwiseAND(half))

    def step(h: Column, x: Column) -> Column:
        mixed = h.bitwiseXOR(x.cast("bigint"))
        return times_prime(mixed, mixed.bitwiseAND(half) * FNV_FACTOR)

    def unsigned(h: Column) -> Column:
        return (h.cast(U64) + F.when(h < 0, F.lit(Decimal(1 << 64))).otherwise(F.lit(Decimal(0))).cast(U64)).cast(U64)

    words = F.concat(octets.cast("array<bigint>"), F.array(family.cast("bigint"), port.cast("bigint")))
    return F.aggregate(words, F.lit(FNV_BASIS).cast("bigint"), step, unsigned)


def ipv4_octets(address: Column) -> Column:
    """Byte values of a dotted address."""
    return F.transform(F.split(address, r"\."), lambda p: p.cast("bigint"))


def ipv4_to_int(address: Column) -> Column:
    """Dotted address as an unsigned 32-bit value; null when it is not one."""
    valid = address.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    parts = F.split(address, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    in_range = F.forall(parts, lambda p: p.try_cast("int").between(0, 255))
    return F.when(valid & in_range, total)


def concat_bytes(parts: Column) -> Column:
    """Join an ARRAY<BINARY> into one value."""
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))


# fixed values: each hexadecimal digit and the digit with its four bits in reverse order
_NIBBLES = "0123456789ABCDEF"
_NIBBLES_REVERSED = "084C2A6E195D3B7F"


# each byte whose bits read otherwise backwards, and that byte; as characters of Latin-1, the null byte is none of them
_TURNED = {b: t for b in range(256) if (t := int(f"{b:08b}"[::-1], 2)) != b}


def _reverse_bits_in_bytes(col: Column) -> Column:
    turned = F.translate(F.decode(col, "ISO-8859-1"), "".join(map(chr, _TURNED)), "".join(map(chr, _TURNED.values())))
    return F.encode(turned, "ISO-8859-1")


def crc32_mpeg2(col: Column) -> Column:
    """CRC-32/MPEG-2 (UDF-1); 0 over a section that ends in its own checksum.

    The built-in CRC shares the polynomial but reads bits the other way round, so reversing the bits of every
    byte going in and of the result coming out gives this one without leaving the JVM.
    """
    reflected = F.crc32(_reverse_bits_in_bytes(col)).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint"))
    digits = F.lpad(F.hex(reflected), 8, "0")
    return F.conv(F.reverse(F.translate(digits, _NIBBLES, _NIBBLES_REVERSED)), 16, 10).cast("bigint")
