"""Big-endian numbers, chunks and checksums as column expressions (all within the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = "89504E470D0A1A0A"


def _number(data: Column, at: int | Column, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(n))), 16, 10).cast("long")


def u8(data: Column, at: int | Column) -> Column:
    """The byte at `at`, from 0; null behind the end."""
    return _number(data, at, 1)


def u16(data: Column, at: int | Column) -> Column:
    return _number(data, at, 2)


def u32(data: Column, at: int | Column) -> Column:
    return _number(data, at, 4)


def put(value: Column, n: int) -> Column:
    """A number as n bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def crc32(name: Column, data: Column) -> Column:
    """The checksum of a chunk: over its name and data."""
    return F.crc32(F.concat(F.encode(name, "ISO-8859-1"), data))


def chunk(name: Column, data: Column) -> Column:
    """A whole chunk: length, name, data, checksum. For image data that is compressed already."""
    return F.concat(put(F.octet_length(data), 4), F.encode(name, "ISO-8859-1"), data, put(crc32(name, data), 4))


def signature() -> Column:
    return F.unhex(F.lit(SIGNATURE))


def signature_error(content: Column) -> Column:
    """Io for fewer than 8 bytes, InvalidSignature for others, null if all is well."""
    return F.when(F.octet_length(content) < 8, "Io").when(F.hex(F.substring(content, 1, 8)) != SIGNATURE, "InvalidSignature")


def adler32(value: Column, back: Column, n: Column) -> Column:
    """Aggregate: Adler-32 of n bytes, of which `value` has `back` bytes behind it. Sums are exact below 2**40 bytes."""
    one = (F.sum(value) + 1) % 65521
    two = (F.sum((back + 1) * value % 65521) + F.max(n)) % 65521
    return two * 65536 + one
