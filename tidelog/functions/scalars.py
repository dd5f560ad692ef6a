"""Small column functions of the log's model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a body's datatype and their names, in order.
DATATYPES = ["json", "snappy", "xattr"]


def partition_of(key: Column, partitions: int) -> Column:
    """The partition a key belongs to: bits 16 to 30 of its CRC-32, modulo the number of partitions."""
    return F.pmod(F.shiftright(F.crc32(key), 16).bitwiseAND(F.lit(0x7FFF)), F.lit(partitions))


def datatype_names(mask: Column) -> Column:
    names = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(DATATYPES)])
    joined = F.array_join(F.filter(names, lambda x: x.isNotNull()), ",")
    return F.when(mask == 0, "raw").otherwise(joined)


def hex_id(number: Column) -> Column:
    return F.lower(F.hex(number))


def from_hex_id(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def clock_seconds(cas: Column) -> Column:
    """Epoch seconds of a hybrid clock value."""
    return F.floor(cas / 1_000_000_000).cast("long")


def valid_key(key: Column, longest: int = 250) -> Column:
    return (F.octet_length(key) > 0) & (F.octet_length(key) <= longest)


def size_label(number: Column) -> Column:
    """A byte count with the largest unit below it."""
    units = ["", "K", "M", "G", "T"]
    power = F.least(F.lit(len(units) - 1), F.floor(F.log2(F.greatest(number, F.lit(1))) / 10)).cast("int")
    return F.concat(F.round(number / F.pow(F.lit(1024.0), power), 1).cast("string"), F.element_at(F.array(*map(F.lit, units)), power + 1))


def stat_name(*labels: Column) -> Column:
    return F.concat_ws(":", *labels)


def bloom_size(keys: Column, false_positives: Column) -> tuple[Column, Column]:
    """Bits and hash functions of a bloom filter for so many keys."""
    bits = F.round(-keys * F.ln(false_positives) / F.lit(0.4804530139182014)).cast("long")
    return bits, F.round(bits / keys * F.lit(0.6931471805599453)).cast("long")


def leb128(number: Column) -> Column:
    """A number of up to 35 bits as unsigned LEB128, in hexadecimal: seven bits a byte, lowest first, the top bit where more follow."""
    digits = F.array(*[F.shiftright(number, 7 * k).bitwiseAND(F.lit(127)) for k in range(5)])
    size = F.greatest(F.lit(1), *[F.when(F.shiftright(number, 7 * k) > 0, k + 1).otherwise(1) for k in range(5)])
    parts = F.transform(F.slice(digits, F.lit(1), size), lambda d, i: F.lpad(F.lower(F.hex(F.when(i + 1 < size, d + 128).otherwise(d))), 2, "0"))
    return F.array_join(parts, "")


def from_leb128(text: Column) -> Column:
    """The number of a LEB128 text in hexadecimal; null if it ends early, goes on after its end, or is longer than it needs to be."""
    size = (F.length(text) / 2).cast("int")
    places = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    more = F.transform(places, lambda k: F.conv(F.substr(text, 2 * k + 1, F.lit(2)), 16, 10).cast("long"))
    right = F.aggregate(F.transform(more, lambda b, i: (b >= 128) == (i < size - 1)), F.lit(True), lambda a, b: a & b) & (size > 0) & ((size == 1) | (F.element_at(more, -1) > 0))
    total = F.aggregate(F.transform(more, lambda b, i: b.bitwiseAND(F.lit(127)) * F.pow(F.lit(128), i).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(right, total)


def negotiated(mask: Column, enabled: Column) -> Column:
    """The bits of a body's datatype that a connection has asked for."""
    return mask.bitwiseAND(enabled)


def split_limited(text: Column, mark: str, limit: int) -> Column:
    """Parts of a text between marks; after `limit` cuts the rest stays whole."""
    return F.split(text, "\\Q" + mark + "\\E", limit + 1)


def whole_number(text: Column) -> Column:
    """The unsigned number that all of a text is, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))
