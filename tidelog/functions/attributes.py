"""Extended attributes: a map from key to JSON text beside a document's body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes a key must stay below, and the macros that a mutation fills in.
KEY_BYTES = 16
CAS_MACRO, SEQNO_MACRO, CHECKSUM_MACRO = '"${Mutation.CAS}"', '"${Mutation.seqno}"', '"${Mutation.value_crc32c}"'


def key_of(path: Column) -> Column:
    """The attribute that a path is in: what stands before its first dot or bracket."""
    return F.regexp_extract(path, r"^([^.\[]*)", 1)


def valid_key(path: Column) -> Column:
    """Keys are not empty, below KEY_BYTES bytes, and do not start with punctuation or control characters but _ (system) and $ (virtual), which need more to follow."""
    key = key_of(path)
    size = F.octet_length(key)
    return (size > 0) & (size < KEY_BYTES) & ~key.rlike(r"^[!-#%-/:-@\[-^`{-~\x00-\x1f\x7f]") & ~((size == 1) & key.isin("_", "$")) & ~F.contains(path, F.lit("\0"))


def little_endian_hex(number: Column) -> Column:
    """0x and the number's eight bytes, lowest first."""
    digits = F.lpad(F.lower(F.hex(number)), 16, "0")
    return F.concat(F.lit("0x"), *[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])


def expand(value: Column, cas: Column, seqno: Column, checksum: Column | None = None) -> Column:
    """The value with its macros filled in after the mutation has got its cas and seqno."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    out = F.replace(value, F.lit(CAS_MACRO), quoted(little_endian_hex(cas)))
    out = F.replace(out, F.lit(SEQNO_MACRO), quoted(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(seqno)), 16, "0"))))
    return F.replace(out, F.lit(CHECKSUM_MACRO), quoted(checksum)) if checksum is not None else out


def sizes(attributes: Column) -> Column:
    """struct<system, user> of the bytes of keys and values."""
    def total(keep) -> Column:
        entries = F.filter(F.map_entries(attributes), keep)
        return F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))

    return F.struct(total(lambda e: e["key"].startswith("_")).alias("system"), total(lambda e: ~e["key"].startswith("_")).alias("user"))


def contents(attributes: Column, *, system: bool = True) -> Column:
    """Sorted keys that a reader may see."""
    keys = F.array_sort(F.map_keys(attributes))
    return keys if system else F.filter(keys, lambda k: ~k.startswith("_"))


def as_text(value: Column, prefix: str) -> Column:
    """A binary value for readers that ask for text: a prefix and base64."""
    return F.concat(F.lit(prefix), F.base64(value))


def expand_document(value: Column, document: dict[str, Column]) -> Column:
    """The value with each "${$document.NAME}" filled in by what the document was before the mutation, as JSON."""
    for name, now in document.items():
        value = F.replace(value, F.lit('"${$document.' + name + '}"'), now)
    return value


def body_from(value: Column, attributes: Column, key: str) -> tuple[Column, Column]:
    """(status, body) after replacing a document's body by one of its attributes, which goes."""
    have = F.element_at(attributes, key)
    return F.when(have.isNull(), "path_missing").otherwise("success"), F.coalesce(have, value)
