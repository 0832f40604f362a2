"""Hashes and binary checks as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = (1 << 32) - 1


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def djb2(text: Column) -> Column:
    """32 bits: h = (h * 33) xor c, from 5381."""
    return F.aggregate(_codes(text), F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseAND(F.lit(LOW)).bitwiseXOR(c))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def fnv1a(text: Column) -> Column:
    """32 bits: h = (h xor c) * 16777619, from 2166136261."""
    return F.aggregate(_codes(text), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(LOW)))


def unit(text: Column) -> Column:
    """FNV-1a in [0, 1]."""
    return fnv1a(text) / F.lit(float(LOW))


def revision(*fields: Column) -> Column:
    """SHA-256 of a record's content as JSON with its keys in order and nulls left out."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def composite(page: Column, linked: Column) -> Column:
    """SHA-256 over a page's hash and its linked documents (url, hash) in the order of their urls."""
    return F.sha2(F.concat_ws("|", page, F.array_join(F.transform(F.array_sort(linked), lambda d: F.concat_ws("=", d["url"], d["hash"])), "|")), 256)


def kind_of(content: Column) -> Column:
    """pdf, docx, doc or rtf by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "docx").when(head.startswith("D0CF11E0A1B11AE1"), "doc").when(head.startswith("7B5C727466"), "rtf")


def fingerprint(value: Column) -> Column:
    """(hash, count) of ``hash:count``, or null."""
    pattern = r"^([a-f0-9]{64}):([1-9]\d{0,17})$"
    return F.when(F.rlike(value, F.lit(pattern)), F.struct(F.regexp_extract(value, pattern, 1).alias("hash"), F.regexp_extract(value, pattern, 2).cast("long").alias("count")))


def state_key(url: Column, change: Column) -> Column:
    """Key of a candidate's state: its canonical url, and the change it stands for."""
    return F.concat_ws("#change=", url, change)
