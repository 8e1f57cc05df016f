"""Hashes, escapes and small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 32 bit.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-16 code units of ``text``, as an unsigned number in a long."""
    # The whole text is encoded and cut once, so the cost is linear; four hex digits are a unit.
    codes = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    units = F.transform(codes, lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(
        units,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: ((h.bitwiseXOR(c)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32)),
    )


def plain_number(value: Column) -> Column:
    """A double as JSON writes it: no decimals if whole, digits down to 0.000001, then a short exponent."""
    text = F.regexp_replace(value.cast("string"), r"\.0(?=E|$)", "")
    digits = F.replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), F.lit("."))
    zeros = F.repeat(F.lit("0"), F.regexp_extract(text, r"E-(\d+)$", 1).cast("int") - 1)
    small = F.abs(value).between(1e-6, 1e-3) & text.contains("E-")
    return F.when(value == 0, "0").when(
        small, F.concat(F.when(value < 0, "-0.").otherwise("0."), zeros, digits)).otherwise(F.replace(text, F.lit("E"), F.lit("e")))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def xml_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def street_of_part(part_id: Column) -> Column:
    """``way/12/part/3`` belongs to street ``way/12``; other ids are their own street."""
    way = F.regexp_extract(part_id, "^(way/[^/]+)", 1)
    return F.when(way == "", part_id).otherwise(way)


def rotated_slice(items: Column, start: Column, count: int) -> Column:
    """``count`` items from position ``start`` on, wrapping around."""
    return F.slice(F.concat(items, items), start + 1, count)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
