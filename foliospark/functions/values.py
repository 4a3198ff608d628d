"""Timestamps, event ids and lenient coercions of loosely typed JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, blank_to_null, strip

_STAMP = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?\z"
)


def parse_ts(text: Column) -> Column:
    """UTC timestamp of an ISO string; without a zone it is UTC, junk is NULL."""
    s = strip(text)
    usual = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z\z"
    part = lambda i: F.regexp_extract(s, _STAMP, i)
    default = lambda c, d: F.when(c == "", d).otherwise(c)
    digits = F.regexp_replace(part(6), ":", "")
    zone = F.when(F.length(digits) == 5, F.concat(F.substring(digits, 1, 3), F.lit(":"), F.substring(digits, 4, 2)))
    zone = zone.when(F.length(digits) == 3, F.concat(digits, F.lit(":00"))).otherwise("Z")
    stamp = F.concat(
        part(1), F.lit("T"), default(part(2), "00"), F.lit(":"), default(part(3), "00"), F.lit(":"),
        default(part(4), "00"), F.lit("."), default(F.substring(part(5), 1, 6), "0"), zone,
    )
    return F.when(s.rlike(usual), s.try_cast("timestamp")).when(part(1) != "", stamp.try_cast("timestamp"))


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_id(folder: Column, generated_at: Column, kind: Column, query: Column) -> Column:
    """Same event, same id: hash of the four trimmed parts, absent ones empty."""
    parts = [strip(F.coalesce(c, F.lit(""))) for c in (folder, generated_at, kind, query)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def text_at(v: Column, path: str = "$") -> Column:
    """String of a JSON value; blank and null become NULL."""
    return blank_to_null(get(v, path, "string"))


def int_at(v: Column, path: str = "$") -> Column:
    return get(v, path, "bigint")


def bool_at(v: Column, path: str = "$") -> Column:
    """False for null, zero, empty and the usual words for no; else true."""
    return is_yes(get(v, path, "string"))


def is_yes(text: Column) -> Column:
    """``bool_at`` of a value's string."""
    word = F.lower(strip(F.coalesce(text, F.lit(""))))
    return ~word.isin("", "false", "0", "0.0", "no", "none", "null", "[]", "{}")


def truthy_at(v: Column, path: str) -> Column:
    """True for any non-empty string and for non-zero, non-empty other values."""
    return truthy(get(v, path, "variant"))


def truthy(value: Column) -> Column:
    """``truthy_at`` of a VARIANT."""
    is_text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
    word = F.coalesce(get(value, "$", "string"), F.lit(""))
    return bind(word, lambda w: (w != "") & (~w.isin("false", "0", "0.0", "[]", "{}") | is_text))


def is_object(v: Column) -> Column:
    # Reading one field of an object is enough; other kinds are no struct.
    return get(v, "$", "struct<_:string>").isNotNull()


def objects_at(v: Column, path: str) -> Column:
    """Objects of a JSON list, other items dropped; NULL when it is no list."""
    return F.filter(get(v, path, "array<variant>"), is_object)
