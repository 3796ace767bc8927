"""Column builders: no UDF, so expressions stay in whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.types import sql_type


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- numbers ------------------------------------------------------------------


def idiv(a, b) -> Column:
    """Integer by integer, toward zero; by zero raises.  BIGINT."""
    return F.call_function("div", _c(a), _c(b))


def cast_integer(x, to: str = "int") -> Column:
    """Decimal to integer rounds half away from zero, where Spark would cut off."""
    return F.round(_c(x)).cast(to)


# -- text ---------------------------------------------------------------------


def similar_pattern(pattern: str) -> str:
    """The regular expression of a SIMILAR TO pattern: %, _ and [...] are special, all else is itself; the whole text matches."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if end > 0:
            out.append(pattern[i : end + 1])
            i = end
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(text, pattern: str) -> Column:
    """SQL's SIMILAR TO; case counts."""
    return _c(text).rlike(similar_pattern(pattern))


def regexp(text, pattern: str, case_sensitive: bool = False) -> Column:
    """RLIKE / REGEXP, insensitive to case; ~ and ~* as case_sensitive says."""
    return _c(text).rlike(pattern if case_sensitive else f"(?i){pattern}")


def trim_blank(text, where: str = "both") -> Column:
    """TRIM of space, tab, carriage return and line feed."""
    blank = F.lit(" \t\r\n")
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[where](_c(text), blank)


def substring_from(text, start: int, length: int | None = None) -> Column:
    """SUBSTRING(s FROM a FOR n): 0 is the start, a negative start counts from the end and is held to the text."""
    text = _c(text)
    begin = F.lit(start) if start > 0 else F.lit(1) if start == 0 else F.greatest(F.length(text) + F.lit(start + 1), F.lit(1))
    if length is not None and length <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.substr(text, begin, F.lit(length)) if length is not None else F.substr(text, begin)


def position(needle, text) -> Column:
    """1-based place of the first occurrence, 0 without one."""
    return F.position(_c(needle), _c(text))


def overlay(text, put, start: int, length: int | None = None) -> Column:
    return F.overlay(_c(text), _c(put), start, -1 if length is None else length)


# -- conversion ---------------------------------------------------------------


def convert(x, to: str) -> Column:
    """CONVERT(type, x): decimals round into integers, other pairs cast; a value that doesn't fit raises."""
    kind = sql_type(to).simpleString()
    return cast_integer(x, kind) if kind in ("tinyint", "smallint", "int", "bigint") and not _is_text(x) else _c(x).cast(kind)


def try_convert(x, to: str) -> Column:
    """TRY_CONVERT: null where the value doesn't fit."""
    return _c(x).try_cast(sql_type(to).simpleString())


def _is_text(x) -> bool:
    return isinstance(x, str)


def simple_case(x, *pairs, default=None) -> Column:
    """CASE x WHEN ...: compares by value equality, so null matches null."""
    x, out = _c(x), None
    for when, then in pairs:
        test = x.eqNullSafe(_c(when))
        out = F.when(test, _c(then)) if out is None else out.when(test, _c(then))
    return out.otherwise(_c(default))


# -- date and time --------------------------------------------------------------

def extract(field: str, x: Column) -> Column:
    """EXTRACT(field FROM x) as BIGINT."""
    field = field.lower()
    name = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.day, "doy": F.dayofyear,
        "hour": F.hour, "minute": F.minute, "second": F.second,
    }
    if field == "dow":
        out = F.weekday(x) + 1
    elif field == "epoch":
        out = F.unix_timestamp(x.cast("timestamp"))
    elif field in name:
        out = name[field](x)
    else:
        raise ValueError(f"unknown field {field}")
    return out.cast("bigint")


def date_field(field: str, x: Column) -> Column:
    """date_part: as extract, but dow is Monday 0 to Sunday 6, isodow Monday 1; decade, century and millennium too."""
    year = F.year(x)
    extra = {
        "dow": F.weekday(x),
        "isodow": F.weekday(x) + 1,
        "decade": F.floor(year / 10),
        "century": F.floor((year + 99) / 100),
        "millennium": F.floor((year + 999) / 1000),
    }
    return extra[field.lower()].cast("bigint") if field.lower() in extra else extract(field, x)


def truncate(part: str, x: Column) -> Column:
    """date_trunc without a time zone; decades, centuries and millennia start at multiples of 10, 100 and 1000."""
    part = part.lower()
    if part in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[part]
        start = (F.floor(F.year(x) / n) * n).cast("int")
        return F.make_timestamp_ntz(start, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(part, x).cast("timestamp_ntz")


def floor_to(x: Column, field: str) -> Column:
    """FLOOR(ts TO field)."""
    return truncate(field, x)


def ceil_to(x: Column, field: str) -> Column:
    """CEIL(ts TO field): the start of the field's next unit, unless x is one."""
    step = F.expr({"quarter": "INTERVAL '3' MONTH", "week": "INTERVAL '7' DAY"}.get(field.lower(), f"INTERVAL '1' {field.upper()}"))
    down = truncate(field, x)
    return F.when(down == x, down).otherwise((down + step).cast("timestamp_ntz"))


def at_time_zone(x: Column, zone: str) -> Column:
    """A UTC time as local time of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), x.cast("timestamp_ntz"))


# -- arrays ---------------------------------------------------------------------


def subscript(array: Column, i: int, strict: bool = False) -> Column:
    """a[i] from 0, from the end if negative; out of range is null, or an error if strict."""
    at = F.lit(i + 1 if i >= 0 else i)
    return F.element_at(array, at) if strict else F.try_element_at(array, at)


def slice_range(array: Column, start: int | None = None, end: int | None = None) -> Column:
    """a[start:end] from 0, end excluded, either from the end if negative."""
    size = F.size(array)
    bound = lambda i, default: default if i is None else F.lit(i) if i >= 0 else F.greatest(size + F.lit(i), F.lit(0))
    lo, hi = bound(start, F.lit(0)), F.least(bound(end, size), size)
    return F.slice(array, lo + 1, F.greatest(hi - lo, F.lit(0)))


_OPS = {
    "=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def any_of(x, op: str, array: Column) -> Column:
    """x op ANY(array)."""
    return F.exists(array, lambda y: _OPS[op](_c(x), y))


def all_of(x, op: str, array: Column) -> Column:
    """x op ALL(array): true of an empty array."""
    return F.forall(array, lambda y: _OPS[op](_c(x), y))
