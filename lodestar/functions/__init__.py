"""Scalar functions whose semantics differ from Spark's defaults, as Column builders."""

from lodestar.functions.scalar import (
    all_of,
    any_of,
    at_time_zone,
    cast_integer,
    ceil_to,
    convert,
    date_field,
    extract,
    floor_to,
    idiv,
    overlay,
    position,
    regexp,
    similar_to,
    simple_case,
    slice_range,
    subscript,
    substring_from,
    trim_blank,
    truncate,
    try_convert,
)

__all__ = [name for name in dir() if not name.startswith("_")]
