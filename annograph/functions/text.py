"""Path, name and number helpers used by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix_of(path: Column) -> Column:
    """Last suffix with its dot; a leading dot alone is not a suffix."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$", 1)


def stem_of(path: Column) -> Column:
    name = base_name(path)
    tail = suffix_of(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(tail))


def output_path(path: Column, folder: str, suffix: str = "", extension: str | None = None) -> Column:
    """`folder` / stem + suffix + extension with forward slashes."""
    tail = F.lit(extension) if extension else suffix_of(path)
    prefix = folder if folder.endswith("/") or not folder else folder + "/"
    return F.regexp_replace(F.concat(F.lit(prefix), stem_of(path), F.lit(suffix), tail), r"\\", "/")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    space = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(text, f"^{space}|{space}$", "")


def numbered(prefix: str, number: Column) -> Column:
    """`prefix` and at least four digits, wider numbers keep all their digits."""
    return F.format_string(prefix + "%04d", number)


def half_even(value: Column) -> Column:
    """Round to the nearest integer, halves to the even one. Written without a decimal detour."""
    return F.rint(value).cast("int")


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
