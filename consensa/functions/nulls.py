"""Null, number and key rules that the operators share. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"^[ \t\r\n]+|[ \t\r\n]+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x: Column | str) -> Column:
    """Text that is no number becomes null."""
    return _c(x).try_cast("double")


def to_int(x: Column | str) -> Column:
    """Whole part of a number; '8.0' is 8, text that is no number becomes null."""
    return to_double(x).try_cast("int")


def is_finite(x: Column | str) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x: Column | str) -> Column:
    return F.when(is_finite(x), _c(x))


def no_nan(x: Column | str) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def trim_blanks(x: Column | str) -> Column:
    """Trim spaces, tabs and line ends."""
    return F.regexp_replace(_c(x), _BLANKS, "")


def upper_key(x: Column | str) -> Column:
    return F.upper(trim_blanks(x))


def blank_key(x: Column | str) -> Column:
    """Join key for which null and blank are equal."""
    return F.coalesce(trim_blanks(_c(x).cast("string")), F.lit(""))


def strip_version(x: Column | str) -> Column:
    """'ENSG01.7' -> 'ENSG01'."""
    return F.regexp_replace(_c(x), r"\..*$", "")


def null_if_blank(x: Column | str) -> Column:
    x = _c(x)
    return F.when(trim_blanks(x) != "", x)


def collapse_sorted(x: Column | str, sep: str = ";") -> Column:
    """Aggregate: sorted distinct non-blank values, joined; '' if there are none."""
    return F.concat_ws(sep, F.array_sort(F.collect_set(null_if_blank(x))))


def collapse_ordered(x: Column | str, order: Column | str, sep: str = ";") -> Column:
    """Aggregate: distinct values in first-seen order, without null, blank and 'nan'; null if there are none."""
    x = trim_blanks(_c(x).cast("string"))
    kept = F.when((x != "") & (F.lower(x) != "nan"), F.struct(_c(order).alias("o"), x.alias("v")))
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["v"]))
    return F.when(F.size(values) > 0, F.concat_ws(sep, values))


def median(x: Column | str) -> Column:
    """Aggregate: median without null and NaN."""
    return F.median(no_nan(x))


def signif(x: Column | str, digits: int = 4) -> Column:
    """Round to significant digits."""
    x = _c(x)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def share_ceil(count: Column, share: float) -> Column:
    """ceil(count * share) in doubles."""
    return F.ceil(count.cast("double") * F.lit(float(share)))
