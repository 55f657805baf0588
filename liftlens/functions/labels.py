"""Numbers as the dashboard shows them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(text: Column) -> Column:
    """Decimal text without the zeros at its end."""
    return F.regexp_replace(text, r"\.?0+$", "")


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def two_digits(value) -> Column:
    """``value`` with two significant digits, as Python's ``format(value, ".2g")``:
    ``31.25 -> '31'``, ``0.155 -> '0.15'``, ``9.96 -> '10'``, ``100.0 -> '1e+02'``.

    The first two digits come from the decimal text of the double. Only a text
    that lies just between two results needs more: there the double itself is
    compared with the middle, in whole numbers (both scaled by a power of two),
    and an exact middle goes to the even digit. That comparison covers 1e-6 to
    1e15; smaller and larger middles are rounded up. NULL stays NULL.
    """
    x = _col(value).cast("double")
    v = F.abs(x)
    long = F.format_string("%.16e", v)  # d.dddddddddddddddde+xx
    exponent = F.split_part(long, F.lit("e"), F.lit(-1)).cast("int")
    digits = F.concat(F.substring(long, 1, 1), F.substring(long, 3, 1)).cast("int")
    middle = F.substring(long, 4, 15) == F.lit("5" + "0" * 14)
    # v = m / 2^s with a whole m; the middle is (10 digits + 5) * 10^(exponent - 2)
    s = F.lit(53) - F.floor(F.log2(v)).cast("int")
    scaled = _whole((v * F.pow(F.lit(2.0), s)).cast("bigint")) * _whole(F.pow(F.lit(10.0), F.lit(2) - exponent).cast("bigint"))
    one = F.lit(1).cast("bigint")
    power = _whole(F.call_function("shiftleft", one, F.lit(40))) * _whole(F.call_function("shiftleft", one, s - 40))
    between = (digits * 10 + 5).cast("decimal(4,0)") * power.cast("decimal(34,0)")
    even = digits % 2 == 0
    down = (
        F.when(~middle | (v < 1e-6) | (v >= 1e15), False)
        .when(exponent >= 2, even)
        .otherwise((scaled < between) | ((scaled == between) & even))
    )
    cut = F.concat(F.substring(long, 1, 3), F.regexp_extract(long, "e.*$", 0))
    short = F.when(down, cut).otherwise(F.format_string("%.1e", v))
    shown = F.split_part(short, F.lit("e"), F.lit(-1)).cast("int")
    fixed = _plain(short.cast("decimal(20,10)").cast("string"))
    scientific = F.concat(F.regexp_replace(F.substring(short, 1, 3), r"\.0$", ""), F.regexp_extract(short, "e.*$", 0))
    text = F.when(v == 0, "0").when((shown >= -4) & (shown < 2), fixed).otherwise(scientific)
    return F.when(F.isnan(x), "nan").when(x < 0, F.concat(F.lit("-"), text)).when(x.isNotNull(), text)


def number_text(value) -> Column:
    """A double between -1e7 and 1e7 as Python prints it: ``0.0001``, ``1e-05``;
    NULL, the dashboard's undefined result, is ``nan``."""
    x = _col(value).cast("double")
    text = x.cast("string")  # scientific below 0.001
    small = F.abs(x) < 1e-4
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.lpad(F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(-1)), "^-", ""), 2, "0")
    return (
        F.when(x.isNull() | F.isnan(x), "nan")
        .when(~text.contains("E"), text)
        .when(small, F.concat(mantissa, F.lit("e-"), power))
        .otherwise(_plain(text.cast("decimal(38,25)").cast("string")))
    )
