"""Text and number formatting as Column expressions, digit-for-digit equal to Python's format specs.

``format_number`` with a pattern rounds the exact binary value half-even, which is what Python does; Spark's own
``round`` and ``format_string`` round the shortest decimal text half-up and differ near ties.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F


def fixed(value: Column, digits: int) -> Column:
    """``f"{value:.<digits>f}"``."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def percent(value: Column, digits: int) -> Column:
    """``f"{value:.<digits>%}"``."""
    return F.concat(fixed(value.cast("double") * F.lit(100.0), digits), F.lit("%"))


def significant3(value: Column) -> Column:
    """``f"{value:.3g}"``: three significant digits, trailing zeros dropped."""
    value = value.cast("double")
    scientific = F.call_function("format_number", value, F.lit("0.00E0"))
    exponent = F.split_part(scientific, F.lit("E"), F.lit(2)).cast("int")
    mantissa = F.split_part(scientific, F.lit("E"), F.lit(1))

    def strip(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

    plain = F.when(exponent == 2, fixed(value, 0)).when(exponent == 1, fixed(value, 1))
    for power in (0, -1, -2, -3, -4):
        plain = plain.when(exponent == power, fixed(value, 2 - power))
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    wide = F.concat(strip(mantissa), F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(value == 0, F.lit("0")).when(exponent.between(-4, 2), strip(plain)).otherwise(wide)


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Python's ``round(value, digits)`` of a double."""
    return fixed(value, digits).cast("double")


def number_text(value: Column) -> Column:
    """``str(float)``: plain digits from 1e-4 up to 1e16, otherwise an exponent of at least two digits."""
    value = value.cast("double")
    size, java = F.abs(value), value.cast("string")
    plain = F.call_function("format_number", value, F.lit("0.0" + "#" * 20))
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    wide = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    wide = F.when(F.length(F.abs(exponent).cast("string")) > 2, F.concat(mantissa, F.lit("e"), sign, F.abs(exponent).cast("string"))).otherwise(wide)
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(wide)
    )


def flag_text(value: Column) -> Column:
    """``str(bool)``."""
    return F.when(value, F.lit("True")).when(~value, F.lit("False"))


def time_text(value: Column, separator: str = " ") -> Column:
    """``str(datetime)`` (or ``isoformat()`` with ``T``): six fraction digits, or none when they are zero."""
    stamp = value.cast("timestamp")
    whole = F.date_format(stamp, f"yyyy-MM-dd'{separator}'HH:mm:ss")
    return F.when(F.unix_micros(stamp) % 1_000_000 == 0, whole).otherwise(
        F.date_format(stamp, f"yyyy-MM-dd'{separator}'HH:mm:ss.SSSSSS")
    )


def canonical_text(value: Column, kind: str) -> Column:
    """Evidence value as canonical text. ``kind`` is text, whole, real, flag or time."""
    if kind == "real":
        return number_text(value)
    if kind == "flag":
        return flag_text(value)
    if kind == "time":
        return time_text(value)
    return value.cast("string")


def render(template: str, **columns: Column) -> Column:
    """Fill a message template with columns, honouring the specs .Nf, .N% and .3g."""
    parts: list[Column] = []
    for literal, name, spec, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        column = columns[name]
        if not spec:
            parts.append(column.cast("string"))
        elif spec == ".3g":
            parts.append(significant3(column))
        elif spec.endswith("f"):
            parts.append(fixed(column, int(spec[1:-1])))
        elif spec.endswith("%"):
            parts.append(percent(column, int(spec[1:-1])))
        else:
            raise ValueError(f"Unsupported format spec: {spec}")
    return F.concat(*parts)
