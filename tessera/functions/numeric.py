"""Numbers in Vietnamese notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_numeric(c: Column, every_group: bool = False) -> Column:
    """A double, or null. Both separators: '.' groups and the first ',' is decimal. One separator: groups of three
    digits are thousands, by the last group for ',' (every_group: by all after the first), by all for '.'."""
    t = F.regexp_replace(c.cast("string"), r"[^\d.,\-]", "")
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    both = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    thousands = t.rlike(r"^[^,]*(,\d{3})+$") if every_group else t.rlike(r",\d{3}$")
    by_comma = F.when(thousands, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(t, "^([^,]*),", "$1."))
    by_dot = F.when(t.rlike(r"^[^.]*(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    plain = F.when(comma & dot, both).when(comma, by_comma).when(dot, by_dot).otherwise(t)
    return F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def density(population: Column, area: Column) -> Column:
    return F.when(population.isNotNull() & (area != 0), F.round(population / area, 2))


def format_vi(c: Column, digits: int = 3) -> Column:
    """Groups by '.', at most so many decimals after ',' (halves away from zero), no trailing zeros."""
    shown = F.format_number(F.round(c.cast("decimal(30,8)"), digits), digits)
    shown = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else shown
    return F.translate(F.when(shown == "-0", "0").otherwise(shown), ",.", ".,")


def shown(c: Column, unit: str = "", digits: int = 3) -> Column:
    """A value for display with its unit, or that there is none."""
    return F.coalesce(F.concat(format_vi(c, digits), F.lit(f" {unit}" if unit else "")), F.lit("Chưa có dữ liệu"))


def area(c: Column) -> Column:
    return shown(c, "km²", 2)


def population(c: Column) -> Column:
    return shown(c, "người")


def currency(c: Column) -> Column:
    return shown(c, "tỷ VNĐ")


def income(c: Column) -> Column:
    return shown(c, "triệu VNĐ/người", 1)


def people_per_km2(c: Column) -> Column:
    return shown(c, "người/km²", 2)


def to_fixed(c: Column, digits: int) -> Column:
    """A number rounded to so many decimals."""
    return F.round(c, digits)


def fixed_text(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def coerced(c: Column) -> Column:
    """A request's value as a number: null and blank text are 0, what is no number is null."""
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    number = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).when(text.rlike(number), text.try_cast("double"))
