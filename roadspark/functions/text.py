"""String parsing as column expressions: speed limits and house numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits that name no speed, and units in km/h.
NO_LIMIT = ["none", "signals", "walk", "variable"]
UNITS = {"mph": 1.609344, "knots": 1.852}


def maxspeed(value: Column) -> Column:
    """km/h of a speed-limit tag; other units than miles and knots count as km/h; null where there is none."""
    text = F.lower(F.trim(value))
    number = F.expr("1") * F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.trim(F.regexp_extract(text, r"^[0-9.]+\s*(.*)$", 1))
    speed = number * F.when(unit == "mph", UNITS["mph"]).when(unit == "knots", UNITS["knots"]).otherwise(1.0)
    return F.when(~text.isin(NO_LIMIT) & (number > 0), speed)


def house_number(text: Column) -> Column:
    """(street, number) of an address whose last word starts with a digit; else (text, null)."""
    clean = F.trim(text)
    pattern = r"^(.*\S)\s+([0-9]\S*)$"
    found = F.regexp_extract(clean, pattern, 2)
    return F.when(found != "", F.struct(F.regexp_extract(clean, pattern, 1).alias("street"), found.alias("number"))).otherwise(F.struct(clean.alias("street"), F.lit(None).cast("string").alias("number")))


def house_key(number: Column) -> Column:
    """(value, suffix) to order house numbers by; those without a leading number come last."""
    digits = F.regexp_extract(F.trim(number), "^([0-9]+)", 1)
    return F.struct(F.coalesce(digits.try_cast("bigint"), F.lit(2**32 - 1).cast("bigint")).alias("value"), F.lower(F.trim(F.regexp_extract(F.trim(number), "^[0-9]*(.*)$", 1))).alias("suffix"))


def clean_house(number: Column) -> Column:
    """Lists joined by semicolons become a range of their first and last."""
    parts = F.filter(F.transform(F.split(F.trim(number), ";"), lambda x: F.trim(x)), lambda x: x != "")
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    return F.when(~F.contains(number, F.lit(";")), F.trim(number)).when(F.size(parts) == 0, F.trim(number)).when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))
