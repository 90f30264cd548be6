"""Unit conversion, solution arithmetic and statistics, with reasons instead of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factors to the base unit of each dimension.
UNITS = {
    "mass": {"kg": 1000.0, "g": 1.0, "mg": 0.001, "ug": 1e-6, "lb": 453.59237},
    "volume": {"l": 1.0, "liter": 1.0, "liters": 1.0, "ml": 0.001, "milliliter": 0.001, "ul": 1e-6, "microliter": 1e-6},
    "concentration": {"m": 1.0, "molar": 1.0, "mm": 0.001, "millimolar": 0.001, "um": 1e-6, "micromolar": 1e-6, "nm": 1e-9, "nanomolar": 1e-9},
}


def _factor(unit: Column, units: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in units.items() for x in kv)), unit)


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """struct<kind, value>; both null if the units don't go together."""
    a, b = F.lower(F.trim(source)), F.lower(F.trim(target))
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    out = None
    for kind, units in UNITS.items():
        fa, fb = _factor(a, units), _factor(b, units)
        test, made = fa.isNotNull() & fb.isNotNull(), row(f"unit_conversion_{kind}", F.round(value * fa / fb, 6))
        out = F.when(test, made) if out is None else out.when(test, made)
    c, k = ["c", "celsius"], ["k", "kelvin"]
    out = out.when(a.isin(c) & b.isin(k), row("unit_conversion_temperature", F.round(value + 273.15, 2)))
    return out.when(a.isin(k) & b.isin(c), row("unit_conversion_temperature", F.round(value - 273.15, 2)))


def _checked(ok: Column, value: Column, reason: str) -> Column:
    return F.struct(F.when(ok, value).alias("value"), F.when(~ok, F.lit(reason)).alias("reason"))


def moles(mass: Column, weight: Column) -> Column:
    return _checked(weight > 0, F.round(F.try_divide(mass, weight), 6), "molecular weight must be positive")


def mass(n: Column, weight: Column) -> Column:
    return F.round(n * weight, 4)


def molarity(n: Column, liters: Column) -> Column:
    return _checked(liters > 0, F.round(F.try_divide(n, liters), 6), "volume must be positive")


def percent_yield(actual: Column, theoretical: Column) -> Column:
    return _checked(theoretical > 0, F.round(F.try_divide(actual, theoretical) * 100.0, 2), "theoretical yield must be positive")


def dilution(c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """struct<unknown, value, reason>: solves c1 v1 = c2 v2 for the only null one."""
    given = sum((x.isNotNull().cast("int") for x in (c1, v1, c2, v2)), F.lit(0))
    row = lambda name, v, digits: F.struct(F.lit(name).alias("unknown"), F.round(v, digits).alias("value"), F.when(v.isNull(), F.lit("division by zero")).alias("reason"))
    wrong = F.struct(F.lit(None).cast("string").alias("unknown"), F.lit(None).cast("double").alias("value"), F.lit("exactly three values are needed").alias("reason"))
    return (
        F.when(given != 3, wrong)
        .when(v2.isNull(), row("v2", F.try_divide(c1 * v1, c2), 4))
        .when(v1.isNull(), row("v1", F.try_divide(c2 * v2, c1), 4))
        .when(c2.isNull(), row("c2", F.try_divide(c1 * v1, v2), 6))
        .otherwise(row("c1", F.try_divide(c2 * v2, v1), 6))
    )


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, median, sample deviation (0 for one value), relative deviation in percent, min, max, n."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    mean = F.avg(value)
    return df.groupBy(*keys).agg(
        F.round(mean, 4).alias("mean"),
        F.round(F.percentile(value, F.lit(0.5)), 4).alias("median"),
        F.round(sd, 4).alias("stdev"),
        F.round(F.when(mean == 0, 0.0).otherwise(sd / mean * 100.0), 2).alias("rsd_percent"),
        F.round(F.min(value), 4).alias("min"),
        F.round(F.max(value), 4).alias("max"),
        F.count(value).alias("n"),
    )


# Patterns of the calculation parser.
YIELD = r"actual\s*(?:yield)?\s*[:=]?\s*([\d.]+)\s*g?.*theoretical\s*(?:yield)?\s*[:=]?\s*([\d.]+)\s*g?"
MOLES = r"([\d.]+)\s*(?:g|grams)\b.*(?:mw|molecular weight|mol wt)\s*[:=]?\s*([\d.]+)"
CONVERT = r"convert\s+([\d.]+)\s*([a-z°]+)\s+(?:to|in)\s+([a-z°]+)"
NUMBERS = r"([-+]?\d*\.\d+|\b\d+\b)"


def parse_calculation(q: Column) -> Column:
    """struct<percent_yield, moles, converted, values>: what a question asks to be calculated; null where nothing."""
    low = F.lower(q)
    part = lambda pattern, i: F.regexp_extract(low, pattern, i)
    number = lambda pattern, i: part(pattern, i).try_cast("double")
    values = F.transform(F.regexp_extract_all(q, F.lit(NUMBERS), F.lit(1)), lambda x: x.try_cast("double"))
    asks = low.rlike("mean|statistics|standard deviation")
    return F.struct(
        percent_yield(number(YIELD, 1), number(YIELD, 2))["value"].alias("percent_yield"),
        moles(number(MOLES, 1), number(MOLES, 2))["value"].alias("moles"),
        convert_unit(number(CONVERT, 1), part(CONVERT, 2), part(CONVERT, 3))["value"].alias("converted"),
        F.when(asks & (F.size(values) >= 3), values).alias("values"),
    )
