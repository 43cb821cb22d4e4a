"""Units of measure: names, dimensions and conversion to base units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# y = a x + b from a unit to another, by dimension; the dimension's base comes first.
LINES = """
length: meter; millimeter centimeter 0.1; centimeter meter 0.01; kilometer meter 1000; inch centimeter 2.54; foot inch 12; yard foot 3; mile foot 5280; nautical_mile meter 1852
mass: kilogram; milligram gram 0.001; gram kilogram 0.001; tonne kilogram 1000; ounce gram 28.349523125; pound ounce 16
time: second; millisecond second 0.001; minute second 60; hour minute 60; day hour 24; week day 7; month day 30.4375; year day 365.25
data: byte; bit byte 0.125; kilobyte byte 1000; megabyte kilobyte 1000; gigabyte megabyte 1000; terabyte gigabyte 1000; petabyte terabyte 1000; kibibyte byte 1024; mebibyte kibibyte 1024; gibibyte mebibyte 1024; tebibyte gibibyte 1024
percent: percent; basis_point percent 0.01
temperature: kelvin; celsius kelvin 1 273.15; fahrenheit celsius 5/9 -160/9
speed: meter_per_second; kilometer_per_hour meter_per_second 1/3.6; mile_per_hour meter_per_second 0.44704; knot meter_per_second 1852/3600; foot_per_second meter_per_second 0.3048
currency: usd; cent usd 0.01
currency: gbp; pence gbp 0.01
currency: inr; paise inr 0.01
currency: eur; eurocent eur 0.01
currency: jpy
"""

# Spellings of units.
SPELLINGS = """
millimeter: mm, millimeter, millimeters, millimetre, millimetres
centimeter: cm, centimeter, centimeters, centimetre, centimetres
meter: m, meter, meters, metre, metres
kilometer: km, kms, kilometer, kilometers, kilometre, kilometres
inch: in., in, inch, inches
foot: ft, foot, feet
yard: yd, yds, yard, yards
mile: mi, mile, miles
nautical_mile: nmi, nautical mile, nautical miles
milligram: mg, milligram, milligrams
gram: g, gm, gram, grams, gramme, grammes
kilogram: kg, kgs, kilogram, kilograms, kilo, kilos
tonne: tonne, tonnes, metric ton, metric tons, t
ounce: oz, ounce, ounces
pound: lb, lbs, pound, pounds
millisecond: ms, millisecond, milliseconds, msec, msecs
second: sec, secs, second, seconds, s
minute: min, mins, minute, minutes
hour: hr, hrs, hour, hours, h
day: day, days
week: wk, wks, week, weeks
month: mo, month, months
year: yr, yrs, year, years
kibibyte: kib, kibibyte, kibibytes
mebibyte: mib, mebibyte, mebibytes
gibibyte: gib, gibibyte, gibibytes
tebibyte: tib, tebibyte, tebibytes
kilobyte: kb, kilobyte, kilobytes
megabyte: mb, megabyte, megabytes
gigabyte: gb, gigabyte, gigabytes
terabyte: tb, terabyte, terabytes
petabyte: pb, petabyte, petabytes
byte: byte, bytes
bit: bit, bits
percent: %, percent, per cent, pct, percentage points, percentage point
basis_point: bps, basis points, basis point
celsius: °c, ° c, degrees celsius, degree celsius, deg c, celsius, centigrade, c
fahrenheit: °f, ° f, degrees fahrenheit, degree fahrenheit, deg f, fahrenheit, f
kelvin: °k, kelvin, kelvins, k
meter_per_second: m/s, mps, meters per second, metres per second
kilometer_per_hour: km/h, kmh, kph, km per hour, kilometers per hour, kilometres per hour
mile_per_hour: mph, miles per hour, mi/h
knot: kn, knot, knots
foot_per_second: ft/s, fps, feet per second
usd: usd, us$, u.s. dollars, dollar, dollars, $
eur: eur, euro, euros, €
gbp: gbp, pound sterling, pounds sterling, quid, £
inr: inr, rs., rs, rupee, rupees, ₹
jpy: jpy, yen, ¥
cent: cent, cents
pence: pence
paise: paise
"""


def _number(s: str) -> float:
    a, _, b = s.partition("/")
    return float(a) / float(b or 1)


def _close() -> dict[str, tuple[str, str, float, float]]:
    """unit -> (dimension, base, factor, offset). Each line's units lead to ones before them or to the base."""
    out: dict[str, tuple[str, str, float, float]] = {}
    for line in LINES.strip().splitlines():
        dimension, _, rest = line.partition(": ")
        base, *steps = rest.split("; ")
        out[base] = (dimension, base, 1.0, 0.0)
        todo = [s.split() for s in steps]
        while todo:
            unit, to, a, *b = todo.pop(0)
            if to not in out:
                todo.append([unit, to, a, *b])
                continue
            _, _, factor, offset = out[to]
            out[unit] = (dimension, base, _number(a) * factor, (_number(b[0]) if b else 0.0) * factor + offset)
    return out


UNITS = _close()
ALIASES = {a.lower(): unit for line in SPELLINGS.strip().splitlines() for unit, _, names in [line.partition(": ")] for a in names.split(", ")}
ALIASES |= {u: u for u in UNITS if u not in ALIASES}


def resolve(name: str | None) -> str | None:
    key = (name or "").strip().lower()
    return ALIASES.get(key.rstrip(".")) or ALIASES.get(key)


def dimension(unit: str) -> str | None:
    return UNITS[unit][0] if unit in UNITS else None


def to_base(value: float, unit: str | None) -> tuple[float, str | None]:
    """Value in the base unit; an unknown unit passes through."""
    name = resolve(unit)
    if name is None:
        return float(value), unit
    _, base, a, b = UNITS[name]
    return value * a + b, base


def convert(value: float, unit: str, to: str) -> float | None:
    """None between units that do not convert, such as two currencies."""
    u, v = resolve(unit), resolve(to)
    if u is None or v is None or UNITS[u][1] != UNITS[v][1]:
        return None
    _, _, a, b = UNITS[v]
    return (to_base(value, u)[0] - b) / a


def unit_table(spark: SparkSession) -> DataFrame:
    """(alias, unit, dimension, base_unit, factor, offset): a few hundred rows at any scale."""
    rows = [(a, u, *UNITS[u]) for a, u in sorted(ALIASES.items())]
    return spark.createDataFrame(rows, "alias string, unit string, dimension string, base_unit string, factor double, offset double")


def normalize_units(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """df with unit_name, dimension, canonical_value and base_unit; unknown units pass through. The unit table is broadcast."""
    t = unit_table(df.sparkSession).withColumnRenamed("unit", "unit_name")
    key = F.lower(F.trim(unit))
    keyed = df.withColumn("_alias", key)
    out = keyed.join(F.broadcast(t), F.col("_alias") == F.col("alias"), "left")
    known: Column = F.col("factor").isNotNull()
    return out.withColumns({"canonical_value": F.when(known, F.col(value) * F.col("factor") + F.col("offset")).otherwise(F.col(value)), "base_unit": F.coalesce("base_unit", unit)}).drop("_alias", "alias", "factor", "offset")
