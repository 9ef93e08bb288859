"""Scalar functions, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where it doesn't match."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def airline(flight: Column) -> Column:
    """The leading code of a flight number, `?` where there is none, so that such rows make a group."""
    return F.coalesce(matched(flight, "^([A-Z]{2,3})"), F.lit("?"))


def numeric_suffixes(name: Column) -> list[Column]:
    """What a stand's name ends in: a number with a letter before and after it, if any, and one with a letter after it."""
    return [matched(name, r"([A-Z]?\d+[A-Z]?)$"), matched(name, r"(\d+[A-Z]?)$")]


def stand_prefix(stand: Column) -> Column:
    return matched(stand, r"^([A-Za-z]+|\d)")


def plain_name(name: Column) -> Column:
    """Upper case, without what is no letter or digit, and without a closing -(X)."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), r"-\(.\)$", ""), "[^A-Z0-9]", "")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a / b)


def floored(x: Column, least: float = 0.0) -> Column:
    """Not below least; null stays null, which greatest() alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def hour_of_day(us: Column) -> Column:
    """Hour and minute as a fraction, from epoch microseconds."""
    minutes = F.floor(us / 60_000_000) % 1440
    return F.floor(minutes / 60) + (minutes % 60) / 60


def weekday(us: Column) -> Column:
    """Monday is 0; 1970-01-01 was a Thursday."""
    return F.pmod(F.floor(us / 86_400_000_000) + 3, F.lit(7))


def rounding_score(us: Column) -> Column:
    """0, 1 or 2: one if the second is zero, one if the minute is a multiple of five."""
    seconds = F.pmod(F.floor(us / 1_000_000), F.lit(3600))
    return F.when(us.isNotNull(), (seconds % 60 == 0).cast("int") + (F.floor(seconds / 60) % 5 == 0).cast("int"))


def same(a: Column, b: Column) -> Column:
    """1 if both are there and equal, else 0."""
    return F.coalesce(a == b, F.lit(False)).cast("int")


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def weather_flags(codes: Column) -> dict[str, Column]:
    """Whether a present-weather code holds fog, snow, rain, thunder, freezing."""
    patterns = {"fog": "FG|BR", "snow": "SN|SG|PL", "rain": "RA|DZ", "thunder": "TS", "freezing": "FZ"}
    return {n: F.coalesce(codes.rlike(p), F.lit(False)).cast("int") for n, p in patterns.items()}


def deicing_likely(temperature: Column, snow: Column, rain: Column, spread: Column, freezing: Column) -> Column:
    """Cold and wet, or freezing; null where the temperature is."""
    wet = (snow == 1) | (rain == 1) | (spread <= 2)
    return F.when(temperature.isNotNull(), ((temperature <= 3) & F.coalesce(wet, F.lit(False)) | (freezing == 1)).cast("int"))


def box(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    """Whether a point lies in the square of km around a centre."""
    import math

    half = km / 111.32
    return (F.abs(lat - lat0) <= half) & (F.abs(lon - lon0) <= half / math.cos(math.radians(lat0)))


def flat_metres(lat: Column, lon: Column, lat0: float, radius: float = 6_371_000.0) -> tuple[Column, Column]:
    """Equirectangular x and y on a globe of that radius."""
    import math

    return F.radians(lon) * radius * math.cos(math.radians(lat0)), F.radians(lat) * radius


def wake_weight(wake: Column) -> Column:
    """Fixed weights of wake categories; anything else weighs 1."""
    weights = {"J": 2.0, "H": 1.6, "M": 1.0, "L": 0.7}
    first = F.upper(F.substring(F.trim(wake), 1, 1))
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(first == k, v).otherwise(out)
    return out


def heavy(wake: Column) -> Column:
    return F.coalesce(F.upper(F.substring(F.trim(wake), 1, 1)).isin("J", "H"), F.lit(False)).cast("int")
