"""Column expressions shared by all operators. Division by zero gives NULL, never inf or NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top, bottom) -> Column:
    """``top / bottom`` as double, NULL where ``bottom`` is zero."""
    return F.try_divide(_c(top).cast("double"), _c(bottom).cast("double"))


def home_win(pts_home, pts_guest) -> Column:
    """Three-valued outcome label: NULL while either score is missing."""
    return _c(pts_home) > _c(pts_guest)


def finite(value) -> Column:
    """±inf and NaN become NULL."""
    col = _c(value)
    bad = col.isin(float("inf"), float("-inf")) | F.isnan(col)
    return F.when(~bad, col)


def number(text) -> Column:
    """Non-strict numeric parse: unreadable text gives NULL."""
    return F.trim(_c(text)).try_cast("double")


def minutes(text) -> Column:
    """``MM:SS`` as minutes; notes such as "Did Not Play" give NULL."""
    parts = F.split(_c(text), ":")
    return number(F.element_at(parts, 1)) + number(F.element_at(parts, -1)) / 60


def long_date(text) -> Column:
    """``Tue, Oct 21, 2025`` as a date; unreadable text gives NULL."""
    return F.try_to_date(F.regexp_extract(_c(text), r"^\w{3}, (.*)$", 1), "MMM d, yyyy")


def game_key(date, abbrev) -> Column:
    return F.concat(F.date_format(_c(date), "yyyyMMdd"), _c(abbrev))


def composite_key(*parts) -> Column:
    return F.concat_ws("_", *[_c(p).cast("string") for p in parts])


def row_key(*parts) -> Column:
    """Surrogate id that is the same on every re-run."""
    return F.sha2(composite_key(*parts), 256)


def fallback(*values) -> Column:
    return F.coalesce(*[_c(v) for v in values], F.lit(0.0))


def blend(last, recent, season) -> Column:
    """15 % last game, 35 % recent window, 50 % season, each falling back to the season value, then 0."""
    return 0.15 * fallback(last, season) + 0.35 * fallback(recent, season) + 0.50 * fallback(season)


def cap(value, upper) -> Column:
    """Clip from above; NULL stays NULL."""
    col = _c(value)
    return F.when(col > upper, F.lit(upper)).otherwise(col)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (_c(v) for v in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # not ``least``: that ignores NULL, and an unknown place would count as the far side of the earth
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(cap(chord, 1.0)))


def elo_expected(own, other) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (_c(other) - _c(own)) / 400))


def elo_margin_factor(margin, favourite_edge) -> Column:
    """Larger wins count more; a win by the favourite counts less than one by the underdog."""
    return F.pow(_c(margin) + 3, F.lit(0.8)) / (7.5 + 0.006 * _c(favourite_edge))


def is_available(injury) -> Column:
    """Healthy (no note) or day-to-day."""
    note = _c(injury)
    return note.isNull() | note.startswith("Day")


def predicted(proba, threshold: float = 0.5) -> Column:
    return _c(proba) >= threshold


def all_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))
