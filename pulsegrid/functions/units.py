"""Time, frequency and period units as column expressions (and plain numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of a time unit, nanohertz of a frequency unit.
TIME_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}
FREQUENCY_UNITS = {"nHz": 1, "uHz": 1_000, "mHz": 1_000_000, "Hz": 1_000_000_000, "kHz": 1_000_000_000_000, "MHz": 1_000_000_000_000_000}
NS_PER_S = 1_000_000_000
_E18 = 1_000_000_000_000_000_000


def _factor(unit: str, units: dict[str, int]) -> int:
    if unit not in units:
        raise ValueError(f"unknown unit {unit!r}; one of {', '.join(units)}")
    return units[unit]


def floor_div(x: Column, y: int | Column) -> Column:
    """Whole-number floor division; nanoseconds of today are beyond what a double holds."""
    y = y if isinstance(y, Column) else F.lit(y)
    return F.call_function("div", x - F.pmod(x, y), y)


def ceil_div(x: Column, y: int | Column) -> Column:
    return -floor_div(-x, y)


def to_ns(x: Column, unit: str = "ns") -> Column:
    """Banker's rounding, exact for whole numbers."""
    return F.bround(x.cast("decimal(38,9)") * F.lit(_factor(unit, TIME_UNITS)).cast("decimal(20,0)"), 0).cast("long")


def from_ns(x: Column, unit: str) -> Column:
    return x / F.lit(_factor(unit, TIME_UNITS)).cast("double")


def scalar_ns(x: float, unit: str = "ns") -> int:
    return round(x * _factor(unit, TIME_UNITS))


def to_nhz(x: Column, unit: str = "nHz") -> Column:
    return F.bround(x.cast("decimal(30,9)") * F.lit(_factor(unit, FREQUENCY_UNITS)).cast("decimal(20,0)"), 0).cast("long")


def scalar_nhz(x: float, unit: str = "nHz") -> int:
    return round(x * _factor(unit, FREQUENCY_UNITS))


def from_nhz(x: Column, unit: str) -> Column:
    return x / F.lit(_factor(unit, FREQUENCY_UNITS)).cast("double")


def period_of(freq_nhz: Column) -> Column:
    """Whole nanoseconds between samples, and by symmetry nanohertz of a period."""
    return floor_div(F.lit(_E18), freq_nhz.cast("long"))


def duration_by_freq(n: Column, freq_nhz: Column) -> Column:
    """n * 10^18 // freq without overflow."""
    product = n.cast("decimal(19,0)") * F.lit(_E18).cast("decimal(19,0)")
    rest = product % freq_nhz.cast("decimal(38,0)")
    # the quotient is whole, so the decimal division rounds nothing
    return ((product - rest) / freq_nhz.cast("decimal(20,0)")).cast("decimal(38,0)").cast("long")


def duration_by_period(n: Column, period_ns: Column) -> Column:
    return n * period_ns


def iso_string(time_n: Column, zone: str = "Etc/GMT") -> Column:
    """Microsecond ISO text in a time zone."""
    micros = floor_div(time_n, 1000)
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(micros), zone), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
