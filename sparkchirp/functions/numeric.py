"""Column functions: scaling, quantising, calibration.  Every float step is rounded to 32 bits, as the data model asks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import f32

#: 3 * 1024 / 255 / 16 in 32-bit floats: the fixed factor of the output scale.
SCALE = float(np.float32(3.0) * np.float32(1024.0) / np.float32(255.0) / np.float32(16.0))


def flt(x: float) -> Column:
    """A 32-bit float literal."""
    return F.lit(f32(x)).cast("float")


def max_value(nbits: int) -> int:
    return (1 << nbits) - 1


def scale_constants(in_nbits: int, out_nbits: int, nchans: int) -> tuple[float, float]:
    """(range of the output, full range of the summed input); 32-bit output has range 1."""
    top = 1.0 if out_nbits == 32 else float(max_value(out_nbits))
    return top, float(np.float32(max_value(in_nbits)) * np.float32(nchans))


def scale_output(total: Column, in_nbits: int, out_nbits: int, nchans: int) -> Column:
    """A channel sum at the output depth: float for 32 bits, else clipped and truncated to an integer.

    All channels count in the divisor, masked ones too.
    """
    top, full = scale_constants(in_nbits, out_nbits, nchans)
    x = ((total.cast("float") * flt(top)) / flt(full)).cast("float") * flt(SCALE)
    if out_nbits == 32:
        return x
    return F.least(F.greatest(x, flt(0)), flt(top)).cast("int")


def quantise(x: Column, gain: Column | None = None) -> Column:
    """Round(x * gain + 127.5), halves up, clipped to a byte."""
    y = x.cast("float") if gain is None else x.cast("float") * gain
    return F.least(F.greatest(F.floor((y + flt(127.5)).cast("double") + F.lit(0.5)), F.lit(0)), F.lit(255)).cast("int")


def affine_range(df: DataFrame, x: str) -> tuple[float, float]:
    """(slope, intercept) that map the range of a column to bytes: two numbers reach the driver."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or high == low:
        return 0.0, 0.0
    return 255.0 / (high - low), -127.5 * (high + low) / (high - low)


def quantise_affine(x: Column, slope: float, intercept: float) -> Column:
    """Round(slope * x + intercept + 127.5), halves away from zero; not clipped."""
    return F.round(F.lit(slope) * x.cast("double") + F.lit(intercept) + F.lit(127.5), 0).cast("int")


def centre(v: Column, nchans: int) -> Column:
    """The sample as the frequency-domain method takes it: (v - 127.5) / channels."""
    return (v.cast("double") - F.lit(127.5)) / F.lit(float(nchans))


def calibrate(raw: Column, scale: Column, offset: Column, weight: Column) -> Column:
    """(raw * scale + offset) * weight of one sample of a calibrated recording."""
    return ((raw.cast("float") * scale.cast("float")) + offset.cast("float")) * weight.cast("float")


def calibrate_arrays(raw: Column, scale: Column, offset: Column, weight: Column) -> Column:
    """As ``calibrate`` for arrays by channel."""
    part = F.zip_with(F.zip_with(raw, scale, lambda r, s: r.cast("float") * s.cast("float")), offset, lambda x, o: x + o.cast("float"))
    return F.zip_with(part, weight, lambda x, w: x * w.cast("float"))


def smearing(dm: Column, delta: Column, dt: float, width: float, f0: float, df: float, nchans: int) -> Column:
    """Total smearing sqrt(dt^2 + width^2 + t_dm^2 + t_delta^2) of a trial and the step to the next."""
    band = nchans * abs(df)
    middle = f0 - band / 2
    k = 8.3 * band / middle**3
    t_dm, t_delta = F.lit(k) * dm.cast("double"), F.lit(k / 4 * nchans) * delta.cast("double")
    return F.sqrt(F.lit(dt * dt + width * width) + t_dm * t_dm + t_delta * t_delta)


def dm_delay(dm: Column, fd: Column) -> Column:
    """Whole-sample delay, halves up."""
    return ((dm.cast("float") * fd.cast("float")).cast("double") + F.lit(0.5)).cast("bigint")


def shift(dm: Column, fd: Column) -> Column:
    """Whole-sample shift, halves to even."""
    return F.rint((dm.cast("float") * fd.cast("float")).cast("double")).cast("bigint")


def phasor(freq: Column, delay: Column) -> tuple[Column, Column]:
    """(cos, sin) of 2 pi frequency delay."""
    angle = F.lit(2.0) * F.pi() * freq * delay
    return F.cos(angle), F.sin(angle)


def complex_multiply(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def sexagesimal(x: Column) -> tuple[Column, Column, Column]:
    """(first, minutes, seconds) of a number written as ddmmss.s; the sign is dropped."""
    first, minutes, seconds = split_angle(F.abs(x), F.floor)
    return first.cast("int"), minutes.cast("int"), seconds


def split_angle(x, floor=math.floor):
    """(first, minutes, seconds) of a number (or column) of at least 0 written as ddmmss.s."""
    first = floor(x / 10000.0)
    minutes = floor((x - first * 10000) / 100.0)
    return first, minutes, x - first * 10000 - minutes * 100


def round_up(x: int, multiple: int) -> int:
    return -(-x // multiple) * multiple


def div_round_up(a: int, b: int) -> int:
    return -(-a // b)


def is_power_of_two(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0


def next_power_of_two(x: int) -> int:
    return 1 << max(0, x - 1).bit_length()
