"""Column functions: hexadecimal fields, frequency scales, spectral distances, times and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shex2dec(h: Column) -> Column:
    """Signed integer of big-endian two's complement digits; the half itself stays positive, blanks count as zeros."""
    clean = F.regexp_replace(h, " ", "0")
    d, full = F.conv(clean, 16, 10).cast("double"), F.pow(F.lit(16.0), F.length(clean))
    bad = F.when(~clean.rlike("^[0-9A-Fa-f]*$"), F.raise_error(F.lit("not hexadecimal")).cast("double"))
    return F.coalesce(bad, F.when(d > full / 2, d - full).otherwise(d)).cast("bigint")


#: Fixed values of the mel scale: natural logarithms from 700 Hz, 1000 mel at 1000 Hz.
MEL_KNEE, MEL_SCALE = 700.0, 1127.01048


def hz_to_mel(f: Column) -> Column:
    return F.signum(f) * F.log(1 + F.abs(f) / MEL_KNEE) * MEL_SCALE


def mel_to_hz(m: Column) -> Column:
    return F.signum(m) * MEL_KNEE * (F.exp(F.abs(m) / MEL_SCALE) - 1)


#: Fixed values of the bark scale: b = BARK_A f / (BARK_B + f) + BARK_C, made to be 0 at 0 Hz by a parabola under BARK_LOW, and of slope
#: 1 + BARK_RISE past BARK_MIDDLE, with a parabola over one bark to each side.
BARK_A, BARK_B, BARK_C = 26.81, 1960.0, -0.53
BARK_LOW, BARK_RISE, BARK_MIDDLE = 3.0, 0.25, 20.4
_DIP, _BEND = 0.53 / 3.53**2, BARK_RISE / 4


def hz_to_bark(f: Column, low: str = "smooth", high: str = "smooth") -> Column:
    """Critical bands, odd in f. low and high: "smooth" corrections (no step of the slope), "linear" ones (under 2 and over 20.1 bark) or "none"."""
    r = BARK_A * F.abs(f) / (BARK_B + F.abs(f)) + BARK_C
    b = {"smooth": F.when(r < BARK_LOW, r + _DIP * (BARK_LOW - r) * (BARK_LOW - r)).otherwise(r), "linear": F.when(r < 2, r + 0.15 * (2 - r)).otherwise(r), "none": r}[low]
    over = r - (BARK_MIDDLE - 1)
    bent = F.when(r > BARK_MIDDLE + 1, r + BARK_RISE * (r - BARK_MIDDLE)).when(over > 0, r + _BEND * over * over).otherwise(b)
    return F.signum(f) * {"smooth": bent, "linear": F.when(r > 20.1, r + 0.22 * (r - 20.1)).otherwise(b), "none": b}[high]


def bark_to_hz(b: Column, low: str = "smooth", high: str = "smooth") -> Column:
    """The inverse of hz_to_bark with the same corrections; null where no frequency has so many bark."""
    x = F.abs(b)
    r = {
        "smooth": F.when(x < BARK_LOW, BARK_LOW - (1 - F.sqrt(F.greatest(1 - 4 * _DIP * (BARK_LOW - x), F.lit(0.0)))) / (2 * _DIP)).otherwise(x),
        "linear": F.when(x < 2, (x - 0.3) / 0.85).otherwise(x),
        "none": x,
    }[low]
    over = x - (BARK_MIDDLE - 1)
    bent = F.when(x > BARK_MIDDLE + 1 + BARK_RISE, (x + BARK_RISE * BARK_MIDDLE) / (1 + BARK_RISE)).when(over > 0, BARK_MIDDLE - 1 + (F.sqrt(1 + 4 * _BEND * F.abs(over)) - 1) / (2 * _BEND)).otherwise(r)
    r = {"smooth": bent, "linear": F.when(x > 20.1, (x + 0.22 * 20.1) / 1.22).otherwise(r), "none": r}[high]
    return F.when(r < BARK_A + BARK_C, F.signum(b) * BARK_B * (r - BARK_C) / F.nullif(BARK_A + BARK_C - r, F.lit(0.0)))


def hz_to_cent(f: Column) -> Column:
    return F.signum(f) * 1200 * F.log2(F.abs(f) / (440 * 2 ** (3 / 12 - 5)))


def cent_to_hz(c: Column) -> Column:
    """The inverse of hz_to_cent over 0 cents; a negative value is taken as one of a negative frequency."""
    return F.signum(c) * (440 * 2 ** (3 / 12 - 5)) * F.pow(F.lit(2.0), F.abs(c) / 1200)


def hz_to_midi(f: Column) -> Column:
    return 69 + 12 * F.log2(F.abs(f) / 440)


def midi_to_hz(n: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (n - 69) / 12)


def name_numbers(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit("([0-9]+)"), 1), lambda x: x.cast("bigint"))


def strip_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def at_offset(start: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.round(seconds * 1_000_000).cast("bigint"))


def _mean_half(a: Column, b: Column, f) -> Column:
    """Mean of f over two spectra of one length, first and last bins at half weight."""
    each = F.zip_with(a, b, f)
    n = F.size(a)
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) - (F.element_at(each, 1) + F.element_at(each, -1)) / 2
    return total / (n - 1)


def dist_is(a: Column, b: Column) -> Column:
    """Itakura-Saito distance of two power spectra."""
    return _mean_half(a, b, lambda x, y: x / y - F.log(x / y)) - 1


def dist_itakura(a: Column, b: Column) -> Column:
    return F.log(_mean_half(a, b, lambda x, y: x / y)) - _mean_half(a, b, lambda x, y: F.log(x / y))


def dist_cosh(a: Column, b: Column) -> Column:
    return _mean_half(a, b, lambda x, y: (x / y + y / x) / 2) - 1
