"""Spectral indices over reflectance columns.  A zero denominator gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamframe import codes


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def normalized_difference(a: Column, b: Column) -> Column:
    return _ratio(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return 2.5 * _ratio(nir - red, nir + 6.0 * red - 7.5 * blue + 1.0)


def savi(nir: Column, red: Column) -> Column:
    return 1.5 * _ratio(nir - red, nir + red + 0.5)


def ndmi(nir: Column, swir: Column) -> Column:
    return normalized_difference(nir, swir)


def ndsi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def bsi(swir: Column, red: Column, nir: Column, blue: Column) -> Column:
    return _ratio((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def ci(red: Column, green: Column) -> Column:
    return normalized_difference(red, green)


def omi(green: Column) -> Column:
    return _ratio(F.lit(1.0), green * green)


def si(red: Column, blue: Column) -> Column:
    return normalized_difference(red, blue)


def ri(red: Column, blue: Column, green: Column) -> Column:
    return _ratio(red * red, blue * green * green)


def cai(swir: Column, nir: Column, red: Column, blue: Column) -> Column:
    return 0.5 * ((swir - nir) - (red - blue))


def bi(blue: Column, green: Column, red: Column) -> Column:
    return F.sqrt((blue * blue + green * green + red * red) / 3.0)


def with_indices(pixels: DataFrame, blue="b02", green="b03", red="b04", nir="b08", swir="b11") -> DataFrame:
    """Add the eleven feature indices and the snow index in one projection."""
    b, g, r, n, s = (F.col(c) for c in (blue, green, red, nir, swir))
    return pixels.withColumns(
        {
            "NDVI": ndvi(n, r), "BSI": bsi(s, r, n, b), "SAVI": savi(n, r), "NDMI": ndmi(n, s),
            "CI": ci(r, g), "OMI": omi(g), "EVI": evi(n, r, b), "SI": si(r, b),
            "RI": ri(r, b, g), "CAI": cai(s, n, r, b), "BI": bi(b, g, r), "NDSI": ndsi(g, s),
        }
    )


def scale_reflectance(digital_number: Column) -> Column:
    return digital_number * codes.REFLECTANCE_SCALE


def true_color(pixels: DataFrame, keys: list[str], red="b04", green="b03", blue="b02") -> DataFrame:
    """Key columns and the three visible bands, in display order."""
    return pixels.select(*keys, red, green, blue)


def raw_bands(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    return pixels.select(*keys, *bands)
