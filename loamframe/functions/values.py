"""Value functions: NaN handling, rounding, units, logarithms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from loamframe import codes

_FLOATS = (T.DoubleType, T.FloatType)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    wide = value.cast("double")
    bad = F.isnan(wide) | wide.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def clean_nan(value: Column, data_type: T.DataType) -> Column:
    """``finite`` applied to every float inside a nested value."""
    if isinstance(data_type, _FLOATS):
        return finite(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: clean_nan(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, item: clean_nan(item, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [clean_nan(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def round_null(value: Column, digits: int = 2) -> Column:
    return F.round(value, digits)


def convert_units(raw: Column, scale: Column, offset: Column, digits: int = 4) -> Column:
    """``raw · scale + offset`` at four decimals, NaN → NULL."""
    return F.round(finite(raw) * scale + offset, digits)


def log_som(value: Column) -> Column:
    return F.log10(value)


def inverse_log_som(log_value: Column, smearing: Column) -> Column:
    return F.pow(F.lit(10.0), log_value) * smearing


def unit_factor(unit: Column) -> Column:
    """Organic matter is modelled in percent; one percent is 10 g/kg."""
    return F.when(unit == "pct", F.lit(1.0)).otherwise(F.lit(10.0))


def nodata_text(value: Column) -> Column:
    """JSON has no NaN or infinity: write those as text, leave an unset value unset."""
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(value.cast("string"))
    )


def area_hectares(area_m2: Column, *stated: Column, square_metres: Column | None = None) -> Column:
    """First stated area in hectares, else one stated in m², else the geometry's own."""
    options = list(stated)
    if square_metres is not None:
        options.append(square_metres / 10_000.0)
    return F.coalesce(*options, area_m2 / 10_000.0)


def region_box(name: Column) -> Column:
    """Named region → ``struct(minx, miny, maxx, maxy)``; unknown → NULL."""
    key = F.lower(F.trim(name))
    box = None
    for region, (minx, miny, maxx, maxy) in codes.REGION_BOXES.items():
        value = F.struct(
            F.lit(minx).alias("minx"), F.lit(miny).alias("miny"),
            F.lit(maxx).alias("maxx"), F.lit(maxy).alias("maxy"),
        )
        box = F.when(key == region, value) if box is None else box.when(key == region, value)
    return box
