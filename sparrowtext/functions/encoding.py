"""Numeric encodings of points and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def quantize_lat(lat: Column) -> Column:
    """Latitude as a 32-bit step; 90 itself falls into the last step."""
    return F.least(F.floor(lat * TWO32 / 180.0), F.lit(2147483647)).cast("int")


def quantize_lon(lon: Column) -> Column:
    return F.least(F.floor(lon * TWO32 / 360.0), F.lit(2147483647)).cast("int")


def feature_freq(value: Column) -> Column:
    """A positive feature value as term frequency: the upper 17 bits of its 32-bit float."""
    v = value.cast("float").cast("double")
    e0 = F.floor(F.log2(v))
    e = F.when(F.pow(F.lit(2.0), e0) > v, e0 - 1).when(F.pow(F.lit(2.0), e0 + 1) <= v, e0 + 1).otherwise(e0)
    return ((e + 127) * 256 + F.floor((v / F.pow(F.lit(2.0), e) - 1) * 256)).cast("int")


def feature_value(freq: Column) -> Column:
    """The value that feature_freq keeps."""
    e, m = F.floor(freq / 256) - 127, freq % 256
    return (F.pow(F.lit(2.0), e) * (1 + m / 256.0)).cast("float")
