"""BM25 in 32-bit floats, as columns.

Spark divides floats as doubles, so each division is cast back: a double quotient of two floats
rounds to the same float as a direct division.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def f32div(a: Column, b: Column) -> Column:
    return (a.cast("double") / b.cast("double")).cast("float")


def quantized_length(dl: Column) -> Column:
    """Field length as its one-byte norm keeps it: exact below 40, else 4 significant bits over 24."""
    over = dl - 24
    cut = F.length(F.bin(over)) - 4
    step = F.pow(F.lit(2.0), cut.cast("double"))
    return F.when(dl < 40, dl.cast("long")).otherwise(24 + (F.floor(over / step) * step).cast("long")).cast("int")


class Similarity:
    """Scores a posting. Subclass to plug in another formula."""

    def idf(self, df: Column, doc_count: Column) -> Column:
        raise NotImplementedError

    def score(self, weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class BM25(Similarity):
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if not (math.isfinite(self.k1) and self.k1 >= 0):
            raise ValueError("k1 must be finite and not negative")
        if not 0 <= self.b <= 1:
            raise ValueError("b must be within 0 and 1")

    def idf(self, df: Column, doc_count: Column) -> Column:
        return F.log(F.lit(1.0) + (doc_count - df + F.lit(0.5)) / (df + F.lit(0.5))).cast("float")

    def score(self, weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
        share = f32div(f32(self.b) * f32(length), avgdl)
        inv = f32div(f32(1.0), f32(self.k1) * ((f32(1.0) - f32(self.b)) + share))
        return weight - f32div(weight, f32(1.0) + f32(tf) * inv)


@dataclass(frozen=True)
class Boolean(Similarity):
    """Every match scores its boost."""

    def idf(self, df: Column, doc_count: Column) -> Column:
        return f32(1.0)

    def score(self, weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
        return weight
