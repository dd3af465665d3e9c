"""Field model: what each source column becomes in an index."""

from __future__ import annotations

from dataclasses import dataclass, replace

LEVELS = ("none", "docs", "freqs", "positions", "offsets")
DOC_VALUES = ("numeric", "binary", "sorted", "sorted_set", "sorted_numeric")


@dataclass(frozen=True)
class Field:
    """One field: independent axes, as each may be on or off."""

    name: str
    column: str | None = None  # source column; default: the name
    level: str = "none"  # what postings hold
    tokenized: bool = False
    analyzer: str = "standard"
    norms: bool = False
    doc_values: str | None = None
    point: str | None = None  # int, long, float, double, lat_lon, int_range, ...
    stored: bool = False
    vectors: bool = False
    feature: bool = False

    @property
    def source(self) -> str:
        return self.column or self.name

    def at(self, column: str) -> Field:
        return replace(self, column=column)

    def shape(self) -> tuple:
        return (self.level, self.tokenized, self.norms, self.doc_values, self.point, self.stored, self.vectors, self.feature)


def text(name: str, level: str = "positions", stored: bool = False, vectors: bool = False, analyzer: str = "standard") -> Field:
    if level not in LEVELS[1:]:
        raise ValueError(f"level must be one of {LEVELS[1:]}")
    return Field(name, level=level, tokenized=True, analyzer=analyzer, norms=True, stored=stored, vectors=vectors)


def keyword(name: str, stored: bool = False) -> Field:
    return Field(name, level="docs", analyzer="keyword", doc_values="sorted_set", stored=stored)


def string(name: str, stored: bool = False) -> Field:
    return Field(name, level="docs", analyzer="keyword", stored=stored)


def feature(name: str) -> Field:
    """Source column: map<string, float> of positive values."""
    return Field(name, level="freqs", feature=True)


def _number(kind: str):
    def field(name: str, stored: bool = False) -> Field:
        return Field(name, doc_values="sorted_numeric", point=kind, stored=stored)

    return field


int_field, long_field, float_field, double_field = map(_number, ("int", "long", "float", "double"))


def lat_lon(name: str) -> Field:
    """Source column: struct<lat, lon>."""
    return Field(name, point="lat_lon")


def _range(kind: str):
    def field(name: str) -> Field:
        return Field(name, point=f"{kind}_range")

    return field


int_range, long_range, float_range, double_range = map(_range, ("int", "long", "float", "double"))


def _values(kind: str):
    def field(name: str) -> Field:
        return Field(name, doc_values=kind)

    return field


numeric_dv, binary_dv, sorted_dv, sorted_set_dv, sorted_numeric_dv = map(_values, DOC_VALUES)


def stored(name: str) -> Field:
    return Field(name, stored=True)


def checked(fields: list[Field]) -> list[Field]:
    """The fields, one per name and source; two of one name must have one shape."""
    shapes: dict[str, tuple] = {}
    for f in fields:
        if shapes.setdefault(f.name, f.shape()) != f.shape():
            raise ValueError(f"field {f.name!r} is declared with two shapes")
    return list(dict.fromkeys(fields))
