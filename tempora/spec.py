"""Roles of columns and JSON keys, checked when declared, and the schemas of the graph's tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import types as T


def _names(value: str | Iterable[str] | None) -> tuple[str, ...]:
    if value is None:
        return ()
    names = (value,) if isinstance(value, str) else tuple(value)
    for name in names:
        if not isinstance(name, str):
            raise TypeError(f"a name must be a string: {name!r}")
    return tuple(dict.fromkeys(names))


@dataclass(frozen=True)
class EventSpec:
    """Which columns of the sample table are events and targets, and which JSON keys mean what."""

    event_cols: tuple[str, ...] = ()
    target_cols: tuple[str, ...] = ()
    sample_obs_col: str = "obs_timestamp"
    obs_key: str = "obs_timestamp"
    event_key: str = "event_timestamp"
    censor_key: str = "censor_timestamp"
    foreign_keys: tuple[str, ...] = ()
    ignored_keys: tuple[str, ...] = ()
    degree: int = 1
    zero_is_missing: bool = True
    on_bad_json: str = "fail"

    def __post_init__(self):
        for name in ("event_cols", "target_cols", "foreign_keys", "ignored_keys"):
            object.__setattr__(self, name, _names(getattr(self, name)))
        for name in ("sample_obs_col", "obs_key", "event_key", "censor_key"):
            if not isinstance(getattr(self, name), str):
                raise TypeError(f"{name} must be a string")
        if not isinstance(self.degree, int):
            raise TypeError("degree must be an integer")
        if self.on_bad_json not in ("fail", "drop", "quarantine"):
            raise ValueError("on_bad_json is one of fail, drop, quarantine")
        if both := set(self.target_cols) & set(self.event_cols):
            raise ValueError(f"both target and event columns: {sorted(both)}")
        groups = [{self.obs_key}, {self.event_key}, {self.censor_key}, set(self.foreign_keys), set(self.ignored_keys)]
        for a, b in combinations(groups, 2):
            if a & b:
                raise ValueError(f"keys with two roles: {sorted(a & b)}")


VARIANTS = T.MapType(T.StringType(), T.VariantType())

#: One row for each event of each sample.
NODES = T.StructType([
    T.StructField("sample_key", T.LongType()),
    T.StructField("sample_obs_timestamp", T.DoubleType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("obs_timestamp", T.DoubleType()),
    T.StructField("event_timestamp", T.DoubleType()),
    T.StructField("censor_timestamp", T.DoubleType()),
    T.StructField("attributes", VARIANTS),
    T.StructField("foreign_keys", VARIANTS),
    T.StructField("eligible", T.BooleanType()),
    T.StructField("node_id", T.LongType()),
])

#: Edges of a sample from u to v; multiplicity counts parallel ones.
EDGES = T.StructType([
    T.StructField("sample_key", T.LongType()),
    T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("multiplicity", T.LongType()),
])

DICTIONARY = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("token", T.StringType()), T.StructField("id", T.LongType()),
])
