"""From tables and JSON histories to the node table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions import scalar
from tempora.operators.partition import numbered_rows
from tempora.spec import EventSpec
from tempora.storage import unused


def point_in_time(samples: DataFrame, data: DataFrame, keys: Sequence[str], sample_ts: str, data_ts: str, columns: Sequence[str], name: str, as_json: bool = True) -> DataFrame:
    """For each sample the history of ``data`` up to its time, as one (JSON) array column ``name``.

    A left join: a sample without history gets one empty event. The array is in the order of the columns.
    """
    a, b = samples.alias("a"), data.alias("b")
    match = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]) & (F.col(f"b.{data_ts}") <= F.col(f"a.{sample_ts}"))
    event = F.struct(F.col(f"b.{data_ts}").alias(data_ts), *[F.col(f"b.{c}").alias(c) for c in columns if c != data_ts])
    group = [F.col(f"a.{k}").alias(k) for k in [*keys, sample_ts]]
    events = F.array_sort(F.collect_list(event))
    return a.join(b, match, "left").groupBy(*group).agg((F.to_json(events) if as_json else events).alias(name))


def _parsed(cell: Column, kind: T.DataType) -> Column:
    """A cell as array<map<string, variant>>; null where it has no such form."""
    if not isinstance(kind, T.StringType):
        cell = F.to_json(cell)
    one = F.array(F.from_json(cell, "map<string,variant>"))
    return F.when(F.ltrim(cell).startswith("{"), F.when(one[0].isNotNull(), one)).otherwise(F.from_json(cell, "array<map<string,variant>>"))


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def explode_events(df: DataFrame, spec: EventSpec, sample_key: str = "sample_key") -> DataFrame:
    """One row for each event of each event column; the column's name is the event's type.

    Columns that ``df`` doesn't have are skipped. A null cell has no events. Cells of a wrong form
    follow ``spec.on_bad_json``: they raise, are dropped, or stay as one row with ``bad_json``.
    """
    columns = [c for c in spec.event_cols if c in df.columns]
    parts = []
    for c in columns:
        events = _parsed(F.col(c), df.schema[c].dataType)
        bad = F.col(c).isNotNull() & (events.isNull() | F.exists(events, lambda e: e.isNull()))
        text = F.col(c).cast("string") if isinstance(df.schema[c].dataType, T.StringType) else F.to_json(c)
        if spec.on_bad_json == "fail":
            events = F.when(bad, F.raise_error(F.concat(F.lit(f"bad JSON in {c}: "), text)).cast("array<map<string,variant>>")).otherwise(events)
        elif spec.on_bad_json == "drop":
            events = F.when(~bad, events)
        rows = df.select(
            F.col(sample_key).alias("sample_key"), F.col(spec.sample_obs_col).cast("double").alias("sample_obs_timestamp"),
            F.lit(c).alias("event_type"), F.when(bad, text).alias("bad_json") if spec.on_bad_json == "quarantine" else F.lit(None).cast("string").alias("bad_json"),
            events.alias("events"),
        )
        if spec.on_bad_json == "quarantine":
            rows = rows.withColumn("events", F.when(F.col("bad_json").isNotNull(), F.array(F.lit(None).cast("map<string,variant>"))).otherwise(F.col("events")))
        parts.append(rows.select("sample_key", "sample_obs_timestamp", "event_type", "bad_json", F.posexplode("events").alias("pos", "e")))
    if not parts:
        raise ValueError(f"none of the event columns {spec.event_cols} is there")
    rows = reduce(DataFrame.unionByName, parts)
    times = {"obs_timestamp": spec.obs_key, "event_timestamp": spec.event_key, "censor_timestamp": spec.censor_key}
    taken = [*times.values(), *spec.ignored_keys, *spec.foreign_keys]
    rows = rows.select(
        "sample_key", "sample_obs_timestamp", "event_type", "pos", "bad_json",
        *[_number(F.col("e")[k]).alias(n) for n, k in times.items()],
        F.map_filter("e", lambda k, _: ~k.isin(*taken)).alias("attributes"),
        (F.map_filter("e", lambda k, _: k.isin(*spec.foreign_keys)) if spec.foreign_keys else F.map_filter("e", lambda k, _: F.lit(False))).alias("foreign_keys"),
    )
    rows = rows.where(F.col("bad_json").isNotNull() | timed())
    return rows if spec.on_bad_json == "quarantine" else rows.drop("bad_json")


def timed(*columns: str) -> Column:
    """An event with no time at all is dropped; here 0 is a time."""
    return F.coalesce(*[F.col(c).cast("double") for c in columns or ("obs_timestamp", "event_timestamp", "censor_timestamp")]).isNotNull()


def with_eligible(events: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """Marks the events that take part in causal edges, and makes zero times missing."""
    out = events.withColumn("eligible", scalar.eligible(F.col("event_timestamp"), F.col("obs_timestamp"), F.col("sample_obs_timestamp"), zero_is_missing))
    if not zero_is_missing:
        return out
    return out.withColumns({c: scalar.missing_if_zero(F.col(c)) for c in ("obs_timestamp", "event_timestamp", "censor_timestamp")})


def event_order(*ties: str) -> list[Column]:
    """By event time (missing last), observation time (missing first), then the tie columns."""
    return [F.col("event_timestamp").asc_nulls_last(), F.col("obs_timestamp").asc_nulls_first(), *[F.col(c).asc() for c in ties]]


def place_in_sample(events: DataFrame, *ties: str) -> DataFrame:
    """``place``: 0, 1, ... in each sample's event order; events without a sample are a sample too."""
    (number,) = unused(events, "number")
    rows = with_node_ids(events, *ties, name=number)
    first = rows.groupBy(F.col("sample_key").alias("key")).agg(F.min(number).alias("first"))
    rows = rows.join(first, F.col("sample_key").eqNullSafe(F.col("key")))
    return rows.withColumn("place", F.col(number) - F.col("first")).drop("key", "first", number)


def with_node_ids(events: DataFrame, *ties: str, name: str = "node_id") -> DataFrame:
    """Dense ``name`` over all samples: samples by key (a null one first), events in event order.

    The events are sorted by ranges and written once, so neither a large sample nor the sum is in one task.
    """
    return numbered_rows(events, "sample_key", *event_order(*(ties or ("event_type", "pos"))), name=name)


def build_nodes(df: DataFrame, spec: EventSpec, sample_key: str = "sample_key") -> DataFrame:
    """The whole node table of a sample table: exploded, marked and numbered."""
    return with_node_ids(with_eligible(explode_events(df, spec, sample_key), spec.zero_is_missing))


def targets(df: DataFrame, spec: EventSpec) -> DataFrame:
    """``df`` without its event columns, its targets as float; a target that isn't there is null."""
    out = df.drop(*[c for c in spec.event_cols if c in df.columns])
    return out.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast("float") for c in spec.target_cols})
