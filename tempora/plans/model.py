"""The event model over the order tables: samples are customers, events are orders and shipments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators import ingest

#: 1997-01-01 in epoch seconds.
SAMPLE_OBS = 852_076_800
DEGREE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp without a zone, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return days.cast("double") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before they are numbered; k1, k2 name one: the order and the shipment's place in it."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", epoch(F.col("o_orderdate")).alias("o_ts"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", epoch(F.col("l_shipdate")).alias("l_ts"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_ts"))
    lines = lines.withColumn("k2", place)
    none = F.lit(None).cast("double")
    a = orders.select(
        F.col("o_custkey").alias("sample_key"), F.lit("order").alias("event_type"), F.col("o_orderkey").alias("k1"), F.lit(0).alias("k2"),
        none.alias("obs_timestamp"), F.col("o_ts").alias("event_timestamp"),
    )
    b = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("sample_key"), F.lit("ship").alias("event_type"), F.col("l_orderkey").alias("k1"), "k2",
        F.col("o_ts").alias("obs_timestamp"), F.col("l_ts").alias("event_timestamp"),
    )
    events = a.unionByName(b)
    return events.withColumns({"sample_obs_timestamp": F.lit(float(SAMPLE_OBS)), "censor_timestamp": F.when(F.col("k2") % 3 == 2, F.lit(float(SAMPLE_OBS) * 1.2)).cast("double")})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events with a stable node id, eligibility, and the order as foreign key."""
    out = ingest.with_eligible(order_events(spark, sf_dir))
    return out.withColumns({"node_id": F.col("k1") * 1000 + F.col("k2"), "fk": F.lit("order"), "fk_value": F.col("k1").cast("string")})


#: The same nodes for the oracle.
NODES_SQL = f"""
nodes AS (
  SELECT o_custkey AS sid, 'order' AS et, o_orderkey AS k1, 0 AS k2, CAST(NULL AS BIGINT) AS obs,
         CAST(epoch(o_orderdate) AS BIGINT) AS ets, o_orderkey * 1000 AS nid, CAST(NULL AS DOUBLE) AS cts,
         TRUE AS el
  FROM orders
  UNION ALL
  SELECT o_custkey, 'ship', l_orderkey, k2, CAST(epoch(o_orderdate) AS BIGINT), CAST(epoch(l_shipdate) AS BIGINT),
         l_orderkey * 1000 + k2, CASE WHEN k2 % 3 = 2 THEN {SAMPLE_OBS} * 1.2e0 END, epoch(l_shipdate) < {SAMPLE_OBS}
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k2
        FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)"""
