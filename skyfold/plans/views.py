"""Instrument views over the test tables, in Spark and in DuckDB's SQL.

Both forms evaluate the same formulas; ``SQL`` holds them as named subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators.predict import PLACED


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def main(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    time = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    user = F.col("user_id")
    return e.select(
        F.col("event_id").alias("row_id"), time.alias("time"), (user % 8).cast("int").alias("antenna1"), (8 + F.floor(user / 8) % 8).cast("int").alias("antenna2"),
        (600.0 * (1 + F.col("event_id") % 3)).alias("interval"), (F.col("event_type") == "error").alias("flag_row"),
        (F.col("value") * F.cos(user)).alias("u"), (F.col("value") * F.sin(user)).alias("v"), (0.1 * F.col("value")).alias("w"),
        (600.0 * (1 + F.col("event_id") % 3)).alias("exposure"), time.alias("time_centroid"), (1.0 + F.col("value") / 100.0).alias("weight"), (0.1 + (F.col("event_id") % 10) / 10.0).alias("sigma"),
        F.floor(time / 86400.0).cast("int").alias("time_idx"), F.col("value"),
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    """16 channels x 2 correlations of every embedding; ``label`` numbers its bin."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    part = F.when(F.col("k") % 2 == 0, F.lit("re")).otherwise(F.lit("im"))
    long = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"), F.floor(F.col("k") / 4).cast("int").alias("chan"), F.floor((F.col("k") % 4) / 2).cast("int").alias("corr"), part.alias("part"), F.col("x").cast("double").alias("x"))
    wide = long.groupBy("row_id", "label", "chan", "corr").agg(F.max(F.when(F.col("part") == "re", F.col("x"))).alias("re"), F.max(F.when(F.col("part") == "im", F.col("x"))).alias("im"))
    return wide.withColumn("flag", (F.col("row_id") + F.col("chan")) % 7 == 0)


def sky(spark: SparkSession, d: str) -> DataFrame:
    """The sky model: every part of the catalogue."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        k.alias("source_id"), F.when(F.col("p_type").isin("ECONOMY", "PROMO", "LARGE"), F.lit("POINT")).otherwise(F.lit("GAUSSIAN")).alias("type"),
        (0.02 * F.cos(k.cast("double"))).alias("l"), (0.02 * F.sin(1.7 * k)).alias("m"), (F.col("p_retailprice") / 1000.0).alias("stokes_i"), (-0.7 + (size - 25) / 100.0).alias("alpha"),
        F.lit(1e9).alias("ref_freq"), (size * 1e-5).alias("emaj"), (size * 5e-6).alias("emin"), (size / 50.0).alias("pa"), (size / 1000.0).alias("c2"),
    )


def sources(spark: SparkSession, d: str) -> DataFrame:
    """A calibration field: one source for each nation."""
    k = F.col("n_nationkey")
    size = 1 + k + F.col("n_regionkey")
    return table(spark, d, "nation").select(
        k.cast("long").alias("source_id"), F.when(k % 2 == 0, F.lit("POINT")).otherwise(F.lit("GAUSSIAN")).alias("type"),
        (0.02 * F.cos(k.cast("double"))).alias("l"), (0.02 * F.sin(1.7 * k)).alias("m"), (0.5 + k / 10.0).alias("stokes_i"), (-0.7 + (size - 25) / 100.0).alias("alpha"),
        F.lit(1e9).alias("ref_freq"), (size * 1e-5).alias("emaj"), (size * 5e-6).alias("emin"), (size / 50.0).alias("pa"), (size / 1000.0).alias("c2"),
    )


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A short observation: one row for each supplier."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        k.alias("row_id"), (600.0 * k).alias("time"), (k % 8).cast("int").alias("antenna1"), (8 + F.col("s_nationkey") % 8).cast("int").alias("antenna2"),
        (b / 20.0 * F.cos(k.cast("double"))).alias("u"), (b / 20.0 * F.sin(k.cast("double"))).alias("v"), (b / 200.0).alias("w"),
    )


def channels(spark: SparkSession, d: str = "") -> DataFrame:
    return spark.range(8).select(F.col("id").cast("int").alias("chan"), (0.856e9 + 0.107e9 * F.col("id")).alias("freq"), F.lit(0.107e9).alias("width"))


def jones(spark: SparkSession, d: str) -> DataFrame:
    """One complex gain for each nation (an antenna), 30 days and 8 channels."""
    ant = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("ant"))
    t = spark.range(30).select(F.col("id").cast("int").alias("time_idx"))
    c = spark.range(8).select(F.col("id").cast("int").alias("chan"))
    g = F.struct((1.0 + 0.1 * F.cos((F.col("time_idx") + F.col("ant")).cast("double"))).alias("re"), (0.1 * F.sin((F.col("time_idx") * F.col("ant")).cast("double"))).alias("im"))
    return ant.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(c)).select("time_idx", "ant", "chan", F.lit(0).alias("dir"), F.array(g).alias("g"))


def model_vis(spark: SparkSession, d: str) -> DataFrame:
    """One complex model visibility for each row and channel, with its row's place."""
    m = main(spark, d).select("row_id", *PLACED, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("chan"))
    g = F.struct((1.0 + 0.01 * (F.col("row_id") % 10)).alias("re"), (0.1 * F.col("chan")).alias("im"))
    return m.select("row_id", *PLACED, "chan", F.lit(0).alias("dir"), F.array(g).alias("vis"))


def data_vis(spark: SparkSession, d: str) -> DataFrame:
    m = main(spark, d).select("row_id", *PLACED, "flag_row", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("chan"))
    g = F.struct((F.col("value") / 100.0).alias("re"), (0.05 * F.col("chan") - 0.1).alias("im"))
    return m.select("row_id", *PLACED, "chan", F.col("flag_row").alias("flag"), F.array(g).alias("vis"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Rows by channels with band, wavelength and one visibility."""
    m = main(spark, d).select("row_id", "u", "v", "w", "value", "flag_row").crossJoin(F.broadcast(channels(spark)))
    return m.select("row_id", "chan", "u", "v", "w", "freq", F.floor(F.col("chan") / 4).cast("int").alias("band"), (F.lit(2.99792458e8) / F.col("freq")).alias("wavelength"), (F.col("value") / 100.0).alias("re"), (0.05 * F.col("chan") - 0.1).alias("im"), F.col("flag_row").alias("flag"))


def plane(spark: SparkSession, d: str) -> DataFrame:
    """(y, x, value): line items summed on a grid of 64 x 64 pixels."""
    i = table(spark, d, "lineitem")
    return i.groupBy((F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") % 64).cast("int").alias("x")).agg((F.sum("l_extendedprice") / 1e4).alias("value"))


SQL = {
    "main": """main AS (SELECT event_id AS row_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS time, CAST(user_id % 8 AS INTEGER) AS antenna1,
        CAST(8 + (user_id // 8) % 8 AS INTEGER) AS antenna2, 6e2 * (1 + event_id % 3) AS span, event_type = 'error' AS flag_row, value * cos(user_id) AS u, value * sin(user_id) AS v,
        1e-1 * value AS w, 1e0 + value / 1e2 AS weight, 1e-1 + (event_id % 10) / 1e1 AS sigma, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 864e2) AS INTEGER) AS time_idx, value FROM events)""",
    "cells": """cells AS (SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label, CAST(c AS INTEGER) AS chan, CAST(p AS INTEGER) AS corr, CAST(embedding[4 * c + 2 * p + 1] AS DOUBLE) AS re,
        CAST(embedding[4 * c + 2 * p + 2] AS DOUBLE) AS im, (vec_id + c) % 7 = 0 AS flag FROM embeddings, range(16) r(c), range(2) q(p))""",
    "sky": """sky AS (SELECT p_partkey AS source_id, CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'LARGE') THEN 'POINT' ELSE 'GAUSSIAN' END AS type, 2e-2 * cos(p_partkey) AS l, 2e-2 * sin(17e-1 * p_partkey) AS m,
        p_retailprice / 1e3 AS stokes_i, -7e-1 + (p_size - 25) / 1e2 AS alpha, 1e9 AS ref_freq, p_size * 1e-5 AS emaj, p_size * 5e-6 AS emin, p_size / 5e1 AS pa, p_size / 1e3 AS c2 FROM part)""",
    "sources": """sources AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, CASE WHEN n_nationkey % 2 = 0 THEN 'POINT' ELSE 'GAUSSIAN' END AS type, 2e-2 * cos(n_nationkey) AS l, 2e-2 * sin(17e-1 * n_nationkey) AS m,
        5e-1 + n_nationkey / 1e1 AS stokes_i, -7e-1 + (n_nationkey + n_regionkey - 24) / 1e2 AS alpha, 1e9 AS ref_freq, (1 + n_nationkey + n_regionkey) * 1e-5 AS emaj, (1 + n_nationkey + n_regionkey) * 5e-6 AS emin,
        (1 + n_nationkey + n_regionkey) / 5e1 AS pa, (1 + n_nationkey + n_regionkey) / 1e3 AS c2 FROM nation)""",
    "snapshot": """snapshot AS (SELECT s_suppkey AS row_id, 6e2 * s_suppkey AS time, CAST(s_suppkey % 8 AS INTEGER) AS antenna1, CAST(8 + s_nationkey % 8 AS INTEGER) AS antenna2,
        s_acctbal / 2e1 * cos(s_suppkey) AS u, s_acctbal / 2e1 * sin(s_suppkey) AS v, s_acctbal / 2e2 AS w FROM supplier)""",
    "channels": "channels AS (SELECT CAST(c AS INTEGER) AS chan, 856e6 + 107e6 * c AS freq, 107e6 AS width FROM range(8) r(c))",
    "jones": """jones AS (SELECT CAST(t AS INTEGER) AS time_idx, CAST(n_nationkey AS INTEGER) AS ant, CAST(c AS INTEGER) AS chan, 1e0 + 1e-1 * cos(t + n_nationkey) AS gr, 1e-1 * sin(t * n_nationkey) AS gi
        FROM nation, range(30) r(t), range(8) q(c))""",
    "model_vis": "model_vis AS (SELECT row_id, CAST(c AS INTEGER) AS chan, 1e0 + 1e-2 * (row_id % 10) AS mr, 1e-1 * c AS mi FROM main, range(8) r(c))",
    "data_vis": "data_vis AS (SELECT row_id, CAST(c AS INTEGER) AS chan, flag_row AS flag, value / 1e2 AS dr, 5e-2 * c - 1e-1 AS di FROM main, range(8) r(c))",
    "samples": "samples AS (SELECT row_id, chan, u, v, w, freq, CAST(chan // 4 AS INTEGER) AS band, 299792458e0 / freq AS wavelength, value / 1e2 AS re, 5e-2 * chan - 1e-1 AS im, flag_row AS flag FROM main, channels)",
    "plane": "plane AS (SELECT CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey % 64 AS INTEGER) AS x, sum(l_extendedprice) / 1e4 AS value FROM lineitem GROUP BY ALL)",
}
_ORDER = ["main", "cells", "sky", "sources", "snapshot", "channels", "jones", "model_vis", "data_vis", "samples", "plane"]


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views (and those they read)."""
    need = set(names.split())
    if need & {"model_vis", "data_vis", "samples"}:
        need.add("main")
    if "samples" in need:
        need.add("channels")
    views = ",\n".join(SQL[n] for n in _ORDER if n in need)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{body if body.lstrip().startswith(',') else chr(10) + body}"
