"""Rectangle tables derived from the star-schema tables, in DataFrames and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES, scaled
from tessella.operators.ranks import global_row_number


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by ship day; many small rectangles."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    rows = global_row_number(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*order), order, "no")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    price = F.round("l_extendedprice")
    return rows.select((F.col("no") + 1).alias("id"), price.cast("int").alias("xmin"), day.cast("int").alias("ymin"), (price + F.col("l_quantity")).cast("int").alias("xmax"), (day + F.col("l_linenumber")).cast("int").alias("ymax"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of the month by value, as wide and high as the user's number."""
    s = F.dayofmonth("ts") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    value = F.round(F.col("value") * 100)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select((F.col("event_id") + 1).alias("id"), s.cast("int").alias("xmin"), value.cast("int").alias("ymin"), (s + F.col("user_id")).cast("int").alias("xmax"), (value + F.col("user_id")).cast("int").alias("ymax"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four components, scaled to integers; corners in any order."""
    a, b, c, d = (scaled(F.col("embedding")[i].cast("double"), 1e8) for i in (0, 2, 1, 3))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select((F.col("vec_id") + 1).alias("id"), F.least(a, b).alias("xmin"), F.least(c, d).alias("ymin"), F.greatest(a, b).alias("xmax"), F.greatest(c, d).alias("ymax"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by prices, with many ties and touching edges."""
    price = F.floor("p_retailprice").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select((F.col("p_partkey") + 1).alias("id"), F.col("p_size").cast("int").alias("xmin"), price.alias("ymin"), (F.col("p_size") + 1).cast("int").alias("xmax"), (price + 2).alias("ymax"))


def moved(queries: DataFrame, dx: int, dy: int) -> DataFrame:
    return queries.select("qid", *[(F.col(s) + (dx if s[0] == "x" else dy)).cast("int").alias(s) for s in SIDES])


def widened(queries: DataFrame, by: int) -> DataFrame:
    return queries.select("qid", *[(F.col(s) + (by if s.endswith("max") else -by)).cast("int").alias(s) for s in SIDES])


SQL = {
    "lineitem": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS id,
  CAST(round(l_extendedprice) AS INT) AS xmin, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS ymin,
  CAST(round(l_extendedprice) + l_quantity AS INT) AS xmax, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS INT) AS ymax FROM lineitem""",
    "events": """SELECT event_id + 1 AS id, CAST(s AS INT) AS xmin, CAST(round(value * 100) AS INT) AS ymin, CAST(s + user_id AS INT) AS xmax, CAST(round(value * 100) + user_id AS INT) AS ymax
  FROM (SELECT *, extract(day FROM ts) * 86400 + extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 AS s FROM events)""",
    "embeddings": """SELECT vec_id + 1 AS id, least(a, b) AS xmin, least(c, d) AS ymin, greatest(a, b) AS xmax, greatest(c, d) AS ymax FROM (SELECT vec_id,
  CAST(round(CAST(embedding[1] AS DOUBLE) * 1e8) AS INT) AS a, CAST(round(CAST(embedding[3] AS DOUBLE) * 1e8) AS INT) AS b,
  CAST(round(CAST(embedding[2] AS DOUBLE) * 1e8) AS INT) AS c, CAST(round(CAST(embedding[4] AS DOUBLE) * 1e8) AS INT) AS d FROM embeddings)""",
    "part": """SELECT p_partkey + 1 AS id, CAST(p_size AS INT) AS xmin, CAST(floor(p_retailprice) AS INT) AS ymin, CAST(p_size + 1 AS INT) AS xmax, CAST(floor(p_retailprice) + 2 AS INT) AS ymax FROM part""",
}
