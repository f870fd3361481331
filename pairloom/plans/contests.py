"""The contest view over order lines: lines 1 and 2 of an order meet, suppliers are the sides, the greater quantity wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators import prior, sides


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contest_id, date, day, a_id, b_id, scores, y (1, 0, 0.5; null: no contest), outcome, method, weight, probabilities and prices."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    keep = ["l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *keep, F.row_number().over(order).alias("n")).filter("n <= 2")
    side = lambda n: F.max(F.when(F.col("n") == n, F.struct(*keep)))
    pair = lines.groupBy("l_orderkey").agg(side(1).alias("a"), side(2).alias("b")).filter("b IS NOT NULL AND a.l_suppkey <> b.l_suppkey")
    j = pair.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    void = F.col("l_orderkey") % 97 == 0
    a, b = F.col("a.l_quantity"), F.col("b.l_quantity")
    p_close, p_open = 0.5 + 4 * (F.col("b.l_tax") - F.col("a.l_tax")), 0.5 + 3 * (F.col("a.l_discount") - F.col("b.l_discount"))
    date = F.to_date("o_orderdate")
    return j.select(
        F.col("l_orderkey").alias("contest_id"), date.alias("date"), prior.day(date).alias("day"), F.col("a.l_suppkey").alias("a_id"), F.col("b.l_suppkey").alias("b_id"),
        a.alias("a_score"), b.alias("b_score"), F.when(void, None).when(a > b, 1.0).when(a < b, 0.0).otherwise(0.5).alias("y"),
        F.when(void, "NC").when(a > b, "W/L").when(a < b, "L/W").otherwise("D/D").alias("outcome"), F.col("a.l_returnflag").alias("method"),
        (F.col("a.l_partkey") % 4).alias("class"), F.col("a.l_extendedprice").alias("a_price"), F.col("b.l_extendedprice").alias("b_price"),
        p_open.alias("p_open"), p_close.alias("p_close"), (1 / (p_open * 1.045)).alias("a_dec"), (1 / ((1 - p_open) * 1.045)).alias("b_dec"),
        (1 / (p_close * 1.035)).alias("a_close"), (1 / ((1 - p_close) * 1.035)).alias("b_close"),
    )


CONTESTS = """
ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS n FROM lineitem),
contests AS (SELECT a.l_orderkey AS contest_id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, a.l_suppkey AS a_id, b.l_suppkey AS b_id,
  a.l_quantity AS a_score, b.l_quantity AS b_score,
  CASE WHEN a.l_orderkey % 97 = 0 THEN NULL WHEN a.l_quantity > b.l_quantity THEN 1.0::DOUBLE WHEN a.l_quantity < b.l_quantity THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS y,
  CASE WHEN a.l_orderkey % 97 = 0 THEN 'NC' WHEN a.l_quantity > b.l_quantity THEN 'W/L' WHEN a.l_quantity < b.l_quantity THEN 'L/W' ELSE 'D/D' END AS outcome,
  a.l_returnflag AS method, a.l_partkey % 4 AS class, a.l_extendedprice AS a_price, b.l_extendedprice AS b_price,
  0.5::DOUBLE + 3 * (a.l_discount - b.l_discount) AS p_open, 0.5::DOUBLE + 4 * (b.l_tax - a.l_tax) AS p_close,
  1 / ((0.5::DOUBLE + 3 * (a.l_discount - b.l_discount)) * 1.045::DOUBLE) AS a_dec, 1 / ((1 - (0.5::DOUBLE + 3 * (a.l_discount - b.l_discount))) * 1.045::DOUBLE) AS b_dec,
  1 / ((0.5::DOUBLE + 4 * (b.l_tax - a.l_tax)) * 1.035::DOUBLE) AS a_close, 1 / ((1 - (0.5::DOUBLE + 4 * (b.l_tax - a.l_tax))) * 1.035::DOUBLE) AS b_close
  FROM ln a JOIN ln b ON a.l_orderkey = b.l_orderkey AND a.n = 1 AND b.n = 2 JOIN orders ON o_orderkey = a.l_orderkey WHERE a.l_suppkey <> b.l_suppkey),
sides AS (SELECT contest_id, date, day, class, method, 'a' AS side, a_id AS id, b_id AS opp, y AS res, a_score AS score, b_score AS opp_score, a_price AS price FROM contests
  UNION ALL SELECT contest_id, date, day, class, method, 'b', b_id, a_id, 1 - y, b_score, a_score, b_price FROM contests)"""


def participants(c: DataFrame) -> DataFrame:
    """contest_id, date, day, class, method, side, id, opp, res (own view), score, opp_score, price."""
    two = c.select("*", (1 - F.col("y")).alias("y_b"))
    return sides.unfold(two, ["contest_id", "date", "day", "class", "method"], {"id": ("a_id", "b_id"), "opp": ("b_id", "a_id"), "res": ("y", "y_b"), "score": ("a_score", "b_score"), "opp_score": ("b_score", "a_score"), "price": ("a_price", "b_price")})
