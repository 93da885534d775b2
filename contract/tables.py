"""Cohort views of the driver tables.

clinical: one row per customer. features: quantity bought per brand (dense) and per
brand and type (sparse), zero where nothing was bought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.operators.prep import Cohort, melt_features, null_to_zero
from twinloom.staging import tasks

# Rows of lineitem that meet in one task.
LINES = 1 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clinical(spark: SparkSession, sf: str) -> DataFrame:
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    return customer.join(spend, "id", "left")


def label(kind: str):
    return F.col("p_brand") if kind == "dense" else F.concat_ws("/", "p_brand", "p_type")


def wide(spark: SparkSession, sf: str, kind: str = "dense") -> DataFrame:
    """One row per customer, one column per feature: the layout measurement tables come in.

    Null where nothing was bought; filled after melting, on one column instead of all.
    """
    part = table(spark, sf, "part").select("p_partkey", label(kind).alias("feature"))
    names = sorted(r[0] for r in part.select("feature").distinct().collect())
    lines = table(spark, sf, "lineitem")
    # partitions of about as many rows each, however many there are: a task holds a group for each id and feature
    parts = max(tasks(spark), -(-lines.count() // LINES))
    bought = (
        lines.repartition(parts, "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .repartition(parts, "l_orderkey")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("id"), "feature", "l_quantity")
        .repartition(parts, "id")
        .groupBy("id")
        .pivot("feature", names)
        .agg(F.sum("l_quantity"))
    )
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return customer.join(bought, "id", "left")


def cells(spark: SparkSession, sf: str, kind: str = "dense") -> DataFrame:
    if kind == "both":
        return cells(spark, sf, "dense").unionByName(cells(spark, sf, "sparse"))
    return null_to_zero(melt_features(wide(spark, sf, kind)))


def cohort(spark: SparkSession, sf: str, kind: str = "dense") -> Cohort:
    return Cohort(clinical(spark, sf), cells(spark, sf, kind))


# ---- the same views as SQL -----------------------------------------------------------

CLINICAL_SQL = """
clinical as (
  select c.c_custkey as id, c.c_mktsegment as segment, c.c_nationkey as nation,
         c.c_acctbal as balance, o.low, o.high
  from customer c left join (
    select o_custkey, min(o_totalprice) as low, max(o_totalprice) as high
    from orders group by o_custkey) o on o.o_custkey = c.c_custkey)"""


def _cells_sql(name: str, expression: str) -> str:
    return f"""
{name} as (
  with bought as (
    select o_custkey as id, {expression} as feature, sum(l_quantity) as quantity
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
    group by 1, 2),
  labels_ as (select distinct {expression} as feature from part)
  select c_custkey as id, l.feature, coalesce(b.quantity, 0)::double as value
  from customer cross join labels_ l
  left join bought b on b.id = c_custkey and b.feature = l.feature)"""


DENSE_SQL = _cells_sql("cells", "p_brand")
SPARSE_SQL = _cells_sql("cells", "p_brand || '/' || p_type")
BOTH_SQL = (
    _cells_sql("dense_cells", "p_brand")
    + ","
    + _cells_sql("sparse_cells", "p_brand || '/' || p_type")
    + ",\ncells as (select * from dense_cells union all select * from sparse_cells)"
)
