"""Reports over the star schema: date filters, joins, grouped sums, top rows.

Plain joins leave the strategy to the optimizer: dimension tables below the
broadcast threshold are broadcast, others are shuffled, adaptively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.dates import date_after, date_prefix, day, month


def q1(lineitem: DataFrame, date: str) -> DataFrame:
    """count of line items shipped on the date."""
    return lineitem.where(date_prefix("l_shipdate", date)).agg(F.count("*").alias("count"))


def q2(lineitem: DataFrame, orders: DataFrame, date: str, payload: str = "o_orderpriority", limit: int | None = 20) -> DataFrame:
    """payload, orderkey of orders with a line item shipped on the date, by key."""
    shipped = lineitem.where(date_prefix("l_shipdate", date)).select(F.col("l_orderkey").alias("o_orderkey"))
    out = orders.join(shipped, "o_orderkey", "left_semi").select(F.col(payload).alias("payload"), F.col("o_orderkey").alias("orderkey"))
    out = out.orderBy("orderkey", "payload")
    return out if limit is None else out.limit(limit)


def q3(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, date: str, limit: int | None = 20) -> DataFrame:
    """orderkey, p_name, s_name of line items shipped on the date; items without part or supplier are dropped."""
    items = lineitem.where(date_prefix("l_shipdate", date)).select("l_orderkey", "l_partkey", "l_suppkey")
    out = (
        items.join(part.select("p_partkey", "p_name"), items.l_partkey == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_name"), items.l_suppkey == F.col("s_suppkey"))
        .select(F.col("l_orderkey").alias("orderkey"), "p_name", "s_name")
        .orderBy("orderkey", "p_name", "s_name")
    )
    return out if limit is None else out.limit(limit)


def _shipped_to(items: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, *columns: str) -> DataFrame:
    """Line items with the nation of their customer; unknown nations have the name ''."""
    return (
        items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_nationkey").alias("n_nationkey"), F.coalesce("n_name", F.lit("")).alias("n_name"), *columns)
    )


def q4(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, date: str) -> DataFrame:
    """n_nationkey, n_name, count of line items shipped on the date, by nation."""
    items = lineitem.where(date_prefix("l_shipdate", date)).select("l_orderkey")
    return _shipped_to(items, orders, customer, nation).groupBy("n_nationkey", "n_name").count().orderBy("n_nationkey")


def q5(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, names: list[str]) -> DataFrame:
    """n_name, month, count of line items for the named nations."""
    some = nation.where(F.col("n_name").isin(names))
    ours = customer.join(F.broadcast(some.select("n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    items = lineitem.select("l_orderkey", month("l_shipdate").alias("month"))
    return _shipped_to(items, orders, ours, some, "month").groupBy("n_name", "month").count().orderBy("n_name", "month")


def disc_price():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def q6(lineitem: DataFrame, date: str) -> DataFrame:
    """Pricing summary of the line items shipped on the date, by return flag and status."""
    return (
        lineitem.where(date_prefix("l_shipdate", date))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base_price"),
            F.sum(disc_price()).alias("sum_disc_price"),
            F.sum(disc_price() * (1 + F.col("l_tax"))).alias("sum_charge"),
            F.avg("l_quantity").alias("avg_qty"),
            F.avg("l_extendedprice").alias("avg_price"),
            F.avg("l_discount").alias("avg_disc"),
            F.count("*").alias("count"),
        )
    )


def q7(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, date: str, payload: str = "o_orderpriority", order_side: str = "after", limit: int = 10
) -> DataFrame:
    """c_name, orderkey, revenue, o_orderdate, payload: the orders with most revenue not shipped by the date.

    Orders are those placed after the date, or before it with order_side 'before'.
    """
    placed = date_after("o_orderdate", date) if order_side == "after" else ~date_after("o_orderdate", date) & ~date_prefix("o_orderdate", date)
    items = lineitem.where(date_after("l_shipdate", date)).groupBy("l_orderkey").agg(F.sum(disc_price()).alias("revenue"))
    some = orders.where(placed).select("o_orderkey", "o_custkey", day("o_orderdate").alias("o_orderdate"), F.col(payload).alias("payload"))
    return (
        items.join(some, items.l_orderkey == some.o_orderkey)
        .join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .select("c_name", F.col("o_orderkey").alias("orderkey"), "revenue", "o_orderdate", "payload")
        .orderBy(F.desc("revenue"), "orderkey")
        .limit(limit)
    )
