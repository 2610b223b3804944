"""Graphs derived from the order and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgas.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_succession(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers, with an edge from each order's customer to that of the next order.

    Edge data: ``w``, a whole weight from the order's price, and ``eid``, its key.
    """
    orders = table(spark, sf_dir, "orders")
    this = orders.select(
        (F.col("o_orderkey") + 1).alias("next"),
        F.col("o_custkey").alias("src"),
        (F.floor(F.col("o_totalprice") / 10000) + 1).cast("double").alias("w"),
        F.col("o_orderkey").alias("eid"),
    )
    following = orders.select(F.col("o_orderkey").alias("next"), F.col("o_custkey").alias("dst"))
    edges = this.join(following, "next").select("src", "dst", "w", "eid")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")
    )
    return PropertyGraph(customers, edges, complete=True)


def turn_chains(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Conversation turns, with an edge from each turn to the next one.  Ids hold conversations of up to a million turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    turn_id = F.col("conv_id") * 1_000_000 + F.col("turn")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), turn_id.alias("dst"))
    edges = turns.select("conv_id", "turn", turn_id.alias("src")).join(after, ["conv_id", "turn"])
    return PropertyGraph(turns.select(turn_id.alias("id")), edges.select("src", "dst"), complete=True)
