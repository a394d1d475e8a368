"""The driver's tables as a property graph, and one query for each operator with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .session import Engine


def graph(spark: SparkSession, d: str) -> Graph:
    """Keys of every table are longs; lineitem gives two kinds of parallel edges; TRADES is a small dense digraph."""
    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    key = lambda df, name: df.withColumn(name, F.col(name).cast("long"))
    region, nation, customer, supplier = key(t("region"), "r_regionkey"), key(t("nation"), "n_nationkey"), t("customer"), t("supplier")
    part, orders, lineitem, events = t("part"), t("orders"), t("lineitem"), t("events")
    turns = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_key"), "conv_id", F.col("turn").alias("turn_no"), "role", F.length("text").cast("long").alias("text_len"))
    line = lineitem.withColumn("line_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    c, s = customer.select("c_custkey", F.col("c_nationkey").alias("cn")), supplier.select("s_suppkey", F.col("s_nationkey").alias("sn"))
    trades = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    trades = trades.groupBy(F.col("cn").cast("long").alias("cn"), F.col("sn").cast("long").alias("sn")).agg(F.count(F.lit(1)).alias("trade_count"), F.round(F.sum("l_extendedprice"), 0).cast("long").alias("weight"))
    g = Graph()
    for label, df, k in (("Region", region, "r_regionkey"), ("Nation", nation, "n_nationkey"), ("Customer", customer, "c_custkey"), ("Supplier", supplier, "s_suppkey"), ("Part", part, "p_partkey"), ("Order", orders, "o_orderkey"), ("User", events.select("user_id").where("user_id IS NOT NULL").distinct(), "user_id"), ("Event", events, "event_id"), ("Doc", t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"), ("Vec", t("embeddings"), "vec_id"), ("Turn", turns, "turn_key")):
        g = g.with_vertices(label, df, k)
    g = g.with_edges("NATION_IN", nation.select("n_nationkey", F.col("n_regionkey").cast("long").alias("n_regionkey")), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), [], "n_nationkey")
    g = g.with_edges("LIVES_IN", customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), [], "c_custkey")
    g = g.with_edges("BASED_IN", supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), [], "s_suppkey")
    g = g.with_edges("PLACED", orders, ("Customer", "o_custkey"), ("Order", "o_orderkey"), [], "o_orderkey")
    g = g.with_edges("CONTAINS", line, ("Order", "l_orderkey"), ("Part", "l_partkey"), [x for x in lineitem.columns], "line_id")
    g = g.with_edges("SUPPLIED_BY", line, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), [x for x in lineitem.columns], "line_id")
    g = g.with_edges("DID", events, ("User", "user_id"), ("Event", "event_id"), [], "event_id")
    after = turns.select((F.col("turn_key") + 1).alias("nxt"), F.col("turn_key").alias("prev")).join(turns.select(F.col("turn_key").alias("k")), F.col("nxt") == F.col("k")).drop("k")
    g = g.with_edges("NEXT", after, ("Turn", "prev"), ("Turn", "nxt"), [], "prev")
    g = g.with_edges("TRADES", trades, ("Nation", "cn"), ("Nation", "sn"), ["trade_count", "weight"])
    return g.with_edges("NEAR", nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")), ("Nation", "a"), ("Nation", "b"), ["a", "b"], "a", directed=False)


_graphs: dict[tuple, Graph] = {}


def engine(spark: SparkSession, d: str) -> Engine:
    """An engine of its own over the directory's graph, whose plans are made once for a session."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), d)
    if key not in _graphs:
        _graphs[key] = graph(spark, d)
    e = Engine(spark, _graphs[key])
    e.execute("CREATE VECTOR INDEX vec_l2 FOR (v:Vec) ON (v.embedding) OPTIONS {dims: 64, metric: 'l2'}")
    e.execute("CREATE VECTOR INDEX vec_cos FOR (v:Vec) ON (v.embedding) OPTIONS {dims: 64, metric: 'cosine'}")
    return e


from .tpch_queries import QUERIES  # noqa: E402


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def one(run):
        if callable(run):
            return lambda spark, d: run(engine(spark, d))
        return lambda spark, d: engine(spark, d).gql(run)

    return {name: one(q[0]) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in QUERIES.items() if q[1]}
