"""Graph analytics over nodes (id, label) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.components import connected_components
from telemill.plans.lineage import written


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other, weight: every edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))).alias("e")).select("e.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree (adjacency entries, parallel edges counting each), distinct_degree, weighted; 0 for lone nodes."""
    d = adjacency(edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("distinct_degree"), F.sum("weight").alias("weighted"))
    zero = F.lit(0).cast("long")
    return nodes.join(d, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("degree", "distinct_degree", "weighted")})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id of what edges join; lone nodes are their own."""
    c = connected_components(edges.where("src <> dst"), "src", "dst")
    return nodes.select("id").join(c.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def topology(nodes: DataFrame, edges: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """The top nodes by degree (label breaking ties), and the sizes of components, largest first."""
    best = degrees(nodes, edges).orderBy(F.desc("degree"), "label", "id").limit(top)
    return best, component_sizes(nodes, edges).orderBy(F.desc("size"), "component")


def node_label(kind: str = "kind") -> Column:
    """Process: comm or name and pid; app: name or id; socket: proto and foreign address; file: its last part; domain: its name."""
    k = F.col(kind)
    pid = F.concat(F.lit("pid "), F.col("pid").cast("string"))
    who = F.coalesce("comm", "name")
    process = F.when(who.isNotNull(), F.concat(who, F.lit(" ("), pid, F.lit(")"))).otherwise(pid)
    return F.when(k == "process", process).when(k == "app", F.coalesce("name", "id")).when(k == "socket", F.concat_ws(" ", "proto", "foreign_addr")).when(k == "file", F.substring_index("id", "/", -1)).otherwise(F.coalesce("name", "id"))


def snapshot_diff(prev_nodes: DataFrame, prev_edges: DataFrame, nodes: DataFrame, edges: DataFrame, spike: int = 5) -> DataFrame:
    """metric, entity, observed, baseline between two snapshots of a graph:

    new_component: components of two or more, none of whose nodes were there before, named by their node of most degree;
    component_merge: earlier components of two or more whose nodes are now in several (a split, in spite of its name);
    degree_spike: nodes whose degree grew by `spike` or more.
    """
    now, before = written(components(nodes, edges), "now"), written(components(prev_nodes, prev_edges), "before")
    deg, old = degrees(nodes, edges), degrees(prev_nodes, prev_edges)
    seen = prev_nodes.select("id", F.lit(1).alias("old"))
    fresh = now.join(seen, "id", "left").join(deg.select("id", "label", "degree"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count("old").alias("k"), F.max(F.struct("degree", "label")).alias("top")).where("n >= 2 and k = 0")
    one = fresh.select(F.lit("new_component").alias("metric"), F.col("top.label").alias("entity"), F.col("n").alias("observed"), F.lit(0).cast("long").alias("baseline"))
    big = before.join(before.groupBy("component").count().where("count >= 2").select("component"), "component")
    parts = big.select("id", F.col("component").alias("was")).join(now, "id").groupBy("was").agg(F.count_distinct("component").alias("n")).where("n > 1")
    two = parts.select(F.lit("component_merge").alias("metric"), F.col("was").cast("string").alias("entity"), F.col("n").alias("observed"), F.lit(1).cast("long").alias("baseline"))
    d = deg.select("id", "label", "degree").join(old.select("id", F.col("degree").alias("before")), "id", "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
    three = d.where(F.col("degree") - F.col("before") >= spike).select(F.lit("degree_spike").alias("metric"), F.col("label").alias("entity"), F.col("degree").alias("observed"), F.col("before").alias("baseline"))
    return one.union(two).union(three)
