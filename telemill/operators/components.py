"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.plans.lineage import drop_written, release, written

#: A node with more than HUB rows is a hub, and there are at most HUBS of them: with more edges, hubs need more rows.
HUB, HUBS = 100_000, 20_000


def with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """pairs (u, v) with m, the least v of each u. rows: how many pairs there are at most.

    The least ones of hubs are broadcast, and their rows spread over all tasks: a node may have any share of the pairs.
    Where there are so few pairs that no node can be a hub, all least ones are broadcast.
    """
    if rows <= HUB:
        return pairs.join(F.broadcast(pairs.groupBy("u").agg(F.min("v").alias("m"))), "u")
    share = max(HUB, -(-rows // HUBS))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = least.where(F.col("n") > share).select("u", F.col("m").alias("hub"))
    # -1, but not as a literal: Spark would take that out of the keys of the join, and not spread by salt
    rest = least.where(F.col("n") <= share).select("u", F.least(F.lit(-1).cast("long"), "n").alias("salt"), "m")
    salt = F.when(F.col("hub").isNull(), -1).otherwise(F.pmod(F.hash("v"), F.lit(1 << 20))).cast("long")
    spread = pairs.join(F.broadcast(hubs), "u", "left").withColumn("salt", salt)
    return spread.join(rest.hint("merge"), ["u", "salt"], "left").select("u", "v", F.coalesce("hub", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with an edge to another, the least node of its component.

    In turn, every node hands its larger neighbours to the least one, and all its smaller ones to the least; that ends
    in one star for each component after about log(n) rounds. Minima are combined before the shuffle, and the edges of
    nodes with very many of them are spread, see with_least(). Each round's edges are written, which cuts the lineage.
    Edges with a null end, and of a node to itself, are left out; repeated ones count once. No edges take no round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    now = written(e, "edges")
    rows, state = now.count(), None
    while rows:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * rows).withColumn("m", F.least("u", "m")).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large, 2 * rows).select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u > v").distinct()
        new = written(small, "edges")
        drop_written(now)
        release(edges.sparkSession)
        now = new
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        rows, state = after[0], after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(classes: DataFrame, links: DataFrame) -> DataFrame | None:
    """classes (doc, c: the least doc of its class) after more links (a, b); None where these join no two classes.

    A doc that classes lack is a class by itself. Only links between classes are followed, so that this costs what the
    links change and not what was found before.
    """
    ends = [classes.select(F.col("doc").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
    across = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    across = written(across.distinct(), "across")
    if across.isEmpty():
        return None
    found = written(connected_components(across), "merged")
    drop_written(across)
    moved = classes.join(found.withColumnRenamed("node", "c"), "c", "left").select("doc", F.coalesce("component", "c").alias("c"))
    return moved.union(found.join(classes.select(F.col("doc").alias("node")), "node", "left_anti").select("node", "component"))
