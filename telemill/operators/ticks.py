"""Gap ticks: numbering bursts of observations by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.scalars import past

GAP = 250_000_000
#: Observations (by obs_seq) that one task numbers.
BLOCK = 1_000_000


def neighbours(rows: DataFrame, columns: list[str], order: str | list[str] = "seq", by: list[str] = (), following: bool = False, block: str | None = None) -> DataFrame:
    """rows with the values of columns in the row before (previous_*) or after (next_*) in an order.

    Blocks of the order (block: an expression that grows with it, by default its first column by BLOCK) are sorted apart;
    at their borders the last or first row of the nearest block is joined in, one row a block, so that no task holds them
    all. A row without neighbour has null there.
    """
    order = [order] if isinstance(order, str) else order
    prefix, ahead = ("next_", F.lead) if following else ("previous_", F.lag)
    by = list(by)
    r = rows.withColumn("__b", F.expr(block or f"{order[0]} div {BLOCK}"))
    values, at = F.struct(*columns), F.struct(*order)
    r = r.withColumn("__near", ahead(values).over(Window.partitionBy(*by, "__b").orderBy(*order)))
    edge = r.groupBy(*by, "__b").agg((F.min_by if following else F.max_by)(values, at).alias("__edge"))
    edge = edge.withColumn("__far", ahead("__edge").over(Window.partitionBy(*by).orderBy("__b"))).drop("__edge")  # a row a block
    r = r.join(edge, [*by, "__b"]) if not by else _joined(r, edge, by)
    near = F.coalesce("__near", "__far")
    return r.withColumns({prefix + c: near[c] for c in columns}).drop("__b", "__near", "__far")


def _joined(rows: DataFrame, edge: DataFrame, by: list[str]) -> DataFrame:
    """The join by block, nulls in by being a group as well."""
    e = edge.select(*[F.col(c).alias(f"__e_{c}") for c in by], F.col("__b").alias("__e_b"), "__far")
    on = F.col("__b").eqNullSafe(F.col("__e_b"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    return rows.join(e, on, "left").drop("__e_b", *[f"__e_{c}" for c in by])


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, block: str | None = None) -> DataFrame:
    """rows with name: the greatest value (nulls left out) of a group's rows up to and with this one in an order.

    By blocks of the order, as neighbours(): a group of any size is spread over tasks, and what the blocks before hold is
    joined in, one row a block.
    """
    r = rows.withColumns({"__b": F.expr(block or f"{order[0]} div {BLOCK}"), "__v": value})
    r = r.withColumn("__in", F.max("__v").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    b = r.groupBy(*by, "__b").agg(F.max("__v").alias("__m"))
    b = b.withColumn("__past", F.max("__m").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__m")  # a row a block
    return r.join(b, [*by, "__b"]).withColumn(name, F.greatest("__in", "__past")).drop("__b", "__v", "__in", "__past")


def with_ticks(obs: DataFrame, gap_ns: int = GAP, block: int = BLOCK) -> DataFrame:
    """obs (source, obs_seq, t) with tick: from 0 by source, a new one when t is more than gap_ns past the last t.

    Blocks of obs_seq are numbered apart; their numbers of breaks, summed up over the blocks before, are joined back,
    so that no task holds a whole source. Times going back never begin a tick.
    """
    o = obs.withColumn("__b", F.expr(f"obs_seq div {block}"))
    w = Window.partitionBy("source", "__b").orderBy("obs_seq")
    o = o.withColumn("__new", F.coalesce(past("t", F.lag("t").over(w)) > gap_ns, F.lit(False)).cast("long"))
    o = o.withColumn("__run", F.sum("__new").over(w))
    s = o.groupBy("source", "__b").agg(F.min_by("t", "obs_seq").alias("first"), F.max_by("t", "obs_seq").alias("last"), F.sum("__new").alias("n"))
    v = Window.partitionBy("source").orderBy("__b")
    jump = F.coalesce(past("first", F.lag("last").over(v)) > gap_ns, F.lit(False)).cast("long")
    s = s.withColumn("jump", jump).withColumn("__before", F.sum(F.col("n") + F.col("jump")).over(v) - F.col("n")).select("source", "__b", "__before")
    return o.join(s, ["source", "__b"]).withColumn("tick", F.col("__before") + F.col("__run")).drop("__b", "__new", "__run", "__before")


def tick_table(ticked: DataFrame) -> DataFrame:
    """source, tick, n, first_t, last_t, first_seq and the next ticks' first_seq (seq1, seq2) and last_t (last1)."""
    t = ticked.groupBy("source", "tick").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max_by("t", "obs_seq").alias("last_t"), F.min("obs_seq").alias("first_seq"))
    w = Window.partitionBy("source").orderBy("tick")
    return t.withColumns({"seq1": F.lead("first_seq", 1).over(w), "seq2": F.lead("first_seq", 2).over(w), "last1": F.lead("last_t", 1).over(w), "last_tick": F.max("tick").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
