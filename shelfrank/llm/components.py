"""Connected components by alternating stars: every round hangs each node's neighbours on the least
of them, first the larger ones, then the smaller ones, until only stars are left. A node's edges are
dealt into SALTS parts by their other end and meet its least neighbour there, which is copied to the
parts that exist, so that the edges of a node with very many neighbours are spread over tasks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.scratch import Scratch

SALTS = 64  # parts of a node's edges


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the least v of their u. Only one row a part meets at u itself."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.union(edges.select("v", "u")))
    return both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger to the smaller node, as _large_star leaves them."""
    met = _with_least(edges)
    moved = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(met.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and check sum of the edges."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(mixed, 32))).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """For each node of ``edges`` (u, v) its component's least node: node, root. Loops and repeated
    edges do no harm; a node whose only edge is a loop is left out, as are nodes without edges."""
    ordered = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, place = scratch.keep(ordered.distinct(), f"{name}0"), 0
    before = None
    while before != (state := _state(now)):
        before, place = state, place + 1
        large = scratch.keep(_large_star(now), f"{name}{place}large")
        now = scratch.keep(_small_star(large), f"{name}{place}")
        scratch.drop(f"{name}{place - 1}", f"{name}{place}large")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
