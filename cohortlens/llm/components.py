"""Connected components of an edge table: distributed union-find by contraction.

Each round renames every node by a bijective bit mix, hooks it to the smallest name in its
closed neighbourhood and on to that node's hook, and rewrites the edges between the hooks;
edges inside a class vanish.
Every step is a grouped minimum (map-side combined, so a node with any number of links
sends one row per task) or an equi-join that AQE may split; no class is ever gathered.
The mix makes each round's order independent of the ids, so long chains shrink by a
constant share per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialize


def _mix(c: Column, salt: int) -> Column:
    """A bijection on 64-bit integers: xor-shifts around a round constant."""
    x = c.bitwiseXOR(F.lit(0x5DEECE66D1234567 ^ (salt * 0x9E3779B97F4A7C1) & (2**62 - 1)))
    x = x.bitwiseXOR(F.shiftleft(x, 21))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 35))
    return x.bitwiseXOR(F.shiftleft(x, 4))


def components(edges: DataFrame) -> DataFrame:
    """``edges(src long, dst long)`` to ``(node, component)``: the smallest node reachable.

    Null ends and self-loops are ignored, repeated edges count once; nodes without an edge
    to another node are not listed. Rounds run until no edge is left (no cap).
    """
    e = materialize(edges.where("src <> dst")
                    .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
                    .distinct(), "edges")
    hooks, salt = [], 0
    while not e.isEmpty():
        both = (e.select(F.col("src").alias("node"), F.col("dst").alias("other"))
                 .union(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))))
        near = (both.groupBy("node").agg(F.min(_mix(F.col("other"), salt)).alias("m"))
                .select("node", _mix(F.col("node"), salt).alias("name"), "m")
                .select("node", "name", F.least("m", "name").alias("hook")))
        next_ = near.select(F.col("name").alias("hook"), F.col("hook").alias("hook2"))
        hook = materialize(near.join(next_, "hook").select("node", F.col("hook2").alias("hook")), "hooks")
        a = hook.select(F.col("node").alias("src"), F.col("hook").alias("a"))
        b = hook.select(F.col("node").alias("dst"), F.col("hook").alias("b"))
        e = materialize(e.join(a, "src").join(b, "dst").where("a <> b")
                         .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
                         .distinct(), "edges")
        hooks.append(hook)
        salt += 1
    if not hooks:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    names = hooks[0]
    for nxt in hooks[1:]:
        step = nxt.select(F.col("node").alias("hook"), F.col("hook").alias("next"))
        names = names.join(step, "hook", "left").select("node", F.coalesce("next", "hook").alias("hook"))
    smallest = names.groupBy("hook").agg(F.min("node").alias("component"))
    return names.join(smallest, "hook").select("node", "component")


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` components (as ``components`` returns them) after further ``links(src, dst)``: only
    the classes that the links touch are united, the rest is carried over."""
    own = known.select(F.col("node").alias("src"), F.col("component").alias("a"))
    other = known.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = links.join(own, "src", "left").join(other, "dst", "left").select(
        F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    united = components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    ends = links.select(F.col("src").alias("node"), F.col("src").alias("component")).union(
        links.select(F.col("dst").alias("node"), F.col("dst").alias("component")))
    every = known.union(ends).groupBy("node").agg(F.min("component").alias("component"))
    return every.join(united, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
