"""Connected components of a link table, by alternating large and small stars.

Each round is two map-side combined ``min`` aggregates and joins that AQE can
split, so neither a hub of a billion links nor a whole component is ever held
in one task.  Rounds are tables in the shared folder; nothing but a count and
a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import drop, stored


#: Links that one task holds; a bound, not a cap: more of them are shuffled.
FEW = 100_000


def _star(links: DataFrame, n: int, small: bool) -> DataFrame:
    """Connect each node's neighbours (larger ones, or smaller ones and itself)
    to the smallest neighbour, as a written table.

    The smallest neighbours are written before they are joined: a hub's links
    then meet one row over two plain exchanges, which AQE can split.  Up to
    :data:`FEW` links are one partition and need no exchange; the result is the
    same.
    """
    few = n <= FEW
    pairs = links if small else links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.coalesce(1) if few else pairs
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    least = least if few else stored(least, "least")
    joined = pairs.join(least, "a")
    if small:  # a > b holds in every link
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.where("a <> m").select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored((out.coalesce(1) if few else out).distinct(), "links")
    if not few:
        drop(least)
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of a link, as a written table (see
    ``drop``); component is the smallest node reachable.  Self-links, repeated links and either direction are fine;
    links with a null end are ignored; no links give an empty table.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.expr(f"{a} is null or {b} is null").alias("bad"))
    now = stored(links.where("not bad and a <> b").select("a", "b").distinct(), "links")
    state = _state(now)
    while state[0]:
        large = _star(now, state[0], small=False)
        nxt = _star(large, state[0], small=True)
        after = _state(nxt)
        drop(large)
        drop(now)
        now, done, state = nxt, after == state, after
        if done:
            break
    # at rest every link goes from a node to the smallest of its component
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = stored(nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    drop(now)
    return out
