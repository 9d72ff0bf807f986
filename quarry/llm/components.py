"""Connected components by contraction in random orders: a logarithmic number of rounds, whatever the shape of the links."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import drop_saved, saved

#: Contracted links that one task finishes. A round costs a dozen shuffles however few its links are.
FEW = 4096


def _step(links: DataFrame, turn: int) -> DataFrame:
    """(node, to): each node's first neighbour in this round's order, or itself if it comes before all of them."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("x"))
    return both.groupBy("node").agg(F.min(place("other")).alias("m")).select("node", F.least("m", place("node"))["x"].alias("to"))


def _jump(steps: DataFrame) -> DataFrame:
    return steps.join(steps.toDF("to", "__far"), "to").select("node", F.col("__far").alias("to"))


def _finished(edges: DataFrame) -> DataFrame:
    """(node, to): each node's least reachable one, for so few links that one task holds them."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = sorted((root(a), root(b)))
                up[b] = a
        yield pd.DataFrame({"node": list(up), "to": [root(x) for x in up]}, dtype="int64")

    return edges.select("a", "b").coalesce(1).mapInPandas(finish, "node long, to long")


def components(links: DataFrame, rounds: list | None = None, few: int = FEW) -> DataFrame:
    """From links (a, b), both long and not null, to (node, component), the least node reachable; nodes with a link only.

    A round orders the nodes by a hash that is another one each time, points every node at the first of itself and its
    neighbours, follows these pointers four steps, and moves the links along. A node stays only if some other's path ends there;
    first among its neighbours is one in (degree + 1) nodes on average, so a chain loses about two thirds of its nodes in a
    round and a star all but one, and the expected number of rounds is logarithmic in the nodes (a chain of 2,000 takes 8).
    The rounds end when at most `few` links are left, which one task solves (0: rounds to the end; the result is the same).
    Labels are then carried back through the rounds, and each component takes its least node. A node with very many
    links is only ever aggregated (with partial sums) or joined by an equality that adaptive execution may split. Loops and
    repeated links do no harm. `rounds`, if given, gets the links left after each round.
    """
    spark = links.sparkSession
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    used, maps = [edges], []
    while left := edges.count():
        if left <= few:
            maps.append(saved(_finished(edges), "parents"))
            break
        first = saved(_step(edges, len(maps)), "parents")
        near = saved(_jump(first), "parents")
        far = saved(_jump(near), "parents")
        maps.append(far)
        moved = edges.join(far.toDF("a", "ta"), "a").join(far.toDF("b", "tb"), "b").where("ta <> tb")
        edges = saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        used += [first, near, edges]
        if rounds is not None:
            rounds.append(edges.count())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1].toDF("node", "root")
    for far in reversed(maps[:-1]):
        up = out.toDF("to", "up")
        out = far.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("root"))
    out = saved(out, "roots")
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    found = saved(out.join(least, "root").select("node", "component"), "components")
    drop_saved(spark, *used, *maps, out)
    return found
