"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector x to the slots floor(a.x / w + b) of M Gaussian projections. For a query, the chance that a neighbour at
distance r falls into a slot is known from the normal distribution, so each perturbed bucket has an estimated chance of success;
buckets are visited in that order until their sum, over all tables, reaches the target recall. r is each query's own distance to
its K-th neighbour within a bounded sample, which is no smaller than in all rows, so the estimate errs to more probes. Queries in
dense groups and isolated ones have radii of other sizes, so there are tables for each common size of radius; a query takes the
narrowest width that its radius allows and visits every bucket if there is none. Candidates of all tables are merged and ranked by
exact distance. Every row is in each index.

Vectors are hashed and screened relative to the sample's mean, so that a common offset costs no digits. The screen is |q|^2 + |x|^2
- 2 q.x with a bound of its rounding error: whatever may be among the nearest by that bound, ties included, is measured exactly.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import partitions, pieces, saved
from quarry.llm.vectors import ROWS, keys_of, matrix, streamed, valid

TABLES = 2
TARGET = 0.98
#: Vectors of the sample that gives a query its radius; queries whose radii give the widths.
SAMPLE = 4096
#: With more lengths of vectors than this, each gives a smaller sample.
SAMPLED_DIMS = 8
#: Widths at most, and the least share of the queries that has one of its own; this decides on speed alone.
LEVELS = 3
SHARE = 0.05
#: A query's radius is at most so many widths (the slots to look at grow with the power M).
REACH = 2.0
#: Members of a bucket that one block holds; a larger bucket has several.
BLOCK = 4096
#: Queries that one block of a bucket meets; more are dealt to copies of the block.
ASKING = 4096
#: Rows of blocks that one task holds, about.
TASK_ROWS = 1 << 17
#: Rounding of a sum of products, relative to the squares summed, a component.
ROUNDING = 4 * np.finfo(float).eps


def projections_for(n: int) -> int:
    return max(2, min(4, round(math.log2(max(n, 2) / 4096) / 1.3)))


def planes(dim: int, m: int, tables: int = TABLES) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng([20240611, dim, m])
    return [(rng.normal(size=(dim, m)), rng.random(m)) for _ in range(tables)]


def bucket_names(slots: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of slots (slots beyond 16 bits wrap, which only merges buckets)."""
    out = np.zeros(len(slots), np.int64)
    for column in slots.T:
        out = (out << 16) | np.mod(column, 65536.0).astype(np.int64)
    return out


def _below(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def probes(place: np.ndarray, width: float, radius: float, need: float) -> np.ndarray:
    """Slots of the buckets to visit, best first, until their chances sum up to `need`. place: a.x / w + b of the query."""
    home = np.floor(place)
    reach = max(1, math.ceil(4 * radius / width))
    offsets = np.arange(-reach, reach + 1)
    low = home[:, None] + offsets
    chance = _below((low + 1 - place[:, None]) * width / radius) - _below((low - place[:, None]) * width / radius)
    chance /= chance.sum(axis=1, keepdims=True)
    joint, slots = chance[0], [low[0]]
    for k in range(1, len(place)):
        joint = (joint[:, None] * chance[k]).ravel()
        slots = [np.repeat(s, len(offsets)) for s in slots] + [np.tile(low[k], len(slots[0]))]
    order = np.argsort(-joint, kind="stable")
    n = int(np.searchsorted(np.cumsum(joint[order]), need)) + 1
    return np.stack(slots, axis=1)[order[:n]]


def widths_for(radii: np.ndarray) -> list[float]:
    """Slot widths, ascending: the median of each group of radii within a factor of two that holds its share of the queries."""
    left, groups = np.sort(radii[np.isfinite(radii)]), []
    while len(left):
        cut = np.searchsorted(left, left[-1] / 2, "right")
        cut = min(cut, len(left) - 1)
        groups.append(left[cut:])
        left = left[:cut]
    large = sorted((g for g in groups if len(g) >= SHARE * len(radii)), key=len)[-LEVELS:]
    return sorted(float(np.median(g)) for g in large)


def screened(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows of q to rows of x, and a bound of their rounding error."""
    squares = (q**2).sum(1)[:, None] + (x**2).sum(1)
    return squares - 2 * q @ x.T, squares * ((x.shape[1] + 4) * ROUNDING)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of one vector to rows of x, by differences."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def radii_in(sample: np.ndarray, names: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row of x to its k-th neighbour in the sample, without the row named as itself; inf for fewer than k."""
    if len(sample) <= k:
        return np.full(len(x), np.inf)
    centre = sample.mean(axis=0)
    d, _ = screened(x - centre, sample - centre)
    d[own[:, None] == names] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.array([max(exact(q, sample[p]).max(), 1e-150) for p, q in zip(near, x)])


def nearest_in(q: np.ndarray, x: np.ndarray, ids: list, few: int, centre: np.ndarray) -> list[list[dict]]:
    """For each row of q its `few` nearest among the ids of the rows of x, by (exact distance, id)."""
    d, error = screened(q - centre, x - centre)
    n = min(len(x), few)
    limit = np.partition(d + error, n - 1, axis=1)[:, n - 1]
    size = np.array([len(i) for i in ids])
    flat, first = np.concatenate([np.asarray(i, np.int64) for i in ids]), np.cumsum(size) - size
    out = []
    for i in range(len(q)):
        places = np.flatnonzero(d[i] - error[i] <= limit[i])
        far = exact(q[i], x[places])
        own = np.repeat(np.arange(len(places)), size[places])
        name = flat[first[places][own] + np.arange(len(own)) - np.repeat(np.cumsum(size[places]) - size[places], size[places])]
        best = np.lexsort((name, far[own]))[:few]
        out.append([{"score": float(far[own[b]]), "vec_id": int(name[b])} for b in best])
    return out


def nearest(rows: DataFrame, queries, k: int = 10, target: float = TARGET, tables: int = TABLES, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by Euclidean distance, ties to the smaller id.

    queries is a condition on rows that says which are queries; all other rows and queries are candidates of a query, but not
    itself. Vectors null, empty, zero or with a null or non-finite component take no part, nor do rows without an id; vectors of another
    length than the query's are no candidates. Equal vectors are one entry with their smallest ids, so that copies cost nothing.
    A query with fewer than k found, or fewer in the sample, visits every bucket. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(id_column).isNotNull() & valid(vector)).select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("v"), queries.alias("asks"))
    half, other = keys_of("v")
    own = own.select("id", "v", "asks", half.alias("h"), other.alias("o"))
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy("h", "o").orderBy("id"))).where(F.col("__n") <= k + 1)
    # A class has a number of its own from here on; it holds where the table is written.
    classes = first.groupBy("h", "o").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = saved(classes.withColumn("key", F.monotonically_increasing_id()), "vectors")
    asked = saved(own.where("asks").select("id", "h", "o").join(classes.select("h", "o", "key"), ["h", "o"]).select("id", "key"), "queries")
    empty = "query_id long, rank int, vec_id long, score double"
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], empty)
    total = sum(sizes.values())
    # The sample is that of the smallest hashes, from each length of vector.
    by_dim = Window.partitionBy(F.size("v")).orderBy("h", "o")
    drawn = classes.withColumn("__n", F.row_number().over(by_dim)).where(F.col("__n") <= (SAMPLE if len(sizes) <= SAMPLED_DIMS else SAMPLE // 64)).select("key", "v").toPandas()
    sample = {dim: (matrix(part["v"]), part["key"].to_numpy()) for dim, part in drawn.groupby(drawn["v"].map(len))}
    centre = {dim: x.mean(axis=0) for dim, (x, _) in sample.items()}
    shared = spark.sparkContext.broadcast(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, ROWS):
            for dim, part in batch.groupby(batch["v"].map(len)):
                x, names = shared.value[dim]
                yield part.assign(radius=radii_in(x, names, matrix(part["v"]), part["key"].to_numpy(), k))

    asking = classes.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    asking = saved(asking.mapInPandas(measure, "key long, v array<double>, radius double"), "radii")
    radii = asking.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select(F.size("v").alias("dim"), "radius").toPandas()
    # A dimension that no query of these has still needs tables, as its queries visit the buckets of the first one.
    fitted = {dim: (widths_for(radii["radius"][radii["dim"] == dim].to_numpy()) or [1.0], projections_for(n)) for dim, n in sizes.items()}
    need = 1 - (1 - target) ** (1 / tables)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, ROWS):
            for dim, part in batch.groupby(batch["v"].map(len)):
                widths, m = fitted[dim]
                x = matrix(part["v"]) - centre[dim]
                for t, (width, (a, b)) in enumerate((w, p) for w in widths for p in planes(dim, m, tables)):
                    names = bucket_names(np.floor(x @ a / width + b))
                    yield pd.DataFrame({"dim": dim, "t": t, "bucket": names, "key": part["key"].to_numpy(), "v": part["v"].to_numpy(), "ids": part["ids"].to_numpy()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, ROWS):
            out = []
            for key, v, radius in zip(batch["key"], batch["v"], batch["radius"]):
                widths, m = fitted[len(v)]
                level = next((i for i, w in enumerate(widths) if radius <= REACH * w), None)
                if level is None:
                    continue  # found by no bucket, it visits every one below
                for t, (a, b) in enumerate(planes(len(v), m, tables), level * tables):
                    names = np.unique(bucket_names(probes((np.asarray(v) - centre[len(v)]) @ a / widths[level] + b, widths[level], radius, need)))
                    out.append(pd.DataFrame({"dim": len(v), "t": t, "bucket": names, "key": key}))
            if out:
                yield pd.concat(out)

    def meet(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        x = matrix(members["v"])
        found = [nearest_in(matrix(part["v"]), x, list(members["ids"]), k + 1, centre[x.shape[1]]) for part in pieces([asking], 256)]
        return pd.DataFrame({"key": asking["key"], "found": [f for some in found for f in some]})

    entries = saved(classes.mapInPandas(index, "dim int, t int, bucket long, key long, v array<double>, ids array<long>"), "buckets")
    counts = entries.groupBy("dim", "t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    members = entries.join(counts, ["dim", "t", "bucket"]).select("dim", "t", "bucket", F.pmod(F.xxhash64("key"), "blocks").alias("block"), "key", "v", "ids", F.lit(0).alias("role"))
    tile = ["dim", "t", "bucket", "block", "turn"]

    def search(visits: DataFrame) -> DataFrame:
        """Blocks of a bucket's members meet groups of its queries, so neither a hot bucket nor its queries are one task's."""
        turns = visits.groupBy("dim", "t", "bucket").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("long").alias("turns"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        placed = visits.join(counts, ["dim", "t", "bucket"]).join(turns, ["dim", "t", "bucket"]).withColumn("turn", F.pmod(F.xxhash64("key", F.lit(1)), "turns")).withColumn("block", every("blocks"))
        sent = placed.join(classes.select("key", "v"), "key").select(*tile, "key", "v", F.array().cast("array<long>").alias("ids"), F.lit(1).alias("role"))
        there = members.join(turns, ["dim", "t", "bucket"]).withColumn("turn", every("turns")).select(*tile, "key", "v", "ids", "role")
        met = streamed(there.unionByName(sent), tile, partitions(spark, total, TASK_ROWS), meet, "key long, found array<struct<score:double,vec_id:long>>", ["key", "found"])
        each = met.select("key", F.inline("found")).groupBy("key", "vec_id").agg(F.min("score").alias("score"))
        return each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")

    best = saved(search(asking.mapInPandas(ask, "dim int, t int, bucket long, key long")), "found")
    whole = classes.groupBy(F.size("v").alias("dim")).agg(F.sum(F.size("ids")).alias("there"))
    got = asking.select("key", F.size("v").alias("dim")).join(best.groupBy("key").agg(F.count(F.lit(1)).alias("got")), "key", "left").join(whole, "dim")
    lacking = saved(got.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), "there")).select("key", "dim"), "lacking")
    if not lacking.isEmpty():
        every = lacking.join(counts.where("t = 0").select("dim", "t", "bucket"), "dim").select("dim", "t", "bucket", "key")
        best = best.join(lacking, "key", "left_anti").unionByName(search(every))
    hits = asked.withColumnRenamed("id", "query_id").join(best, "key").where("vec_id <> query_id").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
