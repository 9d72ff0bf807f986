"""Embedding near-dedup by product quantisation, without a lost link.

Unit vectors are dealt into coarse inverted lists (nearest of some centroids), and the residual is coded by its nearest codeword in each
subspace. A vector probes every list that can hold a vector within the distance that the cosine allows: the bisector of the two
centroids must be no farther than that. In a list, distances to the coded members are sums of table entries; as the error of
each code is known, the triangle inequality rules out members that are too far, and the rest is ranked by the exact cosine in double
precision. Centroids and codewords are fitted on a bounded sample; every row is coded.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import partitions, pieces, saved
from quarry.llm.components import components
from quarry.llm.vectors import ROWS, keys_of, matrix, streamed, valid

#: Vectors of the sample for each list, and at least; subspaces, codewords of each.
SAMPLE_OF_LIST, SAMPLE, SUBSPACES, WORDS = 8, 8192, 8, 32
#: Classes of a list, about: the lists grow with the rows. A vector is sent once to each list that it probes, so fewer, larger lists move
#: less. The centroids are what the driver fits and sends out, so they have a bound (4096 x 8 bytes x the dimension); beyond it lists
#: grow, in more blocks.
OF_LIST, LEAST_LISTS, LISTS = 4096, 4, 4096
#: Members that one block of a list holds, and rows of blocks that one task holds, about.
BLOCK, TASK_ROWS = 4096, 1 << 17
EPS = 1e-9


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Centroids and, for each subspace, codewords of the residuals."""

    def __init__(self, x: np.ndarray, lists: int) -> None:
        self.centroids = kmeans(x, lists, 1)
        rest = x - self.centroids[self.nearest(x)]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.words = [kmeans(rest[:, a:b], WORDS, 2 + i) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:]))]

    def _far(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self._far(x), axis=1)

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of x in the lists `own`, and how far each vector is from its code."""
        rest = x - self.centroids[own]
        codes, error = [], np.zeros(len(x))
        for (a, b), w in zip(zip(self.cuts[:-1], self.cuts[1:]), self.words):
            d = np.maximum((rest[:, a:b] ** 2).sum(1)[:, None] + (w**2).sum(1) - 2 * rest[:, a:b] @ w.T, 0)
            codes.append(np.argmin(d, axis=1))
            error += ((rest[:, a:b] - w[codes[-1]]) ** 2).sum(1)
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Which lists can hold a vector within `reach` of each x."""
        d = self._far(x)
        homes, of = np.unique(own, return_inverse=True)
        apart = np.sqrt(self._far(self.centroids[homes]))[of]
        return d - d[np.arange(len(x)), own][:, None] <= 2 * apart * (reach + EPS) + EPS

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of x to coded members of the list: a look-up in each subspace's table, and a sum."""
        rest, out = x - self.centroids[which], np.zeros((len(x), len(codes)))
        for i, ((a, b), w) in enumerate(zip(zip(self.cuts[:-1], self.cuts[1:]), self.words)):
            table = (rest[:, a:b] ** 2).sum(1)[:, None] + (w**2).sum(1) - 2 * rest[:, a:b] @ w.T
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def lists_for(n: int) -> int:
    return max(1, min(LISTS, max(min(LEAST_LISTS, n // 16), n // OF_LIST)))


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, row for row; only vectors of one label compare.

    n_links counts the other rows with cosine >= threshold, component_id is the least vec_id reachable (itself included), kept says
    whether that is the row itself. A vector that is null, empty, zero or has a null or non-finite component, or that has no label, links with
    nothing; vectors of other lengths don't compare. Equal vectors are one class with a count. Rows that repeat a vec_id count each
    by themselves; a row without a vec_id counts as a link but its own component is that of its class, and it is not kept.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("raw"), F.col(label).alias("label"))
    takes = F.col("label").isNotNull() & valid("raw")
    own = own.select("id", "label", F.when(takes, F.transform("raw", lambda x: x.cast("double") + 0.0)).alias("v"))
    half, other = keys_of("label", "v")
    table = saved(own.withColumns({"h": F.when(F.col("v").isNotNull(), half), "o": F.when(F.col("v").isNotNull(), other)}), "vectors")
    grouped = table.where("h IS NOT NULL").groupBy("h", "o").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    # A class has a number of its own from here on; it holds where the table is written.
    classes = saved(grouped.withColumn("key", F.monotonically_increasing_id()), "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    sample = classes.orderBy("h", "o").limit(max(SAMPLE, SAMPLE_OF_LIST * lists_for(total))).select("v").toPandas()["v"]
    fitted = {}
    for dim, n in sizes.items():
        x = [v for v in sample if len(v) == dim] or [np.eye(1, dim)[0]]
        x = matrix(pd.Series(x))
        fitted[dim] = Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), lists_for(n))
    model = spark.sparkContext.broadcast(fitted)  # LISTS centroids and SUBSPACES * WORDS codewords of each length

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, ROWS):
            for dim, part in batch.groupby(batch["v"].map(len)):
                q = model.value[dim]
                x = matrix(part["v"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                home = q.nearest(x)
                codes, error = q.code(x, home)
                part = part.reset_index(drop=True)
                yield pd.DataFrame({"dim": dim, "label": part["label"], "list": home, "key": part["key"], "v": part["v"], "n": part["n"], "code": [c.tobytes() for c in codes], "error": error, "role": 0})
                who, where = np.nonzero(q.probes(x, home, reach))
                later = where >= home[who]  # the lower list of a pair probes the higher one
                who, where = who[later], where[later]
                yield pd.DataFrame({"dim": dim, "label": part["label"].to_numpy()[who], "list": where, "key": part["key"].to_numpy()[who], "v": part["v"].to_numpy()[who], "n": part["n"].to_numpy()[who], "code": b"", "error": np.where(where == home[who], 1.0, 0.0), "role": 1})

    def meet(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([met(members, part) for part in pieces([asking], 512)])

    def met(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        q, which = model.value[int(members["dim"].iloc[0])], int(members["list"].iloc[0])
        y, x = matrix(members["v"]), matrix(asking["v"])
        ny, nx = np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)
        codes = np.frombuffer(b"".join(members["code"]), dtype=np.uint8).reshape(len(members), -1)
        ykey, xkey, yn, xn = (f[c].to_numpy() for c in ("key", "n") for f in (members, asking))
        close = q.distances(x / nx[:, None], which, codes) <= reach + members["error"].to_numpy() + 1e-7
        same = asking["error"].to_numpy() == 1.0  # both have this list as their home: one of the two orders counts
        close &= ~same[:, None] | (xkey[:, None] < ykey[None, :])
        i, j = np.nonzero(close)
        cosine = (x[i] * y[j]).sum(axis=1) / (nx[i] * ny[j]) if len(i) else np.zeros(0)
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        counts = pd.DataFrame({"a": np.concatenate([xkey[i], ykey[j]]), "n": np.concatenate([yn[j], xn[i]])}).groupby("a", as_index=False)["n"].sum().assign(kind=0, b=0)
        # A forest of the links: each member keeps the group that it is in so far.
        group, links = np.arange(len(y)), []
        for p in np.unique(i):
            mine = np.unique(group[j[i == p]])
            links += [(xkey[p], ykey[g]) for g in mine]
            group[np.isin(group, mine)] = mine[0]
        forest = pd.DataFrame(links, columns=["a", "b"]).assign(kind=1, n=0)
        return pd.concat([counts, forest])[["kind", "a", "b", "n"]].astype("int64")

    schema = f"dim int, label {dict(table.dtypes)['label']}, list int, key long, v array<double>, n long, code binary, error double, role int"
    entries = saved(classes.mapInPandas(place, schema), "lists")
    names = ["dim", "label", "list"]
    counts = entries.where("role = 0").groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    placed = entries.join(counts, names)
    members = placed.where("role = 0").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    asking = placed.where("role = 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = saved(streamed(members.unionByName(asking), [*names, "block"], partitions(spark, total, TASK_ROWS), meet, "kind long, a long, b long, n long", ["kind", "a", "b", "n"]), "links")
    joined = components(found.where("kind = 1").select("a", "b"))
    group = classes.select("key", "n", "rep").join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    known = group.join(least, "component").join(links, "key", "left").join(classes.select("key", "h", "o"), "key").select("h", "o", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = table.select("id", "h", "o").join(known, ["h", "o"], "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept")
    )
