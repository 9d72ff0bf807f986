"""Ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade >= k | text) = 1 / (1 + exp(theta_k - w.x)): one weight vector for all grades and ordered thresholds. x marks which
features a text has: its words (letters only, lower case) and their beginnings, its runs of symbols, and steps of its share of capitals, of symbols
and of distinct words. Features are 32-bit hashes kept sparse, so that unseen words meet no foreign weight. The model is fitted
on a bounded sample of rated rows; every whole text is scored.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import sliced

#: Rated rows that the fit uses at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 12_000
#: A feature needs so many texts of the sample.
LEAST_TEXTS = 4
#: And so many standard errors between its texts' share below the top grade and that of all texts, for n texts of the sample:
#: LEAST_Z for chance, and EFFECT times the root of n for the size of the difference, as standard errors shrink with it.
LEAST_Z, EFFECT = 2.0, 1 / 20
STEPS = 800
RIDGE = 1e-5
#: A text is kept if its grade is `top` with at least this probability.
KEEP_AT = 0.7

_WORDS = re.compile(r"[^\W\d_]+").findall
_SYMBOLS = re.compile(r"[^\w\s]+").findall
_CAPITALS = re.compile(r"[A-Z]{2,}").findall
#: Longer words also count, beside as a whole, by so many first letters, which inflected forms share.
PREFIX = 4


def features(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's features; of a null or empty text, that of emptiness alone."""
    if not text or text.isspace():
        return np.array([zlib.crc32(b"\x00empty")], dtype=np.uint32)
    words, symbols = _WORDS(text.lower()), _SYMBOLS(text)
    distinct = set(words)
    names = [w.encode() for w in distinct]
    names += [b"\x03" + w.encode() for w in {w[:PREFIX] for w in distinct if len(w) > PREFIX}]
    names += [b"\x01" + s.encode("utf-8", "replace") for s in set(symbols)]
    for name, part, whole in (("c", len(_CAPITALS(text)), len(words) + 1), ("s", len(symbols), len(words) + 1), ("d", len(distinct), len(words) + 1)):
        names.append(f"\x02{name}{min(10, int(20 * part / whole)) if name != 'd' else int(10 * part / whole)}".encode())
    return np.unique(np.fromiter(map(zlib.crc32, names), dtype=np.uint32, count=len(names)))


@dataclass
class OrdinalModel:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; the k-th is that of grade >= k + 1

    def score(self, hashes: np.ndarray) -> float:
        if not len(self.keys):
            return 0.0
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return float(self.weights[at][self.keys[at] == hashes].sum())

    def tails(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z, steps: int = STEPS, ridge: float = RIDGE) -> OrdinalModel:
    """Maximise the penalised likelihood by Adam over the whole sample. Without rows, every text has the top grade."""
    if not len(rows):
        return OrdinalModel(np.zeros(0, np.uint32), np.zeros(0), np.full(top, -50.0))
    flat = np.concatenate(rows)
    keys, columns, n = np.unique(flat, return_inverse=True, return_counts=True)
    grades = np.asarray(grades, dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    low = (grades < top).mean()
    z = (np.bincount(columns, weights=(grades < top)[row]) - n * low) / np.sqrt(n * max(low * (1 - low), 1e-9))
    used = (n >= least_texts) & (np.abs(z) >= least_z + EFFECT * math.sqrt(len(rows)))
    renamed = np.cumsum(used) - 1
    keep = used[columns]
    row, columns, keys = row[keep], renamed[columns[keep]], keys[used]
    share = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    w = np.zeros(len(keys))
    base, gaps = first[0], np.log(np.maximum(np.diff(first), 1e-3))
    theta = np.concatenate([[base], gaps])  # the first threshold and logs of the steps up, so that they stay in order
    moment, square = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for step in range(1, steps + 1):
        cut = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = np.bincount(row, weights=w[columns], minlength=len(rows))
        tail = np.hstack([np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(cut - z[:, None], -50, 50))), np.zeros((len(rows), 1))])
        slope = tail * (1 - tail)
        own = np.arange(len(rows))
        p = np.maximum(tail[own, grades] - tail[own, grades + 1], 1e-9)
        up, down = slope[own, grades] / p, slope[own, grades + 1] / p  # d log p / d z = up - down
        dz = -(up - down) / len(rows)
        dcut = np.array([(up[grades == k].sum() - down[grades == k - 1].sum()) / len(rows) for k in range(1, top + 1)])
        dtheta = np.concatenate([[dcut.sum()], [dcut[k:].sum() * math.exp(theta[k]) for k in range(1, top)]])
        grad = np.concatenate([np.bincount(columns, weights=dz[row], minlength=len(w)) + ridge * w, dtheta])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
        w -= move[: len(w)]
        theta -= move[len(w) :]
    return OrdinalModel(keys, w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def grades_of(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Graded ratings from the 0/1 labels: 0 poor, 1 well written but toxic, 2 well written and clean. Rows with a null go."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(F.col(doc_id).cast("long").alias("__id"), grade.cast("int").alias("__grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, top: int = 2, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on at most sample_rows rated documents; ratings has __id and __grade (0 to top). The sample is all that moves."""
    own = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    sample = ratings.orderBy(F.xxhash64("__id"), "__id", "__grade").limit(sample_rows)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, "__text"):
            yield pd.DataFrame({"id": batch["__id"], "grade": batch["__grade"], "hashes": [features(t).tobytes() for t in batch["__text"]]})

    got = own.join(F.broadcast(sample), "__id").mapInPandas(read, "id long, grade int, hashes binary").toPandas().sort_values(["id", "grade", "hashes"])
    got = got.head(sample_rows)  # repeated documents may have made more
    return fit([np.frombuffer(h, dtype=np.uint32) for h in got["hashes"]], got["grade"].to_numpy(), top)


def score_quality(docs: DataFrame, model: OrdinalModel, keep_at: float = KEEP_AT, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with columns expected_grade, p_top (tail probability of the top grade) and kept.

    A null or empty text is scored by its own feature and so has a defined grade; repeated rows get the same one; columns of
    docs that have these names are replaced (give a prefix to keep them).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most the sample's features

    @F.pandas_udf("expected_grade double, p_top double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in sliced(batches):
            tails = [m.tails(m.score(features(t))) for t in texts]
            yield pd.DataFrame({"expected_grade": [float(t.sum()) for t in tails], "p_top": [float(t[-1]) for t in tails]})

    made = f"{prefix}__graded"
    out = docs.withColumn(made, grade(F.col(text)))
    out = out.withColumns({f"{prefix}expected_grade": out[made]["expected_grade"], f"{prefix}p_top": out[made]["p_top"], f"{prefix}kept": out[made]["p_top"] >= keep_at})
    return out.drop(made)
