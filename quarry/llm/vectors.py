"""What the two vector operators share: valid vectors, classes of equal ones, and blocks that stream through a task."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import pieces

#: Rows that are turned into arrays at once.
ROWS = 2048


def valid(vector: str | Column) -> Column:
    """True for a vector with a component, all of them finite, and not all of them zero; false for any other, null too."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def keys_of(*columns) -> tuple[Column, Column]:
    """The 128-bit name of a class of equal rows, in two halves. Adding 0 to components makes both zeros one."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def streamed(rows: DataFrame, block: list[str], partitions: int, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, empty: list[str]) -> DataFrame:
    """For each block (columns `block`), its members (role 0, a bounded number) meet its probes (role 1), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, members = None, [], None
        for batch in pieces(batches, ROWS):
            change = (batch[block] != batch[block].shift()).any(axis=1).to_numpy()
            change[0] = False
            cuts = [0, *np.flatnonzero(change), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.iloc[a:b]
                name = tuple(part[block].iloc[0])
                if name != at:
                    at, held, members = name, [], None
                own = part[part["role"] == 0]
                if len(own):
                    held.append(own)
                    members = None
                probes = part[part["role"] == 1]
                if len(probes) and held:
                    if members is None:
                        members = pd.concat(held, ignore_index=True)
                    yield meet(members, probes.reset_index(drop=True))
        yield pd.DataFrame(columns=empty)

    return rows.repartition(partitions, *block).sortWithinPartitions(*block, "role").mapInPandas(run, schema)
