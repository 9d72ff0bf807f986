"""What the operators share: reading tables, shared scratch tables, slices of batches, per-worker caches."""
from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator works on at once. Spark bounds an Arrow batch by its bytes; a slice of it bounds the arrays made from it.
SLICE_BYTES = 1 << 22
_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator, text: str | None = None, most: int = SLICE_BYTES) -> Iterator:
    """The batches (frames, or the texts themselves) in slices of about `most` characters of text, one row at least."""
    for batch in batches:
        texts = batch if text is None else batch[text]
        ends = np.cumsum(texts.str.len().fillna(0).to_numpy(np.int64) + 64)
        at = 0
        while at < len(batch):
            cut = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.iloc[at:cut]
            at = cut


def pieces(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches in pieces of at most so many rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one machine (tests) gets a temporary one."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables of `saved` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        delete_path(spark, folder)


def delete_path(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over the tasks that it runs."""
    return sys.__dict__.setdefault("_quarry_llm_cache", {})


def partitions(spark: SparkSession, rows: int = 0, each: int = 1) -> int:
    """Parts of a shuffle: the session's number, or more where a part would hold over `each` of so many rows."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def reading_parts(df: DataFrame) -> int:
    """Parts for a shuffle of the rows of a scan: at least as many as the scan's tasks, whose size Spark sets by bytes."""
    return max(partitions(df.sparkSession), df.rdd.getNumPartitions())


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out
