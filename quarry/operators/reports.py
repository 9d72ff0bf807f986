"""The windowed usage report and index statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole)


def usage_report(calls: DataFrame, project: str, bucket: Column, session: str, since, until, when: str, buckets: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Calls by project and bucket within [since, until], both ends included; the row with project null is the total.

    bucket null leaves a call out. An empty or absent scope means every project. Sessions are distinct values of `session` that
    contributed. share is that of the first bucket in all buckets. One rollup serves projects and total.
    """
    own = calls.where(F.col(when).between(F.lit(since), F.lit(until))).withColumn("__bucket", bucket).where("__bucket IS NOT NULL")
    if scope is not None and not scope.isEmpty():
        own = own.join(scope, project, "left_semi")
    counts = [F.count(F.when(F.col("__bucket") == b, 1)).alias(b) for b in buckets]
    out = own.rollup(project).agg(*counts, F.count_distinct(session).alias("sessions"), F.grouping(project).alias("is_total"))
    raw = sum((F.col(b) for b in buckets[1:]), F.col(buckets[0]))
    return out.withColumn("share", share(F.col(buckets[0]), raw))


def most_common(rows: DataFrame, key: str, seen: str) -> DataFrame:
    """Rows by key, most first; ties in the order in which they were first seen."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def by_kind(symbols: DataFrame, kind: str = "kind") -> DataFrame:
    """Symbols of each kind, most first."""
    return symbols.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind)


def systematic_sample(rows: DataFrame, order: list[str], most: int = 60) -> DataFrame:
    """Every (n // most)-th row in order, most at most: a sample is the feature. Ranges of the order are numbered side by side."""
    step = max(1, rows.count() // most)
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = parts.withColumn("__at", at).join(F.broadcast(base), "__part").withColumn("__at", F.col("__at") + F.col("__base"))
    return numbered.where((F.col("__at") % step == 0) & (F.col("__at") < step * most)).drop("__part", "__at", "__base")


def duplicate_rate(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Rows beyond the first of each identity, as a share of all rows."""
    each = rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.sum(F.col("n") - 1).alias("extra"), F.sum("n").alias("total"))
    return total.withColumn("rate", share(F.col("extra"), F.col("total")))


def index_stats(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """files, symbols and references of an index, one row."""
    a = symbols.agg(F.count_distinct("uri").alias("files"), F.count(F.lit(1)).alias("symbols"))
    b = references.agg(F.count(F.lit(1)).alias("references"))
    return a.join(b, F.lit(True), "left")  # one row each
