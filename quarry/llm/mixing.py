"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations alone.

A source of weight e among E has windows for its blocks: block k may take a slot from floor(k E / e) on and must have one before
ceil((k + 1) E / e); in each slot the released block with the earliest deadline goes first. One slot serves one block, so this
order meets every deadline and each source stays within one block of its target e / E at every moment. Weights are whole
numbers, so windows are exact however long the schedule is, and there is no period.

The order is one long simulation, cut into segments that are computed side by side: each starts from the state that the weights
give for its first slot, and is computed again where the segment before ends in another state, until all agree. States of two
runs meet after about the longest window, so this takes few rounds. Blocks of a source that has ended leave their slots empty;
where more than half of the slots would be empty, the others go on alone in a new phase.
"""
from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import free_names, saved

#: Weights that are no whole numbers are multiples of one part in so many.
SCALE = 1 << 50
#: Slots of a segment.
SEGMENT = 1024
BLOCK_DOCS = 16
#: Rows of one source that one task numbers.
BUCKET_ROWS = 4096


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the ratio of the weights: the weights themselves if they are such, else to one part in SCALE, one at least."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if all(x.denominator == 1 for x in exact.values()) and sum(exact.values()) < SCALE:
        out = {s: int(x) for s, x in exact.items()}
    else:
        total = sum(exact.values())
        out = {s: max(1, round(x / total * SCALE)) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: e // common for s, e in out.items()}


def schedule(spark, own: list[int], slots: int, segment: int = SEGMENT) -> DataFrame:
    """The first `slots` slots of sources with whole weights `own`: rows (j, start, took, done) of segments; took names sources by their place."""
    n, total = len(own), sum(own)
    numbers = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    big = lambda x: f"CAST({x} AS DECIMAL(19,0))"
    segments = spark.range(0, -(-slots // segment)).select(
        F.col("id").alias("j"), (F.col("id") * segment).alias("t0"), F.least(F.lit(slots), (F.col("id") + 1) * segment).alias("t1"),
        *(F.expr(numbers(x)).alias(c) for c, x in (("e", own), ("d", [total // e for e in own]), ("m", [total % e for e in own]))),
    )

    def state(k: str) -> str:
        return f"named_struct('k', {k}, 'rel', ({big(k)} * {big(f'{total}L')}) div e[i], 'q', ({big(f'({k} + 1)')} * {big(f'{total}L')}) div e[i], 'r', CAST(({big(f'({k} + 1)')} * {big(f'{total}L')}) % {big('e[i]')} AS BIGINT))"

    places = f"sequence(0, {n - 1})"
    guess = (
        segments.withColumn("low", F.expr(f"transform({places}, i -> ({big('e[i]')} * {big('t0')}) div {total}L)"))
        .withColumn("part", F.expr(f"transform({places}, i -> {big('low[i]')} * {big(f'{total}L')} < {big('e[i]')} * {big('t0')})"))
        .withColumn("due", F.expr(f"array_sort(filter(transform({places}, i -> if(part[i], named_struct('due', -(-({big('(low[i] + 1)')} * {big(f'{total}L')}) div e[i]), 'i', i), NULL)), x -> x IS NOT NULL))"))
        .withColumn("up", F.expr("transform(slice(due, 1, CAST(t0 - aggregate(low, 0L, (a, x) -> a + x) AS INT)), x -> x.i)"))
        .withColumn("start", F.expr(f"transform({places}, i -> {state('(low[i] + if(array_contains(up, i), 1L, 0L))')})"))
    )
    pick = "array_min(transform(a.s, (x, i) -> if(x.rel <= t, named_struct('due', x.q + if(x.r > 0, 1L, 0L), 'i', i), NULL))).i"
    after = "named_struct('k', x.k + 1L, 'rel', x.q, 'q', x.q + d[i] + if(x.r + m[i] >= e[i], 1L, 0L), 'r', (x.r + m[i]) % e[i])"
    run = (
        f"aggregate(sequence(t0, t1 - 1), named_struct('s', start, 'took', CAST(array() AS ARRAY<INT>)), (a, t) -> transform(array({pick}), p -> "
        f"named_struct('s', transform(a.s, (x, i) -> if(i = p, {after}, x)), 'took', concat(a.took, array(p))))[0])"
    )
    facts = ["j", "t0", "t1", "e", "d", "m", "start"]

    def simulated(rows: DataFrame) -> DataFrame:
        return rows.select(*facts, F.expr(run).alias("__ran")).select(*facts, F.col("__ran.took").alias("took"), F.col("__ran.s").alias("done"))

    known = saved(simulated(guess), "segments")
    while slots > segment:
        ends = known.select((F.col("j") + 1).alias("j"), F.col("done").alias("before"))
        wrong = saved(known.join(ends, "j").where("start <> before").select("j", "t0", "t1", "e", "d", "m", F.col("before").alias("start")), "segments")
        if wrong.isEmpty():
            break
        known = saved(known.join(wrong.select("j"), "j", "left_anti").unionByName(simulated(wrong)), "segments")
    return known.select("j", "start", "took", "done")


def phases(spark, sources: list[tuple[str, int, int]]) -> DataFrame:
    """(key, block, slot) of all blocks of sources (name, whole weight, blocks), slots ascending; one small job a phase."""
    left = {s: (e, n) for s, e, n in sources if n}
    base, begun, parts = 0, dict.fromkeys(left, 0), []
    while left:
        names = sorted(left)
        if len(names) == 1:
            (s,) = names
            parts.append(spark.range(0, left[s][1]).select(F.lit(s).alias("key"), (F.col("id") + begun[s]).alias("block"), (F.col("id") + base).alias("slot")))
            break
        common = math.gcd(*(left[s][0] for s in names))
        own = [left[s][0] // common for s in names]
        total = sum(own)
        ends = sorted((-(-left[s][1] * total // e), e) for s, e in zip(names, own))
        # The last end until which at most half of the slots are empty; the first one always is such.
        end, gone, paid = ends[0][0], 0, 0
        for t, e in ends:
            if 2 * (t * gone - paid) <= t * total:
                end = t
            gone, paid = gone + e, paid + t * e
        found = schedule(spark, own, end)
        last = found.orderBy(F.desc("j")).limit(1).select(F.transform("done", lambda x: x["k"]).alias("k")).first()["k"]
        # The k-th turn of a source within its segment serves the block that it had reached at the start and k more.
        slot = found.select("j", "start", F.posexplode("took").alias("at", "which"))
        turn = F.row_number().over(Window.partitionBy("j", "which").orderBy("at")) - 1
        facts = F.array(*(F.struct(F.lit(s).alias("key"), F.lit(begun[s]).cast("long").alias("begun"), F.lit(left[s][1]).cast("long").alias("n")) for s in names))
        rows = slot.select((F.col("j") * SEGMENT + F.col("at") + base).alias("slot"), F.get(facts, "which").alias("f"), (F.get(F.col("start"), "which")["k"] + turn).alias("k"))
        parts.append(rows.where("k < f.n").select("f.key", (F.col("f.begun") + F.col("k")).alias("block"), "slot"))
        for s, k in zip(names, last):
            begun[s] += min(k, left[s][1])
            left[s] = (left[s][0], left[s][1] - min(k, left[s][1]))
        left = {s: x for s, x in left.items() if x[1]}
        base += end
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def mix_sources(docs: DataFrame, weights: dict | None = None, exponent: float = 0.5, block_docs: int = BLOCK_DOCS, doc_id: str = "doc_id", source: str = "source", out: tuple[str, str, str] = ("block", "slot", "place")) -> DataFrame:
    """docs with columns block, slot (long) and place (int): ordered by (slot, place), the sources stand in their target weights.

    weights maps a source (None for a null source) to its target; where it lacks one, or is None altogether, the target is the
    source's number of rows to the power `exponent` (1 keeps the present mixture, 0 evens it out). Every row comes once: nothing
    is dropped or repeated, and (slot, place) is a different one for each row. Within a source, rows stand in the order of a hash of
    doc_id, then doc_id, then a hash of the whole row; rows alike in all of it are interchangeable. An empty table stays empty.
    Columns of docs that have the added names are replaced (give others in `out` to keep them); all other columns stay, whatever
    their names. The driver holds a few numbers for each source.
    """
    spark = docs.sparkSession
    docs = docs.drop(*out)
    key, hashed, bits, bucket, base, rank, slots, n, tie = free_names(docs, *(f"__{x}" for x in ("key", "hash", "bits", "bucket", "base", "rank", "slots", "n", "tie")))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns({
        key: F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string"))),
        hashed: F.xxhash64(F.col(doc_id)), tie: F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in plain)),
    })
    rows = {r[0]: r[1] for r in keyed.groupBy(key).agg(F.count(F.lit(1)).alias(n)).collect()}
    names = dict(zip(("block", "slot", "place"), out))
    if not rows:
        return docs.withColumns({names["block"]: F.lit(0).cast("long"), names["slot"]: F.lit(0).cast("long"), names["place"]: F.lit(0).cast("int")})
    given = {("0" if s is None else f"1{s}"): w for s, w in (weights or {}).items()}
    targets = {s: given.get(s, float(k) ** exponent) for s, k in rows.items()}
    if min(targets.values()) <= 0:
        raise ValueError("a target weight must be above 0")
    whole = whole_weights(targets)
    # A large source is numbered in buckets of its hash range, as many as its rows ask for.
    facts = spark.createDataFrame([(s, max(0, math.ceil(math.log2(max(1, k / BUCKET_ROWS))))) for s, k in sorted(rows.items())], f"{key} string, {bits} int")
    keyed = keyed.join(F.broadcast(facts) if len(rows) < 100_000 else facts, key).withColumn(bucket, F.expr(f"if({bits} = 0, 0L, shiftrightunsigned({hashed}, 64 - {bits}))"))
    counts = keyed.groupBy(key, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, bucket, n, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    # The slots of a bucket's blocks travel with the bucket, so that the documents are dealt out once.
    turns = phases(spark, [(s, whole[s], -(-k // block_docs)) for s, k in rows.items()])
    blocks = bases.select("*", F.explode(F.sequence(F.expr(f"{base} div {block_docs}"), F.expr(f"({base} + {n} - 1) div {block_docs}"))).alias("block"))
    timed = blocks.join(turns.withColumnRenamed("key", key), [key, "block"]).groupBy(key, bucket, base).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias(slots))
    at = Window.partitionBy(key, bucket).orderBy(hashed, F.col(doc_id), tie)
    ranked = keyed.withColumn(rank, F.row_number().over(at) - 1).join(timed, [key, bucket]).withColumn(rank, F.col(rank) + F.col(base))
    block = F.expr(f"{rank} div {block_docs}")
    ranked = ranked.withColumns({names["block"]: block, names["place"]: (F.col(rank) % block_docs).cast("int"), names["slot"]: F.get(F.col(slots), (block - F.expr(f"{base} div {block_docs}")).cast("int"))})
    return ranked.select(*(f"`{c}`" for c in docs.columns), *out)
