"""N-gram Jaccard join: universe-partition pigeonhole, exact.

Two sets that link differ in at most H = (|r| + |s|)(den - num) / (den + num) shingles. The universe of shingles is hashed into m
segments, m set by the size band of the larger set, so that differences can touch only so many of them:

* Exact segments. Shingles that are frequent in the corpus are left out (for all sets alike). If a set has more than H segments
  with something in them, one of these is the same in every set that it links with: their hashes are the index.
* One-deletion neighbourhoods, for the sets that the first way can't serve (mostly frequent shingles). All shingles go into half
  as many segments, and the index also holds each segment less one shingle: more than H/2 segments with two shingles or more
  make sure that one differs by one shingle at most and meets there. This costs an entry per shingle, so it is
  allocated only where the cheap way does not do; sets that fail it again take another seed, and at last single shingles.

A set is served by the first way that does, and enters every way up to that one; so for each pair the way that serves one of the
two holds both. Candidates are verified on whole texts. Sets that are equal are one class from the start.

Index entries travel as packed arrays, 7 bytes each, and are grouped in numpy. A group of up to GROUP classes gives all pairs, a
larger one its pairs with a centre; the links found so far make components, and a large group that still lies in more than one
is compared whole by parity sketches (`_open_pairs`), which bound the distance from below. Only pairs that pass the sketches are
verified. Only classes in different components could change the result, so no others are compared.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import drop_saved, partitions, pieces, saved, sliced
from quarry.llm.components import components
from quarry.llm.shingles import WIDTH, fingerprint, mix, shingle_sets

NUM, DEN = 80, 100
#: Size bands grow by this factor; small sizes have bands of their own.
BAND = 1.6
#: Segments are so many times H + 1: room for those that a set leaves empty.
SPARE = 1.25
#: A task hands on the shingles that this share of its texts has (two at least); frequent are those of which the tasks count more
#: than LEAST and this share of all texts, the most frequent ones first, so many at most.
SHARE, LEAST, FREQUENT = 1 / 4000, 16, 1 << 19
#: A sketch holds the parity of the shingles in each of so many cells a shingle, rounded up to a power of two.
CELLS = 4
#: Seeds of the one-deletion way, then single shingles.
SEEDS = 4
GROUP = 8
#: Classes of a large group on each side of one block of comparisons.
BLOCK = 1024
#: Tasks that the classes of one large group are dealt to.
SALTS = 32
EPS = 1e-9
#: Index entries that a task gathers before it hands them on, and that one part holds at most, about.
FLUSH, PART = 1 << 22, 1 << 22
#: Partners of one centre that are verified in one run.
RUN = 256


def bands(most: int) -> list[tuple[int, int]]:
    """(least, largest) size of each band up to the one that holds `most`."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * BAND) - 1) if low >= 3 else low
        out.append((low, high))
        low = high + 1
    return out


def _bands_of(n: int, all_bands: list[tuple[int, int]], num: int, den: int) -> list[int]:
    """The bands of the larger set, over the sets that may link with one of n shingles."""
    return [j for j, (low, high) in enumerate(all_bands) if high >= n and low * num <= n * den]


def differences(high: int, num: int, den: int) -> int:
    """The most shingles in which two linked sets of at most `high` differ."""
    return 2 * high * (den - num) // (den + num)


def entries(shingles: np.ndarray, frequent: np.ndarray, all_bands: list[tuple[int, int]], num: int = NUM, den: int = DEN) -> np.ndarray:
    """The index entries of a set: 64-bit hashes."""
    out = []
    if not len(shingles):
        return np.zeros(0, np.uint64)
    at = np.searchsorted(frequent, shingles)
    at[at == len(frequent)] = 0
    rare = shingles[frequent[at] != shingles] if len(frequent) else shingles
    for j in _bands_of(len(shingles), all_bands, num, den):
        most = differences(all_bands[j][1], num, den)
        if not most:
            continue  # only equal sets link: they are one class
        m = int(SPARE * (most + 1)) + 2
        values, used = _segments(rare, m, j)
        out.append(values)
        if len(used) > most:
            continue
        for seed in range(1, SEEDS + 1):
            spread = np.sort(mix(shingles + np.uint64(seed)))
            m = max(1, int(SPARE * (most + 1) / 2))
            cell = ((spread >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            one = mix(spread)
            size = np.diff(np.append(first, len(cell)))
            whole = np.add.reduceat(one, first)
            tag = mix(cell[first] + np.uint64((j << 40) | (seed << 32)))
            less = np.repeat(whole, size) - one
            keep = np.repeat(size >= 2, size)  # an emptied segment would meet everything
            out += [mix(whole ^ tag), mix((less ^ np.repeat(tag, size))[keep])]
            if 2 * int((size >= 2).sum()) > most:
                break
        else:
            out.append(mix(shingles ^ mix(np.array([(j << 40) | (63 << 32)], np.uint64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _segments(rare: np.ndarray, m: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of the segments that hold something; rare is sorted, so a segment is a run of it."""
    if not len(rare):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cell = ((rare >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return mix(np.add.reduceat(mix(rare), first) ^ mix(cell[first] + np.uint64(j << 40))), first


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each cell. Two sets differ in as many shingles at least as their sketches in bits."""
    if not len(shingles):
        return b""
    cells = max(64, 1 << int(CELLS * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles + np.uint64(77)) >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(x: bytes, size: int) -> np.ndarray:
    """A sketch with fewer cells: halves fold onto each other, as the cell's number is the low bits of a hash."""
    out = np.frombuffer(x, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def least_distance(x: bytes, y: bytes, n: int, m: int) -> float:
    """A lower bound of the Jaccard distance of two sets of n and m shingles, from their sketches."""
    size = min(len(x), len(y))
    a, b = _folded(x, size), _folded(y, size)
    bits = max(int(np.bitwise_count(a ^ b).sum()), abs(n - m))
    return 2 * bits / (n + m + bits) if n + m else 0.0


def shingle_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document (kind 0: doc_id, n, a and b, the set's fingerprint) and the frequent shingles of each task (kind 1: a, n)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, texts, seen = [], 0, 0, set()
        counts: tuple[np.ndarray, np.ndarray] | None = None

        def fold():
            nonlocal counts, held, size
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            parts = [(keys[more], n[more])] + ([counts] if counts else [])
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
            held, size = [], 0

        for batch in sliced(batches, "t"):
            rows = []
            for d, s in zip(batch["d"], shingle_sets(list(batch["t"]), width)):
                a, b = fingerprint(s)
                rows.append((0, None if pd.isna(d) else int(d), len(s), a, b, sketch(s)))
                if len(s) and a not in seen:
                    seen.add(a)
                    texts += 1
                    held.append(s)
                    size += len(s)
                    if size > FLUSH:
                        fold()
            out = pd.DataFrame(rows, columns=["kind", "doc_id", "n", "a", "b", "sketch"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        if held:
            fold()
        if counts:
            often = counts[1] >= max(2, SHARE * texts)
            yield pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * int(often.sum()), dtype="Int64"), "n": counts[1][often], "a": counts[0][often].view(np.int64), "b": 0, "sketch": None})

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(read, "kind int, doc_id long, n long, a long, b long, sketch binary")


def _index(docs: DataFrame, frequent, all_bands, parts: int, num: int, den: int, width: int, doc_id: str, text: str) -> DataFrame:
    """Packed entries (part, blob): u32 classes, u32 entries, then the classes' fingerprint (i64) and size (u32), the entries' low 32
    bits, next 8 bits and class (u32 each in its array)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sizes, held, size, seen = [], [], [], 0, set()

        def flush():
            values = np.concatenate([h for _, h in held])
            own = np.repeat(np.array([i for i, _ in held], np.uint32), [len(h) for _, h in held])
            part = ((values >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            values, own, part = values[order], own[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            table_a, table_n = np.array(names, np.int64), np.array(sizes, np.uint32)
            for p in range(parts):
                v, o = values[cut[p] : cut[p + 1]], own[cut[p] : cut[p + 1]]
                if len(v):
                    used, o = np.unique(o, return_inverse=True)
                    blob = struct.pack("<II", len(used), len(v)) + table_a[used].tobytes() + table_n[used].tobytes() + v.astype(np.uint32).tobytes() + (v >> np.uint64(32)).astype(np.uint8).tobytes() + o.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes()
                    yield pd.DataFrame({"part": [p], "blob": [blob]})

        for batch in sliced(batches, "t"):
            for s in shingle_sets(list(batch["t"]), width):
                a, _ = fingerprint(s)
                if not len(s) or a in seen:
                    continue
                seen.add(a)
                e = entries(s, frequent.value, all_bands, num, den)
                if len(e):
                    held.append((len(names), e))
                    names.append(a)
                    sizes.append(len(s))
                    size += len(e)
            if size > FLUSH:
                yield from flush()
                names, sizes, held, size = [], [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col(text).alias("t")).mapInPandas(make, "part int, blob binary")


def _unpack(blob: bytes):
    n, m = struct.unpack_from("<II", blob)
    at = 8
    out = []
    for dtype, count in (("<i8", n), ("<u4", n), ("<u4", m), ("u1", m), ("<u4" if n > 65535 else "<u2", m)):
        out.append(np.frombuffer(blob, dtype, count, at))
        at += out[-1].nbytes
    a, size, low, high, own = out
    return a, size, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), own.astype(np.int64)


def _groups(index: DataFrame, num: int, den: int) -> DataFrame:
    """From the packed index: kind 0, a pair (a < b) to verify; kind 1, a class b in a large group of centre g.

    Large groups of one centre are mostly those of one family: their classes are listed, and later compared, once for the centre.
    """

    def one_part(part: int, blobs: list[bytes]) -> pd.DataFrame:
        got = [_unpack(b) for b in blobs]
        base = np.cumsum([0] + [len(g[0]) for g in got])
        a, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        size = np.zeros(len(a), np.int64)
        size[at] = np.concatenate([g[1] for g in got])
        key = np.concatenate([g[2] for g in got])
        own = at[np.concatenate([g[3] + b for g, b in zip(got, base)])]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        key, own = key[fresh], own[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        pairs = []
        for step in range(1, GROUP):  # places `step` apart in one group of up to GROUP
            small = np.repeat((count <= GROUP) & (count > step), count)
            left = np.flatnonzero(small[: len(key) - step] & (key[step:] == key[: len(key) - step]))
            pairs.append(np.stack([own[left], own[left + step]]))
        big = np.repeat(count > GROUP, count)
        centre = np.repeat(own[first], count)
        star = np.flatnonzero(big & (centre != own))
        pairs.append(np.stack([centre[star], own[star]]))
        x, y = np.concatenate(pairs, axis=1)
        near = np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num
        x, y = x[near], y[near]
        both = np.unique(x * np.int64(len(a)) + y) if len(a) else np.zeros(0, np.int64)
        member = np.unique(centre[big] * np.int64(len(a)) + own[big]) if len(a) else np.zeros(0, np.int64)
        out = pd.DataFrame({"kind": 0, "g": 0, "a": a[both // max(1, len(a))], "b": a[both % max(1, len(a))]})
        return pd.concat([out, pd.DataFrame({"kind": 1, "g": a[member // max(1, len(a))], "a": 0, "b": a[member % max(1, len(a))]})]).astype({"kind": "int32", "g": "int64", "a": "int64", "b": "int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch["part"], batch["blob"]):
                if p != part and blobs:
                    yield one_part(part, blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield one_part(part, blobs)

    return index.mapInPandas(read, "kind int, g long, a long, b long")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """pairs (a, b) with inter and either: the sizes of intersection and union, from whole texts.

    A centre a meets its partners in runs of RUN, each run with its own copy of the centre's text, so that neither a task nor a
    worker ever holds more than one set beside the one that it reads.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    dealt = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), "runs").cast("int"))
    wanted = dealt.select("a", "run", "b").unionAll(runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("b")))
    by_doc = wanted.join(classes.select(F.col("a").alias("b"), "rep", F.col("fb").alias("fb")), "b")
    texts = docs.select(F.col("d").alias("rep"), F.col("t").alias("text")).where("rep IS NOT NULL")
    sent = by_doc.join(texts, "rep").select("a", "run", "b", "fb", "text", (F.col("a") == F.col("b")).cast("int").alias("is_a"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, at = None, None
        for batch in sliced(batches, "text"):
            rows = []
            for a, run, b, fb, s in zip(batch["a"], batch["run"], batch["b"], batch["fb"], shingle_sets(list(batch["text"]), width)):
                if fingerprint(s) != (b, fb):
                    continue  # another text under a repeated doc_id
                if a == b:
                    centre, at = s, (a, run)
                elif at == (a, run):
                    inter = len(np.intersect1d(centre, s, assume_unique=True))
                    rows.append((a, b, inter, len(centre) + len(s) - inter))
            yield pd.DataFrame(rows, columns=["a", "b", "inter", "either"]).astype("int64")

    return sent.repartition(partitions(docs.sparkSession), "a", "run").sortWithinPartitions("a", "run", F.desc("is_a"), "b").mapInPandas(compare, "a long, b long, inter long, either long").distinct()


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs with `far`, a lower bound of their distance."""

    @F.pandas_udf("double")
    def bound(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([least_distance(*r) for r in zip(x, y, n, m)], dtype="float64")

    left = sketches.toDF("a", "n", "__x")
    right = sketches.toDF("b", "m", "__y")
    return pairs.join(left, "a").join(right, "b").withColumn("far", bound("__x", "__y", "n", "m")).select("a", "b", "far")


def _checked(docs, classes, sketches, pairs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """The pairs that their sketches leave open, verified on whole texts: a, b, inter, either."""
    near = saved(_screened(pairs, sketches).where(F.col("far") <= (den - num) / den + EPS).select("a", "b"), "screened")
    return saved(_verified(docs, classes, near, num, den, width), "verified")


def _linked(verified: DataFrame, num: int, den: int) -> DataFrame:
    return verified.where(F.col("inter") * den >= F.col("either") * num)


def _open_pairs(large: DataFrame, sketches: DataFrame, links: DataFrame, partitions: int, num: int, den: int) -> DataFrame:
    """Pairs inside large groups that could still join two components and that their sketches don't tell apart.

    A group that lies in one component by now is done: with its centre's links, nearly every group of real near duplicates is. Any
    other is compared whole, in blocks of BLOCK by BLOCK classes, by the bits of the sketches, in numpy; only what passes is a row.
    """
    joined = components(links)
    rows = large.join(joined.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    open_ = rows.groupBy("g").agg(F.min("component").alias("__low"), F.max("component").alias("__high")).where("__low <> __high").select("g")
    # A large group is dealt to SALTS tasks: what is known of a group has a copy for each.
    salt, every = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    family = saved(rows.select("g", "b", "component", salt).join(open_.select("g", every), ["g", "salt"], "left_semi"), "families")
    blocks = family.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).select("g", "blocks", every)
    held = family.join(blocks, ["g", "salt"]).drop("salt").join(sketches.toDF("b", "n", "sketch"), "b").withColumn("own", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = held.withColumn("other", F.explode(F.filter(every, lambda k: k >= F.col("own")))).select("g", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "b", "component", "n", "sketch")
    right = held.withColumn("other", F.explode(F.filter(every, lambda k: k < F.col("own")))).select("g", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "b", "component", "n", "sketch")
    limit = (den - num) / den + EPS

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        least = min(map(len, block["sketch"]))
        bits = np.stack([_folded(x, least) for x in block["sketch"]]).view("<u8")
        name, component, n, side = (block[c].to_numpy() for c in ("b", "component", "n", "side"))
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if (side == 1).any() else first
        if block["i"].iloc[0] != block["j"].iloc[0] and not (side == 1).any():
            second = second[:0]
        found = []
        for k in first:
            differ = np.maximum(np.bitwise_count(bits[second] ^ bits[k]).sum(axis=1, dtype=np.int64), np.abs(n[second] - n[k]))
            near = second[(2 * differ <= limit * (n[second] + n[k] + differ)) & (component[second] != component[k])]
            found.append(np.stack([np.minimum(name[near], name[k]), np.maximum(name[near], name[k])], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for batch in batches:
            for key, part in batch.groupby(["g", "i", "j"], sort=False):
                if key != at and held:
                    yield meet(pd.concat(held, ignore_index=True))
                    held = []
                at = key
                held.append(part)
        if held:
            yield meet(pd.concat(held, ignore_index=True))

    return left.unionAll(right).repartition(partitions, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links of den * |r and s| >= num * |r or s|), row for row.

    A null or empty text, or one without words, has 0 shingles, no link and itself as component; fewer words than `width` make
    one shingle. Documents of equal sets link, whatever their number. Rows that share a doc_id are one document of the
    components. A row whose doc_id is null takes no part: its component is null. An empty table gives an empty result. Other columns
    aren't read, whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    table = saved(shingle_table(own, "d", "t", width), "shingles")
    rows = table.where("kind = 0")
    classes = saved(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")).withColumnRenamed("b", "fb"), "classes")
    total = classes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    many = max(LEAST, SHARE * rows.count())
    often = table.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > many).orderBy(F.desc("n"), "a").limit(FREQUENT).select("a").toPandas()["a"]
    frequent = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(np.uint64)))
    all_bands = bands(2 * (total["most"] or 1))
    parts = max(partitions(spark), (total["n"] or 0) // PART + 1)
    index = _index(own, frequent, all_bands, parts, num, den, width, "d", "t").repartition(parts, "part").sortWithinPartitions("part")
    groups = saved(_groups(index, num, den), "groups")
    pairs = saved(groups.where("kind = 0").select("a", "b").distinct(), "pairs")
    touched = pairs.select("a").unionAll(pairs.select("b")).unionAll(groups.where("kind = 1").select("b")).distinct()
    met = classes.join(touched, "a", "left_semi").select("n", "a", "fb", F.col("rep").alias("doc_id"))
    sketches = saved(rows.withColumnRenamed("b", "fb").join(met, ["n", "a", "fb", "doc_id"], "left_semi").select("a", "n", "sketch").dropDuplicates(["a"]), "sketches")
    verified = _checked(own, classes, sketches, pairs, num, den, width)
    linked = _linked(verified, num, den)
    left = saved(_open_pairs(groups.where("kind = 1").select("g", "b").distinct(), sketches, linked.select("a", "b"), parts, num, den).join(verified.select("a", "b"), ["a", "b"], "left_anti"), "open-pairs")
    linked = linked.unionAll(_linked(saved(_verified(own, classes, left, num, den, width), "verified"), num, den))
    names = classes.select("a", "rep")
    by_class = linked.join(names.toDF("a", "ra"), "a").join(names.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # Members join their class by its least doc_id; a doc_id of several rows joins all their classes.
    member = rows.where("doc_id IS NOT NULL").select("doc_id", "n", "a", F.col("b").alias("fb")).join(classes, ["n", "a", "fb"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    member = saved(member, "members")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    split = member.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(by_class.unionAll(split))
    out = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    none = rows.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    drop_saved(spark, groups, pairs)
    return out.unionAll(none)
