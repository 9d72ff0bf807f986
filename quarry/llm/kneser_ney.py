"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, kept as sorted arrays, mapped into memory by workers.

Word hashes of the training texts, sorted, are the vocabulary; a word's id is its place in it. A pair of words is the number
first * (V + 1) + second; id V stands for what is before a text (order - 1 times). Counts are gathered in each task, sorted and
summed in numpy, and dealt out by ranges of the pair that hold about equal shares of the tokens, so that a frequent word is
split over several parts and all parts together are one sorted array. A triple goes with its first pair, so each part holds
whole contexts; what it passes on are the second pairs of its different triples, whose numbers are the counts of the lower order.
Each part is written as files, which scoring maps and searches by bisection:

* pairs: 40 bits from the part's first key (64 where they don't do), the count, and for order 3 the facts of the pair as a context;
* triples: 40 bits of a hash in the order of the hash, and the count. A part holds some million triples, so that a triple that training
  has not is taken for another one with a chance below one in a hundred thousand, and different ones keep separate entries.

p(w | u v) = max(c(uvw) - D3(c(uvw)), 0) / c(uv.) + gamma(uv) p(w | v), with gamma from what the discounts take away;
p(w | v) likewise, where order 3 counts the different words before a pair (order 2 its occurrences);
p(w) = max(m(w) - D1(m(w)), 0) / M + gamma1 / (V + 1) with m(w) the number of different words before w and M the sum of m.
Discounts for counts 1, 2 and 3 or more come from each order's counts of counts. A context that training has not is left out.
"""
from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import partitions, saved, scratch_path, sliced
from quarry.llm.shared_files import make_folder, mapped, mapped_arrays, write_array, write_arrays
from quarry.llm.shingles import mix, word_hashes

ORDER = 3
#: Hash of the end of a text; no word has it but by chance.
END = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a task gathers before it sorts and hands on, about; texts scored at once hold half as many.
FLUSH = 1 << 20
#: Characters of a token, about.
CHARS = 6
#: Tokens that a part of the count holds, about.
PART = 1 << 22
#: Least discount: an unseen word keeps a chance even where counts of counts are degenerate.
LEAST = 0.05
LOW = np.uint64((1 << 40) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of entries counted once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * more / this if this else 0.0 for k, this, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0] + [min(max(d, LEAST), k - LEAST) for k, d in enumerate(raw, 1)])


def triple_hashes(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(mix(pairs + np.uint64(1)) ^ (words.astype(np.uint64) * _ODD)) & LOW


# ---- arrays of a part's files


def _counts(n: np.ndarray) -> list[np.ndarray]:
    """Counts as one byte each, 255 for those that follow with their places."""
    much = np.flatnonzero(n >= 255)
    return [np.minimum(n, 255).astype("u1"), much.astype("<u8"), n[much].astype("<u8")]


def _count_at(arrays: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    small, places, values = arrays
    out = small[at].astype(np.int64)
    much = np.flatnonzero(out == 255)
    if len(much):
        out[much] = values[np.searchsorted(places, at[much])].astype(np.int64)
    return out


def _facts(total: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(total, n1, n2, n3 or more) of the runs of n that begin at `first`."""
    return np.stack([total, *(np.add.reduceat((n == k) if k < 3 else n >= 3, first, dtype=np.int64) for k in (1, 2, 3))], axis=1)


def _coded(facts: np.ndarray) -> list[np.ndarray]:
    """Rows of facts as a number each into a table of different rows; most contexts share a few."""
    small = (facts < 1 << 16).all(axis=1)
    packed = facts[small].astype(np.uint64) @ np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64)
    rows, code = np.unique(packed, return_inverse=True)
    table = np.concatenate([np.stack([(rows >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)], axis=1).astype("<i8"), facts[~small].astype("<i8")])
    out = np.empty(len(facts), np.int64)
    out[small], out[~small] = code, len(rows) + np.arange(int((~small).sum()))
    return [out.astype("<u2" if len(table) <= 1 << 16 else "<u4"), table.ravel()]


def _forty(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted numbers below 2^40 as 32 and 8 bits; larger ones as they are."""
    if len(keys) and keys[-1] > LOW:
        return [keys.astype("<u8"), np.zeros(0, "u1")]
    return [(keys >> np.uint64(8)).astype("<u4"), (keys & np.uint64(255)).astype("u1")]


def _find(arrays: list[np.ndarray], want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each of the wanted numbers."""
    high, low = arrays
    if not len(high):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    if high.dtype.itemsize == 8:
        at = np.minimum(np.searchsorted(high, want), len(high) - 1)
        return at, high[at] == want
    first, rest = (want >> np.uint64(8)).astype("<u4"), (want & np.uint64(255)).astype("u1")
    at = np.searchsorted(high, first)
    found, open_ = np.zeros(len(want), bool), np.arange(len(want))
    while len(open_):  # over the few entries that share 32 bits
        here = at[open_]
        same = (here < len(high)) & (high[np.minimum(here, len(high) - 1)] == first[open_]) & (want[open_] <= LOW)
        open_, here = open_[same], here[same]
        hit = low[here] == rest[open_]
        found[open_[hit]] = True
        open_ = open_[~hit]
        at[open_] += 1
    return np.minimum(at, len(high) - 1), found


# ---- arrays on their way


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the fewest bytes a number that hold them all, byte planes one after the other, compressed."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        kind = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k))
        planes = np.ascontiguousarray(a.astype(f"<u{kind}").view("u1").reshape(-1, kind).T).tobytes()
        body = pa.compress(planes, codec="zstd", asbytes=True)
        out += [kind.to_bytes(1, "little"), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _arrays(blob: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(blob[0]):
        kind, n, size = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little"), int.from_bytes(blob[at + 9 : at + 17], "little")
        planes = pa.decompress(blob[at + 17 : at + 17 + size], decompressed_size=n * kind, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(kind, n).T).reshape(-1).view(f"<u{kind}").astype(np.uint64))
        at += 17 + size
    return out


def _pack(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys as steps, and other columns. With two others, the first is dealt in runs: a key once, then its entries."""
    if len(more) == 1:
        return _blob(keys[:1], np.diff(keys), *more)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return _blob(keys[:1], np.diff(keys[first]), np.diff(np.append(first, len(keys))), *more)


def _unpack(blob: bytes) -> list[np.ndarray]:
    start, steps, *more = _arrays(blob)
    keys = np.cumsum(np.concatenate([start, steps]), dtype=np.uint64)
    if len(more) == 1:
        return [keys, more[0].astype(np.int64)]
    size, word, n = more
    return [np.repeat(keys, size.astype(np.int64)), word.astype(np.uint32), n.astype(np.int64)]


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of keys and at last counts, sorted by the keys, with counts of equal keys added. Empties parts, so that memory holds them once."""
    columns = []
    while parts[0]:
        own = [part.pop(0) for part in parts]
        columns.append(np.concatenate(own) if len(own) > 1 else own[0])
        del own
    parts.clear()
    order = np.argsort(columns[0], kind="stable") if len(columns) == 2 else np.lexsort(columns[-2::-1])
    for k in range(len(columns)):
        columns[k] = columns[k][order]
    del order
    *keys, counts = columns
    del columns
    fresh = np.ones(len(counts), bool)
    if len(counts):
        fresh[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            fresh[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(fresh)
    for k in range(len(keys)):
        keys[k] = keys[k][first]
    return [*keys, np.add.reduceat(counts, first) if len(first) else counts]


def _dealt(part: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """One packed row for each part; the first column is sorted and part rises with it."""
    names, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(part))
    return pd.DataFrame({"part": names.astype(np.int64), "blob": [_pack(*(c[a:b] for c in columns)) for a, b in zip(first, ends)]})


#: Rows of the passes: packed columns for a part, or (blob null) what a part reports: see _report.
_SENT = "part long, blob binary, kind int, low string, n1 long, n2 long, n3 long, n4 long, more long, edges array<array<long>>"
_COLUMNS = [c.split()[0] for c in _SENT.split(", ")]


def _row(**given) -> pd.DataFrame:
    return pd.DataFrame([{c: given.get(c) for c in _COLUMNS}], columns=_COLUMNS, dtype=object)


def _report(kind: int, part: int, n: np.ndarray, low: int, edges=()) -> pd.DataFrame:
    """Of layer `kind`: entries counted once to four times, their number, the first key, and facts of contexts that other parts may share."""
    return _row(part=int(part), kind=kind, low=str(low), more=len(n), edges=[list(map(int, e)) for e in edges], **{f"n{k}": int((n == k).sum()) for k in (1, 2, 3, 4)})


def _sent(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.reindex(columns=_COLUMNS).astype(object).where(lambda x: x.notna(), None)


def _by_part(rows: DataFrame, parts: int, work, schema: str = _SENT) -> DataFrame:
    """work(part, columns) over the summed rows of each part, one part in memory at a time; reports pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for k, (part, blob) in enumerate(zip(batch["part"], batch["blob"])):
                if blob is None:
                    yield _sent(batch.iloc[k : k + 1])
                    continue
                if part != at and held:
                    yield from work(at, *_summed(held))
                at = part
                held.append(_unpack(blob))
                if len(held) == 32:
                    held.append(_summed(held))
        if held:
            yield from work(at, *_summed(held))

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(run, schema)


class _Tokens:
    """Texts as token hashes: the words, then the end."""

    def __init__(self, texts) -> None:
        words, first = word_hashes(list(texts))
        n = np.diff(first)
        self.ends = np.cumsum(n + 1) - 1
        self.hashes = np.empty(len(words) + len(n), np.uint64)
        is_word = np.ones(len(self.hashes), bool)
        is_word[self.ends] = False
        self.hashes[is_word] = words
        self.hashes[self.ends] = END
        self.starts = self.ends - n

    def before(self, ids: np.ndarray, start: int) -> np.ndarray:
        """The id before each, `start` at a text's first token."""
        out = np.empty_like(ids)
        out[1:] = ids[:-1]
        out[self.starts] = start
        return out


def _gathered(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Batches cut and joined to about FLUSH tokens, a quarter more at most unless one text has more."""
    held, size = [], 0
    for batch in sliced(batches, column, CHARS * FLUSH // 4):
        held.append(batch)
        size += int(batch[column].str.len().sum()) + CHARS * len(batch)
        if size >= CHARS * FLUSH:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of passes that are done, which it does for what the driver has collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass
class Model:
    folder: str
    order: int
    vocabulary_sizes: list[int]  # words of each shard; shards go by the hash's highest bits
    tokens: int
    documents: int = 0
    parts: int = 1
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # first key of each part
    edges: dict = field(default_factory=dict)  # context word -> facts where parts share it
    discount: dict = field(default_factory=dict)  # by order
    gamma_below: float = 1.0
    different: int = 0  # M

    @property
    def words(self) -> int:
        return sum(self.vocabulary_sizes)

    @property
    def base(self) -> int:
        return self.words + 1

    @property
    def bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.vocabulary_sizes)]).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 for a word that training has not."""
        out = np.full(len(hashes), -1, np.int64)
        shards = len(self.vocabulary_sizes)
        cut = np.searchsorted((hashes >> np.uint64(48)).astype(np.int64) * shards >> 16, np.arange(shards + 1))
        for k in range(shards):
            want = hashes[cut[k] : cut[k + 1]]
            if len(want) and self.vocabulary_sizes[k]:
                have = mapped(f"{self.folder}/word-{k}.u64", "<u8")
                at = np.searchsorted(have, want)
                at[at == len(have)] = 0
                out[cut[k] : cut[k + 1]] = np.where(have[at] == want, at + self.bases[k], -1)
        return out

    def _by_id(self, ids: np.ndarray, name: str, dtype: str) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.bases)
        for k in range(len(self.vocabulary_sizes)):
            if cut[k] < cut[k + 1]:
                out[cut[k] : cut[k + 1]] = mapped(f"{self.folder}/{name}-{k}", dtype)[ids[cut[k] : cut[k + 1]] - self.bases[k]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted ids (-1: 0)."""
        return self._by_id(ids, "count", "<i8")

    def below(self, ids: np.ndarray) -> np.ndarray:
        """p(w) of sorted ids."""
        floor = self.gamma_below / (self.words + 1)
        if not self.different:
            return np.full(len(ids), floor)
        m = self._by_id(ids, "before", "<i8")
        return np.maximum(m - self.discount[1][np.minimum(m, 3)], 0) / self.different + floor

    def share(self, keys: np.ndarray) -> np.ndarray:
        """The part of sorted pairs: where the pair stands when words are laid out by their counts, first word first."""
        base = np.uint64(self.base)
        a, b = (keys // base).astype(np.int64), (keys % base).astype(np.int64)
        begun = a == self.words
        names, at = np.unique(np.concatenate([a[~begun], b]), return_inverse=True)
        before, own = self._by_id(names, "sum", "<i8")[at], self.counts(names)[at]
        m = int((~begun).sum())
        last = np.where(b == self.words, 0, before[m:])  # the pair of two starts comes first among those of a start
        place = np.empty(len(keys))
        place[~begun] = before[:m] + own[:m] * (last[~begun] / self.tokens)
        place[begun] = self.tokens + self.documents * (last[begun] / self.tokens)
        out = np.minimum(place / (self.tokens + self.documents) * self.parts, self.parts - 1).astype(np.int64)
        return np.maximum.accumulate(out) if len(out) else out

    def _in_parts(self, keys: np.ndarray):
        """(part, from, to) of the runs of sorted pairs in one part."""
        cut = np.append(np.searchsorted(keys, self.cuts[1:]), len(keys)) if len(self.cuts) else []
        start = 0
        for k, end in enumerate(cut):
            if start < end:
                yield k, start, end
            start = end

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted pairs, and (order 3) their facts as contexts: total, n1, n2, n3; zeros for what training has not."""
        n, facts = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        for k, a, b in self._in_parts(keys):
            low, high, rest, code, table = mapped_arrays(f"{self.folder}/pair-{k}")
            want = keys[a:b]
            at, found = _find([high, rest], want - np.where(want >= low[0], low[0], np.uint64(0)))
            found &= want >= low[0]
            *counts, more, times = mapped_arrays(f"{self.folder}/times-{k}")
            own = np.zeros(b - a, np.int64)
            own[found] = _count_at(counts, at[found])
            if len(more):
                also = np.minimum(np.searchsorted(more, want), len(more) - 1)
                own = np.where(more[also] == want, times[also].astype(np.int64), own)
            n[a:b] = own
            if len(code):
                facts[a:b][found] = table.reshape(-1, 4)[code[at[found]]]
        return n, facts

    def triples(self, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of triples, sorted by their pair."""
        out = np.zeros(len(pairs), np.int64)
        for k, a, b in self._in_parts(pairs):
            high, rest, *counts = mapped_arrays(f"{self.folder}/triple-{k}")
            want = triple_hashes(pairs[a:b], words[a:b])
            order = np.argsort(want)
            at, found = _find([high, rest], want[order])
            out[a:b][order[found]] = _count_at(counts, at[found])
        return out

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """(total, n1, n2, n3) of sorted context words in the pairs; zeros for one that training has not."""
        out = np.zeros((len(ids), 4), np.int64)
        if not len(self.cuts):
            return out
        first = (self.cuts // np.uint64(self.base)).astype(np.int64)
        for k in range(len(self.cuts)):
            a = np.searchsorted(ids, first[k])
            b = np.searchsorted(ids, first[k + 1], "right") if k + 1 < len(self.cuts) else len(ids)
            if a < b:
                names, code, table = mapped_arrays(f"{self.folder}/context-{k}")
                if len(names):
                    at = np.minimum(np.searchsorted(names, ids[a:b]), len(names) - 1)
                    hit = names[at] == ids[a:b]
                    out[a:b][hit] = table.reshape(-1, 4)[code[at[hit]]]
        for context, facts in self.edges.items():
            out[ids == context] = facts
        return out


def _vocabulary(own: DataFrame, folder: str, order: int) -> Model:
    """Count the words and write the vocabulary: hashes, counts, and the sums of the counts before each."""
    spark = own.sparkSession
    shards = max(16, min(65536, partitions(spark)))

    def words(batches):
        for batch in _gathered(batches, "t"):
            keys, n = np.unique(_Tokens(batch["t"]).hashes, return_counts=True)
            yield _sent(_dealt((keys >> np.uint64(48)).astype(np.int64) * shards >> 16, keys, n))

    def write_words(part, keys, n):
        write_array(f"{folder}/word-{part}.u64", keys.astype("<u8"))
        write_array(f"{folder}/count-{part}", n.astype("<i8"))
        yield pd.DataFrame({"part": [part], "n": [len(keys)], "tokens": [int(n.sum())]})

    small = saved(_by_part(own.mapInPandas(words, _SENT), shards, write_words, "part long, n long, tokens long"), "words").collect()
    sizes = [0] * shards
    for r in small:
        sizes[r["part"]] = r["n"]
    model = Model(folder, order, sizes, sum(r["tokens"] for r in small))
    # Sums of counts before each word: a shard's own start comes from the totals of those before it.
    starts, total = {}, 0
    for r in sorted(small, key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["tokens"]

    def write_sums(batches):
        for batch in batches:
            for shard in map(int, batch["id"]):
                n = mapped(f"{folder}/count-{shard}", "<i8")
                write_array(f"{folder}/sum-{shard}", (np.cumsum(n) - n + starts[shard]).astype("<i8"))
            yield batch

    if starts:
        spark.createDataFrame([(s,) for s in starts], "id long").repartition(min(len(starts), partitions(spark))).mapInPandas(write_sums, "id long").count()
        model.documents = int(model.counts(model.ids(np.array([END])))[0])
    return model


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count the texts (null: empty) and write the model to the shared folder. The driver holds a few numbers for each part and shard."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = texts.sparkSession
    own = texts.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    folder = scratch_path(spark, "kneser-ney")
    make_folder(folder)
    model = _vocabulary(own, folder, order)
    if not model.tokens:
        return model
    if model.base >= 1 << 32:
        raise ValueError("a vocabulary of 2^32 words: pairs would pass 64 bits")
    _release(spark)
    base = np.uint64(model.base)
    parts = model.parts = max(partitions(spark), model.tokens // PART + 1)

    def gathered(batches):
        """(pair, last word) of each token; for order 2 the pair ends with the word itself."""
        for batch in _gathered(batches, "t"):
            t = _Tokens(batch["t"])
            names, at = np.unique(t.hashes, return_inverse=True)
            ids = model.ids(names)[at]
            del t.hashes, names, at
            first = t.before(ids, model.words)
            if order == 2:
                columns = [first.astype(np.uint64) * base + ids.astype(np.uint64)]
            else:
                columns = [t.before(first, model.words).astype(np.uint64) * base + first.astype(np.uint64), ids.astype(np.uint32)]
            columns.append(np.ones(len(ids), np.int64))
            del t, ids, first
            keys, *rest = _summed([columns])
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
            part = model.share(keys[fresh])[np.cumsum(fresh) - 1]
            del fresh
            yield _sent(_dealt(part, keys, *rest))

    def write_triples(part, pairs, words, n):
        hashes = triple_hashes(pairs, words)
        by = np.argsort(hashes)
        write_arrays(f"{folder}/triple-{part}", *_forty(hashes[by]), *_counts(n[by]))
        del hashes, by
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        keys = pairs[first]
        write_arrays(f"{folder}/pair-{part}", keys[:1].astype("<u8"), *_forty(keys - keys[0]), *_coded(_facts(np.add.reduceat(n, first), n, first)))
        del first, keys
        low = int(pairs[0])
        follow = (pairs % base) * base + words
        del pairs, words
        follow, m = np.unique(follow, return_counts=True)
        yield _sent(_dealt(model.share(follow), follow, m))
        yield _report(3, part, n, low)

    def write_pairs(part, keys, n):
        if order == 2 or int(part) not in held:
            write_arrays(f"{folder}/pair-{part}", keys[:1].astype("<u8"), *_forty(keys - keys[0]), np.zeros(0, "<u2"), np.zeros(0, "<i8"))
        low, high, rest, *_ = mapped_arrays(f"{folder}/pair-{part}")
        at, found = _find([high, rest], keys - np.where(keys >= low[0], low[0], np.uint64(0)))
        found &= keys >= low[0]
        counts = np.zeros(len(high), np.int64)
        counts[at[found]] = n[found]
        write_arrays(f"{folder}/times-{part}", *_counts(counts), keys[~found].astype("<u8"), n[~found].astype("<u8"))
        a, b = (keys // base).astype(np.int64), (keys % base).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        facts = _facts(np.add.reduceat(n, first), n, first)
        write_arrays(f"{folder}/context-{part}", a[first].astype("<i8"), *_coded(facts))
        ends = np.concatenate([a[first][:, None], facts], axis=1)
        yield _report(2, part, n, int(keys[0]), ends[[0, -1]] if len(ends) > 1 else ends[:1])
        followed, m = np.unique(b, return_counts=True)
        yield _sent(_dealt(np.searchsorted(model.bases[1:], followed, "right"), followed.astype(np.uint64), m))

    def write_before(part, keys, m):
        out = np.zeros(model.vocabulary_sizes[part], "<i8")
        out[keys.astype(np.int64) - model.bases[part]] = m
        write_array(f"{folder}/before-{part}", out)
        yield _report(1, part, m, 0).assign(edges=[[[int((m >= 3).sum())]]])

    reports = []
    if order == 3:
        # The pairs of a part are found in the keys that its triples wrote, so the triples' layer comes to its end first.
        layer = saved(_by_part(own.mapInPandas(gathered, _SENT), parts, write_triples), "triples")
        reports += layer.where("blob IS NULL").collect()
        pairs = layer.where("blob IS NOT NULL")
        _release(spark)
    else:
        pairs = own.mapInPandas(gathered, _SENT)
    held = {r["part"] for r in reports}
    reports += saved(_by_part(_by_part(pairs, parts, write_pairs), len(model.vocabulary_sizes), write_before), "reports").collect()
    _release(spark)
    counted = {k: np.zeros(5, np.int64) for k in (1, 2, 3)}
    seen, low, more = {}, {}, 0
    for r in reports:
        counted[r["kind"]] += [r[c] for c in ("n1", "n2", "n3", "n4", "more")]
        if r["kind"] == 1:
            more += r["edges"][0][0]
        else:
            low[r["part"]] = min(int(r["low"]), low.get(r["part"], 1 << 64))
            for a, *facts in r["edges"] or []:
                seen.setdefault(a, []).append(facts)
    model.edges = {a: tuple(map(sum, zip(*rows))) for a, rows in seen.items() if len(rows) > 1}
    # Parts without a key take the next one's first key, so that their range is empty.
    cuts, following = [], (1 << 64) - 1
    for p in reversed(range(parts)):
        following = low.get(p, following)
        cuts.append(following)
    model.cuts = np.array(cuts[::-1], np.uint64)
    model.cuts[0] = 0
    none, byte, short = np.zeros(0, "<u8"), np.zeros(0, "u1"), np.zeros(0, "<u2")
    there = {k: {r["part"] for r in reports if r["kind"] == k} for k in (2, 3)}
    for p in range(parts):
        if p not in there[2] | there[3]:
            write_arrays(f"{folder}/pair-{p}", np.zeros(1, "<u8"), none.astype("<u4"), byte, short, none.astype("<i8"))
        if p not in there[2]:
            n = len(mapped_arrays(f"{folder}/pair-{p}")[1])
            write_arrays(f"{folder}/times-{p}", np.zeros(n, "u1"), none, none, none, none)
            write_arrays(f"{folder}/context-{p}", none.astype("<i8"), short, none.astype("<i8"))
        if order == 3 and p not in there[3]:
            write_arrays(f"{folder}/triple-{p}", none.astype("<u4"), byte, byte, none, none)
    model.discount = {k: discounts(counted[k][:4].tolist()) for k in range(1, order + 1)}
    model.different = int(counted[2][4])
    n1, n2 = (int(x) for x in counted[1][:2])
    d = model.discount[1]
    model.gamma_below = float(d[1] * n1 + d[2] * n2 + d[3] * more) / model.different
    return model


def _given(n: np.ndarray, facts: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The interpolated probability of entries counted n times in contexts with these facts."""
    total = facts[:, 0]
    gamma = np.where(total > 0, (facts[:, 1:] @ discount[1:]) / np.maximum(total, 1), 1.0)
    return np.maximum(n - discount[np.minimum(n, 3)], 0) / np.maximum(total, 1) + gamma * lower


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10), all over the whole text and its end.

    A null text is empty: its one token is the end. A word that training has not follows the floor of the lower order, and as a
    context it gives the lower order whole. With no training text at all every token has probability 1.
    Repeated rows score alike; columns of docs with the added names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a few numbers for each part and shard, and paths; the arrays stay in files

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        base, start = np.uint64(m.base), m.words
        for texts in sliced((b.fillna("") for b in batches), None, CHARS * FLUSH // 2):
            t = _Tokens(texts)
            names, at = np.unique(t.hashes, return_inverse=True)
            ids = m.ids(names)
            order = np.argsort(ids, kind="stable")
            c, p = np.zeros(len(ids), np.int64), np.ones(len(ids))
            if m.tokens:
                c[order], p[order] = m.counts(ids[order]), m.below(ids[order])
            ids, c, p = ids[at], c[at], p[at]
            if m.tokens:
                first = t.before(ids, start)
                known = np.flatnonzero(first >= 0)
                contexts, of = np.unique(first[known], return_inverse=True)
                facts = m.contexts(contexts)[of]
                # All pairs that occur are looked up once; a token's context in triples is the pair that ends before it.
                both = np.flatnonzero((first >= 0) & (ids >= 0))
                own = first[both].astype(np.uint64) * base + ids[both].astype(np.uint64)
                begin = np.uint64(start) * base + np.uint64(start)
                keys, of = np.unique(np.append(own, begin), return_inverse=True)
                times, over = m.pairs(keys)
                n = np.zeros(len(ids), np.int64)
                n[both] = times[of[:-1]]
                p[known] = _given(n[known], facts, m.discount[2], p[known])
                if m.order == 3:
                    place = np.full(len(ids), -1, np.int64)  # of each token's pair in keys
                    place[both] = of[:-1]
                    place = t.before(place, of[-1])
                    known = np.flatnonzero((place >= 0) & (over[place, 0] > 0))
                    n = np.zeros(len(ids), np.int64)
                    both = known[ids[known] >= 0]
                    both = both[np.argsort(place[both], kind="stable")]
                    n[both] = m.triples(keys[place[both]], ids[both].astype(np.uint64))
                    p[known] = _given(n[known], over[place[known]], m.discount[3], p[known])
            plain = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
            sums = [np.add.reduceat(x, t.starts) for x in ((c > 0).astype(np.int64), plain, np.log10(p))] if len(t.starts) else [[], [], []]
            yield pd.DataFrame({"n_tokens": t.ends - t.starts + 1, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    out = docs.withColumn("__scored", run(F.col(text)))
    made = {c: F.col("__scored")[c] for c in ("n_tokens", "n_known", "base_score", "score")}
    return out.withColumns(made | {"train_tokens": F.lit(model.tokens).cast("long")}).drop("__scored")


def held_out(doc_id: Column) -> Column:
    """True for the tenth of the documents that training leaves out; a null doc_id is left out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))
