"""The operators on edge cases (nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables) and against plain versions."""
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, jaccard, kneser_ney, line_dedup, mixing, packing, quality, token_binary
from quarry.llm.ann import nearest
from quarry.llm.components import components
from quarry.llm.embedding_dedup import near_duplicates
from quarry.llm.shingles import shingle_sets
from quarry.llm.token_counts import token_counts

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))
EDGE = [
    (1, BASE), (2, BASE), (3, BASE.replace("tok30", "other")), (4, ""), (5, None), (6, "one two"), (7, "One  TWO"), (8, "one"), (9, LONG), (10, LONG + " end"),
    (11, " \t\n"), (12, "straße İstanbul Σίσυφος <|endoftext|> 日本語  x\x1cy"), (None, "no id at all"), (None, None), (13, "same row"), (13, "same row"), (13, "other text of one id"),
    (14, "line one of the block that repeats here again\nshort\nline two of the block that repeats here again"),
    (15, "head\nline one of the block that repeats here again\nshort\nline two of the block that repeats here again\ntail"),
]
CLASH = "n_tokens int, kept string, slot int, block string, a int, b int, n int, key int, __doc int, removed int, score int, component int"


def edge(spark, rows=EDGE):
    """The edge rows with columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "s1" if (d or 0) % 3 else None, *[7 if "int" in c else "x" for c in CLASH.split(", ")]) for d, t in rows], f"doc_id long, text string, source string, {CLASH}")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# ---- 1


def plain_components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_jaccard_edges(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(edge(spark)).collect()}
    want = plain_components({d: plain_shingles(t) for d, t in EDGE if d is not None and d != 13})
    for d, t in EDGE:
        if d is None:
            assert (None, len(plain_shingles(t)), None) in got
        else:
            assert (d, len(plain_shingles(t)), 13 if d == 13 else want[d]) in got
    assert jaccard.jaccard_components(edge(spark, [])).count() == 0


def test_jaccard_families_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(150):  # one large group of near copies around the threshold, and strangers that share a passage
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 4), replace=False):
            w[k] = f"x{i}_{k}"
        texts[i] = " ".join(w if i % 3 else [f"y{i}_{k}" for k in range(30)] + base[:25])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_components({d: plain_shingles(t) for d, t in texts.items()})


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 10), st.booleans())
def test_linked_sets_share_an_entry(s, drop, hot):
    r = np.array(sorted(s), np.uint64)
    t = np.sort(np.concatenate([r[drop:], np.arange(1, 1 + drop // 2, dtype=np.uint64)]))
    both = len(np.intersect1d(r, t))
    if not both or 100 * both < 80 * (len(r) + len(t) - both) or (len(r) == len(t) == both):
        return
    frequent = r[::2] if hot else np.zeros(0, np.uint64)
    bands = jaccard.bands(200)
    assert np.intersect1d(jaccard.entries(r, frequent, bands), jaccard.entries(t, frequent, bands)).size
    far = 1 - both / (len(r) + len(t) - both)
    assert jaccard.least_distance(jaccard.sketch(r), jaccard.sketch(t), len(r), len(t)) <= far + 1e-12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x1c é日", max_size=30), min_size=1, max_size=5))
def test_shingles(texts):
    assert [len(s) for s in shingle_sets(texts)] == [len(plain_shingles(t)) for t in texts]


def test_components(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (9, 5), (7, 7), (1, 2), (2, 4), (4, 6), (6, 8), (1, 2)], "a long, b long")
    for few in (0, 2, 100):
        assert {r["node"]: r["component"] for r in components(links, few=few).collect()} == {3: 3, 5: 3, 9: 3, 1: 1, 2: 1, 4: 1, 6: 1, 8: 1}
    assert components(links.limit(0)).count() == 0


# ---- 2, 3, 9


@pytest.fixture(scope="module")
def encoders():
    return {n: (bpe.Encoder(open(P.path(n), encoding="utf-8").read()), Tokenizer.from_file(P.path(n))) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aZ'sé.,!1² \n\t\r\x1c\x85 …—€İŉ<|>日")), st.characters(max_codepoint=0x17F)), max_size=40))
def test_encoder_is_the_library(encoders, text):
    for own, library in encoders.values():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids) and own.count(text) == len(ids)


def test_each_safe_character(encoders):
    """Every safe character alone, between letters, between numbers and at a word's end; the library encodes them in batches."""
    every = [chr(c) for ranges in bpe.safe_classes().values() for a, b in ranges for c in range(a, b + 1)]
    texts = [f"a{c}b 1 {c}{c} 2 {c}x" for c in every]
    for own, library in encoders.values():
        assert sum(own.unsafe(t) is None for t in texts) == len(texts) > 40_000
        for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert own.encode(text) == struct.pack(f"<{len(e.ids)}I", *e.ids), text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aZ'sé.1 \n\t\u3000日本ΣσςİжЖ😀🏽\u0301ก한가\u1112\u1161")), st.characters(codec="utf-8")), max_size=30))
def test_encoder_is_the_library_in_all_scripts(encoders, text):
    for own, library in encoders.values():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids) and own.count(text) == len(ids)


def test_token_counts_edges(spark, encoders):
    got = token_counts(edge(spark), P.path("byte_bpe_50k.json")).select("doc_id", "text", "n_tokens", "kept").collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert r["n_tokens"] == len(encoders["byte_bpe_50k.json"][1].encode(r["text"] or "", add_special_tokens=False).ids) and r["kept"] == "x"
    assert token_counts(edge(spark, []), P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=20), st.integers(0, 3))
def test_segment_round_trip(docs, shrink):
    docs = [[i >> (8 * shrink) for i in d] for d in docs]
    s = token_binary.Segment(token_binary.segment(list(range(len(docs))), [struct.pack(f"<{len(d)}I", *d) for d in docs]))
    assert [s.document(i).tolist() for i in range(len(docs))] == docs
    flat = [i for d in docs for i in d]
    assert [s.at(i) for i in range(len(flat))] == flat and s.slice(3, 11).tolist()[: len(flat[3:11])] == flat[3:11]


def test_rank_directory():
    ids = np.random.default_rng(1).integers(0, 2**17, 5000).astype(np.uint32)
    s = token_binary.Segment(token_binary.segment([None], [ids.tobytes()]))
    assert s.doc_ids == [None] and all(s.at(i) == ids[i] for i in range(0, 5000, 37)) and (s.slice(777, 3333) == ids[777:3333]).all()


def test_token_binary_edges(spark, encoders, tmp_path):
    library = encoders["word_bpe_49k.json"][1]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_binary.token_binary(edge(spark), P.path("word_bpe_49k.json"), 2).collect())
    rows = sorted(((d is not None, d or 0, t is not None, t or "", d, t) for d, t in EDGE), key=lambda r: r[:4])
    start = 0
    for (at, d, n, crc), (*_, doc, text) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (at, d, n, crc) == (start, doc, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += n
    assert token_binary.token_binary(edge(spark, []), P.path("word_bpe_49k.json"), 2).count() == 0
    path = f"file://{tmp_path}/store"
    token_binary.write_token_segments(edge(spark), P.path("word_bpe_49k.json"), path, 2)
    flat = [i for *_, text in rows for i in [*library.encode(text or "", add_special_tokens=False).ids, 2]]
    places = [0, 1, 5, 700, 60_000, len(flat) - 1, len(flat), -1]
    got = {r["place"]: r["id"] for r in token_binary.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()}
    assert got == {p: flat[p] for p in places if 0 <= p < len(flat)}
    assert sum((r["ids"] for r in sorted(token_binary.read_token_segments(spark, path, with_ids=True).collect(), key=lambda r: r["start"])), []) == flat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_two_fit(lengths):
    bins = packing.best_two_fit(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= max(1, 2 * -(-sum(lengths) // 64)) if lengths else not bins


def plain_two_fit(lengths, capacity):
    """The rule by lists: fill greedily with the longest that fits, then let the two tightest take the smallest one's place."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own = []
        while fits := [n for n in left if n <= capacity - sum(own)]:
            own.append(fits[0])
            left.remove(fits[0])
        gap = capacity - sum(own) + own[-1]
        if gap > own[-1]:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if own[-1] < a + b <= gap]
            if pairs:
                _, a, b = max(pairs)
                left = sorted([n for n in left if n not in (a, b)] + [n for k in {a, b} for n in [k] * (left.count(k) - [a, b].count(k))] + [own.pop()], reverse=True)
                own += [a, b]
        bins.append(own)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_best_two_fit_is_the_plain_one(lengths):
    assert [[lengths[i] for i in b] for b in packing.best_two_fit(lengths, 40)] == plain_two_fit(lengths, 40)


def test_two_replace_the_smallest():
    assert sorted(map(sorted, ([[6, 4, 3, 3][i] for i in b] for b in packing.best_two_fit([6, 4, 3, 3], 12)))) == [[3, 3, 6], [4]]


def test_packing_edges(spark, encoders):
    library = encoders["word_bpe_49k.json"][1]
    got = packing.pack_documents(edge(spark), P.path("word_bpe_49k.json"), 1, 4096).collect()
    want = Counter()
    for d, t in EDGE:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want[d, k, at, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(edge(spark, []), P.path("word_bpe_49k.json")).count() == 0


# ---- 4


def plain_schedule(own, slots):
    """Earliest deadline first among the released blocks, one slot after the other."""
    total, done, out = sum(own), [0] * len(own), []
    for t in range(slots):
        _, i = min((-(-(done[i] + 1) * total // e), i) for i, e in enumerate(own) if done[i] * total // e <= t)
        out.append(i)
        done[i] += 1
    return out


@pytest.mark.parametrize("weights, slots", [({"a": 1, "b": 2}, 5000), ({"a": 0.5, "b": 0.31, "c": 0.17, "d": 0.02}, 5000), ({"a": 1e6, "b": 1}, 5000), ({f"s{i}": (i + 1) ** 0.5 for i in range(20)}, 100_000)])
def test_schedule_is_the_plain_one(spark, weights, slots):
    """The segments together are one plain schedule, and each source stays within one block of the weight that was asked for."""
    whole = mixing.whole_weights(weights)
    got = [i for r in mixing.schedule(spark, list(whole.values()), slots).orderBy("j").collect() for i in r["took"]]
    assert got == plain_schedule(list(whole.values()), slots)
    seen = np.cumsum(np.arange(len(whole))[:, None] == np.array(got), axis=1)
    target = np.array(list(weights.values()))[:, None] / sum(weights.values()) * np.arange(1, slots + 1)
    assert np.abs(seen - target).max() < 1 + 1e-6


def test_mixing_edges(spark):
    rows = [(i, "t", s) for i, s in enumerate(["big"] * 400 + ["small"] * 50 + [None] * 30)] + [(3, "t", "big"), (None, None, "small")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, slot int")
    got = mixing.mix_sources(docs, {"big": 0.5, "small": 0.25, None: 0.25}, block_docs=5).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    by_slot = {r["slot"]: r["source"] for r in got}
    first = [by_slot[s] for s in range(20)]  # all three sources last that long
    assert first.count("big") == 10 and first.count("small") == 5
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    one = mixing.mix_sources(spark.createDataFrame([(i, "s") for i in range(10_000)], "doc_id long, source string"), block_docs=7).collect()
    assert sorted(r["slot"] * 7 + r["place"] for r in one) == list(range(10_000))
    many = spark.range(30_000).selectExpr("id AS doc_id", "concat('host', id % 1500) AS source")
    assert mixing.mix_sources(many, block_docs=2).select("slot", "place").distinct().count() == 30_000
    kept = mixing.mix_sources(docs, out=("b", "s", "p")).collect()
    assert all(r["slot"] == 7 for r in kept) and len({(r["s"], r["p"]) for r in kept}) == len(rows)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"big": -1}).count()


# ---- 5


def test_quality_edges(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "kltmnprs" for b in ("ana", "ero", "ilo", "umi", "ota")]

    def text(kind, i):
        w = list(rng.choice(vocabulary, 40))
        if kind == 0:
            return " ".join(f"{x.upper()}!!" for x in w)
        if kind == 1:
            w[5:35:6] = ["rude", "nasty", "rude", "nasty", "rude"]
        return " ".join(w)

    kinds = [i % 4 for i in range(1200)]
    docs = spark.createDataFrame([(i, text(min(k, 2), i)) for i, k in enumerate(kinds)] + [(None, "x"), (-1, None), (-2, ""), (-2, ""), (-3, LONG)], "doc_id long, text string").withColumn("kept", F.lit("old"))
    rated = labels(spark, [(i, int(k > 0), int(k == 1)) for i, k in enumerate(kinds[:800])] + [(None, 1, 1), (5, None, 1), (9999, 1, 0)])
    model = quality.fit_quality(docs, quality.grades_of(rated))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert docs.count() == quality.score_quality(docs, model).count()
    held = range(800, 1200)
    assert np.mean([got[i]["kept"] == (kinds[i] >= 2) for i in held]) > 0.97
    assert all(0 <= r["p_top"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    assert len(quality.features("a \x00 \ud800")) and quality.features(None).tolist() == quality.features("  ").tolist()
    none = quality.fit_quality(docs, quality.grades_of(rated.limit(0)))
    assert quality.score_quality(docs, none).where("kept").count() == docs.count()
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_the_fit_is_a_maximum():
    """No small step away from the fitted weights and thresholds makes the rated sample more likely."""
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.concatenate([rng.choice(40, 6), [100 + g] if rng.random() < 0.8 else [], [200] if g == 2 and rng.random() < 0.5 else []]).astype(np.uint32)) for g in grades]
    model = quality.fit(rows, grades, 2, least_z=0)
    x = np.array([[k in set(r.tolist()) for k in model.keys] for r in rows], float)

    def cost(w, theta):
        tail = np.hstack([np.ones((len(rows), 1)), 1 / (1 + np.exp(theta - (x @ w)[:, None])), np.zeros((len(rows), 1))])
        own = np.arange(len(rows))
        return -np.log(tail[own, grades] - tail[own, grades + 1]).mean() + quality.RIDGE / 2 * (w**2).sum()

    best = cost(model.weights, model.thresholds)
    for _ in range(200):
        assert cost(model.weights + rng.normal(size=len(model.weights)) * 0.02, model.thresholds + rng.normal(size=2) * 0.02) > best - 1e-4
    assert len(model.keys) > 2 and [model.score(r) for r in rows] == pytest.approx((x @ model.weights).tolist())


# ---- 6


def plain_model(texts, order):
    single, grams = Counter(), {order: Counter()}
    for t in texts:
        tokens = [*words(t), "\0end"]
        single.update(tokens)
        padded = ["\0start"] * (order - 1) + tokens
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(tokens)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {k: kneser_ney.discounts([sum(c == n for c in grams[k].values()) for n in (1, 2, 3, 4)]) for k in grams}
    after = defaultdict(lambda: [0, 0, 0, 0])
    for k in grams:
        for g, c in grams[k].items():
            after[k, g[:-1]][0] += c
            after[k, g[:-1]][min(c, 3)] += 1

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / (len(single) + 1)
        if (k, gram[:-1]) not in after:
            return lower
        total, *n = after[k, gram[:-1]]
        c = grams[k][gram]
        return max(c - d[k][min(c, 3)], 0) / total + sum(x * y for x, y in zip(d[k][1:], n)) / total * lower

    return single, p


def test_language_model_holds_its_arrays_once(monkeypatch):
    """Texts are gathered to the bound and a quarter, not to twice the bound; sorting needs less than two more copies of its columns."""
    import tracemalloc

    import pandas as pd

    monkeypatch.setattr(kneser_ney, "FLUSH", 1000)
    batches = [pd.DataFrame({"t": ["abcdefghi " * 10] * 500}) for _ in range(3)]
    sizes = [int(b["t"].str.len().sum()) for b in kneser_ney._gathered(iter(batches), "t")]
    assert sum(sizes) == 150_000 and max(sizes) <= 1.25 * kneser_ney.CHARS * 1000
    blobs = [kneser_ney._pack(np.arange(300_000, dtype=np.uint64) * 3, np.full(300_000, k, np.uint64), np.ones(300_000, np.int64)) for k in range(4)]
    rows = pd.DataFrame({"part": [0] * 4, "blob": blobs})
    held = []

    class Rows:
        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return list(run(iter([rows])))

    def work(part, *columns):
        held.append((tracemalloc.get_traced_memory()[0], [len(c) for c in columns], int(columns[-1].sum())))
        yield part

    tracemalloc.start()
    kneser_ney._by_part(Rows(), 1, work)
    (now, lengths, total), most = held[0], tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths == [1_200_000] * 3 and total == 1_200_000
    assert now < 1.1 * 24 * 1_200_000 and most < 2.5 * 24 * 1_200_000, (now, most)


@pytest.mark.parametrize("order", (2, 3))
def test_language_model_is_the_plain_one(spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "FLUSH", 500)
    monkeypatch.setattr(kneser_ney, "PART", 900)
    rng = np.random.default_rng(9)
    train = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 60) % 50)) for i in range(120)] + [(500, None), (501, ""), (502, "w1 w2 " * 400)]
    model = kneser_ney.train(spark.createDataFrame(train, "doc_id long, text string"), order=order)
    single, p = plain_model([t for _, t in train], order)
    got = kneser_ney.score(edge(spark, EDGE + [(20, "W1 w2 w3 w1 unseen w2 w1 w2"), *train[:40]]), model).collect()
    total, v = sum(single.values()), len(single)
    assert len(got) == len(EDGE) + 41
    for r in got:
        tokens = [*words(r["text"]), "\0end"]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(single[t] > 0 for t in tokens) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((single[t] + 0.1) / (total + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
        padded = ["\0start"] * (order - 1) + tokens
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(tokens))), rel=1e-9)
    for context in (("w1", "w2"), ("\0start", "\0start"), ("w7", "unseen")):
        assert sum(p((*context[3 - order :], w)) for w in single) + p((*context[3 - order :], "unseen")) == pytest.approx(1)


def test_language_model_without_training(spark):
    model = kneser_ney.train(edge(spark, []))
    got = kneser_ney.score(edge(spark), model).collect()
    assert len(got) == len(EDGE) and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert kneser_ney.score(edge(spark, []), model).count() == 0


# ---- 7, 10


def vectors(spark, extra=()):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.05 * rng.normal(size=16)], i % 3) for i in range(600)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, [], 0), (2005, [1.0, 2.0], 0), (2006, [1.0, 2.1], 0), (None, rows[1][1], 1), (2007, rows[1][1], None), (2100, rows[5][1], 2), (2100, rows[5][1], 2)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, n int")


def fine(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_nearest_neighbours(spark):
    rows, df = vectors(spark)
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    hits = total = 0
    for q, v, _ in rows:
        if q is None or q % 50 or not fine(v):
            continue
        best = sorted((math.dist(v, w), i) for i, w, _ in rows if i is not None and i != q and fine(w) and len(w) == len(v))[:10]
        own = sorted(got[q])
        copies = sum(i == q for i, _, _ in rows)
        if copies > 1:
            continue
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1)) and own == sorted(own, key=lambda x: (x[1], x[2]))
        assert all(s == pytest.approx(math.dist(v, next(w for i, w, _ in rows if i == n)), abs=1e-12) for _, s, n in own)
        hits += len({n for _, _, n in own} & {i for _, i in best})
        total += len(best)
    assert hits / total >= 0.9
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_neighbours_among_dense_groups(spark):
    """Most vectors lie in groups of near copies; the isolated ones find their neighbours all the same, and so do the groups' own."""
    rng = np.random.default_rng(5)
    copies = np.repeat(rng.normal(size=(3, 64)), 1600, axis=0) + 0.2 * rng.normal(size=(4800, 64))
    x = np.concatenate([copies, rng.normal(size=(3200, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 40 == 0, k=10).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = {True: [], False: []}
    for q in range(0, len(x), 40):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        recall[q < 4800].append(len(got[q] & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(recall[False]) >= 0.9 and np.mean(recall[True]) >= 0.9, {k: np.mean(v) for k, v in recall.items()}


def test_embedding_dedup_is_exact(spark):
    rows, df = vectors(spark)
    got = near_duplicates(df, 0.93).collect()
    assert len(got) == len(rows)
    links, parent = defaultdict(int), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v) / np.linalg.norm(v) if fine(v) else None for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[x] = y
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least[find(i)], r[0])
    want = Counter((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert near_duplicates(df.limit(0)).count() == 0


# ---- 8


def plain_lines(rows, least=line_dedup.MIN_WORDS):
    """(texts without the lines of runs that copy a first place line by line, lines of all maximal repeated runs of `least` words).

    The first by windows of 1, 2, 4, ... lines, joined where they meet and copy the same lines. The second compares every place with
    every earlier one.
    """
    rows = sorted(rows)
    own = [(d, t.split("\n")) for d, t in rows]
    count = lambda lines: sum(len([w for w in re.split(r"[ \t\r\f\x0B]+", x) if w]) for x in lines)
    first, gone = {}, defaultdict(set)
    for d, lines in own:
        copied = defaultdict(set)
        for i in range(len(lines)):
            size = 1
            while i + size <= len(lines):
                place = first.setdefault((size, tuple(lines[i : i + size])), (d, i))
                if place != (d, i):
                    copied[place[0], i - place[1]] |= set(range(i, i + size))
                size *= 2
        for which in copied.values():
            for i in which:
                if i - 1 not in which:
                    end = i
                    while end in which:
                        end += 1
                    if count(lines[i:end]) >= least:
                        gone[d] |= set(range(i, end))
    every, places = defaultdict(set), [(d, lines, i) for d, lines in own for i in range(len(lines))]
    for n, (d, x, i) in enumerate(places):
        for _, y, j in places[:n]:
            m = 0
            while i + m < len(x) and j + m < len(y) and x[i + m] == y[j + m]:
                m += 1
            if m and count(x[i : i + m]) >= least:
                every[d] |= set(range(i, i + m))
    cut = lambda which: {d: "\n".join(x for i, x in enumerate(lines) if i not in which[d]) for d, lines in own}
    return cut(gone), every, gone


def test_line_dedup_edges(spark):
    got = line_dedup.line_dedup(edge(spark)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] == BASE and by[2]["text"] == "" and by[2]["n_removed"] == 1
    assert by[15]["text"] == "head\ntail" and by[15]["removed"] == "1-4" and by[14]["n_removed"] == 0
    assert by[5]["text"] is None and by[5]["n_lines"] == 0 and by[4]["text"] == "" and by[4]["n_lines"] == 1
    assert line_dedup.line_dedup(edge(spark, [])).count() == 0


def test_line_dedup_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"v{i}_{k}" for k in range(n)) for i, n in enumerate(rng.integers(0, 12, 40))]
    rows = [(i, "\n".join(lines[k] for k in rng.choice(40, rng.integers(1, 9)))) for i in range(40)]
    rows += [(100, "one two three\na b c\nx y z"), (101, "one two three\na b c\nx y z"), (102, "a b c\nx y z")]  # short lines: a run counts as a whole
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, every, gone = plain_lines(rows)
    assert got == want and got[101] == "" and got[102] == "a b c\nx y z"
    # Against a search of all maximal repeated runs: nothing else goes, and nearly all of them do (a run whose parts were seen apart may stay).
    assert all(gone[d] <= every[d] for d in gone) and sum(map(len, gone.values())) >= 0.98 * sum(map(len, every.values()))


def test_line_dedup_keeps_other_columns(spark):
    rows = line_dedup.line_dedup(edge(spark), out=("lines_n", "lines_gone", "lines_which")).collect()
    assert all(r["__doc"] == 7 and r["removed"] == 7 and r["kept"] == "x" for r in rows) and {r["lines_gone"] for r in rows} > {0}


# ---- queries with SQL against it; no operator changes the session; the pipeline runs end to end

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("op1_ngram_jaccard", "op8_line_dedup", "op10_embedding_dedup"))
def test_queries_hold_their_sql(spark, name):
    import duckdb

    from quarry.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_session_settings_stay(spark):
    from quarry.llm.queries import QUERIES

    before = dict(spark.conf.getAll)
    late = QUERIES["op3_token_binary"](spark, SF)  # lazy; another operator is built in between
    QUERIES["op2_token_counts"](spark, SF).count()
    QUERIES["op5_quality_classifier"](spark, SF).count()
    assert late.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and dict(spark.conf.getAll) == before


def test_pipeline_runs(spark, tmp_path):
    """run() on the smallest tables: each kept document's pieces are its tokens after line dedup, in gapless sequences."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library, by, room = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in room.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    from quarry.llm.quality import fit_quality, grades_of, score_quality

    table = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    fine = {r["doc_id"] for r in score_quality(table("documents"), fit_quality(table("documents"), grades_of(table("labels")))).where("kept").collect()}
    left, _, gone = plain_lines([(d, docs[d]) for d in fine if docs[d] is not None])
    left = {d: t for d, t in left.items() if not gone[d] or len(gone[d]) < len(docs[d].split("\n"))}
    groups = plain_components({d: plain_shingles(t) for d, t in left.items()})
    assert set(by) == {d for d in left if groups[d] == d}
    for d, pieces in by.items():
        ids = library.encode(left[d], add_special_tokens=False).ids + [1]
        assert sorted(pieces) == [(k, at, len(ids[at : at + 4096]), zlib.crc32(struct.pack(f"<{len(ids[at : at + 4096])}I", *ids[at : at + 4096]))) for k, at in enumerate(range(0, len(ids), 4096))]



def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rows = EDGE + [(100 + i, f"document number {i} " + " ".join(f"z{i}_{k}" for k in range(50))) for i in range(30)]
    spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 2}", len(t or ""), 1, 2) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, slot int").withColumns({c: F.lit(9) for c in ("__doc", "__key", "__sum", "__spans", "place", "removed", "__q_kept")}).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(1, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        before, docs = docs, spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        assert docs.count() <= before.count()
    kept = {r["doc_id"] for r in docs.collect()}
    assert all(r[c] == 9 for r in docs.collect() for c in ("__doc", "__key", "__sum", "__spans", "place", "removed", "__q_kept"))
    assert {100 + i for i in range(30)} <= kept and 1 in kept and 2 not in kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == kept
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_packs_in_the_order_of_the_mix(spark, tmp_path):
    """Each prefix of the sequences holds the target shares while all sources last, whatever the lengths and the rows' order."""
    import corpus_pipeline

    sizes = {"a": 6400, "b": 1600, None: 400}  # targets 80 : 40 : 20
    rows = [(s, "word " * (300 if s == "b" else 20 + i % 90)) for s, n in sizes.items() for i in range(n)]
    spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents"))
    corpus_pipeline.mixing(spark, spark.read.parquet(str(tmp_path / "documents")), str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    pieces = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in pieces) == list(range(len(rows)))
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append(rows[r["doc_id"]][0])
    seen, worst = Counter(), []
    for s in sorted(held):
        seen.update(held[s])
        n = sum(seen.values())
        if n >= 400 and max(seen[k] / size for k, size in sizes.items()) < 0.9:
            worst.append(max(abs(seen[k] / n - w) for k, w in (("a", 4 / 7), ("b", 2 / 7), (None, 1 / 7))))
    assert len(worst) > 50 and max(worst) < 0.08, (len(worst), max(worst))


def test_pipeline_packs_in_the_order_of_the_rows(spark, tmp_path, monkeypatch):
    """What mixing decides takes effect: packing follows the rows as they were written, through many files, and computes no schedule."""
    import corpus_pipeline

    n = 5000
    order = [int(i) for i in np.random.default_rng(6).permutation(n)]
    mixed = spark.createDataFrame([(i, k, "word " * (1 + i % 90), f"s{i % 3}") for k, i in enumerate(order)], "doc_id long, k long, text string, source string")
    monkeypatch.setattr(corpus_pipeline, "MIX_PIECES", 200)
    for way, files, conf in (("sorted", 12, {}), ("cut", 3, {"maxRecordsPerFile": 301})):
        mixed.repartitionByRange(files, "k").sortWithinPartitions("k").drop("k").write.options(**conf).parquet(str(tmp_path / way))
        docs = spark.read.parquet(str(tmp_path / way))
        assert len(docs.inputFiles()) > files - 1
        pieces = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
        blocks = defaultdict(set)
        for r in pieces:
            blocks[r["sequence_id"] >> 32].add(r["doc_id"])
        assert [blocks[b] for b in sorted(blocks)] == [set(order[at : at + 200]) for at in range(0, n, 200)]
    pieces = corpus_pipeline.packing(spark, mixed.orderBy("k").drop("k"), str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces if r["sequence_id"] >> 32 == 0} == set(order[:200])


# ---- shared


def test_chains_take_few_rounds(spark):
    n, rounds = 2000, []
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = components(links, rounds, few=0).collect()
    assert len(got) == n and {r["component"] for r in got} == {0} and len(rounds) <= 15
    # One task may finish at any point: at the start, after some rounds, or never.
    rounds.clear()
    assert sorted(components(links, rounds, few=300).collect()) == sorted(got) and rounds and 0 < rounds[-1] <= 300
    assert sorted(components(links).collect()) == sorted(got)


def test_nearest_neighbours_with_ties_and_offsets(spark):
    """Hundreds of equal distances give the smallest ids; a common offset costs no neighbours."""
    eye = np.eye(64)
    rows = [(0, [0.5] + [0.0] * 63)] + [(i, (eye[0] * 0.5 + (1 if i % 2 else -1) * eye[1 + i % 63]).tolist()) for i in range(1, 600)]
    far = np.random.default_rng(3).normal(size=(600, 64)) + 1e8
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(far)]
    by = dict(rows)
    for part in (rows[:600], rows[600:]):
        got = defaultdict(list)
        for r in nearest(spark.createDataFrame(part, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=10).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        hits = 0
        for q, found in got.items():
            x = np.array([by[i] for i, _ in part])
            d = np.sqrt(((x - np.array(by[q])) ** 2).sum(axis=1))
            want = sorted((s, i) for s, (i, _) in zip(d.tolist(), part) if i != q)[:10]
            found.sort()
            assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
            hits += len({i for _, i, _ in found} & {i for _, i in want})
            if q == 0:
                assert [i for _, i, _ in found] == [i for _, i in want] == list(range(1, 11))
        assert hits >= 9 * len(got)
