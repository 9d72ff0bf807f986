"""Operators on small fixtures with known results."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import joins as J
from quarry.operators import lookup as L
from quarry.operators import windows as W
from quarry.streaming.burst import FRESH, Burst, replay, sane


def test_search_bands(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["retry", "Ret", "@retry", "r_e_t", "other", "return"])], "seq int, name string")
    got = [(r["name"], r["band"]) for r in L.ranked_search(rows, "ret", ["seq"]).collect()]
    assert got == [("Ret", 0), ("retry", 1), ("return", 1), ("@retry", 2), ("r_e_t", 3)]
    assert L.ranked_search(rows, "", ["seq"]).count() == 0
    assert L.ranked_search(rows, "a.b", ["seq"]).count() == 0


def test_fallback_takes_a_record_whole(spark):
    rows = spark.createDataFrame([("foo", "a"), ("bar", "z"), ("baz", "q")], "name string, scope string")
    records = spark.createDataFrame([(1, "foo", "a", None), (2, "foo", "", 7), (3, "bar", "", 5), (4, "bar", "", 6)], "seq int, name string, scope string, size int")
    out = J.fallback_lookup(rows, records, [["name", "scope"], ["name"]], ["seq"], ["seq", "size"])
    got = {r["name"]: (r["record"], r["level"]) for r in out.collect()}
    assert got["foo"][0]["seq"] == 1 and got["foo"][0]["size"] is None and got["foo"][1] == 0
    assert got["bar"][0]["seq"] == 3 and got["bar"][1] == 1
    assert got["baz"] == (None, None)


def test_paths_stop_at_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (8, 9, "x"), (9, 8, "y")], "id int, parent_id int, name string")
    assert {r["node"]: r["path"] for r in J.resolve_paths(nodes).collect()} == {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 8: ["y", "x"], 9: ["x", "y"]}


def test_paths_have_any_depth(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(150)] + [(500, 501, "x"), (501, 500, "y"), (600, 999, "z")], "id int, parent_id int, name string")
    assert {r["node"]: r["path"] for r in J.resolve_paths(nodes).collect()} == {i: [f"n{k}" for k in range(i + 1)] for i in range(150)} | {500: ["y", "x"], 501: ["x", "y"], 600: ["z"]}


def test_body_ends_and_absorbed_locals(spark):
    rows = spark.createDataFrame(
        [("f", 0, "label", 0), ("f", 1, "cheap_local", 2), ("f", 2, "label", 5), ("f", 3, "segment", 7), ("f", 4, "cheap_local", 9)], "uri string, seq int, kind string, line int"
    ).withColumn("last", F.lit(12))
    edge = F.col("kind").isin("label", "segment")
    ends = {r["seq"]: r["body_end"] for r in W.body_ends(rows, ["uri"], ["seq"], edge, "line", "line", "last").collect()}
    assert ends[0] == 4 and ends[2] == 6 and ends[4] == 12
    owners = {r["seq"]: r["owner"] for r in W.absorb(rows, ["uri"], ["seq"], edge, F.col("kind") == "label", F.col("seq")).collect()}
    assert owners == {0: None, 1: 0, 2: None, 3: None, 4: None}  # a segment owns nothing


def test_comment_above(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["; one", "; two", "a:", "b:", "; three", "", "c:"])], "uri string, line int, t string")
    got = {r["line"]: r["comment"] for r in W.comment_above(lines, ["uri"], "line", F.col("t").startswith(";"), F.regexp_replace("t", "^; ?", "")).collect()}
    assert got == {2: "one\ntwo", 3: None, 5: "three", 6: None}


def test_shared_depth(spark):
    pairs = spark.createDataFrame([("a/b/x.s", "a/b/y.s", 2), ("a/b/x.s", "a/c/y.s", 1), ("x.s", "y.s", 0), ("a/x.s", "b/x.s", 0), ("a/b/c", "a/z/c", 1)], "p string, q string, want int")
    assert all(r["d"] == r["want"] for r in pairs.withColumn("d", W.shared_depth(F.col("p"), F.col("q"))).collect())


def plain_nearest(rows):
    """(key, anchor, depth) by comparing all rows of a name; rows are (key, name, path)."""
    out = []
    most = {}
    for a, n, p in rows:
        for b, m, q in rows:
            if None not in (a, b, p, q) and n == m and a != b:
                x, y = p.split("/")[:-1], q.split("/")[:-1]
                d = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
                most[a] = max(d, most.get(a, 0))
                out.append((b, a, d))
    return sorted(r for r in out if r[2] == most[r[1]])


def test_nearest_by_path_holds_the_plain_version(spark, monkeypatch):
    """Repeated keys and rows, empty segments, nulls, and folders that are dealt to several tasks."""
    rows = [(1, "x", "a/b/x"), (1, "x", "a/c/x"), (2, "x", "a/b/x"), (2, "x", "a/b/x"), (3, None, None), (None, "x", "a/b/x"), (4, "", ""), (5, "", ""), (6, "", "/"), (7, "", "//"), (8, "x", "x"), (9, "x", "//x"), (10, "x", "é/x"), (11, "y", "a/b/y")]
    rows += [(20 + i % 40, f"n{i % 3}", "/".join(["", "a", "b"][i * k % 3] for k in range(i % 6)) + f"/n{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "k long, name string, path string")
    for most in (W.FOLDER_ROWS, 4):
        monkeypatch.setattr(W, "FOLDER_ROWS", most)
        assert sorted(map(tuple, W.nearest_by_path(df, "k", "name", "path").select("k", "anchor", "depth").collect())) == plain_nearest(rows)


def test_proximity_of_a_common_name_takes_no_square(spark, tmp_path):
    """12,000 pages of one name, two in a folder: 144 million pairs to compare, 12,000 to return."""
    import time

    from quarry.plans.catalog import QUERIES

    spark.range(12_000).selectExpr("id AS page_id", "concat('http://h/', id div 2, '/') AS url").write.parquet(str(tmp_path / "pages.parquet"))
    began = time.time()
    got = {r["anchor"]: (r["page_id"], r["depth"]) for r in QUERIES["proximity"](spark, str(tmp_path)).collect()}
    assert got == {i: (i ^ 1, 4) for i in range(12_000)}
    assert time.time() - began < 60


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "uri string, sig int")
    new = spark.createDataFrame([("b", 2), ("c", None), ("d", 1)], "uri string, sig int")
    assert sorted(tuple(r) for r in J.snapshot_diff(old, new, ["uri"], ["sig"]).collect()) == [("a", "deleted"), ("b", "modified"), ("d", "created")]


def test_scalars(spark):
    row = spark.createDataFrame([("0x1F", "12", "1+2+30", "2.5h", "2024-01-02T03:04:05Z", "a\nb\r\nc")], "h string, d string, ids string, back string, iso string, t string")
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    got = row.select(X.hex_value(F.col("h")), X.hex_value(F.col("d")), X.id_list(F.col("ids")), X.when_of(F.col("back"), now), X.when_of(F.col("iso"), now), X.address_text(F.lit(0x822))).first()
    assert list(got) == [31, 12, [1, 2, 30], dt.datetime(2024, 1, 1, 9, 30), dt.datetime(2024, 1, 2, 3, 4, 5), "$0822"]
    assert [r["content"] for r in X.lines_of(row, [], "t").collect()] == ["a", "b", "c"]


CASES = [
    ([(0, "count"), (1, "count"), (2, "count")], [False, False, True], 0),
    ([(0, "count"), (1, "count"), (2, "reset"), (3, "count"), (4, "count"), (5, "count")], [False, False, False, False, False, True], 0),
    ([(0, "count"), (1, "count"), (2, "count"), (3, "count"), (4, "count"), (5, "count"), (6, "count")], [False, False, True, False, False, False, False], 4),
    ([(0, "count"), (1, "count"), (2, "count"), (3, "count"), (4, "count"), (5, "count"), (130, "count")], [False, False, True, False, False, False, True], 0),
    ([(0, "count"), (1, "count"), (602, "count"), (603, "count")], [False] * 4, 2),
]


@pytest.mark.parametrize("events, denied, count", CASES)
def test_burst_rule(spark, events, denied, count):
    rows = [("s", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), k) for i, (t, k) in enumerate(events)]
    rows += [("other", i, dt.datetime(2024, 1, 1), None) for i in range(2)]
    df = spark.createDataFrame(rows, "session string, id int, ts timestamp, kind string")
    got = sorted((r["id"], r["denied"], r["burst"]) for r in replay(df, Burst(), "session", "ts", ["id"], "kind").where("session = 's'").collect())
    assert [g[1] for g in got] == denied and got[-1][2] == count


def test_malformed_state():
    assert sane((2, 5.0, 1.0), 10.0) == (2, 5.0, 1.0)
    for bad in ((-1, 5.0, 1.0), ("x", 1, 1), (1, 500.0, 1.0), (1, float("nan"), 1.0), ()):
        assert sane(bad, 10.0) == FRESH


def test_streaming_burst(spark, tmp_path):
    from quarry.streaming.burst import stream

    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), "count") for t in range(3)]
    spark.createDataFrame(rows, "session string, ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("session string, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = stream(events, Burst(), "session", "ts", "kind").writeStream.format("memory").queryName("denials").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert sorted((r["at"], r["denied"]) for r in spark.table("denials").collect())[-1][1] is True
