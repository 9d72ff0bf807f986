"""The registered queries over the driver's tables, and the SQL that checks them.

Each binds a generic operator to columns of the tables. A few constants name values that every scale of the tables has.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import joins as J
from quarry.operators import lookup as L
from quarry.operators import reports as R
from quarry.operators import windows as W
from quarry.streaming.burst import Burst, replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- lookups and search


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#4'")
def lookup_exact(spark, sf_dir):
    return L.lookup(read(spark, sf_dir, "part"), "Brand#4", "p_brand").select("p_partkey", "p_name")


@query(
    """SELECT p_partkey, p_name, band FROM (
         SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') THEN 1
           WHEN contains(lower(p_name), 'ring') THEN 2 WHEN regexp_matches(lower(p_name), '(?s)r.*i.*n.*g') THEN 3 END::INTEGER AS band FROM part)
       WHERE band IS NOT NULL ORDER BY band, p_partkey LIMIT 50"""
)
def ranked_search(spark, sf_dir):
    return L.ranked_search(read(spark, sf_dir, "part"), "Ring", ["p_partkey"], 50, "p_name").select("p_partkey", "p_name", "band")


@query(
    """SELECT min(p_partkey) AS p_partkey, p_name, min(p_brand) AS p_brand FROM (
         SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY band, p_partkey) AS n FROM (
           SELECT p_partkey, p_name, p_brand, CASE WHEN lower(p_name) = 'bolt' THEN 0 WHEN starts_with(lower(p_name), 'bolt') THEN 1
             WHEN contains(lower(p_name), 'bolt') THEN 2 WHEN regexp_matches(lower(p_name), '(?s)b.*o.*l.*t') THEN 3 END AS band FROM part)
         WHERE band IS NOT NULL)
       WHERE n <= 5 GROUP BY p_name, p_brand"""
)
def search_per_root(spark, sf_dir):
    best = L.top_per_root(read(spark, sf_dir, "part"), "p_brand", "bolt", ["p_partkey"], 5, ["p_brand", "p_name"], "p_name")
    return best.select("p_partkey", "p_name", "p_brand")


@query(
    """SELECT doc_id, line, ordinal, name FROM (
         SELECT doc_id, line, unnest(names) AS name, unnest(range(0, len(names)))::INTEGER AS ordinal FROM (
           SELECT doc_id, line, regexp_extract_all(content, '@?[A-Za-z_][A-Za-z0-9_]*') AS names FROM (
             SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line FROM documents)))"""
)
def tokenize_refs(spark, sf_dir):
    return X.identifiers_of(X.lines_of(read(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "line"])


@query(
    """WITH refs AS (SELECT unnest(regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents),
       defs AS (SELECT s_name, regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*') AS w FROM (SELECT item_id AS s_name, text FROM benchmark)),
       d AS (SELECT name, count(*) AS defs FROM (SELECT unnest(w) AS name FROM defs) GROUP BY name),
       r AS (SELECT name, count(*) AS refs FROM refs GROUP BY name)
       SELECT name, defs, refs, defs * refs AS score FROM d JOIN r USING (name) ORDER BY score DESC, name LIMIT 5"""
)
def top_referenced(spark, sf_dir):
    words = lambda t: read(spark, sf_dir, t).select(F.explode(F.regexp_extract_all("text", F.lit(X.IDENTIFIER), F.lit(0))).alias("name"))
    return J.top_referenced(words("benchmark"), words("documents"))


# ---- joins


@query(
    """WITH s AS (SELECT s_suppkey, s_nationkey AS nation, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][1 + s_suppkey % 5] AS segment FROM supplier),
       c AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey AS nation, c_mktsegment AS segment FROM customer),
       a AS (SELECT nation, segment, min(c_custkey) AS k FROM c GROUP BY nation, segment),
       b AS (SELECT nation, min(c_custkey) AS k FROM c GROUP BY nation),
       r AS (SELECT s_suppkey, coalesce(a.k, b.k, (SELECT min(c_custkey) FROM c)) AS k, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 ELSE 2 END::INTEGER AS level
             FROM s LEFT JOIN a ON s.nation = a.nation AND s.segment = a.segment LEFT JOIN b ON s.nation = b.nation)
       SELECT s_suppkey, level, c.c_custkey, c.c_name, c.c_acctbal FROM r JOIN c ON c.c_custkey = r.k"""
)
def fallback_enrich(spark, sf_dir):
    segments = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.element_at(segments, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("segment"))
    records = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    out = J.fallback_lookup(rows, records, [["nation", "segment"], ["nation"], []], ["c_custkey"], ["c_custkey", "c_name", "c_acctbal"])
    return out.select("s_suppkey", "level", "record.*")


def _places(spark, sf_dir) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"))
    return region.unionAll(nation).unionAll(customer)


_PLACES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
walk AS (SELECT id, name AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, w.path || '::' || n.name FROM walk w JOIN nodes n ON n.parent_id = w.id)"""


@query(f"WITH RECURSIVE {_PLACES} SELECT id AS node, path FROM walk")
def scope_paths(spark, sf_dir):
    return J.resolve_paths(_places(spark, sf_dir)).select("node", F.array_join("path", "::").alias("path"))


@query(f"WITH RECURSIVE {_PLACES} SELECT id AS node, path FROM walk WHERE path = 'ASIA::NATION_2' OR starts_with(path, 'ASIA::NATION_2::')")
def scope_prefix(spark, sf_dir):
    paths = J.resolve_paths(_places(spark, sf_dir))
    return paths.where(L.scope_matches(F.col("path"), F.array(F.lit("ASIA"), F.lit("NATION_2")))).select("node", F.array_join("path", "::").alias("path"))


@query(
    """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')"""
)
def export_anti(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.without_definition(read(spark, sf_dir, "orders").select("o_orderkey"), returned, ["o_orderkey"])


@query("SELECT c_custkey, c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def import_export(spark, sf_dir):
    importers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return J.imports_of(importers, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query(
    """SELECT name, text_id, doc_id, ordinal FROM (
         SELECT w AS name, item_id AS text_id, NULL::BIGINT AS doc_id, o::INTEGER AS ordinal FROM (SELECT item_id, unnest(regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*')) AS w, unnest(range(0, len(regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*')))) AS o FROM benchmark)
         UNION ALL
         SELECT w, NULL, doc_id, o::INTEGER FROM (SELECT doc_id, unnest(regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*')) AS w, unnest(range(0, len(regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*')))) AS o FROM documents))
       WHERE name = 'the'"""
)
def references_of(spark, sf_dir):
    words = lambda t, key: read(spark, sf_dir, t).select(key, F.posexplode(F.regexp_extract_all("text", F.lit(X.IDENTIFIER), F.lit(0))).alias("ordinal", "name"))
    defs = words("benchmark", "item_id").select("name", F.col("item_id").alias("text_id"), F.lit(None).cast("long").alias("doc_id"), "ordinal")
    refs = words("documents", "doc_id").select("name", F.lit(None).cast("long").alias("text_id"), "doc_id", "ordinal")
    return L.references(defs.unionAll(refs), "the")


@query(
    """WITH texts AS (SELECT 'documents' AS place, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)
       SELECT place, id, line, 'renamed' AS new_text, count(*) AS n FROM (
         SELECT place, id, line, unnest(regexp_extract_all(content, '@?[A-Za-z_][A-Za-z0-9_]*')) AS name FROM (
           SELECT place, id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line FROM texts))
       WHERE name = 'the' GROUP BY place, id, line"""
)
def rename_edits(spark, sf_dir):
    names = lambda t, key: X.identifiers_of(X.lines_of(read(spark, sf_dir, t).select(F.lit(t).alias("place"), F.col(key).alias("id"), "text"), ["place", "id"]), ["place", "id", "line"])
    sites = J.rename_sites(names("benchmark", "item_id"), names("documents", "doc_id"), "the", "renamed", ["place", "id", "line", "ordinal"])
    return sites.groupBy("place", "id", "line", "new_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
       b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
       SELECT o_orderkey, change FROM (
         SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'deleted'
           WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'modified' END AS change
         FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL"""
)
def refresh_diff(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < TIMESTAMP '2000-01-01'")
    new = orders.where("o_orderdate >= TIMESTAMP '1996-01-01'").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return J.snapshot_diff(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey, 'old' AS version FROM orders),
       fresh AS (SELECT o_orderkey, o_custkey, 'new' AS version FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus <> 'P')
       SELECT * FROM a WHERE o_custkey % 10 <> 3 UNION ALL SELECT * FROM fresh"""
)
def upsert_files(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = orders.where("o_custkey % 10 = 3").select("o_custkey")
    fresh = orders.where("o_custkey % 10 = 3 AND o_orderstatus <> 'P'").drop("o_orderstatus").withColumn("version", F.lit("new"))
    return J.upsert_files(orders.drop("o_orderstatus").withColumn("version", F.lit("old")), changed, fresh, "o_custkey")


# ---- ranges

_SPANS = """spans AS (
  SELECT user_id, event_id AS span_id, ts AS start_ts, CASE WHEN event_id % 2 = 0 THEN lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) ELSE lead(ts, 6) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS end_ts, event_type FROM events
), closed AS (SELECT user_id, span_id, start_ts, end_ts FROM spans WHERE end_ts IS NOT NULL AND event_type IN ('signup', 'purchase'))"""


def _spans(spark, sf_dir) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start_ts"), F.when(F.col("event_id") % 2 == 0, F.lead("ts", 2).over(by)).otherwise(F.lead("ts", 6).over(by)).alias("end_ts"), "event_type")
    return events.where("end_ts IS NOT NULL AND event_type IN ('signup', 'purchase')").drop("event_type")


@query(
    f"""WITH {_SPANS}, hit AS (
          SELECT e.event_id, c.span_id, row_number() OVER (PARTITION BY e.event_id ORDER BY date_diff('microsecond', c.start_ts, c.end_ts), c.span_id) AS n
          FROM events e JOIN closed c ON e.user_id = c.user_id AND e.ts >= c.start_ts AND e.ts < c.end_ts)
        SELECT e.event_id, e.user_id, h.span_id FROM events e LEFT JOIN hit h ON e.event_id = h.event_id AND h.n = 1"""
)
def smallest_enclosing(spark, sf_dir):
    points = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    width = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))
    return J.smallest_enclosing(points, _spans(spark, sf_dir), ["user_id"], "ts", "start_ts", "end_ts", ["event_id"], width, ["span_id"]).select("event_id", "user_id", "span_id")


@query(
    f"""WITH {_SPANS} SELECT a.span_id AS inner_id, b.span_id AS outer_id FROM closed a JOIN closed b ON a.user_id = b.user_id
        WHERE a.start_ts >= b.start_ts AND a.end_ts <= b.end_ts AND NOT (a.start_ts = b.start_ts AND a.end_ts = b.end_ts)"""
)
def strict_inside(spark, sf_dir):
    a, b = _spans(spark, sf_dir).alias("a"), _spans(spark, sf_dir).alias("b")
    within = L.strictly_inside(F.col("a.start_ts"), F.col("a.end_ts"), F.col("b.start_ts"), F.col("b.end_ts"))
    return a.join(b, F.col("a.user_id") == F.col("b.user_id")).where(within).select(F.col("a.span_id").alias("inner_id"), F.col("b.span_id").alias("outer_id"))


# ---- order-dependent operators

_ITEMS = """items AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq FROM lineitem)"""


def _items(spark, sf_dir) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(by)).select("l_orderkey", "l_returnflag", "l_partkey", "seq")


@query(
    f"""WITH {_ITEMS} SELECT l_orderkey, seq::INTEGER AS seq, min(CASE WHEN l_returnflag = 'N' THEN seq END) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::INTEGER AS next_boundary FROM items"""
)
def next_boundary(spark, sf_dir):
    out = W.next_boundary(_items(spark, sf_dir), ["l_orderkey"], ["seq"], F.col("l_returnflag") == "N", F.col("seq"))
    return out.select("l_orderkey", "seq", "next_boundary")


@query(
    f"""WITH {_ITEMS}, n AS (SELECT l_orderkey, seq, count(*) OVER (PARTITION BY l_orderkey) AS last, min(CASE WHEN l_returnflag = 'N' THEN seq END) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM items)
        SELECT l_orderkey, seq::INTEGER AS seq, greatest(least(coalesce(nb - 1, last), last), seq)::INTEGER AS body_end FROM n"""
)
def body_ends(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).cast("int"))
    return W.body_ends(items, ["l_orderkey"], ["seq"], F.col("l_returnflag") == "N", "seq", "seq", "last").select("l_orderkey", "seq", "body_end")


@query(
    f"""WITH {_ITEMS}, b AS (SELECT *, max(CASE WHEN l_returnflag IN ('N', 'R') THEN seq END) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM items)
        SELECT b.l_orderkey, b.seq::INTEGER AS seq, CASE WHEN b.l_returnflag = 'A' AND o.l_returnflag = 'N' THEN o.seq END::INTEGER AS owner
        FROM b LEFT JOIN items o ON o.l_orderkey = b.l_orderkey AND o.seq = b.last"""
)
def absorb_children(spark, sf_dir):
    flag = F.col("l_returnflag")
    return W.absorb(_items(spark, sf_dir), ["l_orderkey"], ["seq"], flag.isin("N", "R"), flag == "N", F.col("seq")).select("l_orderkey", "seq", "owner")


@query(
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, min(substr(o_orderpriority, 1, 1)) OVER (PARTITION BY o_custkey) AS best FROM orders) WHERE substr(o_orderpriority, 1, 1) = best"""
)
def tier_preference(spark, sf_dir):
    return W.best_tier(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey"], F.substring("o_orderpriority", 1, 1))


@query(
    """WITH p AS (SELECT page_id, url, list_last(string_split(url, '/')) AS name, string_split(url, '/') AS s FROM pages),
       d AS (SELECT a.page_id AS anchor, b.page_id, coalesce(len(list_filter(range(1, least(len(a.s), len(b.s))), lambda i: a.s[:i] = b.s[:i])), 0)::INTEGER AS depth FROM p a JOIN p b ON a.name = b.name AND a.page_id <> b.page_id)
       SELECT page_id, anchor, depth FROM (SELECT *, max(depth) OVER (PARTITION BY anchor) AS most FROM d) WHERE depth = most"""
)
def proximity(spark, sf_dir):
    """Pages of one name, as symbols of one name in several files: those that share most of each page's path."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.element_at(F.split("url", "/", -1), -1).alias("name"))
    return W.nearest_by_path(pages, "page_id", "name", "url").select("page_id", "anchor", "depth")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    return L.first_of(read(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line FROM documents),
       m AS (SELECT *, length(content) < 60 AS short FROM l),
       b AS (SELECT *, coalesce(sum(CASE WHEN NOT short THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM m),
       c AS (SELECT doc_id, g, string_agg(content, chr(10) ORDER BY line) AS comment FROM b WHERE short GROUP BY doc_id, g)
       SELECT b.doc_id, b.line, c.comment FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.g = c.g WHERE NOT b.short"""
)
def comment_block(spark, sf_dir):
    lines = X.lines_of(read(spark, sf_dir, "documents"), ["doc_id"])
    return W.comment_above(lines, ["doc_id"], "line", F.length("content") < 60, F.col("content")).select("doc_id", "line", "comment")


# ---- reports


@query(
    """WITH e AS (SELECT user_id, event_type, event_id // 10 AS session FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_type <> 'error')
       SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click,
              count(*) FILTER (event_type = 'signup') AS signup, count(DISTINCT session) AS sessions, grouping(user_id)::TINYINT AS is_total,
              count(*) FILTER (event_type = 'purchase') / nullif(count(*), 0)::DOUBLE AS share
       FROM e GROUP BY ROLLUP (user_id)"""
)
def usage_report(spark, sf_dir):
    calls = read(spark, sf_dir, "events").withColumn("session", F.expr("event_id div 10"))
    bucket = F.when(F.col("event_type") != "error", F.col("event_type"))
    day = lambda d: F.to_timestamp(F.lit(d))
    return R.usage_report(calls, "user_id", bucket, "session", day("2024-01-05"), day("2024-01-20"), "ts", ["purchase", "view", "click", "signup"])


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type")
def usage_by_tool(spark, sf_dir):
    return R.most_common(read(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT sum(n - 1)::BIGINT AS extra, sum(n)::BIGINT AS total, sum(n - 1) / sum(n)::DOUBLE AS rate FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_rate(spark, sf_dir):
    return R.duplicate_rate(read(spark, sf_dir, "documents"), ["text"])


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '@?[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
       SELECT (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FROM documents) AS symbols, (SELECT count(*) FROM w) AS "references" """
)
def index_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    refs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(X.IDENTIFIER), F.lit(0))).alias("name"))
    return R.index_stats(docs.select(F.col("source").alias("uri")), refs)


@query(
    """WITH RECURSIVE e AS (
         SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type IN ('view', 'click') THEN 'count' WHEN event_type = 'purchase' THEN 'reset' END AS kind,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       f AS (
         SELECT user_id, event_id, n, false AS denied, 0::INTEGER AS burst, '-infinity'::DOUBLE AS seen, '-infinity'::DOUBLE AS deny, 0 AS step FROM (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n FROM e)
         UNION ALL
         SELECT user_id, event_id, n, kind IS NOT DISTINCT FROM 'count' AND c >= 3 AND t - deny >= 21600,
                CASE WHEN kind IS NULL THEN burst WHEN kind = 'reset' THEN 0 WHEN c >= 3 AND t - deny >= 21600 THEN 0 ELSE c END::INTEGER,
                CASE WHEN kind IS NOT DISTINCT FROM 'count' THEN t ELSE seen END, CASE WHEN kind IS NOT DISTINCT FROM 'count' AND c >= 3 AND t - deny >= 21600 THEN t ELSE deny END, 0
         FROM (SELECT f.user_id, e.event_id, e.n, e.kind, e.t, f.burst, f.seen, f.deny, CASE WHEN e.t - f.seen > 172800 THEN 1 ELSE f.burst + 1 END AS c FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
       SELECT event_id, user_id, denied, burst FROM f WHERE n > 0"""
)
def burst_rule(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "count").when(F.col("event_type") == "purchase", "reset")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"))
    rule = Burst(gap=172800.0, quiet=21600.0, least=3)  # the table's events are hours apart
    return replay(events, rule, "user_id", "ts", ["event_id"], "kind").select("event_id", "user_id", "denied", "burst")


# ---- scalar functions


@query("SELECT page_id, sha256(concat_ws(chr(0), url, length(html)::VARCHAR)) AS key FROM pages")
def content_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.content_key(F.col("url"), F.length("html")).alias("key"))


@query("SELECT l_orderkey, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey")
def id_list_parse(spark, sf_dir):
    packed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), "+").alias("ids"))
    return packed.select("l_orderkey", F.explode(X.id_list(F.col("ids"))).alias("id")).groupBy("l_orderkey", "id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_points FROM documents")
def byte_vs_char(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_points"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def uri_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(X.path_of_uri(F.col("url")), F.lit("")).alias("path"))


@query("SELECT p_partkey, '$' || lpad(printf('%X', p_partkey * 17), greatest(4, length(printf('%X', p_partkey * 17)))::INTEGER, '0') AS address, p_brand || '::' || p_type || '::' || p_name AS qualified FROM part")
def address_detail(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.address_text(F.col("p_partkey") * 17).alias("address"), X.qualified_name(F.array("p_brand", "p_type"), F.col("p_name")).alias("qualified"))


# ---- the assembly index, over a project written from the tables: a file for each order, which calls its line items' parts and the next order


def _project(spark, sf_dir) -> DataFrame:
    calls = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: F.concat(F.lit("  lda part_"), p)), "\n").alias("body"))
    own = read(spark, sf_dir, "orders").select("o_orderkey").join(calls, "o_orderkey", "left")
    text = F.concat(F.lit(".import p"), F.col("o_orderkey") + 1, F.lit("\n.export p"), "o_orderkey", F.lit("\n; one order\n.proc p"), "o_orderkey", F.lit("\n  jsr p"), F.col("o_orderkey") + 1, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n.endproc\n"))
    return own.select(F.concat(F.lit("orders/o"), "o_orderkey", F.lit(".s")).alias("uri"), text.alias("text"))


@query(
    """SELECT 'orders/o' || o_orderkey || '.s' AS uri, 2::BIGINT AS n_symbols, 2 + count(l_orderkey)::BIGINT AS n_references
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
)
def asm_index(spark, sf_dir):
    from quarry.sources import project

    rows = project.index(_project(spark, sf_dir))
    count = lambda what: F.count(F.when(F.col("what") == what, 1))
    return rows.groupBy("uri").agg(count("symbol").alias("n_symbols"), count("reference").alias("n_references"))


@query(
    """SELECT o.o_orderkey AS id, 'orders/o' || coalesce(n.o_orderkey, o.o_orderkey) || '.s' AS uri, CASE WHEN n.o_orderkey IS NULL THEN 'import' ELSE 'proc' END AS kind
       FROM orders o LEFT JOIN orders n ON n.o_orderkey = o.o_orderkey + 1"""
)
def asm_definitions(spark, sf_dir):
    from quarry.plans import intel
    from quarry.sources import project

    files = _project(spark, sf_dir)
    key = F.col("o_orderkey")
    cursors = read(spark, sf_dir, "orders").select(key.alias("id"), F.concat(F.lit("orders/o"), key, F.lit(".s")).alias("uri"), F.lit(4).alias("line"), F.concat(F.lit("p"), key + 1).alias("name"))
    return intel.definitions(cursors, project.symbols(files), project.exports(files)).select("id", "uri", "kind")


def _cursors(spark, sf_dir) -> DataFrame:
    """A cursor on the call of the next order in each file."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(key.alias("id"), F.concat(F.lit("orders/o"), key, F.lit(".s")).alias("uri"), F.lit(4).alias("line"), F.lit(3).alias("character"))


@query("SELECT o_orderkey AS id, 'p' || (o_orderkey + 1) AS name, 6 AS from_char, (7 + length((o_orderkey + 1)::VARCHAR))::INTEGER AS to_char FROM orders")
def asm_cursors(spark, sf_dir):
    from quarry.plans import intel

    return intel.named(_cursors(spark, sf_dir), _project(spark, sf_dir)).select("id", "name", "from_char", "to_char")


_SITES = """calls AS (
         SELECT o_orderkey AS id, 'p' || (o_orderkey + 1) AS name FROM orders),
       sites AS (
         SELECT 'p' || (o_orderkey + 1) AS name, 'orders/o' || o_orderkey || '.s' AS uri, 4 AS r_sl FROM orders UNION ALL
         SELECT 'p' || o_orderkey, 'orders/o' || o_orderkey || '.s', 1 FROM orders)"""


@query(f"WITH {_SITES} SELECT id, uri, r_sl FROM calls JOIN sites USING (name)")
def asm_references(spark, sf_dir):
    from quarry.plans import intel
    from quarry.sources import project

    rows, cursors = project.index(_project(spark, sf_dir)), _cursors(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), F.col("id") + 1))
    return intel.references_at(cursors, project.symbols_in(rows), project.references_in(rows)).select("id", "uri", "r_sl")


@query(
    f"""WITH {_SITES}, places AS (
         SELECT * FROM sites UNION ALL SELECT 'p' || (o_orderkey + 1), 'orders/o' || o_orderkey || '.s', 0 FROM orders UNION ALL SELECT 'p' || o_orderkey, 'orders/o' || o_orderkey || '.s', 3 FROM orders)
       SELECT id, uri, r_sl, 'renamed' AS new_text FROM calls JOIN places USING (name)"""
)
def asm_rename(spark, sf_dir):
    from quarry.plans import intel
    from quarry.sources import project

    rows, cursors = project.index(_project(spark, sf_dir)), _cursors(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), F.col("id") + 1))
    return intel.rename_at(cursors, project.symbols_in(rows), project.references_in(rows), "renamed").select("id", "uri", "r_sl", "new_text")


@query("SELECT o_orderkey AS id, '**p' || o_orderkey || '** (proc)' || chr(10) || chr(10) || 'one order' AS markdown FROM orders")
def asm_hover(spark, sf_dir):
    from quarry.plans import intel
    from quarry.sources import project

    files = _project(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    symbols = project.symbols(files).withColumns({"address": none("long"), "segment": none("string"), "size": none("long")})
    own = symbols.where("kind = 'proc'").select(F.substring("name", 2, 20).cast("long").alias("id"), "name", "uri", "kind", "seq", F.col("s_sl").alias("line"))
    return intel.hover(own, symbols, X.lines_of(files, ["uri"])).select("id", "markdown")


@query("SELECT kind, count(*) AS n FROM (SELECT 'import' AS kind FROM orders UNION ALL SELECT 'proc' FROM orders) GROUP BY kind")
def asm_kinds(spark, sf_dir):
    from quarry.sources import project

    return R.by_kind(project.symbols(_project(spark, sf_dir)))


@query(
    """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER () // 60) AS step FROM orders)
       SELECT o_orderkey FROM n WHERE i % step = 0 AND i < 60 * step"""
)
def systematic_sample(spark, sf_dir):
    return R.systematic_sample(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'grep' WHEN 2 THEN NULL ELSE 'read' END AS kind FROM part"""
)
def shell_kinds(spark, sf_dir):
    from quarry.functions.shell import command_kinds

    path = F.concat(F.lit("src/part_"), F.col("p_partkey"), F.lit(".s"))
    forms = [F.concat(F.lit("for f in "), path, F.lit("; do head $f; done")), F.concat(F.lit("find . -name '*.s' | xargs grep "), "p_brand"), F.concat(F.lit("sed -i s/a/b/ "), path), F.concat(F.lit('echo "$(cat '), path, F.lit(')"'))]
    command = F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int"))
    return command_kinds(read(spark, sf_dir, "part").select("p_partkey", command.alias("command"))).select("p_partkey", "kind")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'left' WHEN l_linenumber % 3 = 0 THEN 'right' END AS root FROM lineitem")
def deepest_root(spark, sf_dir):
    from quarry.sources import project

    uri = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "work/a/deep/").when(F.col("l_linenumber") % 3 == 0, "work/a/").otherwise("else/"), F.lit("x.s"))
    rows = project.with_root(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", uri.alias("uri")), ["work/a", "work/a/deep"])
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("root") == "work/a/deep", "left").when(F.col("root") == "work/a", "right").alias("root"))
