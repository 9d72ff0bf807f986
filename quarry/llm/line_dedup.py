"""Line dedup: prefix doubling over the corpus' line-id sequences, with DataFrame operations alone.

A line's id is a 128-bit hash. Round k gives every place a name for the 2^k lines that start there: the hash of the names of its
two halves from round k-1. Places of one name are an interval of the suffix array whose longest common prefix is 2^k lines or
more. Only names that occur twice go on, so the sequence of rounds shrinks fast and ends after log2 of the longest repeat.
Any repeated run of m lines is the union of the repeated windows of 2^floor(log2 m) lines in it, so the windows that occur
earlier cover exactly the later copies of the maximal repeated runs. Windows that meet and copy the same earlier lines are one run;
a run counts if it has MIN_WORDS words as a whole. The runs that count are merged and deleted.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import drop_saved, free_names, saved

#: A run counts if it has at least so many words: short lines that meet by chance stay.
MIN_WORDS = 8
#: The places of a name that more than one in HOT of all places has are joined in SALTS parts; there are at most HOT such names.
HOT, SALTS = 2000, 32
PLACE = ["__doc", "__sum", "__i"]
NAME = ["__a", "__b"]
SOURCE = ["__fd", "__fs", "__delta"]


def _name(*parts):
    """Two independent 64-bit hashes of the parts."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def _repeats(level: DataFrame, k: int, least: int, used: list) -> DataFrame | None:
    """The places of level whose name occurs twice, with the first place of the name; None if there are none. least: that of a hot name."""
    # One row per document and name comes first, so that a frequent line is pre-aggregated before it is dealt out.
    first = saved(
        level.groupBy(*NAME, "__doc", "__sum").agg(F.min("__i").alias("__i"), F.count(F.lit(1)).alias("__n"))
        .groupBy(*NAME).agg(F.min(F.struct(*PLACE)).alias("__first"), F.sum("__n").alias("__n")).where("__n > 1"),
        f"names-{k}",
    )
    used.append(first)
    if first.isEmpty():
        return None
    hot = F.col("__n") > least
    some = F.broadcast(first.where(hot).select(*NAME, F.lit(SALTS).alias("__salts")))
    salted = level.join(some, NAME, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("__doc", "__i"), "__salts"), F.lit(0)).cast("int")).drop("__salts")
    every = first.select(*NAME, "__first", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))).alias("__salt"))
    return saved(salted.join(every, [*NAME, "__salt"]).drop("__salt"), f"repeats-{k}")


def _islands(rows: DataFrame, by: list[str], *facts) -> DataFrame:
    """Stretches (start, end) of the rows (__i, __end) of each key that meet or overlap."""
    at = Window.partitionBy(*by).orderBy("__i", "__end")
    reach = F.max("__end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("__new", F.when(F.col("__i") <= reach, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy(*by, "__island").agg(F.min("__i").alias("__start"), F.max("__end").alias("__end"), *facts)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of lines that stand earlier in the corpus: __doc, __sum (hash of the text), __spans array of (start, end).

    Order is that of (doc_id, hash of text, line); a null doc_id counts as the least number. Rows alike in doc_id and text are one
    document. Returns documents with a stretch only.
    """
    a, b = _name(F.col("__line"))
    own = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("__doc"), F.xxhash64(F.col(text)).alias("__sum"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("__i", "__line")
    )
    words = F.size(F.filter(F.split(F.col("__line"), r"[ \t\r\f\x0B]+"), lambda w: w != ""))
    lines = level = saved(own.select(*PLACE, a.alias("__a"), b.alias("__b"), words.cast("long").alias("__words")), "lines")
    covers, used, k, least = [], [lines], 0, lines.count() // HOT + 1
    while (again := _repeats(level, k, least, used)) is not None:
        used.append(again)
        later = again.where(F.struct(*PLACE) > F.col("__first"))
        covers.append(later.select(*PLACE, F.lit(1 << k).alias("__len"), "__words", F.col("__first.__doc").alias("__fd"), F.col("__first.__sum").alias("__fs"), (F.col("__i") - F.col("__first.__i")).alias("__delta")))
        right = again.select("__doc", "__sum", (F.col("__i") - (1 << k)).alias("__i"), F.col("__a").alias("__a2"), F.col("__b").alias("__b2"), F.col("__words").alias("__words2")).distinct()
        a, b = _name("__a", "__b", "__a2", "__b2")
        level = again.join(right, PLACE).select(*PLACE, a.alias("__a"), b.alias("__b"), (F.col("__words") + F.col("__words2")).alias("__words"))
        k += 1
    if not covers:
        covers = [lines.limit(0).select(*PLACE, F.lit(1).alias("__len"), "__words", F.col("__doc").alias("__fd"), F.col("__sum").alias("__fs"), F.col("__i").alias("__delta"))]
    cover = covers[0]
    for more in covers[1:]:
        cover = cover.unionAll(more)
    by = ["__doc", "__sum", *SOURCE]
    # Lines that are alike in doc_id and text are there several times; a run is the same for all of them.
    runs = saved(_islands(cover.withColumn("__end", F.col("__i") + F.col("__len")), by, F.max("__words").alias("__most"), F.max("__len").alias("__longest")), "runs")
    used.append(runs)
    # A run of several windows with too few words each is counted line by line.
    several = runs.where((F.col("__most") < min_words) & (F.col("__end") - F.col("__start") > F.col("__longest")))
    counted = (
        several.select(*by, "__island", "__start", "__end", F.explode(F.sequence("__start", F.col("__end") - 1)).alias("__i"))
        .join(lines.groupBy(*PLACE).agg(F.max("__words").alias("__words")), PLACE)
        .groupBy(*by, "__island", "__start", "__end").agg(F.sum("__words").alias("__words")).where(F.col("__words") >= min_words)
    )
    kept = runs.where(F.col("__most") >= min_words).select("__doc", "__sum", F.col("__start").alias("__i"), "__end").unionAll(counted.select("__doc", "__sum", F.col("__start").alias("__i"), "__end"))
    merged = _islands(kept, ["__doc", "__sum"])
    spans = saved(merged.groupBy("__doc", "__sum").agg(F.array_sort(F.collect_list(F.struct(F.col("__start").alias("start"), F.col("__end").alias("end")))).alias("__spans")), "spans")
    drop_saved(docs.sparkSession, *used)
    return spans


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", out: tuple[str, str, str] = ("n_lines", "n_removed", "removed")) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from the text.

    Adds n_lines, n_removed (int) and removed, the deleted stretches as "start-end" (end not included) joined by commas. A null
    text stays null with 0 lines; an empty one is a single empty line and stays; a text whose lines all go is empty. Line ends
    are \\n alone. Documents that repeat each other whole keep the first. Columns of docs that have the added names are replaced (give
    others in `out` to keep them); all other columns stay, whatever their names.
    """
    docs = docs.drop(*out)
    doc, total, doc2, total2, cut = free_names(docs, "__doc", "__sum", "__doc2", "__sum2", "__spans")
    spans = repeated_spans(docs, min_words, doc_id, text).toDF(doc2, total2, cut)
    keyed = docs.withColumns({doc: F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), total: F.xxhash64(F.col(text))})
    both = keyed.join(spans, (F.col(doc) == F.col(doc2)) & (F.col(total) == F.col(total2)) & F.col(text).isNotNull(), "left")
    lines = F.split(F.col(text), "\n", -1)
    gone = F.aggregate(cut, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    # What is left stands between one stretch's end and the next one's start.
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["end"]))
    ends = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.size(lines)))
    left = F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")
    named = F.array_join(F.transform(cut, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    made = {
        out[0]: F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)),
        out[1]: F.when(F.col(cut).isNull(), 0).otherwise(gone),
        out[2]: F.coalesce(named, F.lit("")),
        text: F.when(F.col(cut).isNull(), F.col(text)).otherwise(left),
    }
    return both.withColumns(made).select(*(f"`{c}`" for c in docs.columns), *out)


#: The same result by windows of 1, 2, 4, ... lines as strings (for tables whose doc_id is unique).
ORACLE = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), sizes AS (
  SELECT (1 << k)::BIGINT AS len FROM range(0, 20) r(k)
), windows AS (
  SELECT doc_id, i, len, md5(array_to_string(list_slice(ls, i + 1, i + len), chr(10))) AS h
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM lines) JOIN sizes ON i + sizes.len <= len(ls)
), firsts AS (
  SELECT len, h, min(struct_pack(d := doc_id, i := i)) AS f, count(*) AS n FROM windows GROUP BY len, h
), later AS (
  SELECT w.doc_id, w.i, w.i + w.len AS e, f.f.d AS fd, w.i - f.f.i AS delta FROM windows w JOIN firsts f ON w.len = f.len AND w.h = f.h WHERE f.n > 1 AND (w.doc_id, w.i) <> (f.f.d, f.f.i)
), reached AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id, fd, delta ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later
), numbered AS (
  SELECT *, sum(CASE WHEN i <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, fd, delta ORDER BY i, e ROWS UNBOUNDED PRECEDING) AS g FROM reached
), runs AS (
  SELECT doc_id, min(i) AS a, max(e) AS b FROM numbered GROUP BY doc_id, fd, delta, g
), gone AS (
  SELECT DISTINCT r.doc_id, unnest(range(a, b)) AS i FROM (SELECT DISTINCT doc_id, a, b FROM runs) r JOIN lines l ON r.doc_id = l.doc_id
  WHERE len(list_filter(regexp_split_to_array(array_to_string(list_slice(l.ls, a + 1, b), chr(10)), '[ \\t\\r\\f\\x0B\\n]+'), lambda x: x <> '')) >= {min_words}
), stretches AS (
  SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g
), spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a) AS n FROM stretches GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM lines) l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INTEGER AS n_lines,
       coalesce(s.n, 0)::INTEGER AS n_removed, coalesce(s.removed, '') AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
""".replace("{min_words}", str(MIN_WORDS))
