"""Linker debug files: lines `kind<TAB>key=value,…` as raw records, and the symbols that they describe."""
from __future__ import annotations

import glob

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import hex_value, id_list
from quarry.operators.joins import resolve_paths

RECORD = r"^\w+\t"


def dbg_files(root: str) -> list[str]:
    """The linker's debug files of a project: build/*.dbg, then obj/*.dbg, each sorted."""
    return [p for folder in ("build", "obj") for p in sorted(glob.glob(f"{glob.escape(root)}/{folder}/*.dbg"))]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("seq", "line"))
    return lines.where(~F.col("line").rlike(r"^\s*(#.*)?$"))


def broken_dbg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seq and line of what is no record. A file with such a line gives no records at all."""
    return _lines(spark, path).where(~F.col("line").rlike(RECORD))


def read_dbg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seq, kind and fields (map of strings) of each record. Blank lines and # lines are skipped; files of `broken_dbg` are left out."""
    lines = _lines(spark, path).withColumn("__good", F.min(F.col("line").rlike(RECORD)).over(Window.partitionBy("path"))).where("__good")
    kind, body = F.regexp_extract("line", r"^(\w+)\t", 1), F.regexp_extract("line", r"^\w+\t(.*)$", 1)
    pair = r"(\w+)=(\"[^\"]*\"|[^,]*)"
    keys, values = F.regexp_extract_all(body, F.lit(pair), F.lit(1)), F.regexp_extract_all(body, F.lit(pair), F.lit(2))
    return lines.select("path", "seq", kind.alias("kind"), F.map_from_arrays(keys, F.transform(values, lambda v: F.regexp_replace(v, '^"|"$', ""))).alias("fields"))


def write_symbols(records: DataFrame, path: str, name: str | None = None) -> None:
    """Symbol records as JSON lines in the order of their names, of one name if it is given."""
    own = records if name is None else records.where(F.col("name") == name)
    own.orderBy("name", "path", "seq").write.mode("overwrite").json(path)


def records(raw: DataFrame, kind: str, **types: str) -> DataFrame:
    """One typed view with path and seq: int (decimal or 0x), string, or ids for a +-joined list."""
    cast = {"int": hex_value, "string": lambda c: c, "ids": id_list}
    return raw.where(F.col("kind") == kind).select("path", "seq", *(cast[t](F.col("fields")[k]).alias(k) for k, t in types.items()))


def symbol_records(raw: DataFrame) -> DataFrame:
    """path, seq, name, kind (lab, equ, imp), file, 1-based line, scope_path, parent_name, addrsize, addr, size, segment, import_of.

    Line and file come from the first definition, an import's target from one hop, a cheap local's scope from its parent's, and the
    segment by its id. Ids count within one debug file.
    """
    sym = records(raw, "sym", id="int", name="string", addrsize="string", size="int", scope="int", parent="int", **{"def": "ids"}, val="int", seg="int", type="string", exp="int")
    line = records(raw, "line", id="int", file="int", line="int").select("path", F.col("id").alias("line_id"), F.col("file").alias("file_id"), "line")
    files = records(raw, "file", id="int", name="string").select("path", F.col("id").alias("file_id"), F.col("name").alias("source"))
    seg = records(raw, "seg", id="int", name="string").select("path", F.col("id").alias("seg"), F.col("name").alias("segment"))
    node = lambda c: F.concat_ws("#", "path", c)
    scope = records(raw, "scope", id="int", name="string", parent="int").select(node("id").alias("id"), F.when(F.col("parent").isNotNull(), node("parent")).alias("parent_id"), "name")
    # The root scope of a module has no name; paths leave it out.
    paths = resolve_paths(scope).select(F.col("node").alias("scope_node"), F.filter("path", lambda p: p != "").alias("scope_path"))
    target = sym.select("path", F.col("id").alias("exp"), F.when(F.col("type").isin("lab", "equ"), F.col("name")).alias("import_of"))
    parent = sym.select("path", F.col("id").alias("parent"), F.col("name").alias("parent_name"), F.col("scope").alias("parent_scope"))
    out = sym.withColumn("line_id", F.get("def", F.lit(0))).join(line, ["path", "line_id"], "left").join(files, ["path", "file_id"], "left").join(seg, ["path", "seg"], "left")
    out = out.join(target, ["path", "exp"], "left").join(parent, ["path", "parent"], "left").withColumn("scope_node", node(F.coalesce("scope", "parent_scope"))).join(paths, "scope_node", "left")
    return out.select(
        "path", "seq", "name", F.col("type").alias("kind"), F.col("source").alias("file"), "line", F.coalesce("scope_path", F.array().cast("array<string>")).alias("scope_path"), "parent_name", "addrsize", F.col("val").alias("addr"), "size", "segment", "import_of"
    )
