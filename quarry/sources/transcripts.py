"""Tool calls of agent transcripts: JSON lines below a folder, as rows in buckets, and the report as Markdown."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.listing import enabled_languages

# File suffixes, the tools of each bucket, and shell commands that read a file.
SUFFIXES = (".s", ".inc", ".asm", ".mac")
SERVER = "mcp__serena__"
STRUCTURE_TOOLS = (
    "find_symbol", "get_symbols_overview", "find_referencing_symbols", "find_declaration", "find_implementations", "rename_symbol", "safe_delete_symbol",
    "replace_symbol_body", "insert_after_symbol", "insert_before_symbol", "get_diagnostics_for_file", "get_diagnostics_for_symbol",
)
TEXT_TOOLS = ("read_file", "search_for_pattern", "replace_content", "replace_in_files", "create_text_file", "delete_lines", "replace_lines", "insert_at_line")
READ_TOOLS = ("Read", "Grep", "Glob")
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
SHELL_READS = ("cat ", "head ", "tail ", "sed -n", "grep ", "rg ", "less ", "bat ")
BUCKETS = ["symbolic", "serena_text", "native_read", "native_edit", "shell_read"]

PATHS = ("file_path", "relative_path", "path", "notebook_path")
TEXTS = ("pattern", "glob", "query", "command")
INPUT = "struct<" + ",".join(f"{k}:string" for k in (*PATHS, *TEXTS)) + ">"


def targets_assembly(tool_input: str) -> Column:
    """Whether a path of the call ends in a suffix, or a pattern or command mentions one."""
    ends = [F.lower(F.col(f"{tool_input}.{k}")).endswith(s) for k in PATHS for s in SUFFIXES]
    holds = [F.contains(F.lower(F.col(f"{tool_input}.{k}")), F.lit(s)) for k in TEXTS for s in SUFFIXES]
    found = F.lit(False)
    for c in (*ends, *holds):
        found = found | F.coalesce(c, F.lit(False))
    return found


def bucket(tool: str, tool_input: str) -> Column:
    """The bucket of a call, null if it doesn't count. Structure tools count without a path."""
    name, asm = F.col(tool), targets_assembly(tool_input)
    bare = F.regexp_extract(name, f"^{SERVER}(.*)$", 1)
    command = F.ltrim(F.col(f"{tool_input}.command"))
    reads = F.lit(False)
    for c in SHELL_READS:
        reads = reads | F.coalesce(command.startswith(c), F.lit(False))
    return (
        F.when(bare.isin(*STRUCTURE_TOOLS), "symbolic").when(bare.isin(*TEXT_TOOLS) & asm, "serena_text").when(name.isin(*READ_TOOLS) & asm, "native_read")
        .when(name.isin(*EDIT_TOOLS) & asm, "native_edit").when((name == "Bash") & reads & asm, "shell_read")
    )


def tool_calls(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """session, project, at, tool, input of every tool call; lines that are no JSON, have no time or no list of blocks give none.

    since skips files that were not changed after it. A line without a folder belongs to its file's folder.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    lines = (reader.option("modifiedAfter", since) if since else reader).text(root)
    parsed = lines.select(
        F.col("_metadata.file_path").alias("session"),
        F.from_json("value", f"timestamp string, cwd string, message struct<content:array<struct<type:string,name:string,input:{INPUT}>>>").alias("j"),
    )
    folder = F.element_at(F.split(F.regexp_replace("session", "/[^/]*$", ""), "/"), -1)
    project = F.element_at(F.split(F.rtrim(F.col("j.cwd"), F.lit("/")), "/"), -1)
    at = F.try_to_timestamp(F.regexp_replace("j.timestamp", "Z$", "+00:00"))
    calls = parsed.select("session", F.coalesce(F.when(F.length(project) > 0, project), folder).alias("project"), at.alias("at"), F.explode("j.message.content").alias("c"))
    return calls.where("at IS NOT NULL AND c.type = 'tool_use' AND c.name IS NOT NULL").select("session", "project", "at", F.col("c.name").alias("tool"), F.col("c.input").alias("input"))


def append_json(report: DataFrame, path: str) -> None:
    """The report as JSON lines, with the moment of writing, after those that are there."""
    report.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def projects_in(spark: SparkSession, root: str, language: str = "ca65") -> DataFrame:
    """project: folders below root whose project.yml lists the language; the scope of a report."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "project.yml").load(f"{root}/*")

    @F.pandas_udf("boolean")
    def lists(content: pd.Series) -> pd.Series:
        return content.map(lambda c: language in enabled_languages(bytes(c).decode("utf-8", "replace"))).astype(bool)

    return names.where(lists("content")).select(F.element_at(F.split("path", "/"), -2).alias("project"))


def projects_listed(spark: SparkSession, path: str) -> DataFrame:
    """project: the names of a JSON array in a file."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("project"))


def markdown(report: DataFrame, project: str = "project") -> str:
    """The report of reports.usage_report as a table, one line a project and the total last. Projects are few."""
    rows = report.orderBy("is_total", project).collect()
    out = ["| project | " + " | ".join(BUCKETS) + " | sessions | share |", "|" + "---|" * (len(BUCKETS) + 3)]
    for r in rows:
        share = "n/a" if r["share"] is None else f"{100 * r['share']:.1f} %"
        out.append(f"| {'total' if r['is_total'] else r[project]} | " + " | ".join(str(r[b]) for b in BUCKETS) + f" | {r['sessions']} | {share} |")
    return "\n".join(out) + "\n"
