"""Text edits in order, and assembler messages as rows."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_edit(text: str, start: tuple[int, int] | None, end: tuple[int, int] | None, new: str) -> str:
    """The text after one edit; without a range the new text replaces all of it. Places past a line's or the text's end stop there."""
    if start is None or end is None:
        return new
    begins = [0]
    for line in text.split("\n"):
        begins.append(begins[-1] + len(line) + 1)

    def place(at: tuple[int, int]) -> int:
        line, character = at
        return len(text) if line >= len(begins) - 1 else min(begins[line] + character, begins[line + 1], len(text))

    return text[: place(start)] + new + text[place(end) :]


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (uri, text) after their edits (uri, seq, s_line, s_char, e_line, e_char, new_text), applied in the order of seq.

    A null range replaces the whole text. Edits stream through a task in order, one file's text in memory at a time.
    """
    own = files.select("uri", F.lit(-1).cast("long").alias("seq"), *(F.lit(None).cast("int").alias(c) for c in ("s_line", "s_char", "e_line", "e_char")), F.col("text").alias("new_text"))
    steps = own.unionByName(edits.select("uri", F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("int").alias(c) for c in ("s_line", "s_char", "e_line", "e_char")), "new_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, text, seen = None, "", False
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                if seen and r.uri != uri:
                    done.append((uri, text))
                    text = ""
                uri, seen = r.uri, True
                whole = pd.isna(r.s_line) or pd.isna(r.e_line)
                text = apply_edit(text, *((None, None) if whole else ((int(r.s_line), int(r.s_char)), (int(r.e_line), int(r.e_char)))), r.new_text or "")
            yield pd.DataFrame(done, columns=["uri", "text"])
        if seen:
            yield pd.DataFrame([(uri, text)], columns=["uri", "text"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps.repartition(parts, "uri").sortWithinPartitions("uri", "seq").mapInPandas(run, "uri string, text string")


def diagnostics(output: DataFrame, column: str = "line") -> DataFrame:
    """file, line (0-based), severity and message of the assembler's warnings and errors; other lines give none. Both file(12): and file:12: are read."""
    pattern = r"^([^:(]+?)[(:](\d+)[):]{1,2}\s*(Warning|Error):\s*(.*)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    found = output.where(F.col(column).rlike(pattern))
    return found.select(part(1).alias("file"), F.greatest(part(2).cast("int") - 1, F.lit(0)).alias("line"), part(3).alias("severity"), part(4).alias("message"))
