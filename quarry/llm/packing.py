"""Best-two-fit packing of token pieces into sequences of a fixed length.

A bin is first filled greedily with the longest piece that still fits. If room is left, the bin's smallest piece gives way to
the two unpacked pieces whose sum fills the expanded gap most tightly, if they fill more than it did. The choice among equal
lengths follows row order. Sets of present lengths are bit sets, so both steps are a few operations on 4096-bit integers.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import saved, sliced
from quarry.llm.token_counts import encoder, vocabulary

#: Pieces that one task packs. A block leaves at most about one bin part empty, so larger blocks waste less.
BLOCK_PIECES = 16_384
#: Rows of a file whose pieces one task numbers.
RUN_ROWS = 1024
#: Columns that say where a row stands among the rows of a table.
ORDER = ("file", "row")


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, each a list of indexes into lengths (all from 1 to capacity)."""
    places: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        places.setdefault(lengths[i], []).append(i)
    have = there = 0  # bit n: a piece of length n is unpacked; bit capacity - n of the mirror image
    for n in places:
        have |= 1 << n
        there |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal have, there
        i = places[n].pop()
        if not places[n]:
            have ^= 1 << n
            there ^= 1 << (capacity - n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal have, there
        places[n].append(i)
        have |= 1 << n
        there |= 1 << (capacity - n)

    bins = []
    while have:
        room, own = capacity, []
        while room and (fits := have & ((1 << (room + 1)) - 1)):
            n = fits.bit_length() - 1
            own.append((n, take(n)))
            room -= n
        if room and have:
            small, gone = own[-1]
            shortest = (have & -have).bit_length() - 1
            for total in range(room + small, max(small, 2 * shortest - 1), -1):
                pairs = have & (there >> (capacity - total))
                half = total // 2
                if total == 2 * half and pairs >> half & 1 and len(places[half]) < 2:
                    pairs ^= 1 << half
                if pairs:
                    a = pairs.bit_length() - 1
                    own[-1:] = [(a, take(a)), (total - a, take(total - a))]
                    give(small, gone)
                    break
        bins.append([i for _, i in own])
    return bins


def token_pieces(df: DataFrame, vocabulary_path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each whole text's ids and the end id, cut into pieces of at most `capacity`; ids go into a checksum.

    Each piece has its row's columns `carry`, too.
    """
    spark = df.sparkSession
    vocab = vocabulary(spark, vocabulary_path)
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocab.value).encode
        for batch in sliced(batches, "t"):
            rows = []
            for d, t, *more in zip(batch["d"], batch["t"], *(batch[c] for c in carry)):
                ids = encode(t) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((None if pd.isna(d) else int(d), k, at // 4, len(piece) // 4, zlib.crc32(piece), *more))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *carry])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = ", ".join(["doc_id long, piece int, start long, length long, ids_crc32 long", *(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)])
    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), *carry).mapInPandas(cut, schema)


def in_order(df: DataFrame) -> DataFrame:
    """df with the columns ORDER: where each row stands in the order in which df was written, or has now if it comes from no files.

    Spark names files by the number of their task, and a task's second and later files by a further number; a sorted table's tasks
    follow each other. Files with other names follow each other by their paths.
    """
    try:
        at = df.metadataColumn("_metadata")
        named = df.withColumns({"file": at["file_path"], "row": at["row_index"]})
    except AnalysisException:
        return df.withColumns({"file": F.lit(""), "row": F.monotonically_increasing_id()})
    number = lambda pattern: F.lpad(F.regexp_extract(F.element_at(F.split("file", "/"), -1), pattern, 1), 20, "0")
    return named.withColumn("file", F.concat(number(r"^part-(\d+)"), number(r"-c(\d+)\."), "file"))


def with_ranks(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, their number in the order (file, row, piece), in place of file and row.

    Runs of rows are numbered each by itself; one task adds up the runs, not their pieces. Read twice: pass a table that is written.
    """
    run = pieces.withColumn("__run", F.expr(f"row div {RUN_ROWS}"))
    before = Window.orderBy("file", "__run").rowsBetween(Window.unboundedPreceding, -1)
    bases = run.groupBy("file", "__run").agg(F.count(F.lit(1)).alias("__n")).select("file", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    at = Window.partitionBy("file", "__run").orderBy("row", "piece")
    return run.withColumn("__at", F.row_number().over(at) - 1).join(bases, ["file", "__run"]).withColumn("rank", F.col("__at") + F.col("__base")).drop("__run", "__at", "__base", "file", "row")


def pack(pieces: DataFrame, capacity: int, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt by a hash into blocks of about block_pieces, so a task's memory has a bound at every size, and each
    block is packed by itself; sequence_id holds the block in its high half. Read twice: pass a table that is written.
    Where pieces have a `rank` (from 0, without gaps), a block is a range of ranks instead, blocks follow each other in that order, and
    the sequences of a block stand in the order of their first pieces' ranks, so that each part of the block is a fair sample of it.
    """
    ranked = "rank" in pieces.columns
    blocks = max(1, -(-pieces.count() // block_pieces))

    def of(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "rank"] if ranked else ["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = block["length"].tolist()
        sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
        base = int(block["block"].iloc[0]) << 32
        bins = best_two_fit(lengths, capacity)
        if ranked:
            rank = block["rank"].tolist()
            bins.sort(key=lambda own: rank[own[0]])
        for b, own in enumerate(bins):
            at = 0
            for i in own:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        return block.drop(columns=["block", "rank"] if ranked else "block").assign(sequence_id=sequence, offset=offset)

    place = F.monotonically_increasing_id()  # spreads rows that are alike; the same on a retry, as a written table is read
    dealt = pieces.withColumn("block", F.expr(f"rank div {block_pieces}") if ranked else F.pmod(F.xxhash64("doc_id", "piece", place), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    A null or empty text is a piece that holds the end id alone. A null doc_id stays null. Repeated rows are packed
    each. An empty table gives no sequence.
    Other columns of df aren't read, whatever their names.
    """
    return pack(saved(token_pieces(df, vocabulary_path, end_id, capacity), "pieces"), capacity)
