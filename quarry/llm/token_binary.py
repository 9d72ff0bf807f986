"""Token ids in directly addressable codes, written as files of self-contained segments with a table of where each stands.

Ids are cut into chunks of CHUNK_BITS bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go on,
and level k+1 holds the next chunk of just those. A rank directory over each bitmap turns a place on one level into a
place on the next, so that the id at any place is read from one byte per level, without decoding what stands before.

A segment is one binary image in a file, which is mapped and not read, so that one token costs the few bytes that it takes:
  magic "DAC1", u32 documents, u64 tokens, u32 levels, i64 ids of documents, u8 null flags, u64 first places (documents + 1),
  then for each level: u64 entries, the chunks (u8), the bitmap (u8, little-endian bits), the directory (u32 ones before every
  RANK_BITS bits). Each task writes one file; the table (Parquet) has part, seg, n_docs, n_ids, file, offset and size of each segment.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import partitions, reading_parts, scratch_path, sliced
from quarry.llm.shared_files import make_folder, mapped, written
from quarry.llm.token_counts import encoder, vocabulary

CHUNK_BITS = 8
RANK_BITS = 512
#: A segment ends after so many tokens or documents: this bounds its memory and that of its reader.
SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 4096
TABLE = "part int, seg int, n_docs long, n_ids long, file string, offset long, size long"


def pack(ids: np.ndarray) -> bytes:
    """The levels of an array of unsigned 32-bit ids."""
    out, rest = [], np.asarray(ids, dtype=np.uint32)
    levels = 0
    while True:
        chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        more = (rest >> CHUNK_BITS) != 0
        pad = np.zeros(-(-max(1, len(more)) // RANK_BITS) * RANK_BITS, dtype=np.uint8)
        pad[: len(more)] = more
        ones = pad.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones[:-1])]).astype("<u4")
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), np.packbits(pad, bitorder="little").tobytes(), directory.tobytes()]
        levels += 1
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return struct.pack("<I", levels) + b"".join(out)


def segment(doc_ids: list, ids: list[bytes]) -> bytes:
    """The image of a segment: each document's ids are little-endian unsigned 32-bit integers."""
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    starts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype("<u8")
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    return b"DAC1" + struct.pack("<IQ", len(doc_ids), len(flat)) + names.tobytes() + null.tobytes() + starts.tobytes() + pack(flat)


class Segment:
    """Reader of an image (bytes, or a memory-mapped file). `at` reads one token; `slice` reads a run of them."""

    def __init__(self, image) -> None:
        view = memoryview(image)
        if bytes(view[:4]) != b"DAC1":
            raise ValueError("not a DAC1 segment")
        n, self.n_tokens = struct.unpack_from("<IQ", view, 4)
        at = 16

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(view, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        names, null, self.starts = take("<i8", n), take("u1", n), take("<u8", n + 1)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, null)]
        self.levels = []
        for _ in range(int(take("<u4", 1)[0])):
            size = int(take("<u8", 1)[0])
            chunks = take("u1", size)
            blocks = -(-max(1, size) // RANK_BITS)
            self.levels.append((chunks, take("u1", blocks * RANK_BITS // 8), take("<u4", blocks)))

    def at(self, place: int) -> int:
        """The id at a place, from one chunk of each level that it has."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[place]) << (CHUNK_BITS * level)
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            block = place // RANK_BITS
            head = np.unpackbits(bits[block * RANK_BITS // 8 : (place >> 3) + 1], bitorder="little")[: place - block * RANK_BITS]
            place = int(directory[block]) + int(head.sum())
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end (or to the last), by the same steps for all places at once."""
        end = min(end, self.n_tokens)
        values = np.zeros(max(0, end - start), dtype="<u4")
        where, first, size = np.arange(len(values)), start, len(values)
        for level, (chunks, bits, directory) in enumerate(self.levels):
            if not size:
                break
            values[where] |= chunks[first : first + size].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            block = first // RANK_BITS
            run = np.unpackbits(bits[block * RANK_BITS // 8 : (first + size + 7) // 8], bitorder="little")
            skip = first - block * RANK_BITS
            more = run[skip : skip + size].astype(bool)
            first = int(directory[block]) + int(run[:skip].sum())
            where, size = where[more], int(more.sum())
        return values

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_segments(df: DataFrame, vocabulary_path: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append end_id, and write the segments to `path` in ascending doc_id order.

    Documents are dealt out by ranges of doc_id, so a segment holds neighbours and (part, seg) follows that order.
    A null text is empty and still has its end id; a null doc_id comes first; repeated rows are written each, those of
    one doc_id ordered by text; an empty table writes an empty one. Other columns aren't read.
    """
    spark = df.sparkSession
    vocab = vocabulary(spark, vocabulary_path)
    end = struct.pack("<I", end_id)

    folder = f"{path}/segments"
    make_folder(folder)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(vocab.value).encode, TaskContext.get().partitionId()
        name, rows = f"{part}-{uuid.uuid4().hex}.dac", []  # a task that runs twice writes two files, and the table names one
        names, ids, size, at = [], [], 0, 0

        def put(out):
            nonlocal names, ids, size, at
            image = segment(names, ids)
            out.write(image + bytes(-len(image) % 8))
            rows.append((part, len(rows), len(names), size // 4, name, at, len(image)))
            at += -(-len(image) // 8) * 8
            names, ids, size = [], [], 0

        with written(f"{folder}/{name}") as out:
            for batch in sliced(batches, "t"):
                for d, t in zip(batch["d"], batch["t"]):
                    ids.append(enc(t) + end)
                    names.append(None if pd.isna(d) else int(d))
                    size += len(ids[-1])
                    if size >= 4 * SEGMENT_TOKENS or len(names) >= SEGMENT_DOCS:
                        put(out)
            if names:
                put(out)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TABLE.split(", ")])

    (
        df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
        .repartitionByRange(reading_parts(df), "d")
        .sortWithinPartitions("d", "t")
        .mapInPandas(encode, TABLE)
        .write.parquet(f"{path}/table")
    )


def opened(folder: str, file: str, offset: int, size: int) -> Segment:
    """A segment of a mapped file."""
    return Segment(mapped(f"{folder}/{file}", np.uint8)[offset : offset + size])


def _placed(spark, path: str) -> DataFrame:
    """The table with `base`, the ids before each segment. Totals of each part go to the driver, as many as the write had tasks."""
    files = spark.read.schema(TABLE).parquet(f"{path}/table")
    bases, base = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases.append((part, base))
        base += n
    parts = spark.createDataFrame(bases, "part int, part_base long")
    before = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(F.broadcast(parts), "part").withColumn("base", F.col("part_base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("part_base")


def tokens_at(spark, path: str, places: DataFrame) -> DataFrame:
    """place (a column of `places`, counted over all documents) and the id there, each read by itself; places outside have no row."""
    folder = f"{path}/segments"
    rows = _placed(spark, path).select("file", "offset", "size", "base", (F.col("base") + F.col("n_ids")).alias("end"))
    run = lambda c: F.floor(c / SEGMENT_TOKENS)
    # A segment lies in few runs of places, which are the key of the join.
    held = rows.where("end > base").withColumn("run", F.explode(F.sequence(run(F.col("base")), run(F.col("end") - 1))))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("run", run(F.col("place"))).join(held, "run").where("place >= base AND place < end")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (file, offset, size), part in batch.groupby(["file", "offset", "size"]):
                s = opened(folder, file, offset, size)
                yield pd.DataFrame({"place": part["place"], "id": [s.at(int(p - b)) for p, b in zip(part["place"], part["base"])]})

    return asked.mapInPandas(read, "place long, id long")


def read_token_segments(spark, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, ids."""
    folder = f"{path}/segments"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, offset, size, base in zip(batch["file"], batch["offset"], batch["size"], batch["base"]):
                s = opened(folder, file, offset, size)
                runs = [s.document(i) for i in range(len(s.doc_ids))]
                out = pd.DataFrame({"doc_id": pd.array(s.doc_ids, dtype="Int64"), "start": s.starts[:-1].astype("int64") + base, "n_tokens": [len(r) for r in runs], "ids_crc32": [zlib.crc32(r.tobytes()) for r in runs]})
                if with_ids:
                    out["ids"] = [r.astype("int64") for r in runs]
                yield out

    rows = _placed(spark, path).repartition(partitions(spark), "part", "seg")
    return rows.select("file", "offset", "size", "base").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_binary(df: DataFrame, vocabulary_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the segments (to the shared folder, if no path is given) and read the documents back from them."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "token-segments")
    write_token_segments(df, vocabulary_path, path, end_id)
    return read_token_segments(spark, path)
