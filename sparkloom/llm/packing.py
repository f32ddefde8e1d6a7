"""Best-fit packing of tokenised documents into fixed-length sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pretokens import PreTokens


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places `histogram[length]` pieces of each length: runs (length, first rank, count, first sequence, offset).

    Piece number r of its length, in the run that holds r, goes to sequence `first sequence + r - first rank` at `offset`.
    Large pieces (over a third of the capacity) come first: at most two share a sequence, the largest with the largest that fits
    beside it. Each smaller one then takes the fullest sequence with room, largest first, and opens a new one only if none has.
    Sequences with the same room are one group, so the work and the result depend on the capacity, never on the number of pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    groups: dict[int, list[list[int]]] = {}  # room -> [first sequence, count]
    next_seq = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        rank = used.get(length, 0)
        used[length] = rank + n
        runs.append((length, rank, n, first, offset))

    left = {k: v for k, v in histogram.items() if v > 0}
    third = capacity / 3
    large = sorted((k for k in left if k > third), reverse=True)
    for a in large:
        for b in [x for x in large if x <= min(a, capacity - a)]:
            if not left[a]:
                break
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                place(a, n, next_seq, 0)
                place(b, n, next_seq, a)
                groups.setdefault(capacity - a - b, []).append([next_seq, n])
                next_seq += n
                left[a] -= n
                left[b] -= n
        if left[a]:
            place(a, left[a], next_seq, 0)
            groups.setdefault(capacity - a, []).append([next_seq, left[a]])
            next_seq += left[a]
            left[a] = 0
    for length in sorted((k for k in left if left[k] and k <= third), reverse=True):
        n = left[length]
        while n:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                fit = capacity // length
                whole = -(-n // fit)
                groups[capacity] = [[next_seq, whole]]
                next_seq += whole
                continue
            first, count = groups[room].pop()
            take = min(n, count)
            if take < count:
                groups[room].append([first + take, count - take])
            if not groups[room]:
                del groups[room]
            place(length, take, first, capacity - room)
            groups.setdefault(room - length, []).append([first, take])
            n -= take
    return runs


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only a document longer than the capacity is cut, into pieces of the capacity and a rest.
    A task numbers its pieces of each length; sums over tasks make the numbers global; the histogram of lengths (at most
    `capacity` numbers) is all the driver sees, and its plan tells each (length, number) its place.
    Null and empty texts are end_id alone; repeated rows and repeated or null ids are documents of their own.
    """
    id_type = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    step, last = 4 * capacity, np.asarray([end_id], np.uint32).tobytes()

    def cut_up(batches):
        from pyspark import TaskContext

        tokens, part = PreTokens.of(tokenizer), TaskContext.get().partitionId()
        seen, full = np.zeros(capacity + 1, np.int64), 0
        for table in common.blocks(batches, "text", 4 << 20):
            row, piece, size, crc = [], [], [], []
            for i, data in enumerate(tokens.each(common.binary(table["text"]))):
                data += last
                for k in range(0, len(data), step):
                    some = data[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    size.append(len(some) >> 2)
                    crc.append(zlib.crc32(some))
            size_ = np.asarray(size, np.int64)
            order = np.argsort(size_, kind="stable")
            ordered = size_[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(size_), np.int64)
            rank[order] = np.arange(len(size_)) - first + seen[ordered]
            seen += np.bincount(size_, minlength=capacity + 1)
            n = len(row)
            yield pa.RecordBatch.from_arrays([
                table["id"].take(pa.array(row, pa.int64())).combine_chunks(), pa.array(piece, pa.int32()), pa.array(np.asarray(piece, np.int64) * capacity), pa.array(size_),
                pa.array(crc, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(rank),
            ], ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    fields = [("id", id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.LongType()), ("rank", T.LongType())]
    pieces = common.cut(src.mapInArrow(cut_up, T.StructType([T.StructField(*f) for f in fields])))

    from pyspark.sql import Window

    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.asarray(plan(histogram, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    #: One number for (length, rank) that keeps their order.
    wide = 1 << 50
    keys = runs[:, 0] * wide + runs[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            run = runs[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(base.select("length", "part", "base"), ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    out = [(id_col, id_type), *fields[1:5], ("sequence_id", T.LongType()), ("offset", T.LongType())]
    return numbered.mapInArrow(place, T.StructType([T.StructField(*f) for f in out]))
