"""Benchmark decontamination by Wu-Manber search for windows of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: ASCII letters in lower case, digits and all other characters make words; the rest of ASCII separates them.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WuManber:
    """Finds all occurrences of word windows. For the windows of one length m, a block is the last two words of a position
    (one word if m is 1). shift has, for each block that occurs in a window, how far its last occurrence is from the window's end;
    any other block lets the search skip m-1 words. Where the shift is 0, the bucket of that block gives the windows that end so,
    by their first word, and these are compared word by word."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        vocabulary = {w for window in windows for w in window}
        self.ids = {w: i for i, w in enumerate(sorted(vocabulary), 1)}
        self.base = len(self.ids) + 1
        self.items: list[set[str]] = []
        self.lengths: dict[int, tuple[dict, dict]] = {}
        for window, items in windows.items():
            row = [self.ids[w] for w in window]
            m = len(row)
            shift, buckets = self.lengths.setdefault(m, ({}, {}))
            if m == 1:
                shift[row[0]] = 0
                end = row[0]
            else:
                for j in range(1, m):
                    block = row[j - 1] * self.base + row[j]
                    shift[block] = min(shift.get(block, m - 1), m - 1 - j)
                end = row[-2] * self.base + row[-1]
            buckets.setdefault(end, {}).setdefault(row[0], []).append((row, len(self.items)))
            self.items.append(items)

    def search(self, words: list[bytes]):
        """Yields (first word, length, items) of each occurrence."""
        row = list(map(self.ids.get, words, [0] * len(words)))
        base, n = self.base, len(row)
        for m, (shift, buckets) in self.lengths.items():
            get, skip, i = shift.get, max(1, m - 1), m - 1
            while i < n:
                block = row[i - 1] * base + row[i] if m > 1 else row[i]
                step = get(block, skip)
                if step:
                    i += step
                    continue
                at = i - m + 1
                for window, k in buckets[block].get(row[at], ()):
                    if row[at : i + 1] == window:
                        yield at, m, self.items[k]
                i += 1


def windows_of(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def find_contamination(df: DataFrame, benchmark: DataFrame, width: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = 100_000) -> DataFrame:
    """One row for each row of df: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Windows are `width` consecutive words of an item, or all of a shorter one. They are searched in blocks of about `most`
    distinct windows, so the driver and each task hold that many at a time whatever the benchmark's size; documents stream
    through one scan for each block, without a shuffle, carrying their hit words and items. Null and empty texts have no words,
    items without words have no window, items with one id count as one, a null item id is the text `null`; an empty benchmark
    hits nothing. Repeated rows give a row each.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    state = [T.StructField("id", id_type), T.StructField("text", T.StringType()), T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]
    out = [T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]

    def scan(shared, final: bool):
        def f(batches):
            common.only("decontamination")
            finder = shared.value
            for b in common.slices(batches, "text", 16 << 20):
                hits, items, counts = [], [], []
                for data, old, known in zip(common.binary(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    words = words_of(data)
                    spans = list(finder.search(words)) if words else []
                    found = set(known or ())
                    marks = np.zeros(0, bool)
                    if spans or old:
                        marks = np.zeros(len(words), bool) if old is None else np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                        for at, m, names in spans:
                            marks[at : at + m] = True
                            found |= names
                    counts.append((len(words), int(marks.sum())))
                    hits.append(np.packbits(marks).tobytes() if marks.any() and not final else None)
                    items.append(sorted(found))
                if not final:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["id", "text", "hits", "items"])
                else:
                    n = [len(x) for x in items]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0), pa.array([c for c, _ in counts], pa.int64()), pa.array([h for _, h in counts], pa.int64()), pa.array(n, pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x >= least_items for x in n]),
                    ], [s.name for s in out])

        return f

    def blocks():
        windows: dict[tuple[bytes, ...], set[str]] = {}
        for row in benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")).toLocalIterator():
            for w in windows_of((row[1] or "").encode(), width):
                windows.setdefault(w, set()).add("null" if row[0] is None else row[0])
            if len(windows) >= most:
                yield WuManber(windows)
                windows = {}
        yield WuManber(windows)

    frame = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    held = None
    for number, finder in enumerate(blocks()):
        if held is not None:
            frame = frame.mapInArrow(scan(held, False), T.StructType(state))
            if number % 8 == 0:
                frame = common.cut(frame)
        held = spark.sparkContext.broadcast(finder)
    return frame.mapInArrow(scan(held, True), T.StructType(out))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df without rows whose id is that of a contaminated row; all columns stay. A null id is an id like others."""
    bad = find_contamination(df, benchmark, id_col=id_col, **options).filter("contaminated").select(F.col(id_col).alias("__bad")).distinct()
    bad = common.cut(bad)
    return df.join(bad, df[id_col].eqNullSafe(bad["__bad"]), "left_anti")
