"""Exact deduplication: per-partition counting quotient filters, merged by sorted remainders, route copies to byte verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed value: the characters that do not count.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Fingerprints have 64 bits; the first QUOTIENT_BITS are the quotient.
QUOTIENT_BITS = 20
#: Repeated fingerprints up to this many go to every task (32 MB); beyond, texts are joined to them.
BROADCAST_FINGERPRINTS = 4 << 20


class CountingQuotientFilter:
    """Counts of 64-bit fingerprints, without loss: occupied quotients in order, the length of each one's run, and the sorted
    remainders of all runs with a count for each."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray | None = None) -> "CountingQuotientFilter":
        prints = prints.astype(np.uint64)
        order = np.argsort(prints, kind="stable")
        return cls.sorted(prints[order], np.ones(len(prints), np.int64) if counts is None else counts[order])

    @classmethod
    def sorted(cls, prints: np.ndarray, counts: np.ndarray) -> "CountingQuotientFilter":
        new = np.concatenate([[True], prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
        prints = prints[at]
        quotients, runs = np.unique(prints >> np.uint64(64 - QUOTIENT_BITS), return_counts=True)
        return cls(quotients.astype(np.uint32), runs.astype(np.uint32), prints & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1), total)

    def prints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.runs).astype(np.uint64) << np.uint64(64 - QUOTIENT_BITS)) | self.remainders

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        """The filter of both inputs: sorted runs are merged, nothing is sorted again, and equal remainders add their counts."""
        a, b = self.prints(), other.prints()
        at = np.searchsorted(a, b) + np.arange(len(b))
        mine = np.ones(len(a) + len(b), bool)
        mine[at] = False
        prints, counts = np.empty(len(mine), np.uint64), np.empty(len(mine), np.int64)
        prints[at], prints[mine], counts[at], counts[mine] = b, a, other.counts, self.counts
        return CountingQuotientFilter.sorted(prints, counts)

    def split(self, parts: int):
        """(part, filter) for ranges of quotients."""
        part = (self.quotients.astype(np.int64) * parts) >> QUOTIENT_BITS
        ends, starts = np.searchsorted(part, np.arange(parts + 1)), np.concatenate([[0], np.cumsum(self.runs, dtype=np.int64)])
        for p in range(parts):
            lo, hi = ends[p], ends[p + 1]
            if lo < hi:
                i, j = starts[lo], starts[hi]
                yield p, CountingQuotientFilter(self.quotients[lo:hi], self.runs[lo:hi], self.remainders[i:j], self.counts[i:j])

    def dump(self) -> bytes:
        head = np.asarray([len(self.quotients), len(self.remainders)], np.int64).tobytes()
        return head + self.quotients.tobytes() + self.runs.tobytes() + self.remainders.tobytes() + self.counts.tobytes()

    @classmethod
    def load(cls, data: bytes) -> "CountingQuotientFilter":
        q, n = np.frombuffer(data, np.int64, 2).tolist()
        at = 16 + 8 * q
        return cls(np.frombuffer(data, np.uint32, q, 16), np.frombuffer(data, np.uint32, q, 16 + 4 * q), np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n))


def whole(data: bytes) -> int:
    """Spark's xxhash64 of the text."""
    return xxhash.xxh64_intdigest(data, 42)


def fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, broadcast_most: int = BROADCAST_FINGERPRINTS, with_row: bool = False) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256 and, if asked, whole (a hash of the text as it is) and row
    (a number in the order of the input).

    Texts are equal when their bytes are, blanks deleted; null counts as empty. Of equal ones the row with the most code points
    stays, then that with the smallest id (a null id last), then the first of repeated rows, so one row of each group is kept.
    A fingerprint that counts once needs no more work. Texts of the others are compared byte by byte with one text of their class
    (each task sends each distinct text once, so a group of any size is a text a task), and two texts of one digest raise an error.
    """
    spark = df.sparkSession
    n_parts = parts or max(8, common.shuffle_partitions(spark))
    id_type = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def digest(batches):
        from pyspark import TaskContext

        common.only("exact dedup")
        row = TaskContext.get().partitionId() << 33
        for b in common.slices(batches, "text"):
            texts = common.binary(b.column(1))
            plain = [t.translate(None, BLANKS) for t in texts]
            prints = np.fromiter(map(fingerprint, plain), np.uint64, len(plain)).view(np.int64)
            chars = [len(t.decode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(row, row + len(plain))), pa.array(prints), pa.array([hashlib.sha256(t).digest() for t in plain], pa.binary()), pa.array(chars, pa.int64()), pa.array(np.fromiter(map(whole, texts), np.uint64, len(texts)).view(np.int64))], ["id", "row", "print", "sha", "chars", "whole"])
            row += len(plain)

    digested = common.cut(src.mapInArrow(digest, T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("print", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("chars", T.LongType()), T.StructField("whole", T.LongType())])))

    def filters(batches):
        found = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if found:
            rows = [(p, f.dump()) for p, f in CountingQuotientFilter.build(np.concatenate(found)).split(n_parts)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["part", "filter"])

    def repeated(batches):
        """Merges the filters of a range of quotients, like with like in size, so that each remainder is moved a few times only; ranges
        come one after the other."""
        at, held = None, []
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != at and held:
                    yield twice(held)
                    held = []
                at = part
                held.append(CountingQuotientFilter.load(data))
                while len(held) > 1 and len(held[-2].counts) < 2 * len(held[-1].counts):
                    held.append(held.pop().merge(held.pop()))
        if held:
            yield twice(held)

    def twice(held):
        f = held[-1]
        for other in held[-2::-1]:
            f = f.merge(other)
        return pa.RecordBatch.from_arrays([pa.array(f.prints()[f.counts > 1].view(np.int64))], ["print"])

    again = common.cut(digested.select("print").mapInArrow(filters, "part int, filter binary").repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(repeated, "print long"))
    n_again = again.count()

    def texts_of(wanted):
        """Distinct texts of a task with their prints: of all rows, or of those whose print is wanted."""

        def f(batches):
            known = None if wanted is None else wanted.value
            sent: dict[bytes, int] = {}
            size = 0
            for b in common.slices(batches, "text"):
                plain = [t.translate(None, BLANKS) for t in common.binary(b.column(1))]
                prints = np.fromiter(map(fingerprint, plain), np.uint64, len(plain)).view(np.int64)
                if known is None:
                    pick = range(len(plain))
                else:
                    at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
                    pick = np.flatnonzero(known[at] == prints).tolist() if len(known) else []
                for i in pick:
                    if plain[i] not in sent:
                        sent[plain[i]] = int(prints[i])
                        size += len(plain[i])
                if size > common.BLOCK_BYTES:
                    yield rows(sent)
                    sent, size = {}, 0
            if sent:
                yield rows(sent)

        def rows(sent):
            return pa.RecordBatch.from_arrays([pa.array(list(sent.values()), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in sent], pa.binary()), pa.array(list(sent), pa.binary())], ["print", "sha", "plain"])

        return f

    kind = "print long, sha binary, plain binary"
    if n_again <= broadcast_most:
        wanted = spark.sparkContext.broadcast(np.sort(common.numbers(again)))
        texts = src.mapInArrow(texts_of(wanted), kind)
    else:
        texts = src.mapInArrow(texts_of(None), kind).join(again, "print", "left_semi")
    same = texts.groupBy("print", "sha").agg(F.min("plain").alias("a"), F.max("plain").alias("b"))
    verified = same.select("print", "sha", F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.lit("two texts have one SHA-256"))).alias("ok"))

    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = (
        digested.join(again, "print", "left_semi").groupBy("print", "sha").agg(F.count("*").alias("group_size"), best.alias("best"))
        .join(verified, ["print", "sha"]).filter("ok").select("print", "sha", "group_size", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"))
    )
    extra = ["whole", "row"] if with_row else []
    return digested.join(groups, ["print", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *extra,
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_groups does not keep; all columns stay as they are.

    A row is told by its id (null equals null) and its text as it is. Rows that repeat both are one: of those that stay one stays,
    and they differ in other columns at most."""
    found = exact_groups(df, id_col, text_col, with_row=True)
    keep = found.groupBy(F.col(id_col).alias("__id"), F.col("whole").alias("__whole")).agg(F.max("kept").alias("__kept"), (F.count("*") > 1).alias("__again")).filter("__kept").drop("__kept")
    mine = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    marked = df.withColumn("__mine", mine)
    stay = marked.join(common.cut(keep), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mine") == F.col("__whole")))
    once = stay.filter(~F.col("__again"))
    return once.unionByName(stay.filter("__again").dropDuplicates(["__id", "__whole"])).select(*df.columns)
