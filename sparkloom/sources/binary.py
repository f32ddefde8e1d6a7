"""Readers and writers of fixed-width binary files: vectors, ground truth, edges, CSR graphs.

Files are read in byte ranges, a task each, through pyarrow's file systems (local paths, file:, hdfs:, s3:), so a file of any size
spreads over the cluster and nothing but a range is in memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 64 << 20


def _open(path: str):
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
    return files, inner


def header(path: str, kind: str, n: int) -> list[int]:
    files, inner = _open(path)
    size = np.dtype(kind).itemsize * n
    with files.open_input_file(inner) as f:
        return np.frombuffer(f.read(size), kind).tolist()


def file_size(path: str) -> int:
    files, inner = _open(path)
    return files.get_file_info(inner).size


def records(spark: SparkSession, path: str, start: int, width: int, count: int, decode: Callable[[int, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """decode(first record number, bytes as an array of (records, width)) for `count` records of `width` bytes from `start`."""
    each = max(1, CHUNK // width)
    chunks = spark.range(-(-count // each)).repartition(max(1, -(-count // each)), "id")

    def f(batches):
        files, inner = _open(path)
        for b in batches:
            for k in b["id"]:
                first = int(k) * each
                n = min(each, count - first)
                with files.open_input_file(inner) as g:
                    g.seek(start + first * width)
                    yield decode(first, np.frombuffer(g.read(n * width), np.uint8).reshape(n, width))

    return chunks.mapInPandas(f, schema)


#: Element types of vector files by name.
KINDS = {"u8bin": "u1", "i8bin": "i1", "fbin": "<f4"}


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, vec): u8bin, i8bin, fbin hold n, d and n * d elements."""
    n, d = header(path, "<i4", 2)
    t = np.dtype(KINDS[kind])
    return records(spark, path, 8, d * t.itemsize, n, lambda first, x: pd.DataFrame({"id": np.arange(first, first + len(x)), "vec": list(np.ascontiguousarray(x).view(t).astype(np.float32))}), "id long, vec array<float>")


def read_prefixed_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, vec): fvecs, bvecs and ivecs repeat the dimension before each vector."""
    t = np.dtype({"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}[kind])
    (d,) = header(path, "<i4", 1) if file_size(path) else (0,)
    width = 4 + d * t.itemsize
    out = "array<int>" if kind == "ivecs" else "array<float>"
    return records(spark, path, 0, width, file_size(path) // width, lambda first, x: pd.DataFrame({"id": np.arange(first, first + len(x)), "vec": list(np.ascontiguousarray(x[:, 4:]).view(t).astype(np.int32 if kind == "ivecs" else np.float32))}), f"id long, vec {out}")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, distance): n, k, n * k ids, n * k distances; ranks from 1."""
    n, k = header(path, "<i4", 2)

    def rows(kind, name):
        return lambda first, x: pd.DataFrame({"qid": np.repeat(np.arange(first, first + len(x)), k), "rank": np.tile(np.arange(1, k + 1), len(x)), name: np.ascontiguousarray(x).view(kind).ravel()})

    ids = records(spark, path, 8, 4 * k, n, rows("<i4", "id"), "qid long, rank int, id long")
    distances = records(spark, path, 8 + 4 * k * n, 4 * k, n, rows("<f4", "distance"), "qid long, rank int, distance float")
    return ids.join(distances, ["qid", "rank"])


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, id): n, total, n counts, ids."""
    n, total = header(path, "<i4", 2)
    files, inner = _open(path)
    with files.open_input_file(inner) as f:
        f.seek(8)
        ends = np.cumsum(np.frombuffer(f.read(4 * n), "<i4"))
    return records(spark, path, 8 + 4 * n, 4, total, lambda first, x: pd.DataFrame({"qid": np.searchsorted(ends, np.arange(first, first + len(x)), side="right"), "id": np.ascontiguousarray(x).view("<i4").ravel()}), "qid long, id long")


def read_binary_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst[, w]) of packed records of two 32-bit ids and, if weighted, a 32-bit float."""
    t = np.dtype([("src", "<u4"), ("dst", "<u4")] + ([("w", "<f4")] if weighted else []))
    return records(spark, path, 0, t.itemsize, file_size(path) // t.itemsize, lambda first, x: pd.DataFrame({c: np.ascontiguousarray(x).view(t)[c].ravel() for c in t.names}), "src long, dst long" + (", w float" if weighted else ""))


def read_binary_csr(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst): n, m and the file's size as 64-bit numbers, n + 1 offsets, m 32-bit targets. Offsets join their edges by range: each
    task of targets reads the offsets that it needs."""
    n, m, _ = header(path, "<i8", 3)

    def decode(first, x):
        files, inner = _open(path)
        low, size = 0, n
        with files.open_input_file(inner) as f:
            while size > 0:  # the vertex whose edges hold the first target
                half = size // 2
                f.seek(24 + 8 * (low + half + 1))
                if int(np.frombuffer(f.read(8), "<i8")[0]) <= first:
                    low, size = low + half + 1, size - half - 1
                else:
                    size = half
            f.seek(24 + 8 * low)
            src, ends, last = [], [], low
            while not ends or ends[-1] < first + len(x):
                count_ = min(65536, n + 1 - last)
                if count_ <= 0:
                    break
                some = np.frombuffer(f.read(8 * count_), "<i8")
                ends += some[1:].tolist() if last == low else some.tolist()
                last += count_
        src = low + np.searchsorted(np.asarray(ends), np.arange(first, first + len(x)), side="right")
        return pd.DataFrame({"src": src, "dst": np.ascontiguousarray(x).view("<u4").ravel()})

    return records(spark, path, 24 + 8 * (n + 1), 4, m, decode, "src long, dst long")


def write_vectors(points: DataFrame, path: str, kind: str = "fbin") -> None:
    """One vector file in order of id; rows stream through the driver, a batch at a time."""
    files, inner = _open(path)
    n = points.count()
    first = points.select(F.size("vec")).first()
    with files.open_output_stream(inner) as f:
        f.write(np.asarray([n, first[0] if first else 0], "<i4").tobytes())
        for r in points.orderBy("id").select("vec").toLocalIterator():
            f.write(np.asarray(r[0]).astype(KINDS[kind]).tobytes())


def convert_vectors(spark: SparkSession, source: str, kind: str, target: str, to: str, first: int | None = None) -> None:
    """From one vector file to another, the first rows only if `first` is given."""
    points = read_vectors(spark, source, kind) if kind in KINDS else read_prefixed_vectors(spark, source, kind)
    write_vectors(points if first is None else points.filter(F.col("id") < first), target, to)
