"""Helpers that the training-data operators share."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loops import cut, shared_dir  # noqa: F401

#: Texts are worked on in blocks of at most this many bytes and rows.
BLOCK_BYTES, BLOCK_ROWS = 48 << 20, 60_000


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pc.fill_null(column, b"").to_pylist()


def slices(batches, text: str, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS):
    """Cuts record batches so that no piece holds more than max_bytes of text (or it is a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(pc.cast(col, pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = size[begin - 1] if begin else 0
            end = int(np.searchsorted(size, base + max_bytes, side="right"))
            end = min(max(end, begin + 1), begin + max_rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def blocks(batches, text: str, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS):
    """As slices, but small batches are joined first: one table for each block."""
    held, size, rows = [], 0, 0
    for part in slices(batches, text, max_bytes, max_rows):
        n = part.column(part.schema.get_field_index(text)).nbytes
        if held and (size + n > max_bytes or rows + part.num_rows > max_rows):
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, rows = [], 0, 0
        held.append(part)
        size, rows = size + n, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between ASCII white space of all texts, which are UTF-8: (number of each word, ends[row], the distinct words)."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    ends = split.offsets.to_numpy()[1:].astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), pc.cast(coded.dictionary, pa.binary()).to_pylist()
    if b"" in names:  # white space at the ends of a text
        empty = names.index(b"")
        there = codes != empty
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        codes = codes[there]
        codes = codes - (codes > empty)
        del names[empty]
    return codes.astype(np.int64), ends, names


def owners(ends: np.ndarray) -> np.ndarray:
    """The row of each of the things that end at ends[row]."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def tally(row: np.ndarray, code: np.ndarray, kinds: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count or sum of weights) of each pair that occurs, by row, then code; codes are below kinds."""
    key = row * max(kinds, 1) + code
    if weights is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=weights, minlength=len(key)).astype(np.int64)
    return key // max(kinds, 1), key % max(kinds, 1), n


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n[i] numbers from start[i] on, for each i in turn."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def numbers(df: DataFrame) -> np.ndarray:
    """The one long column of df on the driver, eight bytes a row: it comes in packed blocks, one or a few a task."""

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())], ["data"])

    return np.frombuffer(b"".join(bytes(r[0]) for r in df.mapInArrow(packed, "data binary").collect()), np.int64)


def sum_arrays(df: DataFrame, parts: int = 32) -> list:
    """The sums of packed arrays of 64-bit integers, one column data, by partition number modulo parts: what the driver gets does not grow
    with the tasks."""

    def add(batches):
        total = None
        for b in batches:
            for data in b.column(1).to_pylist():
                one = unpack(data, np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], ["data"])

    keyed = df.select((F.spark_partition_id() % parts).alias("part"), "data")
    return [unpack(bytes(r["data"]), np.int64) for r in keyed.repartition(parts, "part").mapInArrow(add, "data binary").collect()]


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def held_out(name: str, modulus: int, remainder: int):
    """True where crc32(id as text) mod modulus is remainder; a null id is never held out."""
    return F.coalesce(crc_of_id(name) % modulus == remainder, F.lit(False))


def pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def term_buckets(spark: SparkSession) -> int:
    """Into how many buckets terms are dealt: more for more partitions, but fewer than these, as each block answers each bucket."""
    return max(8, round(4 * shuffle_partitions(spark) ** 0.5))


#: What operators remember in a worker from task to task, by name; the name that only() got last.
_KEPT: dict[str, object] = {}
_last: list[str] = []


def kept(name: str, cache):
    """Makes a cache known, so that only() can empty it."""
    _KEPT[name] = cache
    return cache


def only(name: str) -> None:
    """Empties all caches but one: a worker that serves several operators holds what one needs. If that, or another operator than the
    last, leaves memory free, it is given back."""
    gone = [n for n, c in _KEPT.items() if n != name and len(c)]
    for n in gone:
        _KEPT[n].clear()
    if gone or _last != [name]:
        _last[:] = [name]
        trim()


def trim() -> None:
    """Gives memory that is free in this worker back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
