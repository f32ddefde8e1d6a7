"""Token counts without ids: pieces are counted once for each distinct pre-token and joined to pre-token frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pretokens import PreTokens


def bucket_of(terms: list[bytes], buckets: int) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(t) for t in terms), np.int64, len(terms)) % buckets


class Postings:
    """Per-document frequencies of a block of documents, dealt by term: a payload for each bucket of terms holds the bucket's
    terms with their documents (numbers within the block) and frequencies. Terms hold no line feed."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, names: list[bytes], doc: np.ndarray, term: np.ndarray, freq: np.ndarray) -> None:
        """Frequencies of further documents; term counts within names, which are distinct."""
        put, index = self.index.setdefault, self.index
        number = np.fromiter((put(t, len(index)) for t in names), np.int64, len(names))
        self.parts.append((number[term].astype(np.uint32), doc.astype(np.uint32), freq.astype(np.uint32) if not len(freq) or freq.max() < 1 << 32 else freq))

    def write(self, buckets: int):
        """Yields (bucket, payload)."""
        term, doc, freq = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.uint32) for i in range(3))
        terms = list(self.index)
        of = bucket_of(terms, buckets)
        names = np.argsort(of, kind="stable")  # terms by bucket
        rank = np.empty(len(terms), np.int64)
        rank[names] = np.arange(len(terms))
        order = np.argsort(rank[term], kind="stable")
        term, doc, freq = rank[term[order]], doc[order], freq[order]
        df = np.bincount(term, minlength=len(terms))
        ends = np.searchsorted(of[names], np.arange(buckets + 1))
        starts = np.concatenate([[0], np.cumsum(df)])
        press = zstandard.ZstdCompressor(level=1)
        for b in range(buckets):
            lo, hi = ends[b], ends[b + 1]
            if lo == hi:
                continue
            p, q = starts[lo], starts[hi]
            text = b"\n".join(terms[i] for i in names[lo:hi].tolist())
            f = freq[p:q].astype(np.int64)
            small = np.minimum(f, 255).astype(np.uint8)
            head = np.asarray([hi - lo, q - p, len(text), int((f >= 255).sum())], np.int64).tobytes()
            yield b, press.compress(head + text + df[lo:hi].astype(np.uint32).tobytes() + doc[p:q].tobytes() + small.tobytes() + f[f >= 255].tobytes())

    @staticmethod
    def read(payload: bytes):
        """(terms, df, doc, freq) of a payload."""
        data = zstandard.ZstdDecompressor().decompress(payload)
        n, m, size, wide = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        terms = data[at : at + size].split(b"\n")
        df = np.frombuffer(data, np.uint32, n, at := at + size)
        doc = np.frombuffer(data, np.uint32, m, at := at + 4 * n)
        freq = np.frombuffer(data, np.uint8, m, at := at + 4 * m).astype(np.int64)
        if wide:
            freq[freq == 255] = np.frombuffer(data[at + m :], np.int64, wide)
        return terms, df, doc, freq


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row for each row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Each task counts the pre-tokens of its documents and deals compressed postings by pre-token; a task that owns a bucket of
    pre-tokens counts their pieces once, joins them to the postings and sends back a sum for each document it has seen. Ids last
    only while a batch of pre-tokens is counted. Memory: a block of text and one payload. A pre-token of every document takes about a byte for each document.
    Null and empty texts have 0 bytes and tokens; repeated rows and repeated or null ids give a row each; other columns are ignored.
    """
    spark = df.sparkSession
    n_buckets = buckets or common.term_buckets(spark)
    id_type = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def deal(batches):
        from pyspark import TaskContext

        tokens, block = PreTokens.of(tokenizer), TaskContext.get().partitionId() << 32
        for table in common.blocks(batches, "text"):
            sizes: list[int] = []
            posts = Postings()
            for part in common.slices(table.to_batches(), "text", 4 << 20):
                texts, first = common.binary(part.column(1)), len(sizes)
                sizes += map(len, texts)
                plain = [tokens.plain(t) for t in texts]
                codes, ends, chunks = common.words([p or b"" for p in plain])
                row, chunk, n = common.tally(common.owners(ends), codes, len(chunks))
                # from chunks to pre-tokens
                index: dict[bytes, int] = {}
                split = [tokens.split(c) for c in chunks]
                size = np.fromiter(map(len, split), np.int64, len(split))
                flat = np.fromiter((index.setdefault(t, len(index)) for ts in split for t in ts), np.int64, int(size.sum()))
                at, each = common.ranges((np.cumsum(size) - size)[chunk], size[chunk]), size[chunk]
                row, term, n = np.repeat(row, each), flat[at], np.repeat(n, each)
                odd = [(i, index.setdefault(t, len(index))) for i, p in enumerate(plain) if p is None for t in tokens.library_split(texts[i])]
                if odd:
                    row, term, n = np.append(row, [i for i, _ in odd]), np.append(term, [t for _, t in odd]), np.append(n, [1] * len(odd))
                row, term, n = common.tally(row, term, len(index), n)
                posts.add(list(index), row + first, term, n)
            rows = list(posts.write(n_buckets))
            yield out(([b for b, _ in rows], [block] * len(rows), [p for _, p in rows], [None] * len(rows), [None] * len(rows)), table["id"].type)
            yield pa.RecordBatch.from_arrays([
                pa.array([block % n_buckets], pa.int32()), pa.array([block], pa.int64()), pa.array([None], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table["id"].combine_chunks()), pa.array([sizes], pa.list_(pa.int64())),
            ], ["bucket", "block", "payload", "ids", "sizes"])
            block += 1

    def out(cols, kind):
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(kind)), pa.array(cols[4], pa.list_(pa.int64()))], ["bucket", "block", "payload", "ids", "sizes"])

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.LongType()))])

    def pieces(batches):
        tokens = PreTokens.of(tokenizer)
        for batch in batches:
            sums = []
            for payload in batch.column(2).to_pylist():
                if payload is None:
                    sums.append(None)
                    continue
                terms, df_, doc, freq = Postings.read(payload)
                n = np.repeat(tokens.counts(terms), df_) * freq
                sums.append(_sparse(doc, n))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, pa.binary()), batch.column(3), batch.column(4)], ["block", "sums", "ids", "sizes"])

    summed = (
        src.mapInArrow(deal, schema).repartition(n_buckets, "bucket")
        .mapInArrow(pieces, T.StructType([T.StructField("block", T.LongType()), T.StructField("sums", T.BinaryType()), schema["ids"], schema["sizes"]]))
    )

    def finish(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = next(x for x in table["sizes"].to_pylist() if x is not None)
        total = np.zeros(len(sizes), np.int64)
        for s in table["sums"].to_pylist():
            if s is not None:
                doc, n = _dense(s)
                total[doc] += n
        ids = table["ids"].drop_null().combine_chunks()
        return pa.table({id_col: ids.flatten() if isinstance(ids, pa.ListArray) else ids.chunk(0).flatten(), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)})

    return summed.groupBy("block").applyInArrow(finish, T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]))


def _sparse(doc: np.ndarray, n: np.ndarray) -> bytes:
    """Sums by document, packed."""
    sums = np.bincount(doc, weights=n, minlength=1).astype(np.int64)
    at = np.flatnonzero(sums)
    return zstandard.ZstdCompressor(level=1).compress(np.asarray([len(at)], np.int64).tobytes() + np.diff(at, prepend=0).astype(np.uint32).tobytes() + sums[at].tobytes())


def _dense(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.cumsum(np.frombuffer(data, np.uint32, n, 8).astype(np.int64)), np.frombuffer(data[8 + 4 * n :], np.int64, n)
