"""A deterministic sharded WARC writer, and the reader of what it committed."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.loops import global_scan
from . import common

#: Fixed value: the date of every record, so that the same rows give the same bytes.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha1 string, first_id string, last_id string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: tuple[str | None, str | None] | None, order: int) -> bytes:
    """One record, uncompressed: a response, or a revisit of the page refers_to (its id and url). order tells repeated rows apart."""
    safe = lambda s: "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in s)
    name = lambda i, u, n: uuid.uuid5(uuid.NAMESPACE_URL, f"{i}\n{u}\n{n}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:uuid:{name(page_id, url, order)}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{name(*refers_to, 0)}>", f"WARC-Refers-To-Date: {DATE}"]
        if refers_to[1]:
            head.append(f"WARC-Refers-To-Target-URI: {safe(refers_to[1])}")
        if refers_to[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to[0]}")
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time
    return press.compress(data) + press.flush()


class Roller:
    """Writes gzip members to numbered files of a run: each under a temporary name of this attempt, renamed when it is whole."""

    def __init__(self, uri: str, part: int, attempt: int, most: int):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.part, self.attempt, self.most = part, attempt, most
        self.number, self.out = 0, None

    def add(self, member: bytes, page_id: str | None):
        """Yields the manifest row of a file that this member closes."""
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{self.attempt}"
            self.out, self.sha, self.size, self.records, self.first = self.fs.open_output_stream(self.temporary), hashlib.sha1(), 0, 0, page_id
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id
        if self.size >= self.most:
            yield self.close()

    def close(self):
        self.out.close()
        self.fs.move(self.temporary, f"{self.path}/{self.name}")  # the same rows give the same bytes: a second attempt changes nothing
        self.out, self.number = None, self.number + 1
        return (self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last)


def write_warc(df: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = 64 << 20, least: int = 0, run_bytes: int = 32 << 20, most_runs: int = 100_000) -> DataFrame:
    """Writes a record for each row under uri, a folder that all executors reach, and returns the manifest that commits them.

    Rows are range-sorted by (id, url, digest) and cut into runs of about `run_bytes` of payload, but at most most_runs runs, where
    the running sum of their sizes says so: the rows alone decide, not a sample or a partitioning. A task writes whole runs and
    rolls the files of each by compressed size, so the same rows give the same files. Of rows with equal payloads of at
    least `least` bytes, the first in that order (smallest id, nulls last) is the response and the others revisit it; equal means
    the same SHA-256. Null html is an empty payload, null ids and urls get no header, repeated rows revisit the first of them.
    Who is first is found on digests alone, and only digests that repeat are joined to it (a join that adaptive execution can split);
    the decisions meet their rows in the sort, so payloads are shuffled once. The first key of each run is broadcast. An empty df
    commits an empty manifest.
    """
    from pyarrow import fs

    spark = df.sparkSession
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(f"{path}/_temporary")
    id_type = df.schema[id_col].dataType
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(html, 256).alias("sha"), html.alias("html"))
    z = F.col("id").isNull().alias("z")
    keys = common.cut(rows.groupBy(z, "id", "url", "sha").agg((F.count("*") * (F.first(F.octet_length("html")) + 1)).alias("bytes"), F.first(F.octet_length("html") >= least).alias("long")))
    scanned = global_scan(keys, F.col("bytes"), ["z", "id", "url", "sha"], "before", inclusive=False)
    wide = max(run_bytes, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // most_runs))
    run = lambda x: F.floor(x / wide)
    firsts = scanned.filter((run(F.col("before")) < run(F.col("before") + F.col("bytes"))) | (F.col("before") == 0)).select("z", "id", "url", "sha").collect()
    key = lambda i, u, sha: (i is None, i if i is not None else 0, u is not None, u or "", sha)
    begins = spark.sparkContext.broadcast(sorted(key(r["id"], r["url"], r["sha"]) for r in firsts)[1:])
    keys = keys.filter("long").select("id", "url", "sha")
    order = lambda: F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("url").alias("url"))
    first = keys.groupBy("sha").agg(F.min(order()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    decided = keys.join(first, "sha", "left").withColumn("first", F.coalesce("first", order())).select("id", "url", "sha", F.lit(None).cast("binary").alias("html"), F.lit(0).alias("kind"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    none = [F.lit(1).alias("kind"), F.lit(None).cast(id_type).alias("first_id"), F.lit(None).cast("string").alias("first_url")]
    both = decided.unionByName(rows.select("id", "url", "sha", "html", *none))

    def numbered(batches):
        """Rows with the number of their run."""
        for b in batches:
            runs = [bisect_right(begins.value, key(*k)) for k in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), *b.columns], ["run", *b.schema.names])

    both = both.mapInArrow(numbered, T.StructType([T.StructField("run", T.IntegerType()), *both.schema.fields]))
    tasks = max(1, min(len(firsts), 4 * common.shuffle_partitions(spark)))
    both = both.repartition(tasks, "run").sortWithinPartitions("run", F.col("id").isNull(), "id", "url", "sha", "kind")

    def write(batches):
        from pyspark import TaskContext

        attempt, roll = TaskContext.get().taskAttemptId(), None
        at, decision, same, done = None, None, 0, []
        for b in common.slices(batches, "html", 8 << 20):
            for run_, page, url, sha, html_, kind, f_id, f_url in zip(*[c.to_pylist() for c in b.columns]):
                if roll is None or run_ != roll.part:
                    if roll is not None and roll.out is not None:
                        done.append(roll.close())
                    roll = Roller(uri, run_, attempt, roll_bytes)
                if (page, url, sha) != at:
                    at, decision, same = (page, url, sha), None, 0
                if kind == 0:
                    decision = (f_id, f_url)
                    continue
                refers = None if decision is None or (decision == (page, url) and same == 0) else decision
                text = lambda x: None if x is None else str(x)
                member = gzip_member(record(text(page), url, html_, refers and (text(refers[0]), refers[1]), same))
                done += roll.add(member, text(page))
                same += 1
        if roll is not None and roll.out is not None:
            done.append(roll.close())
        yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=arrow)

    names = ["file", "records", "bytes", "sha1", "first_id", "last_id"]
    arrow = pa.schema([(n, pa.int64() if n in ("records", "bytes") else pa.string()) for n in names])
    both.mapInArrow(write, MANIFEST).write.parquet(f"{uri}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def read_records(stream):
    """(headers, block) of each record of a gzipped WARC stream, one record in memory at a time."""
    press, held, more = zlib.decompressobj(31), bytearray(), True
    data = b""
    while more:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        held += press.decompress(data)
        data = press.unused_data
        if press.eof:
            head, _, rest = bytes(held).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            press, held = zlib.decompressobj(31), bytearray()
        elif not data:
            continue
    if held:
        raise ValueError("a record ends in its middle")


def read_warc(spark: SparkSession, uri: str, id_type: T.DataType, id_col: str = "page_id") -> DataFrame:
    """One row for each record of the files that the manifest names: id, payload_bytes, payload_digest, record_type, refers_to.
    Digests are computed anew; a block or payload that differs from its header raises an error."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest").select("file")

    def read(batches):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                out: list[tuple] = []
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in read_records(stream):
                        if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a block does not fit its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"{name}: a payload does not fit its digest")
                        out.append((h.get("X-Page-ID"), n, digest, h["WARC-Type"], h.get("X-Refers-To-Page-ID")))
                        if len(out) == 10_000:
                            yield rows(out)
                            out = []
                if out:
                    yield rows(out)

    def rows(out):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], ["id", "payload_bytes", "payload_digest", "record_type", "refers"])

    n = max(1, manifest.count())
    read_back = manifest.repartition(n).mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers string")
    return read_back.select(F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))
