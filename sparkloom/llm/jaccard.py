"""Exact Jaccard join of shingle sets: skipping blocks of index lists by size and position, and deriving answers from similar sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Counters of the sketch that orders shingles, rarest first. A coarser sketch costs candidates, never links.
SKETCH_BITS = 23
#: Candidate sets up to this many are named to every task (a text's digest each, 32 MB); beyond, all sets are joined to their names.
BROADCAST_SETS = 4 << 20
#: Links that a task joins at once into stars.
TASK_LINKS = 400_000
#: Entries of one index list that a task compares with as many others; longer lists are cut and their parts compared in pairs.
LIST_PART = 4_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends[row]): for each text the sorted hashes of the distinct runs of `width` words; fewer words are one run, none
    give no shingle."""
    import xxhash

    codes, ends, names = common.words([t.lower() for t in texts])
    h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[codes]
    row = common.owners(ends)
    many = np.diff(ends, prepend=0)
    n = np.minimum(many, width)
    out = n[row].astype(np.uint64)
    pad = np.concatenate([h, np.zeros(width, np.uint64)])
    for k in range(width):
        step = mix(out * np.uint64(0x100000001B3) + pad[k : k + len(h)])
        out = step if not len(n) or n[many > 0].min(initial=width) > k else np.where(n[row] > k, step, out)
    keep = np.arange(len(h)) <= (ends - n)[row]
    out, row = out[keep], row[keep]
    at = np.cumsum(np.where(many > 0, many - n + 1, 0))
    for i, j in zip(np.concatenate([[0], at]).tolist(), at.tolist()):
        out[i:j].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def set_ids(hashes: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """16 bytes that tell each set; None for an empty one."""
    some = np.flatnonzero(np.diff(ends, prepend=0))
    out: list[bytes | None] = [None] * len(ends)
    if len(some):
        starts = np.concatenate([[0], ends])[some]
        sums = np.stack([np.add.reduceat(mix(x), starts) for x in (hashes, hashes ^ np.uint64(0x5851F42D4C957F2D))], 1).astype(">u8")
        for i, x in zip(some.tolist(), sums):
            out[i] = x.tobytes()
    return out


def most_apart(size: int, num: int, den: int) -> int:
    """The most shingles in which a set of this size and one that links with it differ."""
    return size * (den - num) // num


def parities(s: np.ndarray, num: int, den: int) -> bytes:
    """Whether an even or odd number of the set's shingles falls on each bit: eight bits for each shingle in which a set that links
    may differ, 512 to 4096. Two sets differ in at least as many shingles as their parities in bits."""
    bits = min(4096, max(512, 1 << (8 * most_apart(len(s), num, den)).bit_length()))
    place = (mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def bits_apart(a: tuple[int, int], b: tuple[int, int]) -> int:
    """In how many bits two parities (number, bits) differ; the longer one is folded first."""
    (x, m), (y, n) = a, b
    while m > n:
        m >>= 1
        x = (x ^ (x >> m)) & ((1 << m) - 1)
    while n > m:
        n >>= 1
        y = (y ^ (y >> n)) & ((1 << n) - 1)
    return (x ^ y).bit_count()


def digest(text: bytes) -> int:
    """64 bits by which later passes find a text again; texts that share one only cost a set more."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def overlap_needed(a: int, b: int, num: int, den: int) -> int:
    """The least intersection of sets of a and b shingles that link: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (den + num))


def jaccard_components(df: DataFrame, num: int = 90, den: int = 100, width: int = 3, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS, broadcast_most: int = BROADCAST_SETS, list_part: int = LIST_PART) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two texts link when den * |A and B| >= num * |A or B|; those without words link with nothing. Rows of one set are one class
    from the start (null ids count as greatest; a class of null ids has a null component). Then, on distinct sets:
    1. Shingles are ordered by a sketch of how many sets have them, rarest first, then by hash. Two sets that link share one of
       the first (1 - num/den) |A| + 1 of each; these go to index lists, with their position and the set's size.
    2. In each list and range of sizes the entry of the least position is a centre: it has the fewest shingles of its own. A set
       takes the one of its centres that its parities allow, and is compared with it on whole sets. Links make components.
    3. Answers of sets with one centre are derived from the centre's: what tells a set from its centre (its difference) is known, and
       two such sets link only if their differences do not differ by more than they may. Differences have index lists of their own,
       in the group of the centre, the members' rarest parts first, so what the whole group shares costs nothing.
    4. Sets of different centres and components are found by the first index lists. All lists are read in blocks of one size and
       position; a block whose size or position leaves too little to share is skipped with all its entries, as are blocks of one component
       or centre. What is left is parted by parities, then verified on whole sets.
    A large group of near copies costs about a pair a member, whereas all pairs that differ are found. Long lists are cut into parts
    of list_part entries, and each pair of parts is a task's work of its own.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    parts = common.shuffle_partitions(spark)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    # classes of equal sets
    def identify(batches):
        common.only("jaccard")
        sketch = np.zeros(1 << sketch_bits, np.uint32)
        seen: set[bytes] = set()
        for b in common.slices(batches, "text", 8 << 20):
            texts = common.binary(b.column(1))
            hashes, ends = shingle_sets(texts, width)
            ids, sizes = set_ids(hashes, ends), np.diff(ends, prepend=0)
            odd, digests = [None] * len(ids), [None] * len(ids)
            for i, key in enumerate(ids):
                if key is not None:
                    s = hashes[ends[i] - sizes[i] : ends[i]]
                    odd[i], digests[i] = parities(s, num, den), digest(texts[i])
                    if key not in seen and len(seen) < 2_000_000:
                        seen.add(key)
                        np.add.at(sketch, (s >> np.uint64(64 - sketch_bits)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(len(ids), pa.int32()), pa.array(odd, pa.binary()), pa.array(digests, pa.uint64()).view(pa.int64())], names)
        if sketch.any():
            cut = [common.pack(x) for x in np.split(sketch, 32)]
            yield pa.RecordBatch.from_arrays([pa.nulls(32, id_arrow), pa.nulls(32, pa.binary()), pa.nulls(32, pa.int64()), pa.array(range(32), pa.int32()), pa.array(cut, pa.binary()), pa.nulls(32, pa.int64())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    kind = T.StructType([T.StructField("id", id_type), T.StructField("set", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("digest", T.LongType())])
    names = kind.names
    told = common.cut(src.mapInArrow(identify, kind))

    def add(batches):
        at, held = None, None
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = common.unpack(data, np.uint32).astype(np.int64)
                if part != at:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([common.pack((8 * np.log2(held + 1)).astype(np.uint8))], pa.binary())], ["part", "sketch"])
                    at, held = part, one
                else:
                    held += one
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([common.pack((8 * np.log2(held + 1)).astype(np.uint8))], pa.binary())], ["part", "sketch"])

    summed = told.filter("part is not null").select("part", "sketch").repartition(32, "part").sortWithinPartitions("part").mapInArrow(add, "part int, sketch binary").collect()
    ranks = np.zeros((32, (1 << sketch_bits) // 32), np.uint8)
    for r in summed:
        ranks[r["part"]] = common.unpack(bytes(r["sketch"]), np.uint8)
    ranks = spark.sparkContext.broadcast(ranks.ravel())  # 2**sketch_bits bytes

    def rank(s: np.ndarray) -> np.ndarray:
        return ranks.value[(s >> np.uint64(64 - sketch_bits)).astype(np.int64)]

    # index entries: the first shingles of each distinct set of a task
    def prefixes(batches):
        sent: set[bytes] = set()
        for b in common.slices(batches, "text", 8 << 20):
            toks, sets, sizes, places = [], [], [], []
            hashes, ends = shingle_sets(common.binary(b.column(1)), width)
            begins = np.concatenate([[0], ends])
            order = rank(hashes)
            for i, key in enumerate(set_ids(hashes, ends)):
                if key is None or key in sent:
                    continue
                if len(sent) < 2_000_000:
                    sent.add(key)
                s = hashes[begins[i] : ends[i]]
                n = len(s) - (-(-num * len(s) // den)) + 1
                toks.append(s[np.argsort(order[begins[i] : ends[i]], kind="stable")[:n]].view(np.int64))
                sets += [key] * n
                sizes += [len(s)] * n
                places += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(places, pa.int32())], ["tok", "set", "size", "pos"])

    entries = src.mapInArrow(prefixes, "tok long, set binary, size int, pos int").repartition(parts, "tok").sortWithinPartitions("tok", "size", "set")

    def shared(batches):
        """Entries with another set of their list in reach of their size, once for each set. Entries come by list and size, so the
        nearest sizes are next to them; the last entry waits for the next batch."""
        held, told_ = None, False  # the last entry, and whether it is out already
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            tok, sets = table.column(0).to_numpy(), table.column(1).to_pylist()
            same = tok[1:] == tok[:-1]
            fresh = np.concatenate([[True], ~(same & np.fromiter((x == y for x, y in zip(sets, sets[1:])), bool, len(same)))])
            at = np.flatnonzero(fresh)
            tok = tok[at]
            size = table.column(2).to_numpy()[at].astype(np.int64)
            before = np.concatenate([[False], (tok[1:] == tok[:-1]) & (size[1:] * num <= size[:-1] * den)])
            after = np.append(before[1:], False)
            keep = before | after
            keep[0] &= not (held is not None and told_)
            last_told = bool(keep[-1]) or (len(at) == 1 and held is not None and told_)
            yield table.take(pa.array(at[keep])).combine_chunks().to_batches()[0] if keep.any() else b.slice(0, 0)
            held, told_ = table.slice(int(at[-1]), 1).combine_chunks().to_batches()[0], last_told

    sets = told.filter("set is not null").groupBy("set").agg(F.first("size").alias("size"), F.first("sketch").alias("odd"), F.min("digest").alias("digest"))
    odd = sets.select("set", "odd")
    lists = common.cut(entries.mapInArrow(shared, "tok long, set binary, size int, pos int"))

    def read(odd: bytes) -> tuple[int, int]:
        return int.from_bytes(odd, "little"), 8 * len(odd)

    def allowed(a: int, b: int) -> int:
        """In how many shingles sets of a and b that link may differ."""
        return a + b - 2 * overlap_needed(a, b, num, den)

    def weigh(batches):
        """Candidate centres (a, b, size and parities of both, position) with 0 if they may link, 1 if they are not far from it."""
        for b in batches:
            far = []
            for m, n, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                apart, most = bits_apart(read(x), read(y)), allowed(m, n)
                far.append(0 if apart <= most else 1 if 2 * apart <= 3 * most else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.int32()), b.column(6)], ["a", "b", "far", "pos"])

    def centres() -> DataFrame:
        """(a, b): sets b with their centres a. Ranges of sizes are as wide as links reach and overlap by half."""
        half = F.floor(F.log(F.col("size").cast("double")) / (np.log(den / num) / 2 if den > num else 1e-9)).cast("long")
        ranges = F.array(F.floor(half / 2) * 2, F.floor((half + 1) / 2) * 2 + 1)
        own = lists.select("tok", "set", "size", "pos", F.explode(ranges).alias("sizes"))
        first = own.groupBy("tok", "sizes").agg(F.min(F.struct("pos", "set", "size")).alias("c"), F.count("*").alias("n")).filter("n > 1").select("tok", "sizes", "c")
        both = F.col("size") + F.col("c.size")
        need = F.ceil(both * num / (den + num) - 1e-9)
        pairs = own.join(first, ["tok", "sizes"]).filter((F.col("set") != F.col("c.set")) & (F.least(F.col("size") - F.col("pos"), F.col("c.size") - F.col("c.pos")) >= need))
        pairs = pairs.groupBy(F.col("c.set").alias("a"), F.col("set").alias("b")).agg(F.first("c.size").alias("m"), F.first("size").alias("n"), F.min("c.pos").alias("pos"))
        pairs = pairs.join(odd.select(F.col("set").alias("a"), F.col("odd").alias("x")), "a").join(odd.select(F.col("set").alias("b"), F.col("odd").alias("y")), "b")
        told_ = pairs.select("a", "b", "m", "n", "x", "y", "pos").mapInArrow(weigh, "a binary, b binary, far int, pos int").filter("far is not null")
        return told_.groupBy("b").agg(F.min(F.struct("far", "pos", "a")).alias("way")).select(F.col("way.a").alias("a"), "b")

    def by_list(batches):
        """Rows of each list or pair of its parts, as tuples; they come one after the other."""
        at, held = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            cols[7] = [read(x) for x in cols[7]]
            for row in zip(*cols):
                if row[:3] != at:
                    if len(held) > 1:
                        yield held
                    at, held = row[:3], []
                held.append(row)
        if len(held) > 1:
            yield held

    def codes(values: list) -> np.ndarray:
        """A number for each value, -1 for None."""
        at: dict = {}
        return np.asarray([-1 if v is None else at.setdefault(v, len(at)) for v in values], np.int64)

    def across(derived: bool):
        """Pairs of different components: rows are (tok, low, high, part, set, size, pos, parities, component, centre, apart), apart
        being the size of the difference whose index list it is where derived."""

        def f(batches):
            found: set = set()
            for rows in by_list(batches):
                held: dict = {}
                for r in rows:
                    held[r[8]] = held.get(r[8], 0) + 1
                if len(held) < 2:
                    continue
                blocks: dict = {}
                for r in rows:
                    blocks.setdefault((r[5], r[6], r[10], r[3], None if derived else r[9], r[8] if held[r[8]] > 1 else None), []).append(r)
                keys = sorted(blocks, key=lambda k: k[:4])
                members = [blocks[k] for k in keys]
                size, pos, apart, part = (np.asarray([k[i] for k in keys], np.int64) for i in range(4))
                centre, component = codes([k[4] for k in keys]), codes([k[5] for k in keys])
                split = rows[0][1] != rows[0][2]
                for j in range(len(keys)):
                    lo = int(np.searchsorted(size, -(-num * size[j] // den)))  # the blocks of sizes that do not reach this one are skipped
                    i = slice(lo, j + 1)
                    most = size[i] + size[j] - 2 * -(-num * (size[i] + size[j]) // (den + num))
                    if derived:
                        ok = (2 * pos[i] <= apart[i] - apart[j] + most) & (2 * pos[j] <= apart[j] - apart[i] + most)
                    else:
                        ok = 2 * np.minimum(size[i] - pos[i], size[j] - pos[j]) >= size[i] + size[j] - most
                        ok &= (centre[i] != centre[j]) | (centre[j] < 0)
                    ok &= (component[i] != component[j]) | (component[j] < 0)
                    if split:
                        ok &= part[i] != part[j]
                    for k in (lo + np.flatnonzero(ok)).tolist():
                        limit = int(most[k - lo])
                        for n, y in enumerate(members[j]):
                            for x in members[k][:n] if k == j else members[k]:
                                if x[8] != y[8] and x[4] != y[4] and bits_apart(x[7], y[7]) <= limit:
                                    found.add((x[4], y[4]) if x[4] < y[4] else (y[4], x[4]))
                        if len(found) > 100_000:
                            yield pairs_out(found)
                            found = set()
            yield pairs_out(found)

        return f

    def pairs_out(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    def compared(rows: DataFrame, derived: bool) -> DataFrame:
        """Pairs (a, b) of the lists tok of rows (tok, set, size, pos, component, centre, apart) that hold several components."""
        mixed = rows.groupBy("tok").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high").select("tok", F.ceil(F.col("n") / list_part).cast("int").alias("k"))
        rows = rows.join(mixed, "tok").join(odd, "set").withColumn("part", F.pmod(F.xxhash64("set"), F.col("k")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = rows.select("tok", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "set", "size", "pos", "odd", "component", "centre", "apart")
        return rows.repartition(parts, "tok", "low", "high").sortWithinPartitions("tok", "low", "high").mapInArrow(across(derived), "a binary, b binary")

    def sets_of(wanted):
        """Sets of the texts whose digests are wanted (a few others may come too), or of all."""

        def f(batches):
            sent: set[bytes] = set()
            for b in common.slices(batches, "text", 8 << 20):
                keys, bodies = [], []
                texts = common.binary(b.column(1))
                if wanted is not None:
                    own = np.fromiter(map(digest, texts), np.uint64, len(texts)).view(np.int64)
                    at = np.minimum(np.searchsorted(wanted.value, own), max(len(wanted.value) - 1, 0))
                    texts = [texts[i] for i in np.flatnonzero(wanted.value[at] == own)] if len(wanted.value) else []
                hashes, ends = shingle_sets(texts, width)
                begins = np.concatenate([[0], ends])
                for i, key in enumerate(set_ids(hashes, ends)):
                    if key is not None and key not in sent:
                        if len(sent) < 2_000_000:
                            sent.add(key)
                        keys.append(key)
                        bodies.append(hashes[begins[i] : ends[i]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], ["set", "body"])

        return f

    def verify(differences: bool):
        """Sizes and intersection of two sets; what tells the second from the first, the parts that fewest members of a group around the
        first have in front: a shingle that the first lacks, if rare, or one that it has, if frequent."""

        def f(batches):
            for b in batches:
                inter, left, right, told_ = [], [], [], []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    there = x[at] == y
                    i = int(there.sum())
                    inter.append(i)
                    left.append(len(x))
                    right.append(len(y))
                    if differences and len(x) + len(y) - 2 * i <= len(y):
                        lost = np.ones(len(x), bool)
                        lost[at[there]] = False
                        n = 2.0 ** (rank(x) / 8)
                        d = np.concatenate([y[~there], x[lost]])
                        told_.append(d[np.lexsort((d, np.concatenate([2.0 ** (rank(y[~there]) / 8), n.max() + 1 - n[lost]])))].tobytes())
                    else:
                        told_.append(None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inter, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(told_, pa.binary())], ["a", "b", "both", "na", "nb", "difference"])

        return f

    def checked(pairs: DataFrame, differences: bool = False) -> DataFrame:
        """Pairs (a, b) with whether they link and, if asked, b's difference from a."""
        pairs = common.cut(pairs)
        wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        if wanted.count() <= broadcast_most:
            texts = np.sort(common.numbers(sets.join(wanted, "set", "left_semi").select("digest")))
            bodies = src.mapInArrow(sets_of(spark.sparkContext.broadcast(texts)), "set binary, body binary")
        else:
            bodies = src.mapInArrow(sets_of(None), "set binary, body binary").join(wanted, "set", "left_semi")
        bodies = common.cut(bodies.groupBy("set").agg(F.max("body").alias("body")))
        a, b = bodies.select(F.col("set").alias("a"), F.col("body").alias("x")), bodies.select(F.col("set").alias("b"), F.col("body").alias("y"))
        rows = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(verify(differences), "a binary, b binary, both long, na long, nb long, difference binary")
        return common.cut(rows.withColumn("linked", den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))))

    def differences(batches):
        """Index entries of the members of groups: rows are (centre, set, size, component, difference)."""
        for b in batches:
            toks, at, places, apart = [], [], [], []
            for i, (centre, size, d) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 4)))):
                d = np.frombuffer(d, np.uint64)
                own = d[: most_apart(size, num, den) + 1]
                toks.append(mix(own ^ np.uint64(int.from_bytes(centre[:8], "big"))).view(np.int64))
                at += [i] * len(own)
                places += range(len(own))
                apart += [len(d)] * len(own)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)), b.column(1).take(at), b.column(2).take(at), pa.array(places, pa.int32()), b.column(3).take(at), b.column(0).take(at), pa.array(apart, pa.int32())], ["tok", "set", "size", "pos", "component", "centre", "apart"])

    stars = checked(centres(), True)
    links = stars.filter("linked").select("a", "b")
    first = common.cut(components(links).select(F.col("node").alias("set"), "root"))
    component = F.coalesce("root", "set").alias("component")
    groups = stars.filter("difference is not null").select(F.col("b").alias("set"), F.col("a").alias("centre"), F.col("nb").cast("int").alias("size"), "difference")
    named = lists.join(first, "set", "left").join(groups.select("set", "centre"), "set", "left").select("tok", "set", "size", "pos", component, "centre", F.lit(0).alias("apart"))
    # a set whose difference is empty is the centre, and what links by the sum of two differences links with the centre, too
    members = groups.join(first, "set", "left").select("centre", "set", "size", component, "difference")
    mixed = members.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("centre")
    derived = members.join(mixed, "centre", "left_semi").mapInArrow(differences, "tok long, set binary, size int, pos int, component binary, centre binary, apart int")
    more = compared(named, False).union(compared(derived, True)).distinct()
    rest = checked(more.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    roots = components(links.union(rest.filter("linked").select("a", "b")))

    rows = told.filter("part is null").select("id", "set", "size")
    classes = rows.filter("set is not null").groupBy("set").agg(F.min("id").alias("least"))
    rooted = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("set", "component_id")
    out = rows.join(named, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def state_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def forest(batches):
    """For the links of a task: (node, least node of its component among these links), without the roots themselves."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([root(x) for x in part], pa.binary())], ["v", "u"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that links reach.

    First each task replaces its links by the stars of the components that they make, so that a group of many links costs later
    joins a row a member. Then alternating large and small stars: a round links each node's greater neighbours, then its other
    neighbours, to the least of them. Rounds grow with the logarithm of a component's size; edges never outnumber the links."""
    edges = common.cut(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct())
    tasks = -(-edges.count() // TASK_LINKS)
    edges = common.cut(edges.coalesce(max(1, tasks)).mapInArrow(forest, "v binary, u binary"))  # v > u
    before = state_of(edges)
    for _ in range(64):
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").union(low.select("v", F.col("m").alias("u"))).distinct()
        edges = common.cut(small)
        state = state_of(edges)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components have not settled in 64 rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one document of each component: that with the smallest id; those without words all stay. Columns stay as they are.
    Repeated rows of the id that stays are told apart by nothing, so they all stay; drop exact copies first."""
    found = jaccard_components(df, id_col=id_col, text_col=text_col, **options)
    gone = common.cut(found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct())
    return df.join(gone, df[id_col].eqNullSafe(gone["__gone"]), "left_anti")
