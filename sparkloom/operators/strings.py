"""Text and string algorithms."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import tokens
from ..plans.loops import cut, dense_index


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n)"""
    return texts.select(F.explode(tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def insert_delete_distance(a: Column, b: Column) -> Column:
    """The least number of insertions and deletions that make b of a (no substitutions): |a| + |b| - 2 LCS; null beside a null. Rows of
    the table of longest common subsequences are whole numbers, a bit for each character of a: 0 where the length grows."""

    @F.pandas_udf("long")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str, t: str) -> int | None:
            if s is None or t is None:
                return None
            full, at = (1 << len(s)) - 1, {}
            for i, c in enumerate(s):
                at[c] = at.get(c, 0) | 1 << i
            row = full
            for c in t:
                hit = row & at.get(c, 0)
                row = (row + hit | row - hit) & full
            return len(s) + len(t) - 2 * (len(s) - row.bit_count())

        return pd.Series([one(s, t) for s, t in zip(x, y)], dtype="Int64")

    return distance(a, b)


def matches(texts: DataFrame, id_col: str, column: str, pattern: str) -> DataFrame:
    """(id, at): all places, from 0 and overlaps included, where pattern begins."""
    n = F.greatest(F.length(column) - len(pattern), F.lit(-1))
    places = F.when(n >= 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(F.col(column), i + 1, F.lit(len(pattern))) == pattern)).otherwise(F.array().cast("array<int>"))
    return texts.filter(F.col(column).contains(pattern)).select(F.col(id_col).alias("id"), F.explode(places).alias("at"))


def suffix_arrays(texts: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, rank, at) of all suffixes of each text, ids unique, by prefix doubling: ranks of 2k characters come from two ranks of k by a
    join on the place, for all texts at once. Null and empty texts have none."""
    chars = F.posexplode(F.regexp_extract_all(F.col(column), F.lit("(?s)(.)"), F.lit(1))).alias("at", "c")
    rows = cut(texts.select(F.col(id_col).alias("id"), chars).select("id", F.col("at").cast("long").alias("at"), F.ascii("c").cast("long").alias("r")))
    total, k = rows.agg(F.count("*"), F.max("at")).first(), 1
    while True:
        nxt = rows.select("id", (F.col("at") - k).alias("at"), F.col("r").alias("r2"))
        both = cut(rows.join(nxt, ["id", "at"], "left").select("id", "at", "r", F.coalesce("r2", F.lit(-1)).alias("r2")))
        names = cut(dense_index(both.select("id", "r", "r2").distinct(), ["id", "r", "r2"], "new"))
        rows = cut(both.join(names, ["id", "r", "r2"]).select("id", "at", F.col("new").alias("r")))
        if names.count() == total[0] or k > total[1]:
            first = rows.groupBy("id").agg(F.min("r").alias("first"))
            return rows.join(first, "id").select("id", (F.col("r") - F.col("first")).alias("rank"), "at")
        k *= 2


def longest_common_prefixes(suffixes: DataFrame, texts: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, rank, at, lcp): shared first characters of each suffix and the one before it in order. From place to place the number
    falls by one at most, so a text takes time in proportion to its length; one text fits a task."""

    def f(sa: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sa = sa.sort_values("rank")
        order, n = sa["at"].tolist(), 0
        if not order:
            return pd.DataFrame({"id": [], "rank": [], "at": [], "lcp": []})
        text, lcp = rows["text"].iloc[0], [0] * len(order)
        place = {at: r for r, at in enumerate(order)}
        for at in range(len(order)):
            r = place[at]
            if not r:
                n = 0
                continue
            before = order[r - 1]
            while max(at, before) + n < len(text) and text[at + n] == text[before + n]:
                n += 1
            lcp[r], n = n, max(0, n - 1)
        return pd.DataFrame({"id": sa["id"], "rank": sa["rank"], "at": order, "lcp": lcp})

    kind = suffixes.schema["id"].dataType.simpleString()
    own = texts.select(F.col(id_col).alias("id"), F.col(column).alias("text"))
    return suffixes.groupBy("id").cogroup(own.groupBy("id")).applyInPandas(f, f"id {kind}, rank long, at long, lcp long")


def longest_repeated_substrings(texts: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, length, first, second) of each text that is not empty: two places of its longest repeated substring, which is the first in
    suffix order of those of one length. A text without repetition has length 0 and nulls."""
    sa = cut(suffix_arrays(texts, id_col, column))
    lcp = longest_common_prefixes(sa, texts, id_col, column)
    best = lcp.groupBy("id").agg(F.min(F.struct((-F.col("lcp")).alias("less"), "rank", "at")).alias("m")).select("id", (-F.col("m.less")).alias("length"), "m.rank", "m.at")
    other = sa.select("id", (F.col("rank") + 1).alias("rank"), F.col("at").alias("other"))
    found = lambda pick: F.when(F.col("length") > 0, pick("at", "other"))
    return best.join(other, ["id", "rank"], "left").select("id", "length", found(F.least).alias("first"), found(F.greatest).alias("second"))


def suffix_array(spark, text: str) -> DataFrame:
    """(rank, at) of all suffixes of one text."""
    return suffix_arrays(spark.createDataFrame([(0, text)], "id long, text string"), "id", "text").select("rank", "at")


def longest_repeated_substring(spark, text: str) -> DataFrame:
    """One row: length, and the starts of two occurrences; none for an empty text."""
    return longest_repeated_substrings(spark.createDataFrame([(0, text)], "id long, text string"), "id", "text").select("length", "first", "second")


def bw_encode(spark, text: str) -> str:
    """The Burrows-Wheeler transform of text with an end mark that sorts first."""
    sa = suffix_array(spark, text)
    rows = sa.orderBy("rank").collect()  # the text is the driver's own
    return text[-1:] + "".join(text[r["at"] - 1] if r["at"] else "\0" for r in rows)


def huffman_lengths(counts: dict[str, int]) -> dict[str, int]:
    """Code lengths of symbols; one symbol alone has length 1."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    depth = {s: 0 for s in counts}
    if len(heap) == 1:
        return {s: 1 for s in counts}
    k = len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, k, x + y))
        k += 1
    return depth


def huffman_cost(texts: DataFrame, column: str) -> int:
    """Bits of all texts under the Huffman code of their characters; the alphabet's counts go to the driver."""
    chars = texts.select(F.explode(F.split(column, "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    counts = {r["c"]: r["n"] for r in chars.collect()}
    depth = huffman_lengths(counts)
    return sum(counts[c] * depth[c] for c in counts)


def nearest_smaller(seq: DataFrame) -> DataFrame:
    """(idx, value, parent): the Cartesian tree of a sequence, its parents the greater of the nearest smaller values on both sides.
    Meant for sequences of a group that fits a task; group by key for many."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, at = pdf["value"].tolist(), pdf["idx"].tolist()
        stack, left, right = [], [None] * len(v), [None] * len(v)
        for i, x in enumerate(v):
            while stack and v[stack[-1]] > x:
                right[stack.pop()] = i
            left[i] = stack[-1] if stack else None
            stack.append(i)
        up = [max((j for j in (left[i], right[i]) if j is not None), key=lambda j: (v[j], j == left[i]), default=None) for i in range(len(v))]
        return pd.DataFrame({"key": pdf["key"], "idx": at, "value": v, "parent": pd.array([None if j is None else at[j] for j in up], dtype="Int64")})

    return seq.groupBy("key").applyInPandas(f, "key long, idx long, value double, parent long")


def range_min(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, value): the least value of idx from lo to hi, by a sparse table: the minima of all runs of a power of two."""
    n = max(1, seq.count())
    table = seq.select("idx", F.lit(0).alias("k"), "value")
    row, k = table, 0
    while (2 << k) <= n:
        other = row.select((F.col("idx") - (1 << k)).alias("idx"), F.col("value").alias("v"))
        row = cut(row.join(other, "idx").select("idx", F.lit(k + 1).alias("k"), F.least("value", "v").alias("value")))
        table = table.union(row)
        k += 1
    span = queries.withColumn("k", F.floor(F.log2(F.col("hi") - F.col("lo") + 1) + 1e-12).cast("int"))
    asked = span.select("qid", "k", F.explode(F.array(F.col("lo"), F.expr("hi - shiftleft(1, k) + 1"))).alias("idx"))
    return asked.join(table, ["idx", "k"]).groupBy("qid").agg(F.min("value").alias("value"))


