"""Toxicity by the nearest labelled examples: TF-IDF cosine over a block-max inverted index, and distance-weighted, calibrated votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .langid import plain_words

#: A term that tells label 1 weighs more: it must be in LEAST_EXAMPLES of it, and its log-likelihood ratio counts beyond TELLING. Every
#: other word weighs BASE times its inverse document frequency.
LEAST_EXAMPLES, TELLING, BASE = 5, 15.0, 0.3
#: The beginnings of words are terms, too, where they tell label 1: forms of one stem share them. This many times as frequent, and a
#: log-likelihood ratio that one term in some ten million reaches by chance.
PREFIXES, LEAST_RATIO, LEAST_G2 = (4, 5, 6), 8.0, 30.0
#: Similarity (squared) that the prior's vote has, and from which on an example counts as a copy when votes are calibrated.
PRIOR_VOTE, COPY = 0.02, 0.999


def stems_of(word: bytes) -> list[bytes]:
    """The beginnings of a word, marked as such."""
    if word.isascii():
        return [word[:n] + b"*" for n in PREFIXES if len(word) > n]
    chars = word.decode("utf-8")
    return [chars[:n].encode() + b"*" for n in PREFIXES if len(chars) > n]


class Terms(dict):
    """word -> numbers of its terms in the vocabulary, remembered for at most `most` words."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = tuple(self.vocabulary[t] for t in (word, *stems_of(word)) if t in self.vocabulary)
        return found

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, frequency) of all texts, by row and term."""
        codes, ends, names = common.words(list(map(plain_words, texts)))
        row, word, n = common.tally(common.owners(ends), codes, len(names))
        found = [self[w] for w in names]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for ts in found for t in ts), np.int64, int(size.sum()))
        at, each = common.ranges((np.cumsum(size) - size)[word], size[word]), size[word]
        return common.tally(np.repeat(row, each), flat[at], len(self.vocabulary), np.repeat(n, each))


class BlockMaxIndex:
    """Unit vectors of n examples, as (row, term, weight): postings of the terms, and blocks of `width` examples.

    Postings of rare terms are summed as they are. Terms that more than one in `frequent` examples have are kept by block, with
    the greatest weight of each term and block: they give each block a bound, the blocks of the greatest bounds are scored
    first, and those that cannot reach the k-th best are skipped. The result is that of all products, in single precision."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, width: int = 64, frequent: int = 32):
        self.n, self.width, self.blocks = n, width, -(-n // width)
        held = np.bincount(term, minlength=terms)
        self.place = np.full(terms, -1)  # of frequent terms
        often = np.flatnonzero(held * frequent > n)
        self.place[often] = np.arange(len(often))
        dense = self.place[term] >= 0
        self.often = np.zeros((self.blocks * width, len(often)), np.float32)
        self.often[row[dense], self.place[term[dense]]] = weight[dense]
        self.peaks = self.often.reshape(self.blocks, width, len(often)).max(1) if n else np.zeros((0, len(often)), np.float32)
        order = np.argsort(term[~dense], kind="stable")
        self.at, self.weight = row[~dense][order], weight[~dense][order].astype(np.float32)
        self.size = np.bincount(term[~dense], minlength=terms)
        self.start = np.cumsum(self.size) - self.size

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, similarity) of the k examples with the greatest positive products of each query, best first; ties go to the smaller
        number, and -1 stands where there are fewer."""
        best, near = np.full((queries, k), -1), np.zeros((queries, k), np.float32)
        if not self.n:
            return best, near
        for lo in range(0, queries, 64):
            hi = min(lo + 64, queries)
            i, j = np.searchsorted(row, [lo, hi])
            self._some(row[i:j] - lo, term[i:j], weight[i:j], best[lo:hi], near[lo:hi], k)
        return best, near

    def _some(self, row, term, weight, best, near, k: int) -> None:
        q, wide = len(best), self.blocks * self.width
        place = self.place[term]
        rare = place < 0
        each = self.size[term[rare]]
        at = common.ranges(self.start[term[rare]], each)
        scores = np.bincount(np.repeat(row[rare] * wide, each) + self.at[at], weights=np.repeat(weight[rare], each) * self.weight[at], minlength=q * wide).astype(np.float32).reshape(q, wide)
        often = np.zeros((q, self.often.shape[1]), np.float32)
        often[row[~rare], place[~rare]] = weight[~rare]
        bound = scores.reshape(q, self.blocks, self.width).max(2) + often @ self.peaks.T
        first = min(self.blocks, -(-k // self.width))
        top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        least = np.zeros(q, np.float32)  # the k-th best of the first blocks
        for x in range(q):
            found = np.concatenate([scores[x, c * self.width : (c + 1) * self.width] + self.often[c * self.width : (c + 1) * self.width] @ often[x] for c in top[x].tolist()])
            if len(found) >= k:
                least[x] = np.partition(found, -k)[-k]
        open_ = (bound >= least[:, None] * (1 - 1e-5)) & (bound > 0)
        many = open_.sum(1) * 4 > self.blocks
        full = np.flatnonzero(many)
        if len(full):
            scores[full] += often[full] @ self.often.T
        for x in range(q):
            if many[x]:
                own, number = scores[x], None
            else:
                number = (np.flatnonzero(open_[x])[:, None] * self.width + np.arange(self.width)).ravel()
                own = scores[x, number] + self.often[number] @ often[x]
            if len(own) > k:
                keep = np.flatnonzero(own >= np.partition(own, -k)[-k])
            else:
                keep = np.arange(len(own))
            keep = keep[own[keep] > 0]
            keep = keep[np.lexsort((keep, -own[keep]))][:k]
            best[x, : len(keep)] = keep if number is None else number[keep]
            near[x, : len(keep)] = own[keep]


def unit(row: np.ndarray, term: np.ndarray, n: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Weights of unit length a row: the square root of the frequency times the term's weight."""
    w = n**0.5 * weights[term]
    return w / np.maximum(np.bincount(row, weights=w * w, minlength=rows) ** 0.5, 1e-12)[row]


def logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


class Model:
    """vocabulary: term -> number; weights: by term; examples: (ids, labels, masses), masses being how many labelled rows each
    stands for; row, term, n: their term frequencies. Votes are calibrated on the examples, each asked without itself and its copies."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, examples: tuple, row: np.ndarray, term: np.ndarray, n: np.ndarray, k: int):
        self.vocabulary, self.weights, self.k = vocabulary, weights, k
        self.ids, self.labels, self.mass = examples[0], np.asarray(examples[1], np.int64), np.asarray(examples[2], float)
        rows = len(self.ids)
        w = unit(row, term, n, weights, rows)
        self.index = BlockMaxIndex(row, term, w, rows, len(vocabulary))
        self.prior = ((self.mass * self.labels).sum() + 0.5) / (self.mass.sum() + 1)
        quiet = np.bincount(row, minlength=rows) == 0
        self.silent = ((self.mass * self.labels)[quiet].sum() + self.prior) / (self.mass[quiet].sum() + 1)
        self.slope, self.shift = 1.0, 0.0
        if (self.labels == 1).any() and (self.labels == 0).any():
            best, near = self.index.nearest(row, term, w, rows, k + 8)
            near[(best == np.arange(rows)[:, None]) | (near > COPY)] = 0
            self._calibrate(logit(self.votes(best, near)[~quiet]), self.labels[~quiet], self.mass[~quiet])

    def votes(self, best: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The share of label 1 in the votes of the k nearest, which weigh their squared similarity and their mass."""
        rank = np.cumsum(near > 0, 1)
        v = np.where(rank <= self.k, near.astype(float), 0) ** 2 * np.where(best >= 0, self.mass[best] if len(self.mass) else 0.0, 0)
        mean = self.mass.mean() if len(self.mass) else 1.0
        return ((v * (self.labels[best] if len(self.labels) else 0)).sum(1) + PRIOR_VOTE * mean * self.prior) / (v.sum(1) + PRIOR_VOTE * mean)

    def _calibrate(self, x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> None:
        """Logistic regression of the labels on the votes' log odds, weighted by mass, by Newton steps."""
        a, at = np.stack([x, np.ones(len(x))], 1), np.asarray([1.0, 0.0])
        mass = mass / mass.mean()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
            at = at + np.linalg.solve((a * (mass * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (mass * (y - p)) - 1e-2 * (at - [1.0, 0.0]))
        if at[0] > 0:
            self.slope, self.shift = float(at[0]), float(at[1])

    def score(self, texts: list[bytes], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, nearest examples, their similarities) of each text."""
        row, term, n = terms.vectors(texts)
        best, near = self.index.nearest(row, term, unit(row, term, n, self.weights, len(texts)), len(texts), self.k)
        scores = 1 / (1 + np.exp(-(logit(self.votes(best, near)) * self.slope + self.shift)))
        return np.where(near[:, 0] > 0, scores, self.silent), best, near


def g2(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The log-likelihood ratio of terms in a of n1 and b of n0 texts, 0 where they are not more frequent in the former."""
    share = n1 / max(n0 + n1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = np.where(a > 0, a * np.log(a / ((a + b) * share)), 0), np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0)
    return np.where(a * n0 > b * n1, 2 * (x + y), 0)


def fit(docs: DataFrame, labels: DataFrame, k: int = 15, sample: int = 3_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the rows of docs that labels has. Of each label's rows at most about `sample`, chosen by a hash of the id, become
    examples, with their whole texts; votes are weighted by the inverse of that share. Examples of equal words are one, of their
    masses' sum. Every word of an example is a term, weighted by its inverse document frequency over all documents and by how it
    tells label 1. Null labels and ids teach nothing; an id with several labels counts as its greatest; repeated ids are examples each."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = common.cut(known)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = {c: min(1.0, sample / sizes.get(c, 1)) for c in (0, 1)}
    wide = 1 << 20
    part = F.pmod(F.xxhash64("id"), F.lit(wide))
    chosen = known.filter(part < F.when(F.col("label") == 1, int(rates[1] * wide)).otherwise(int(rates[0] * wide)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    examples = rows.join(F.broadcast(chosen), "id").select("id", "label", "text")  # about 2 * sample rows at most

    def tallied(batches):
        """Words and counts of each example."""
        for b in common.slices(batches, "text", 4 << 20):
            codes, ends, names = common.words(list(map(plain_words, common.binary(b.column(2)))))
            row, word, n = common.tally(common.owners(ends), codes, len(names))
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            own = [sorted(zip([names[w] for w in word[i:j].tolist()], n[i:j].tolist())) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b"\n".join(w for w, _ in x) for x in own], pa.binary()), pa.array([np.asarray([c for _, c in x], np.int64).tobytes() for x in own], pa.binary())], ["id", "label", "words", "n"])

    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("n", T.BinaryType())])
    same: dict[tuple, list] = {}  # (words, counts, label) -> [least id, mass]
    for r in examples.mapInArrow(tallied, kind).collect():
        held = same.setdefault((bytes(r["words"]), bytes(r["n"]), r["label"]), [r["id"], 0.0])
        held[0], held[1] = min(held[0], r["id"]), held[1] + 1 / rates[r["label"]]
    got = sorted((x[1][0], x[0][2], x[1][1], x[0][0], x[0][1]) for x in same.items())
    got.sort(key=lambda x: (x[1], x[3][:64]))  # like with like, for tight blocks
    label, index = np.asarray([x[1] for x in got], np.int64), {}
    split = [x[3].split(b"\n") if x[3] else [] for x in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in split])
    word = np.fromiter((index.setdefault(w, len(index)) for x in split for w in x), np.int64, len(row))
    count = np.frombuffer(b"".join(x[4] for x in got), np.int64)
    got = [x[:3] for x in got]
    del split, same
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    a, b = (np.bincount(word[label[row] == c], minlength=len(index)).astype(float) for c in (1, 0))
    told = np.where(a >= LEAST_EXAMPLES, g2(a, b, n1, n0), 0)
    # stems that tell
    stems: dict[bytes, int] = {}
    of = [[stems.setdefault(s, len(stems)) for s in stems_of(w)] for w in index]
    size = np.fromiter(map(len, of), np.int64, len(of))
    flat = np.fromiter((s for x in of for s in x), np.int64, int(size.sum()))
    del of
    begin = np.cumsum(size) - size

    def stems_in(block: np.ndarray, kept: np.ndarray | None = None):
        """(row, stem, count) of some of (row, word, count)."""
        at, each = common.ranges(begin[word[block]], size[word[block]]), size[word[block]]
        r, t, c = np.repeat(row[block], each), flat[at], np.repeat(count[block], each)
        if kept is not None:
            r, t, c = r[kept[t]], t[kept[t]], c[kept[t]]
        return common.tally(r, t, len(stems), c)

    edges = np.searchsorted(row, np.arange(0, len(got) + 200, 200))
    sa, sb = np.zeros(len(stems)), np.zeros(len(stems))
    for i, j in zip(edges, edges[1:]):  # 200 examples at a time
        s_row, stem, _ = stems_in(np.arange(i, j))
        for c, total in ((1, sa), (0, sb)):
            total += np.bincount(stem[label[s_row] == c], minlength=len(stems))
    s_told = g2(sa, sb, n1, n0)
    keep = (sa >= LEAST_EXAMPLES) & (sa / max(n1, 1) >= LEAST_RATIO * (sb + 0.5) / (n0 + 1)) & (s_told >= LEAST_G2)
    number = np.where(keep, len(index) + np.cumsum(keep) - 1, -1)
    vocabulary = index | {s: int(number[i]) for s, i in stems.items() if keep[i]}
    found = [stems_in(np.arange(i, j), keep) for i, j in zip(edges, edges[1:])] or [(row[:0], word[:0], count[:0])]
    s_row, stem, s_n = (np.concatenate([x[i] for x in found]) for i in range(3))
    row, term, count = np.concatenate([row, s_row]), np.concatenate([word, number[stem]]), np.concatenate([count, s_n])
    del stems, flat, size, begin, found, s_row, stem, s_n, word
    order = np.lexsort((term, row))
    told = np.concatenate([BASE + np.maximum(told - TELLING, 0) ** 0.5, np.maximum(s_told[keep] - TELLING, 0) ** 0.5])
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        terms, n = Terms(shared.value), np.zeros(len(shared.value) + 1, np.int64)
        for b in common.slices(batches, "text", 4 << 20):
            n += np.bincount(terms.vectors(common.binary(b.column(1)))[1], minlength=len(n))
            n[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([common.pack(n)], pa.binary())], ["data"])

    df = sum(common.sum_arrays(rows.mapInArrow(frequencies, "data binary")), np.zeros(len(vocabulary) + 1, np.int64))
    total, df = df[-1], df[:-1]
    weights = (np.log((total + 1) / (df + 1)) + 1) * told
    return Model(vocabulary, weights, ([x[0] for x in got], label, [x[2] for x in got]), row[order], term[order], count[order], k)


def score_toxicity(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", evidence: bool = False) -> DataFrame:
    """One row for each row of df: id, score (0 to 1), predicted (1 if score >= threshold) and, if asked, evidence: the nearest
    examples as an array of (id, similarity, label). Terms that no example has meet none and are left out. A text that shares no
    term with any example, as an empty or null one, scores as the examples without terms do. No shuffle; repeated rows give a row each."""
    id_type = df.schema[id_col].dataType
    shared = df.sparkSession.sparkContext.broadcast(model)
    near_type = T.ArrayType(T.StructType([T.StructField("id", id_type), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    out = [T.StructField(id_col, id_type), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if evidence:
        out.append(T.StructField("evidence", near_type))

    def f(batches):
        m = shared.value
        terms = Terms(m.vocabulary)
        for b in common.slices(batches, "text", 4 << 20):
            scores, best, near = m.score(common.binary(b.column(1)), terms)
            cols = [b.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            if evidence:
                rows = [[{"id": m.ids[i], "similarity": s, "label": int(m.labels[i])} for i, s in zip(x, y) if s > 0] for x, y in zip(best.tolist(), near.tolist())]
                cols.append(pa.array(rows, pa.list_(pa.struct([("id", b.column(0).type), ("similarity", pa.float64()), ("label", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, [x.name for x in out])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(f, T.StructType(out))
