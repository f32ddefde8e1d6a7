"""Language identification of mixed-language text: scripts narrow the candidates, then Viterbi labels the words."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: First and last code point of scripts; letters in none of them are of script 0.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
_NAMES = ["other", *dict.fromkeys(n for _, _, n in SCRIPTS)]
_STARTS = [a for a, _, _ in SCRIPTS]
#: All ASCII but letters separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text: bytes) -> bytes:
    """The text in lower case, with blanks for the ASCII characters that are no letters."""
    text = text.translate(_TABLE)
    return text if text.isascii() else text.decode("utf-8").lower().encode()


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and other characters above ASCII."""
    return plain_words(text).split()


def script_of(word: bytes) -> int:
    """The script of a word's first letter, -1 if it has no letter."""
    if word[0] < 128:
        return _NAMES.index("Latin")
    for c in word.decode("utf-8"):
        if c.isalpha():
            k = bisect_right(_STARTS, ord(c)) - 1
            return _NAMES.index(SCRIPTS[k][2]) if k >= 0 and ord(c) <= SCRIPTS[k][1] else 0
    return -1


def grams(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and for each the number of its word: byte 2-, 3-, 4- and 5-grams of the word between marks."""
    data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # of the mark before each word
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    end = np.repeat(starts + lengths + 1, lengths + 1)  # of the mark after
    pos = np.arange(len(owner))
    out, of = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, 6):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n == 1:
            continue
        ok = pos + n - 1 <= end
        ok = ok[: len(h)]
        x = h[: len(ok)][ok] + np.uint64(n)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(64 - bits)).astype(np.int64))
        of.append(owner[: len(ok)][ok])
    return np.concatenate(out), np.concatenate(of)


#: So many new words are scored at once.
SCORED = 1 << 14
#: The worker's scores of words: model, rows (word -> row of table) and table.
_known: dict = common.kept("language words", {})


class Model:
    """langs; logs[gram, lang]: log probability ratios of hashed grams; allowed[script, lang]."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, bits: int):
        self.langs, self.bits = langs, bits
        p = (counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * len(counts))
        self.logs = np.log(p)
        self.logs = (self.logs - self.logs.mean(1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        self.allowed = share >= 0.001
        self.key = uuid.uuid4().hex

    def scores(self, words: list[bytes], most: int = 500_000) -> np.ndarray:
        """For each word its row of table; each word is scored once, and a worker keeps the scores of one model at a time. A word
        in a script that leaves no or every candidate tells by its grams alone."""
        if _known.get("model") != self.key or len(_known["rows"]) > most:
            _known.update(model=self.key, rows={}, table=np.zeros((0, len(self.langs)), np.float32))
        rows = _known["rows"]
        new = list(set(words) - rows.keys())
        if new:
            base = len(_known["table"])
            _known["table"] = np.concatenate([_known["table"], *[self.score(new[k : k + SCORED]) for k in range(0, len(new), SCORED)]])
            rows.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def score(self, words: list[bytes]) -> np.ndarray:
        """The scores of each word by language; memory for each gram of all these words."""
        hashed, of = grams(words, self.bits)
        s = np.stack([np.bincount(of, weights=self.logs[hashed, k], minlength=len(words)) for k in range(len(self.langs))], 1)
        s = np.clip(s, -20, 20)
        kinds = np.fromiter(map(script_of, words), np.int64, len(words))
        ok = self.allowed[np.maximum(kinds, 0)] | ~self.allowed[np.maximum(kinds, 0)].any(1, keepdims=True)
        s = np.where(ok, s, -30.0)
        s[kinds < 0] = 0
        return s.astype(np.float32)

    @property
    def table(self) -> np.ndarray:
        return _known["table"]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of the words of all documents, which lie one after the other: the scores' sum less a penalty a switch.
    Documents advance together, a word at a time; ties go to the label of the word before, then to the first label."""
    n, k = scores.shape
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")  # documents with more than t words
    kind = np.uint8 if k <= 1 << 8 else np.uint16 if k <= 1 << 16 else np.uint32
    back = np.empty((n, k), kind)
    own = np.arange(k, dtype=kind)
    v = np.zeros((len(lengths), k), np.float32)
    final = np.zeros(len(lengths), np.int64)
    for t in range(len(live)):
        m = live[t]
        at = starts[:m] + t
        now = v[:m]
        best = now.argmax(1)
        top = now[np.arange(m), best][:, None] - penalty
        stay = now >= top
        back[at] = np.where(stay, own, best[:, None].astype(kind))
        np.maximum(now, top, out=now)
        now += scores[at]
    labels = np.empty(n, kind)
    final = v.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        labels[at] = final[:m]
        final[:m] = back[at, final[:m]]
    return labels


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 10_000, bits: int = 18, id_col: str = "doc_id") -> Model:
    """A model of the labelled rows of df. Of each language's rows at most about `sample` are used, all of a rarer one, chosen by a
    hash of text and id (if df has one); their whole texts count. The counts have a fixed size: 2**bits grams by languages. Rows
    without language or text teach nothing."""
    chance = F.pmod(F.xxhash64(F.col(text_col).cast("string"), *[F.col(c) for c in df.columns if c == id_col]), F.lit(1 << 20))
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), chance.alias("chance")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model(["und"], np.zeros((1 << bits, 1)), np.zeros((len(_NAMES), 1)), bits)
    shares = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * (1 << 20)) or 1))])
    some = rows.filter(F.col("chance") < F.element_at(shares, F.col("lang"))).select("text", "lang")

    def count(batches):
        common.only("")
        total = np.zeros((1 << bits, len(langs)))
        scripts = np.zeros((len(_NAMES), len(langs)))
        for b in common.slices(batches, "text"):
            by: dict[str, Counter] = {}
            for text, lang in zip(common.binary(b.column(0)), b.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(words_of(text))
            for lang, c in by.items():
                k, words = langs.index(lang), list(c)
                if not words:
                    continue
                n = np.fromiter(c.values(), np.float64, len(words))
                hashed, of = grams(words, bits)
                total[:, k] += np.bincount(hashed, weights=n[of], minlength=1 << bits)
                kinds = np.fromiter(map(script_of, words), np.int64, len(words))
                scripts[:, k] += np.bincount(kinds[kinds >= 0], weights=n[kinds >= 0], minlength=len(_NAMES))
        for k in range(len(langs)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([common.pack(np.concatenate([total[:, k], scripts[:, k]]))], pa.binary())], ["k", "counts"])

    def add(batches):
        """Sums by language, one table in memory at a time; a language's tables come one after the other."""
        at, total = None, None
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([common.pack(total)], pa.binary())], ["k", "counts"])
                one = common.unpack(data, np.float64)
                at, total = k, one.copy() if k != at else total + one
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([common.pack(total)], pa.binary())], ["k", "counts"])

    kind = "k int, counts binary"
    got = some.mapInArrow(count, kind).repartition(min(len(langs), common.shuffle_partitions(df.sparkSession)), "k").sortWithinPartitions("k").mapInArrow(add, kind).collect()
    counts = np.zeros((1 << bits, len(langs)))
    scripts = np.zeros((len(_NAMES), len(langs)))
    for r in got:
        x = common.unpack(bytes(r["counts"]), np.float64)
        counts[:, r["k"]], scripts[:, r["k"]] = x[: 1 << bits], x[1 << bits :]
    return Model(langs, counts, scripts, bits)


def identify(df: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row for each row of df: id, lang_pred, score and, if asked, spans: array of (start, end, lang) by words.

    Words get a score for each language that their script leaves; Viterbi labels them, a switch costing `penalty`; the text's
    language is that with most letters, and the score its share of them. Texts that are null or have no letter are `und`, 0.0.
    No shuffle; repeated rows and repeated or null ids give a row each.
    """
    id_type = df.schema[id_col].dataType
    shared = df.sparkSession.sparkContext.broadcast(model)
    langs = model.langs
    out = [T.StructField(id_col, id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    if spans:
        out.append(T.StructField("spans", span_type))

    def label(batches):
        common.only("language words")
        m = shared.value
        for table in common.blocks(batches, "text", 6 << 20):
            rows = [words_of(t) for t in common.binary(table["text"])]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            words = [w for r in rows for w in r]
            at = m.scores(words)
            labels = viterbi(m.table[at], lengths, penalty) if words else np.zeros(0, np.uint8)
            labels = labels.astype(np.int64)
            size = np.fromiter(map(len, words), np.float64, len(words))
            lettered = np.ones(len(words), bool)
            for i in [i for i, w in enumerate(words) if w[0] > 127]:
                lettered[i] = script_of(words[i]) >= 0
            size[~lettered] = 0
            doc = np.repeat(np.arange(len(rows)), lengths)
            mass = np.bincount(doc * len(langs) + labels, weights=size, minlength=len(rows) * len(langs)).reshape(len(rows), len(langs))
            total = mass.sum(1)
            best = mass.argmax(1)
            share = np.where(total > 0, mass[np.arange(len(rows)), best] / np.maximum(total, 1), 0.0)
            names = [langs[k] if t > 0 else "und" for k, t in zip(best.tolist(), total.tolist())]
            cols = [table["id"].combine_chunks(), pa.array(names), pa.array(share)]
            if spans:
                found, begin = [], 0
                for n in lengths.tolist():
                    own = labels[begin : begin + n]
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]]).tolist() if n else [0]
                    found.append([{"start": a, "end": b, "lang": langs[own[a]]} for a, b in zip(edges, edges[1:])])
                    begin += n
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(label, T.StructType(out))
