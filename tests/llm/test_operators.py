"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, id int"


def texts() -> list:
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta.", "épée", "straße", "it's", "42", "mañana", "don't", "zeta;", "ETA", "###", "x"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(5, 200))) for _ in range(30)]
    odd = [None, "", " \t\n", "<|endoftext|> a", "漢字 かな ３", "a\x85b\xa0c", "İstanbul", "x" * 3000, "one", "two words", "a\x0bb\x0cc"]
    near = [base[0] + " more", "zz " + base[1], base[2].replace("alpha", "omega", 1)]
    return [*base, *odd, *near, base[3], base[3].replace(" ", "\n"), base[4], base[4], "long " * 12_000]


def rows() -> list:
    t = texts()
    out = [(i, x, ("en", "fr", None)[i % 3], f"s{i % 4}", None if x is None else len(x), "clash", 7) for i, x in enumerate(t)]
    return [*out, (5, t[5], "en", "s1", len(t[5]), "clash", 7), (None, t[6], None, None, None, None, None), (None, "no id", "fr", "s", 5, "", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts(docs, empty):
    from sparkloom.llm.token_counts import count_tokens

    got = count_tokens(docs, vocabulary(), 100)
    tok = tokenizer()
    want = Counter()
    for r in rows():
        t = r[1] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want[(r[0], len(t.encode()), n, n > 100)] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert count_tokens(empty, vocabulary()).count() == 0


def test_pretokens_of_every_code_point():
    """Ids of every code point alone, in a word, beside a digit and an apostrophe, and of random strings, as the library gives them."""
    from sparkloom.llm.pretokens import PreTokens

    tokens = PreTokens.of(vocabulary())
    forms = lambda c: [c, f"ab{c}cd 1{c}'s x {c} y"]
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts_ = [f for c in points[:0x600] for f in forms(c)] + ["\n".join(f for c in points[k : k + 40] for f in forms(c)) for k in range(0x600, len(points), 40)]
    r = random.Random(1)
    texts_ += ["".join(chr(r.choice((r.randrange(1, 0x80), r.randrange(1, 0x250), r.randrange(1, 0x3000)))) for _ in range(r.randrange(1, 12))) for _ in range(20_000)]
    texts_ += ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", ""]
    got = tokens.encode([t.encode() for t in texts_])
    want = tokens.tok.encode_batch_fast(texts_, add_special_tokens=False)
    assert [t for t, g, w in zip(texts_, got, want) if np.frombuffer(g, np.uint32).tolist() != w.ids] == []


def test_packing(docs, empty):
    from sparkloom.llm.packing import pack_documents, plan

    capacity = 256
    got = pack_documents(docs, vocabulary(), capacity).collect()
    tok = tokenizer()
    want = Counter()
    for r in rows():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            some = np.asarray(ids[k : k + capacity], "<u4")
            want[(r[0], k // capacity, k, len(some), zlib.crc32(some.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    assert pack_documents(empty, vocabulary()).count() == 0
    assert plan({}, 10) == []
    # two large items at most share a sequence, and small ones fill the rest
    runs = plan({6: 2, 4: 2, 3: 1, 1: 3}, 10)
    assert 1 + max(s + n - 1 for _, _, n, s, _ in runs) == 3


def test_exact_dedup(docs, empty, spark):
    from sparkloom.llm.exact_dedup import CountingQuotientFilter, drop_copies, exact_groups

    plain = lambda t: (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
    groups: dict = {}
    for r in rows():
        groups.setdefault(plain(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    for most in (1 << 20, 0):
        got = exact_groups(docs, broadcast_most=most).collect()
        assert len(got) == len(rows())
        assert sum(r.kept for r in got) == len(groups)
        size = {hashlib.sha256(k).hexdigest(): (len(v), None if min(v)[1] else min(v)[2]) for k, v in groups.items()}
        for r in got:
            assert (r.group_size, r.keep_id) == size[r.text_sha256]
    assert exact_groups(empty).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    unique = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_copies(unique).collect()) == [1, 3, 4]
    odd = [(1, "a b", 1), (1, "ab", 2), (2, "a  b", 3), (None, "x", 4), (None, "x", 5), (None, None, 6), (3, "", 7)]
    stay = drop_copies(spark.createDataFrame(odd, "doc_id long, text string, n int")).collect()
    assert Counter((r.doc_id, r.text) for r in stay) == Counter([(2, "a  b"), (None, "x"), (3, "")])
    random_ = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64) << np.uint64(57)
    a, b = CountingQuotientFilter.build(random_[:400]), CountingQuotientFilter.build(random_[400:])
    m = CountingQuotientFilter.load(a.merge(b).dump())
    assert dict(zip(m.prints().tolist(), m.counts.tolist())) == Counter(random_.tolist())
    again = [f for _, f in m.split(7)]
    assert np.array_equal(np.concatenate([f.prints() for f in again]), m.prints())


def test_language_id(docs, empty, spark):
    from sparkloom.llm.langid import identify, train, viterbi

    r = random.Random(5)
    en, de = ["the", "thing", "shore", "with", "other", "weather"], ["schnell", "über", "zwischen", "straße", "nicht", "durch"]
    make = lambda w, n: " ".join(r.choice(w) for _ in range(n))
    data = [(i, make(en if i % 2 else de, 40), "en" if i % 2 else "de") for i in range(60)]
    model = train(spark.createDataFrame([*data, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    mixed = make(en, 30) + " " + make(de, 60)
    ask = spark.createDataFrame([(1, make(en, 20)), (2, make(de, 20)), (3, mixed), (4, None), (5, ""), (6, "12 34 -- €"), (None, "the"), (1, make(en, 20))], "doc_id long, text string")
    got = identify(ask, model, spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[1].lang_pred == "en" and by[2].lang_pred == "de" and by[3].lang_pred == "de"
    assert [by[k].lang_pred for k in (4, 5, 6)] == ["und"] * 3 and by[4].score == 0
    assert [(s.start, s.end, s.lang) for s in by[3].spans] == [(0, 30, "en"), (30, 90, "de")]
    assert 0.5 < by[3].score < 0.9
    assert identify(empty, model).count() == 0 and identify(docs, train(empty)).count() == len(rows())
    # more languages than a byte tells
    many = np.zeros((4, 300), np.float32)
    many[:, 290] = 5
    assert viterbi(many, np.asarray([4]), 1.0).tolist() == [290] * 4
    # a rare language is learned whole, however small the sample of the others
    few = train(spark.createDataFrame([*[(i, make(en, 30), "en") for i in range(200)], (900, make(de, 40), "de")], "doc_id long, text string, lang string"), sample=20)
    assert [r.lang_pred for r in identify(ask, few).filter("doc_id = 2").collect()] == ["de"]
    # against all paths
    rng = np.random.default_rng(2)
    s = rng.normal(size=(7, 3)).astype(np.float32)
    import itertools

    def cost(p):
        return sum(s[i, k] for i, k in enumerate(p)) - 1.0 * sum(a != b for a, b in zip(p, p[1:]))

    best = max(itertools.product(range(3), repeat=7), key=cost)
    assert viterbi(s, np.asarray([7]), 1.0).tolist() == list(best)


def test_sharding(docs, empty, spark):
    from pyspark.sql import functions as F

    from sparkloom.llm.sharding import curve_table, hilbert_index, hilbert_shards

    grid = spark.range(8).selectExpr("id as x").join(spark.range(8).selectExpr("id as y"), F.lit(True)).join(spark.range(8).selectExpr("id as z"), F.lit(True))
    at = {r.h: (r.x, r.y, r.z) for r in grid.select("x", "y", "z", hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).collect()}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(511))
    assert len(curve_table(2)) == 8 * 4
    got = hilbert_shards(docs, ["lang", "source", "n_chars"], 5, [F.col("doc_id"), F.col("text")], ["doc_id"]).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(rows()) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for k in sizes:
        own = sorted((r.slot, r.curve) for r in got if r.shard == k)
        assert [s for s, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)
    assert hilbert_shards(empty, ["lang", "n_chars"], 3, [F.col("doc_id")], ["doc_id"]).count() == 0


def test_sharding_cells_and_files(spark, tmp_path):
    """Strings with a common start and negative numbers are told apart, and the written shards' zones let a reader skip most."""
    from pyspark.sql import functions as F

    from sparkloom.llm.sharding import edges_of, hilbert_shards, write_shards

    r = random.Random(4)
    data = [(i % 900, f"https://example.org/{r.randrange(40):02d}", float(r.randrange(-500, 500)) if i % 50 else None) for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, url string, score double").repartition(3)
    assert len(edges_of(df, "url", 32)) >= 25 and edges_of(df.filter("url is null"), "url", 32) == []
    sharded = hilbert_shards(df, ["url", "score"], 16, [F.col(c) for c in df.columns], ["doc_id", "url", "score"])
    zones = write_shards(sharded, ["url", "score"], f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((x.doc_id, x.url, x.score) for x in back.collect()) == Counter(data)
    z = zones.collect()
    assert sum(x.rows for x in z) == 1000 and len(z) == 16
    for column, low, high in (("url", "https://example.org/00", "https://example.org/04"), ("score", -500.0, -400.0)):
        needed = [x for x in z if x[f"min_{column}"] is not None and x[f"min_{column}"] <= high and x[f"max_{column}"] >= low]
        assert 0 < len(needed) <= 8
        held = {x.shard for x in back.filter(F.col(column).between(low, high)).collect()}
        assert held <= {x.shard for x in needed}
    for x in (tmp_path / "shards").glob("shard=*/*.parquet"):
        slots = pq.read_table(x, columns=["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)


def test_warc_same_rows_same_files(spark, tmp_path):
    """Files depend on the rows alone: not on the input's partitions, nor on those of shuffles."""
    from sparkloom.llm.warc import write_warc

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = []
    n = spark.conf.get("spark.sql.shuffle.partitions")
    for i, (parts, shuffle) in enumerate(((1, n), (5, n), (3, "13"))):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        manifest = write_warc(pages.repartition(parts), f"file://{tmp_path}/{i}", roll_bytes=20_000, run_bytes=100_000)
        found.append(sorted((r.file, r.records, r.sha1) for r in manifest.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", n)
    assert found[0] == found[1] == found[2] and len({f.split("-")[1] for f, _, _ in found[0]}) > 1


def test_warc(spark, tmp_path):
    from pyspark.sql import types as T

    from sparkloom.llm.warc import read_records, read_warc, write_warc

    data = [(i, f"http://h/{i} é", f"<p>{i % 4}</p>" * (i % 7)) for i in range(40)] + [(50, None, None), (51, "u", ""), (None, "u", "<p>x</p>"), (3, "http://h/3 é", "<p>3</p>" * 3), (60, "b", "é" * 100_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    uri = f"file://{tmp_path}/w"
    manifest = write_warc(pages, uri, roll_bytes=2000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(data)
    got = read_warc(spark, uri, T.LongType()).collect()
    least: dict = {}
    for i, _, h in data:
        h = h or ""
        least[h] = min(least.get(h, (True, 0)), (i is None, i or 0))
    want = Counter()
    for i, u, h in data:
        h = h or ""
        first = least[h] == (i is None, i or 0)
        d = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if first and (i, u, h, "seen") in want:
            first = False
        want[(i, u, h, "seen")] += 1
        want[(i, len(h.encode()), d, "response" if first else "revisit", None if first or least[h][0] else least[h][1])] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter({k: n for k, n in want.items() if len(k) == 5})
    files = sorted((tmp_path / "w").glob("part-*.warc.gz"))
    assert len(files) == manifest.count() > 3 and not list((tmp_path / "w/_temporary").iterdir())
    again = write_warc(pages, f"file://{tmp_path}/v", roll_bytes=2000)
    assert sorted(r.sha1 for r in again.collect()) == sorted(r.sha1 for r in manifest.collect())
    with open(files[0], "rb") as f:
        assert all(h["WARC-Type"] in ("response", "revisit") for h, _ in read_records(f))
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e", T.LongType()).count() == 0


def near_sets(rows_, width):
    out = []
    for r in rows_:
        w = (r[1] or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_jaccard(docs, empty, width, num):
    from sparkloom.llm.jaccard import jaccard_components

    data = [r for r in rows() if r[0] is not None]
    sets = near_sets(data, width)
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= num * (len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(data):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(data))
    got = jaccard_components(docs.filter("doc_id is not null"), num, 100, width)
    assert Counter(map(tuple, got.collect())) == want
    if width == 5:
        assert Counter(map(tuple, jaccard_components(docs.filter("doc_id is not null"), num, 100, width, sketch_bits=5, broadcast_most=0).collect())) == want
        assert jaccard_components(docs, num, 100, width).count() == len(rows())
        assert jaccard_components(empty).count() == 0


def test_jaccard_near_copies(spark):
    """A large group of near copies at every distance from each other, and their links by brute force."""
    from sparkloom.llm.jaccard import jaccard_components

    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(len(t))] = f"v{r.randrange(1000)}"
        data.append((i, " ".join(t)))
    sets = near_sets(data, 3)
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = jaccard_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == {i: find(i) for i in range(len(data))}


@pytest.mark.parametrize("list_part", [4_000, 300])
def test_jaccard_large_groups(spark, list_part):
    """2,000 near copies without their original, at distances on both sides of the limit, and large sets; links by brute force."""
    from sparkloom.llm.jaccard import jaccard_components

    r = random.Random(11)
    data = []
    for size, copies, most in ((100, 2000, 4), (3600, 60, 90)):
        base = [f"{size}w{i}" for i in range(size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randrange(1, most)):
                t[r.randrange(len(t))] = f"v{r.randrange(10**6)}"
            data.append((len(data), " ".join(t)))
    sets = near_sets(data, 3)
    place: dict = {}
    held = np.zeros((len(data), len(place_all := {x for s in sets for x in s})), np.float32)
    for i, s in enumerate(sets):
        held[i, [place.setdefault(x, len(place)) for x in s]] = 1
    assert len(place) == len(place_all)
    both, sizes = held @ held.T, held.sum(1)
    linked = 100 * both >= 90 * (sizes[:, None] + sizes[None] - both)
    label = np.arange(len(data))
    while True:
        new = np.where(linked, label[None], len(data)).min(1)
        if (new == label).all():
            break
        label = new
    assert len(set(label.tolist())) > 20  # the group does not link as a whole
    got = jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(4), list_part=list_part)
    assert {x.doc_id: x.component_id for x in got.collect()} == dict(enumerate(label.tolist()))


def test_decontaminate(docs, empty, spark):
    from sparkloom.llm.decontaminate import drop_contaminated, find_contamination, words_of

    t = texts()
    items = [(1, t[0][:200]), (10, t[1][5:150]), (2, "two words"), (3, None), (4, "--"), (5, "alpha"), (6, t[0][:200]), (None, "épée")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for i, x in items:
        w = words_of((x or "").encode())
        windows += [("null" if i is None else str(i), w[k : k + 8]) for k in range(max(1, len(w) - 7))] if w else []
    want = Counter()
    for r in rows():
        w = words_of((r[1] or "").encode())
        hit, found = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        want[(r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)] += 1
    for most in (100_000, 20):
        assert Counter(map(tuple, find_contamination(docs, bench, most=most).collect())) == want
    assert find_contamination(empty, bench).count() == 0
    none = find_contamination(docs, bench.limit(0))
    assert none.count() == len(rows()) and none.filter("n_hit > 0").count() == 0
    assert drop_contaminated(docs, bench).columns == docs.columns


def test_toxicity(docs, empty, spark):
    from sparkloom.llm.toxicity import PRIOR_VOTE, BlockMaxIndex, fit, logit, score_toxicity, stems_of, unit

    r = random.Random(1)

    def vectors(n):
        """(row, term, weight) of n unit vectors over 60 terms, of which the first are frequent, and the same as a matrix."""
        dense = np.zeros((n, 60))
        for x in dense:
            for _ in range(r.randrange(0, 12)):
                x[min(int(r.expovariate(0.1)), 59)] = r.randrange(1, 4)
        row, term = np.nonzero(dense)
        w = unit(row, term, dense[row, term] ** 2, np.ones(60), n)
        dense[row, term] = w
        return row, term, w, dense

    row, term, w, held = vectors(700)
    q_row, q_term, q_w, asked = vectors(150)
    for width, frequent in ((16, 4), (64, 32), (8, 1), (512, 1000)):
        best, near = BlockMaxIndex(row, term, w, 700, 60, width, frequent).nearest(q_row, q_term, q_w, 150, 9)
        for x, i, y in zip(asked @ held.T, best, near):
            want = np.sort(x)[::-1][:9]
            assert np.allclose(y, want, atol=1e-5) and np.allclose(x[i[i >= 0]], y[i >= 0], atol=1e-5)
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(300)]
    bad = ["stupid", "moronic", "idiots"]
    data, labels = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(40)]
        if i % 5 == 0:
            w[3], w[20] = r.choice(bad), r.choice(bad)
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    d = spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*[x for x in labels if x[0] % 4], (None, 1), (950, None), (1, 0)], "doc_id long, toxic int")
    model = fit(d, lab)
    got = {x.doc_id: x for x in score_toxicity(d, model, evidence=True).collect()}
    assert all(got[i].predicted == y for i, y in labels) and got[900].predicted == 0 and got[901].score == got[900].score
    assert len(got[0].evidence) > 0 and all(e.label == 1 for e in got[0].evidence)
    # scores by brute force: every text with words meets every example
    known = {i: y for i, y in labels if i % 4}
    own = {i: Counter(t.split()) for i, t in data}
    byte = lambda c: Counter({(t if isinstance(t, bytes) else t.encode()): n for t, n in c.items()})
    vec = {}
    for i, c in own.items():
        all_ = byte(c)
        for x, n in c.items():
            for s in stems_of(x.encode()):
                all_[s] += n
        v = {model.vocabulary[t]: n**0.5 * model.weights[model.vocabulary[t]] for t, n in all_.items() if t in model.vocabulary}
        size = sum(x * x for x in v.values()) ** 0.5
        vec[i] = {t: x / size for t, x in v.items()}
    for i in range(0, 400, 9):
        near = sorted(((sum(x * vec[j].get(t, 0) for t, x in vec[i].items()), y) for j, y in known.items()), reverse=True)[: model.k]
        votes = (sum(s * s * y for s, y in near) + PRIOR_VOTE * model.prior) / (sum(s * s for s, _ in near) + PRIOR_VOTE)
        assert abs(got[i].score - 1 / (1 + np.exp(-(logit(votes) * model.slope + model.shift)))) < 1e-3
    assert score_toxicity(empty, model).count() == 0
    assert score_toxicity(docs, fit(docs, lab.limit(0))).count() == len(rows())


def test_lm_score(docs, empty):
    from pyspark.sql import functions as F

    from sparkloom.llm.lm_score import Events, Mixer, score_texts

    got = score_texts(docs, F.col("doc_id") % 3 != 0).collect()
    assert len(got) == len(rows())
    counts: Counter = Counter()
    for r in rows():
        if r[0] is not None and r[0] % 3:
            counts.update([*(r[1] or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows():
        w = [*(r[1] or "").encode().lower().split(), b""]
        want[(r[0], not (r[0] is not None and r[0] % 3), len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert score_texts(empty, F.lit(True)).count() == 0
    assert score_texts(docs.limit(5), F.lit(False)).count() == 5
    # the model is a distribution: all one-byte words and longer ones share what is left after each first byte
    tables = [np.random.default_rng(k).normal(size=1 << 18).astype(np.float16) for k in range(5)]
    import sparkloom.llm.lm_score as lm

    mixer = Mixer([np.resize(t, 1 << c[1]) for t, c in zip(tables, lm.CONTEXTS)], np.full((32, 5), 0.3))
    first = {}
    for b in range(256):
        e = Events([bytes([b])])
        first[b] = len(e.bit)
    total = 0.0
    for b in range(256):
        word = bytes([b]) if b not in (32, 10) else None
        if word is None:
            continue
        closed = np.exp(mixer.score([word]))[0, 0]
        total += closed
    assert 0 < total < 1


def test_lm_contexts_are_exact(docs):
    from pyspark.sql import functions as F

    import sparkloom.llm.lm_score as lm

    src = docs.select("text", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)).alias("train"))
    texts = [(r.text or "").encode() for r in src.filter("train").collect()]
    words = Counter(w for t in texts for w in [*t.lower().split(), b""])
    want = [Counter() for _ in range(lm.COUNTED)]
    for w, n in words.items():
        for i, byte in enumerate(w + b" "):
            for k, (order, _, _, least) in enumerate(lm.CONTEXTS[: lm.COUNTED]):
                for j in range(lm.DEPTH[byte] if n >= least else 0):
                    want[k][(b" " + w)[-order + i + 1 if order and i + 1 > order else 0 : i + 1], int(lm.NODES[byte, j]), int(lm.BITS[byte, j])] += n
    groups = docs.sparkSession.sparkContext.broadcast(lm.Groups(texts))
    seen = Counter()
    for _, data, known in lm.gathered(_batches(lm.gather(lm.count_words(src, groups, 3), 3))):
        terms, _ = lm.read_words(data)
        seen.update(terms)
        for w in terms:
            e = lm.Events([w])
            at = np.repeat(np.arange(len(w) + 1), e.depth)
            for k, (order, _, _, _) in enumerate(lm.CONTEXTS[: lm.COUNTED]):
                table, place = known.look(e, k)
                for i, node, got in zip(at.tolist(), e.node.tolist(), table.sum(2)[place].tolist()):
                    ctx = (b" " + w)[-order + i + 1 if order and i + 1 > order else 0 : i + 1]
                    assert got == [want[k][ctx, node, 0], want[k][ctx, node, 1]]
    assert max(seen.values()) == 1 and seen.keys() >= words.keys()


def _batches(df):
    import pyarrow as pa

    rows_ = sorted(df.collect(), key=lambda r: (r.row, r.kind))
    yield pa.RecordBatch.from_pylist([r.asDict() for r in rows_], pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())]))


def test_lm_scores_by_brute_force():
    """Probabilities of words in each group, recomputed event by event from counts in dictionaries."""
    import sparkloom.llm.lm_score as lm

    random = np.random.default_rng(3)
    words = sorted({b"", b"a", b"ab", b"abc", b"abd", b"the", b"then", b"themselves", b"x" * 40, "über".encode(), b"\xff\x00", *(bytes(random.integers(97, 100, n).astype(np.uint8)) for n in random.integers(1, 9, 60))})
    counts = random.integers(0, 3, (len(words), lm.GROUPS)) * (random.random((len(words), 1)) < 0.8)
    weights = random.normal(0.4, 0.1, (32, 5))
    entries, held = [], Counter()
    e = lm.Events(words)
    for k, (order, _, _, least) in enumerate(lm.CONTEXTS[: lm.COUNTED]):
        used = np.where(counts.sum(1, keepdims=True) >= least, counts, 0)
        entries.append((e.contexts(k) | e.byte, used[e.word]))
        for w, n in zip(words, used.tolist()):
            for i, byte in enumerate(w + b" "):
                ctx = (b" " + w)[max(0, i + 1 - order) if order else 0 : i + 1]
                for j in range(lm.DEPTH[byte]):
                    for g in range(lm.GROUPS):
                        held[k, ctx, int(lm.NODES[byte, j]), int(lm.BITS[byte, j]), g] += n[g]
    known = lm.Known(*lm.add_up(*lm.together(entries)))

    def log_odds(k, ctx, node, g):
        c = [sum(held[k, ctx, node, bit, h] for h in ([g] if g is not None else range(lm.GROUPS))) for bit in (0, 1)]
        return np.log((c[1] + lm.DELTA) / (c[0] + lm.DELTA))

    got = lm.Mixer([], weights).score(words, known)
    for w, scores in zip(words, got.tolist()):
        for g in range(lm.GROUPS):
            total = 0.0
            for i, byte in enumerate(w + b" "):
                gate = None
                for j in range(lm.DEPTH[byte]):
                    x = [log_odds(min(k, lm.COUNTED - 1), (b" " + w)[max(0, i + 1 - o) if o else 0 : i + 1], int(lm.NODES[byte, j]), g if apart else None) for k, (o, _, apart, _) in enumerate(lm.CONTEXTS)]
                    gate = sum((abs(v) > 1e-12) << k for k, v in enumerate(x)) if gate is None else gate
                    z = float(weights[gate] @ x)
                    total -= np.log1p(np.exp(-z if lm.BITS[byte, j] else z))
            assert abs(total - scores[g]) < 1e-3 * max(1, abs(total))
    order = random.permutation(len(words))
    assert np.allclose(lm.Mixer([], weights).score([words[i] for i in order], known), got[order], atol=1e-3)


def test_lm_score_weights_come_from_all_words():
    import random

    from sparkloom.llm import lm_score as lm

    random.seed(3)
    words = sorted({bytes(random.choices(b"etaoinsh", range(8, 0, -1), k=random.randint(1, 7))) for _ in range(1500)})
    counts = np.random.default_rng(3).integers(0, 4, (len(words), lm.GROUPS)) + np.eye(lm.GROUPS, dtype=int)[0]
    e = lm.Events(words)
    known = lm.Known(*lm.add_up(*lm.together([lm.add_up(e.contexts(k) | e.byte, np.where(counts.sum(1, keepdims=True) >= lm.CONTEXTS[k][3], counts, 0)[e.word]) for k in range(lm.COUNTED)])))

    def cost(mixer):
        return sum(float((own * np.log1p(np.exp(np.where(bit == 1, -1, 1) * sum(mixer.weights[gate, k] * s for k, s in enumerate(inputs))))).sum()) for gate, inputs, bit, own, _ in mixer.examples(known, words, counts.astype(float)))

    start = lm.Mixer.fit(known, [(words[i], counts[i].tolist()) for i in range(0, len(words), 40)])
    half = len(words) // 2
    whole = start.moments(known, words, counts)
    assert np.allclose(whole, start.moments(known, words[:half], counts[:half]) + start.moments(known, words[half:], counts[half:]), rtol=1e-4, atol=1e-2)
    assert cost(start.stepped(whole)) < cost(start)


def test_lm_words_share_the_events_of_their_beginnings():
    """Slopes and curvatures of the step over training words, recomputed word by word from counts in dictionaries; an event that
    several words have is worked on once for each group, and once more for words too rare to be in all counts."""
    from sparkloom.llm import lm_score as lm

    random = np.random.default_rng(5)
    words = sorted({b"", b"a", b"und", "über".encode(), b"\xff\x00", *(b"themselves" + bytes(random.integers(97, 100, n).astype(np.uint8)) for n in random.integers(0, 6, 40))})
    counts = random.integers(0, 3, (len(words), lm.GROUPS)) * (random.random((len(words), 1)) < 0.7)
    counts[:3] = np.eye(lm.GROUPS, dtype=int)[:3]
    words, counts = [w for w, n in zip(words, counts) if n.any()], counts[counts.any(1)]
    weights = random.normal(0.4, 0.1, (32, 5))
    e = lm.Events(words)
    known = lm.Known(*lm.add_up(*lm.together([lm.add_up(e.contexts(k) | e.byte, np.where(counts.sum(1, keepdims=True) >= lm.CONTEXTS[k][3], counts, 0)[e.word]) for k in range(lm.COUNTED)])))

    def steps(w):
        for i, byte in enumerate(w + b" "):
            for j in range(lm.DEPTH[byte]):
                yield [(b" " + w)[max(0, i + 1 - order) if order else 0 : i + 1] for order, *_ in lm.CONTEXTS], int(lm.NODES[byte, j]), int(lm.BITS[byte, j]), (b" " + w + b" ")[: i + 2], j

    held: Counter = Counter()
    for w, n in zip(words, counts.tolist()):
        for ctx, node, bit, _, _ in steps(w):
            for k, (_, _, _, least) in enumerate(lm.CONTEXTS):
                for g in range(lm.GROUPS if sum(n) >= least else 0):
                    held[k, ctx[k], node, bit, g] += n[g]
    want, once, gate = np.zeros((32, 5, 6)), set(), None
    for w, n in zip(words, counts.tolist()):
        for g in np.flatnonzero(n).tolist():
            for ctx, node, bit, start, j in steps(w):
                x = []
                for k, (_, _, apart, least) in enumerate(lm.CONTEXTS):
                    c = [sum(held[k, ctx[k], node, o, h] for h in ([g] if apart else range(lm.GROUPS))) for o in (0, 1)]
                    c[bit] = max(0, c[bit] - (sum(n) >= least))
                    x.append(np.log((c[1] + lm.DELTA) / (c[0] + lm.DELTA)))
                gate = sum((abs(v) > 1e-12) << k for k, v in enumerate(x)) if j == 0 else gate
                p = 1 / (1 + np.exp(-weights[gate] @ x))
                want[gate, :, 0] += (bit - p) * n[g] * np.asarray(x)
                want[gate, :, 1:] += p * (1 - p) * n[g] * np.outer(x, x)
                once.add((start, node, bit, g, sum(n) >= 2))
    mixer = lm.Mixer([], weights)
    assert np.allclose(mixer.moments(known, words, counts), want, rtol=1e-4, atol=1e-3)
    assert sum(len(bit) for _, _, bit, _, _ in mixer.examples(known, words, counts.astype(float))) == len(once)
    table, place = known.look(lm.Events(words), 2)
    assert table.shape[2] == 1 and len(table) < len(place)  # no context of this size has its groups apart


def _traced(work) -> tuple[int, int]:
    """Bytes that Python and numpy hold after work, and at most during it."""
    import gc
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        gc.collect()
        return tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_workers_stay_small():
    """What the encoder keeps is bounded by bytes, ids of a block are not all in memory at once, new words are scored some at a time."""
    from sparkloom.llm.langid import _NAMES, Model
    from sparkloom.llm.pretokens import PreTokens

    r = random.Random(3)
    letters = lambda n: r.randbytes(n).translate(bytes(97 + i % 26 for i in range(256)))
    tokens, long = PreTokens(vocabulary()), [letters(300_000) for _ in range(8)]
    blocks = [[b" ".join(str(k * 5000 + i).encode() + b"-" * 700 for i in range(5000))] for k in range(40)]
    held, _ = _traced(lambda: [len(x) for b in blocks for x in tokens.encode(b)])
    assert held < 150 << 20  # 140 MB of text without a chunk that comes twice
    for texts_ in [[t] for t in long] + [blocks[0], blocks[0]]:
        got = tokens.encode(texts_)
        want = tokens.tok.encode_batch_fast([t.decode() for t in texts_], add_special_tokens=False)
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [w.ids for w in want]

    common_words = [b"the of and to in " * 40_000] * 10
    _, most = _traced(lambda: [len(x) for x in PreTokens.each(tokens, common_words)])
    assert most < 60 << 20  # 2,000,000 words

    words = list({letters(r.randrange(3, 12)) for _ in range(150_000)})
    model = Model(["a", "b"], np.ones((1 << 10, 2)), np.ones((len(_NAMES), 2)), 10)
    _, most = _traced(lambda: model.scores(words))
    assert most < 60 << 20
