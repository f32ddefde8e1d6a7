"""Stages of the pipeline on a small corpus, each held against plain Python."""

import corpus_pipeline as p
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", __import__("pyspark").sql.functions.lit("x")).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = before
    for number, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        now = {r.doc_id: r.text for r in docs.collect()}
        assert now.items() <= kept.items(), name
        if name == "exact_dedup":
            plain = lambda t: (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
            assert sorted(map(plain, now.values())) == sorted({plain(t) for t in kept.values()})
        if name == "ngram_jaccard":
            sets = {}
            for i, t in kept.items():
                w = (t or "").encode().lower().split()
                sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            ids = sorted(now)
            for a in range(len(ids)):
                for b in range(a):
                    x, y = sets[ids[a]], sets[ids[b]]
                    assert not x or not y or 100 * len(x & y) < 80 * len(x | y)
            for i in kept.keys() - now.keys():
                assert any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in kept if j != i)
        kept = now
    packed = p.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_run_and_nulls(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "the cat sat on the mat and the other cat sat too", "en", "s", 5), (1, "the cat sat on the mat and the other cat sat too", "en", "s", 5), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in p.run(spark, str(tmp_path)).collect()] == [1]


def test_decontaminate_drops_one_item(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    texts = [None, "", "nothing of it here", f"before {item} after", "Two, three four five six seven eight NINE", "two three four five six seven eight", "short item", "a short item here", "short, another item", f"{item} short item"]
    bench = [(1, item), (2, "short item"), (3, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    windows = {tuple(w[i : i + 8]) for w in (plain(t) for _, t in bench) if w for i in range(max(1, len(w) - 7))}
    holds = lambda w: any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w)))
    want = [i for i, t in enumerate(texts) if not holds(plain(t))]
    assert want == [0, 1, 2, 5, 8]
    assert sorted(r.doc_id for r in p.decontaminate(spark, docs, str(tmp_path)).collect()) == want
