"""The corpus pipeline on a small table of documents."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ran", "del", "pos", "tik")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(30)
    docs, labels = [], []
    for k in range(200):
        junk = k % 6 == 5
        text = " ".join(w + "###" for w in prose(50).split()) if junk else prose(60)
        docs.append((k, text))
        labels.append((k, int(not junk), 0))
    docs += [(1000, docs[0][1]), (1001, docs[1][1] + " tail"), (1002, prose(20) + " " + item), (1003, prose(50))]
    top = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_run(spark, folder):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    want = {k for k in range(200) if k % 6 != 5} | {1003}
    assert set(got) == want
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) for r in got.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_stage_with_odd_rows(spark, folder, k):
    """Nulls in any column, empty and very long texts, repeated rows, an empty
    table, and extra columns named like those the operators use."""
    rng = random.Random(40 + k)
    words = [a + b for a in ("sa", "ti", "vo") for b in ("ran", "del", "pos", "ver")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one = prose(50)
    rows = [(1, None), (None, None), (2, ""), (3, one), (3, one), (None, prose(40)), (None, prose(40)), ((1 << 53) + 1, prose(45)), (4, prose(30_000)), (5, "x" * 20_000), (6, "\n".join([prose(8)] * 50))]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, quality int, node string, item_id int, places string, line string, ids string, seg int, hash long"
    rows = [(i, t, None, None, None if t is None else len(t), 0.5, 1, "n", 7, "p", "l", "i", 3, 9) for i, t in rows]
    df = spark.createDataFrame(rows, names)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, df, folder)
    got = out.collect()
    none = stage(spark, df.limit(0), folder)
    assert none.count() == 0 and none.columns == out.columns
    if k == 4:
        assert len(got) == len(rows) and all(r.lossless for r in got)
        return
    assert out.schema.fieldNames() == df.schema.fieldNames() and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    count = {i: sum(r.doc_id == i for r in got) for i in {r[0] for r in rows}}
    if name == "n-gram Jaccard join":
        assert count[3] == 1 and len(got) == len(rows) - 1
    elif name != "quality classifier":
        assert len(got) == len(rows)
    if name == "line dedup":
        assert all(r.n_chars == len(r.text) for r in got if r.doc_id is not None)
