"""Functions and operators on small fixtures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from skarn.dialect import Rewriter, tokenize
from skarn.functions import fts, json, spatial, vector
from skarn.operators import relational, statistics
from skarn.sources import tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tokenize(spark):
    text = "Hello World! This is a test."
    assert one(spark, fts.tokenize(F.lit(text)))[0] == fts.tokenize_python(text) == ["hello", "world", "this", "is", "a", "test"]
    assert one(spark, fts.tokenize(F.lit("  «Été» -- x-y ")))[0] == ["été", "x-y"]


def test_highlight(spark):
    assert one(spark, fts.highlight(F.lit("Hello big world, hello"), "hello WORLD"), fts.highlight(F.lit("none"), "hello")) == ("**Hello** big **world**, hello", "none")


def test_search_grammar():
    for bad in ("(a", "a)", "OR a"):
        with pytest.raises(ValueError):
            fts.parse(bad)
    assert fts.match_sql("", ["c"]) == "false"


def test_search(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "c"), (4, None)], "id long, t string")
    assert [tuple(r) for r in fts.search(df, "id", "t", "A b").collect()] == [(1, 3), (2, 1)]
    assert fts.index(df, "id", ["t"]).where("term = 'a'").count() == 2
    assert {r.id for r in df.where(fts.match("-a", ["t"])).collect()} == {2, 3, 4}


def test_vectors(spark):
    v = vector.literal
    assert one(spark, vector.l2_distance(v([0, 0]), v([3, 4])), vector.cosine_similarity(v([1, 0]), v([0, 2])), vector.cosine_similarity(v([0, 0]), v([1, 1]))) == (5.0, 0.0, 0.0)
    with pytest.raises(Exception, match="dimensions"):
        one(spark, vector.l2_distance(v([1]), v([1, 2])))
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(10)], "id long, e array<float>")
    got = [tuple(r)[:2] for r in vector.knn_join(df.where("id = 3"), df, "id", "e", 2).orderBy("rank").collect()]
    assert got == [(3, 2), (3, 4)]


def test_json(spark):
    doc = F.lit('{"a": {"b": [1, true, "x", null]}}')
    assert one(spark, json.json_extract(doc, "$.a.b[0]"), json.json_extract(doc, "$.a.b[1]"), json.json_extract(doc, "$.a.b[2]"), json.json_extract(doc, "$.z"), json.json_number(doc, "$.a.b[0]"), json.json_number(doc, "$.a.b[2]")) == ("1", "1", "x", None, 1.0, None)
    assert one(spark, json.json_type(doc, "$.a"), json.json_type(doc, "$.a.b"), json.json_type(doc, "$.a.b[1]"), json.json_type(doc, "$.a.b[3]"), json.json(F.lit("{bad"))) == ("object", "array", "boolean", "null", None)
    assert one(spark, json.json_object(F.lit("k"), F.lit(1.5), F.lit("n"), F.lit(None).cast("string")))[0] == '{"k":1.5,"n":null}'


def test_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (2, 5.0, 15.0, 5.0, 15.0), (3, 20.0, 30.0, 20.0, 30.0)], "id long, a double, b double, c double, d double")
    box = spatial.Box.of("a", "b", "c", "d")
    assert {r.id for r in spatial.search_range(df, box, spatial.Box.of(4, 12, 4, 12)).collect()} == {1, 2}
    assert [r.id for r in spatial.nearest(df, box, 0, 0, 2, "id").collect()] == [1, 2]
    pairs = spatial.box_join(df, df.toDF("id2", "e", "f", "g", "h"), box, spatial.Box.of("e", "f", "g", "h"), 4.0).where("id < id2").select("id", "id2")
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    assert df.where(box.contains(spatial.Box.of(6, 9, 6, 9))).count() == 2


def test_integer_division(spark):
    assert one(spark, relational.int_div(F.lit(7), F.lit(2)), relational.int_div(F.lit(-7), F.lit(2)), relational.int_div(F.lit(7), F.lit(0)), relational.int_mod(F.lit(-7), F.lit(4))) == (3, -3, None, -3)


def test_rowids_are_dense(spark):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("k"))
    got = relational.with_rowid(df, ["k"]).orderBy("k").collect()
    assert [r._rowid for r in got] == list(range(1, 101))


def test_asof_join(spark):
    a = spark.createDataFrame([("x", 1), ("x", 5), ("y", 5)], "k string, t int")
    b = spark.createDataFrame([("x", 1, 10), ("x", 4, 40), ("x", 5, 50)], "k string, t int, v int")
    got = sorted(tuple(r) for r in relational.asof_join(a, b, "k", "t", ["v"]).collect())
    assert got == [("x", 1, None), ("x", 5, 40), ("y", 5, None)]


def test_salted_join(spark):
    a = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 99), (3, 7)], "k int, v int")
    b = spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, a.join(b, "k", how).select("k", "v").collect()))
        assert sorted(map(str, relational.salted_join(a, b, "k", 4, how).select("k", "v").collect())) == want
    with pytest.raises(ValueError):
        relational.salted_join(a, b, "k", 4, "full")


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (11, "b")], "n int, s string")
    got = {r.column_name: tuple(r)[1:] for r in statistics.column_stats(df, ["n", "s"], exact=True).collect()}
    assert got == {"n": (4, 4, 0, "1", "11"), "s": (4, 2, 1, "a", "b")}
    assert [tuple(r) for r in statistics.most_common(df.where("s is not null"), "s", 1).collect()] == [("a", 2)]
    assert sorted(tuple(r) for r in statistics.histogram(df, "n", 2).collect()) == [(0, 3), (1, 1)]
    assert statistics.selectivity(df, "s = 'a'") == 0.5


def test_rewriter_leaves_strings_alone():
    r = Rewriter(lambda name: name in ("a", "b"))
    assert r.sql("SELECT 'a / b' FROM t") == "SELECT 'a / b' FROM t"
    assert "div" in r.sql("SELECT a / b FROM t") and "try_divide" in r.sql("SELECT a / c FROM t")
    assert r.sql("SELECT m[1], [1, 2]") == "SELECT m[1], CAST(array(1, 2) AS ARRAY<FLOAT>)"
    assert [t.text for t in tokenize("a<=b -- x\n||c")] == ["a", "<=", "b", "||", "c"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        tables.write(df, path, fmt)
        assert sorted(map(tuple, tables.read(spark, path, fmt, "a int, b string").collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.read(spark, "x", "xlsx")


def test_match_is_the_token_rule(spark):
    rng = random.Random(3)
    parts = ["cat", "Cat", "dog", "concat", "cat's", "a.b", "ab", "x", "é", " ", " ", "  ", "\n", "-", "...", "(", '"', " ", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    tokens = {r.id: r.t for r in df.select("id", fts.tokenize(F.col("text")).alias("t")).collect()}
    runs = lambda t, words: any(t[i : i + len(words)] == words for i in range(len(t)))
    for query, words in (("cat", ["cat"]), ("a.b", ["a.b"]), ("cat's", ["cat's"]), ("é", ["é"]), ('"cat dog"', ["cat", "dog"]), ('"x ab cat"', ["x", "ab", "cat"])):
        got = {r.id for r in df.where(fts.match(query, ["text"])).collect()}
        assert got == {k for k, t in tokens.items() if t and runs(t, words)}, query
    none = {r.id for r in df.where(fts.match("-cat", ["text"])).collect()}
    assert none == {k for k, t in tokens.items() if not t or "cat" not in t}


def test_knn_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, [rng.random(), rng.random()]) for k in range(60)], "id int, v array<double>")
    whole = sorted(map(tuple, vector.knn_join(df, df, "id", "v", 3).collect()))
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    cut = vector.knn_join(df, df, "id", "v", 3)
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) == 180
    assert "CartesianProduct" not in cut._jdf.queryExecution().executedPlan().toString()


def test_box_join_of_small_and_huge_boxes(spark):
    rng = random.Random(5)

    def boxes(n):
        out = []
        for k in range(n):
            size = rng.choice([0, 0.5, 1, 3, 40, 5000])
            x, y = rng.uniform(-100, 100), rng.uniform(-100, 100)
            out.append((k, x, x + size, y, y + rng.choice([0, 1, size])))
        return out

    a, b = boxes(120), boxes(120)
    left = spark.createDataFrame(a, "id int, x0 double, x1 double, y0 double, y1 double")
    right = spark.createDataFrame(b, "sid int, u0 double, u1 double, v0 double, v1 double")
    got = spatial.box_join(left, right, spatial.Box.of("x0", "x1", "y0", "y1"), spatial.Box.of("u0", "u1", "v0", "v1"), 1.0).select("id", "sid").collect()
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_asof_and_interval_joins_by_brute_force(spark):
    rng = random.Random(6)
    left = [(k, rng.choice("ab"), rng.randint(0, 60)) for k in range(80)]
    right = [(rng.choice("ab"), rng.randint(0, 60), k) for k in range(40)]
    ldf, rdf = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 < t), default=(0, None))[1] for i, k, t in left}
    for bucket in (None, "floor(t / 7)"):
        got = relational.asof_join(ldf, rdf, "k", "t", ["v"], ["v"], bucket)
        assert got.columns == ["id", "k", "t", "v"] and {r.id: r.v for r in got.collect()} == want
    spans = spark.createDataFrame([(k, t, t + v % 9 - 1, v) for k, t, v in right], "k string, lo int, hi int, s int")
    got = relational.interval_join(ldf, spans, "t", "lo", "hi", 5.0, ["k"]).select("id", "s").collect()
    assert sorted(map(tuple, got)) == sorted((i, v) for i, k, t in left for k2, lo, v in right if k == k2 and lo <= t <= lo + v % 9 - 1)


def test_salted_join_does_not_broadcast_the_repeats(spark):
    a, b = spark.range(500).selectExpr("id % 40 AS k", "id AS v"), spark.range(40).selectExpr("id AS k")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plan = relational.salted_join(a, b, "k", 16, how)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert relational.salted_join(a, b, "k").count() == 500


def test_knn_join_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vectors = [[rng.choice([0.0, 0.1, 0.3, 1e3]) for _ in range(5)] for _ in range(40)]
    rows = [(k, rng.choice(vectors)) for k in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (303, [1e200] * 5), (304, [1e200] * 5), (305, [float("nan")] * 5)]

    def distance(a, b):
        if a is None or b is None or None in a or None in b:
            return (1, 0.0)
        s = 0.0
        for x, y in zip(a, b):
            s += (x - y) * (x - y)
        return (0, float("inf")) if s == float("inf") else (0.5, 0.0) if s != s else (0, s**0.5)

    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.where("id % 10 = 0 or id > 295")
    want = []
    for k, v in rows:
        if k % 10 == 0 or k > 295:
            near = sorted((*distance(v, w), j) for j, w in rows if j != k)[:4]
            want += [(k, j, rank + 1) for rank, (_, _, j) in enumerate(near)]
    for pairs, batch in ((20_000_000, "10000"), (2_000, "16")):
        monkeypatch.setattr(vector, "TASK_PAIRS", pairs)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = vector.knn_join(queries, df, "id", "v", 4)
            got = sorted((r.query_key, r.neighbour_key, r["rank"]) for r in found.collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted(want)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    few = spark.createDataFrame([(1, [0.0]), (2, None), (3, [2.0])], "id long, v array<double>")
    assert [(r.neighbour_key, r.distance) for r in vector.knn_join(few.where("id = 1"), few, "id", "v", 5).orderBy("rank").collect()] == [(3, 2.0), (2, None)]
    with pytest.raises(Exception, match="dimensions"):
        vector.knn_join(few, spark.createDataFrame([(9, [1.0, 2.0])], "id long, v array<double>"), "id", "v", 1).collect()


def test_interval_join_of_copies_and_hot_bins(spark, monkeypatch):
    monkeypatch.setattr(relational, "PIECE_ROWS", 6)
    monkeypatch.setattr(relational, "REPEATS", 4)
    rng = random.Random(9)
    left = [(k, rng.choice([1.0, 2.5, 7.0])) for k in range(60)]
    right = [(lo, lo + 2) for lo in (rng.choice([0.0, 0.5, 1.5, 6.0]) for _ in range(50))] + [(9.0, 8.0), (None, 9.0)]
    out = relational.interval_join(spark.createDataFrame(left, "id int, t double"), spark.createDataFrame(right, "lo double, hi double"), "t", "lo", "hi", 2.0)
    assert out.columns == ["id", "t", "lo", "hi"]
    assert sorted((r.id, r.lo) for r in out.collect()) == sorted((i, lo) for i, t in left for lo, hi in right if lo is not None and lo <= t <= hi)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan and "strategy=merge" in plan
    rows = out.select("id", "lo").collect()
    changes = sum(rows[k] != rows[k - 1] for k in range(1, len(rows)))
    assert changes < len(rows) / 2  # copies of a right row stand together


def test_box_join_cuts_a_full_cell_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(relational, "PIECE_ROWS", 10)
    left = spark.range(90).selectExpr("id", "id / 100 AS x0", "id / 100 + 0.1 AS x1", "0D AS y0", "1D AS y1").coalesce(1)
    right = spark.range(70).selectExpr("id AS sid", "id / 100 AS u0", "id / 100 + 0.1 AS u1", "0D AS v0", "1D AS v1").coalesce(1)
    box, other = spatial.Box.of("x0", "x1", "y0", "y1"), spatial.Box.of("u0", "u1", "v0", "v1")
    out = spatial.box_join(left, right, box, other, 10.0).select("id", "sid", F.spark_partition_id().alias("p")).collect()
    want = {(a, b) for a in range(90) for b in range(70) if a / 100 <= b / 100 + 0.1 and a / 100 + 0.1 >= b / 100}
    assert len(out) == len(want) and {(r.id, r.sid) for r in out} == want
    assert len({r.p for r in out}) > 1  # one cell, several tasks


def test_sketches_beside_exact_counts():
    r = Rewriter(lambda name: False)
    both = "SELECT APPROX_COUNT_DISTINCT(a, 0.02) - COUNT(DISTINCT a) FROM t"
    assert r.sql(both) == "SELECT APPROX_COUNT_DISTINCT(DISTINCT a, 0.02) - COUNT(DISTINCT a) FROM t"
    for alone in ("SELECT APPROX_COUNT_DISTINCT(a) FROM t", "SELECT DISTINCT APPROX_COUNT_DISTINCT(a) FROM t", "SELECT APPROX_COUNT_DISTINCT(a) FROM (SELECT COUNT(DISTINCT b) AS a FROM u) AS q"):
        assert r.sql(alone).count("DISTINCT ") == alone.count("DISTINCT ")


def test_sketches_are_not_kept_for_each_value(spark):
    spark.range(3000).selectExpr("id % 700 AS a", "id % 9 AS b").createOrReplaceTempView("sketched")
    text = Rewriter(lambda name: False).sql("SELECT APPROX_COUNT_DISTINCT(a, 0.02) AS x, COUNT(DISTINCT a) AS n, COUNT(*) AS r FROM sketched")
    made, alone = spark.sql(text), spark.sql("SELECT APPROX_COUNT_DISTINCT(a, 0.02) AS x FROM sketched")
    assert tuple(made.first()) == (alone.first().x, 700, 3000)
