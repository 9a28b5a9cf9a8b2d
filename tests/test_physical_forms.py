"""Two physical forms of one operator must agree; so must an operator and its brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from spanlake.operators import intervals as I
from spanlake.operators.aggregates import contiguity_check, table_fingerprint
from spanlake.operators.knn import knn_join
from spanlake.operators.lexical import bm25_search
from spanlake.operators.skew import carry, islands, number_rows


def rows_of(df, digits=7):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def vectors(spark, n, dim, name, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i % 3, rng.normal(size=dim).tolist()) for i in range(n)], f"{name} long, video_id long, embedding array<float>")


def test_knn_blocks_equal_broadcast_and_brute_force(spark):
    u = vectors(spark, 300, 8, "unit", 1)
    q = vectors(spark, 25, 8, "query_id", 2).select("query_id", F.lit(0).alias("query_idx"), F.col("embedding").alias("vec"))
    a = knn_join(q, u, 5, keep=("unit",))
    b = knn_join(q, u, 5, keep=("unit",), max_task_queries=4, unit_block_rows=40)
    assert rows_of(a) == rows_of(b) and a.count() == 25 * 3 * 5
    um = {r.unit: (r.video_id, np.array(r.embedding, dtype=float)) for r in u.collect()}
    qv = {r.query_id: np.array(r.vec, dtype=float) for r in q.collect()}
    for r in a.where("query_id < 3").collect():
        s = sorted(((-float(qv[r.query_id] @ e / np.linalg.norm(qv[r.query_id]) / np.linalg.norm(e)), k) for k, (v, e) in um.items() if v == r.video_id))
        assert s[r["rank"] - 1][1] == r.unit


def test_knn_empty_queries(spark):
    u = vectors(spark, 10, 4, "unit", 1)
    q = vectors(spark, 1, 4, "query_id", 2).where("query_id < 0").select("query_id", F.lit(0).alias("query_idx"), F.col("embedding").alias("vec"))
    assert knn_join(q, u, 5, keep=("unit",)).count() == 0


def test_bm25_forms_agree(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["中文字幕", "中文"]
    docs = spark.createDataFrame([(i, i % 4, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(200)], "segment_idx long, video_id long, text string")
    qs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=4))) for i in range(12)], "query_id long, text string")
    assert rows_of(bm25_search(qs, docs, 7)) == rows_of(bm25_search(qs, docs, 7, max_task_terms=3))


def test_overlap_join_equals_nested_loop(spark):
    rnd = random.Random(9)

    def table(n, key, s, e):
        return spark.createDataFrame([(rnd.randint(0, 2), i, x := round(rnd.random() * 100, 1), x + round(rnd.random() * rnd.choice([1, 12, 12, 400]), 1)) for i in range(n)], f"video_id int, {key} int, {s} double, {e} double")

    a, b = table(80, "a", "s", "e"), table(90, "b", "bs", "be")
    la, lb = a.collect(), b.collect()
    for strict in (True, False):
        got = rows_of(I.overlap_join(a, b, ["video_id"], ("s", "e"), ("bs", "be"), width=3.0, strict=strict).select("a", "b"))
        want = sorted((x.a, y.b) for x in la for y in lb if x.video_id == y.video_id and ((x.s < y.be and x.e > y.bs) if strict else (x.s <= y.be and x.e >= y.bs)))
        assert got == want


def test_carry_equals_plain_windows_with_one_hot_key(spark):
    rnd = random.Random(11)
    rows = [(0 if i % 3 else i % 7, i, round(rnd.random() * 1000, 1), rnd.randint(0, 50)) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, id int, t double, x int")
    got = {r.id: (r.m, r.s, r.l) for r in carry(d, ["k"], [F.col("t"), F.col("id")], 30.0, max_before={"m": F.col("x")}, sum_upto={"s": F.col("x")}, lag={"l": F.col("x")}).collect()}
    state = {}
    for k, i, t, x in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        m, s, last = state.get(k, (None, 0, None))
        assert got[i] == (m, s + x, last)
        state[k] = (x if m is None else max(m, x), s + x, x)
    n = number_rows(d, ["k"], [F.col("t"), F.col("id")], 30.0)
    assert n.groupBy("k").agg((F.max("idx") + 1 == F.count("*")).alias("ok")).where("ok").count() == n.select("k").distinct().count()


def test_islands(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 1.0, 2.0), (1, 2, 6.5, 7.0), (1, 3, 9.5, 10.0), (1, 4, 12.0, 13.0)], "k int, id int, s double, e double")
    got = {r.id: r.island for r in islands(d, ["k"], "s", "e", 2.0, ["id"], 3.0).collect()}
    assert got[0] == got[1] == got[2] and len({got[2], got[3], got[4]}) == 2 and got[3] == got[4]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    d = spark.createDataFrame([(i, f"t{i}", i / 7) for i in range(200)], "id int, t string, x double")
    f = lambda x: table_fingerprint(x, ["id", "t", "x"]).collect()
    assert f(d) == f(d.orderBy(F.desc("id")).repartition(7))
    assert f(d) != f(d.withColumn("t", F.when(F.col("id") == 5, "z").otherwise(F.col("t"))))
    assert f(d) != f(d.unionByName(d.limit(1)))


def test_contiguity(spark):
    d = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 0), (2, 2), (3, 1), (4, 0), (4, 2)], "v int, i int")
    assert {r.v: r.contiguous for r in contiguity_check(d, ["v"], "i").collect()} == {1: True, 2: False, 3: False, 4: False}
