"""What writing and searching the stored index moves, and its rows where units and texts differ."""
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from spanlake.catalogue import all_queries, all_sql
from spanlake.functions.text import joined_tokens, tokenize
from spanlake.operators import postings as P
from spanlake.session import shared_dir

DIR = "/root/testdata/sf0.001"


def test_joined_tokens_are_the_tokens(spark):
    texts = ["", "  ", None, "One, two;\tTHREE", "·x²½ — 3.5e7", "中文字幕", "a中文字 b文", "É ß İstanbul ΣΑΣ", "\U00010400a\U0001f600b", "...", "line\nline\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in df.select("text", tokenize("text").alias("t"), joined_tokens("text").alias("j")).collect():
        assert (r.j.split(" ") if r.j is not None else []) == (r.t or []), r.text


def test_no_block_is_larger_than_two_parts(spark):
    docs = spark.range(4000).select(F.col("id").alias("segment_idx"), (F.col("id") % 3).alias("video_id"), F.concat(F.lit("a b"), F.col("id") % 7).alias("text"))
    path = f"{shared_dir(spark)}/index-pieces-{np.random.default_rng().integers(1 << 60):x}"
    P.write_postings(docs, path, block_docs=50)
    blocks = spark.read.parquet(f"{path}/docs").collect()
    assert max(r.n for r in blocks) <= 100 and sum(r.n for r in blocks) == 4000 and len({r.block for r in blocks}) == len(blocks)


def test_a_task_sends_nothing_below_its_bar():
    r = np.random.default_rng(7)
    state = P._Scores({"a": np.array([0])}, {"a": 1.0}, 1, 10.0, 3, 1.2, 0.75)
    sent = []
    for n in range(20):
        tf = r.integers(1, 9, 30)
        asked, scores = state.block(r.integers(5, 20, 30).astype(float), np.zeros(30, int), [(7,)], ["a"], [np.arange(30)], [tf], np.array([9.0]), np.array([1.0]))
        sent.append(int((scores > 0).sum()))
    assert sent[0] == 3 and sum(sent[1:]) < 40


def test_no_text_of_a_unit_is_joined_or_searched(spark):
    """Of the documents a search reads neither texts nor heads; the index is written from texts that no join has shuffled."""
    plan = all_queries()["hybrid_search"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    files = [line for line in plan.splitlines() if "Relation" in line and "text#" in line and "source#" in line]
    names = set(re.findall(r"text#\d+", " ".join(files)))
    used = [line for line in plan.splitlines() if "Relation" not in line and any(n in line for n in names)]
    assert files and not used


def test_texts_whose_vector_is_missing(spark, tmp_path):
    """They count in the statistics of the index and take up places, but are no units."""
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{DIR}/embeddings.parquet").where(F.col("vec_id") % 10 != 3).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")

    def rows(found):
        return sorted(tuple("~" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in found)

    got = rows(all_queries()["hybrid_search"](spark, str(tmp_path)).collect())
    assert got and got == rows(con.execute(all_sql()["hybrid_search"]).fetchall())
