"""Names in texts against a search of every name in every text."""
import random

import pytest

from spanlake.catalogue import all_queries
from spanlake.operators.relations import entity_mention


def test_longest_name(spark):
    r = random.Random(4)
    names = ["a", "Ann", "anna", "ANNA LEE", "é", "李", "李小龙", "x y", "straße", ""] + ["".join(r.choice("abc ") for _ in range(n)).strip() or "q" for n in range(1, 40)]
    texts = ["".join(r.choice("abc é李小龙nNlLeE") for _ in range(r.choice([0, 1, 2, 5, 40, 300]))) for _ in range(80)] + ["Meet Anna Lee here", "STRASSE", "see 李小龙 now", "zzz", None, "".join(names)]
    got = {x.query_id: x.name for x in entity_mention(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"),
                                                      spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(99, None)], "entity_id long, name string")).collect()}
    want = {}
    for q, t in enumerate(texts):
        found = [n for n in names if n and t is not None and n.casefold() in t.casefold()]
        if found:
            want[q] = min(found, key=lambda n: (-len(n), n))
    assert got == want


def test_rows_do_not_grow_with_the_lengths_of_names(spark):
    text = " ".join(f"w{i}" for i in range(300))
    texts = spark.createDataFrame([(1, text)], "query_id long, text string")
    names = spark.createDataFrame([(n, text[:n]) for n in range(3, 200)], "entity_id long, name string")
    df = entity_mention(texts, names)
    assert df.collect()[0].name == text[:199]
    assert entity_mention(texts, names.limit(0)).collect() == [] and entity_mention(texts.limit(0), names).collect() == []


@pytest.mark.parametrize("name", ["entity_mention", "resolve_entity_vector", "classify_query_identity"])
def test_no_rows_of_texts_are_broadcast(spark, name):
    """Of the rows of texts and of what is one row a text, no small file makes a broadcast."""
    df = all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = [b for b in plan.split("\n\n") if "BroadcastExchange" in b.split("\n")[0] and "Input" in b]
    assert not [b for b in sent if "query_id" in b]
