"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontam, htmltext, langid, licences, mixing, negatives, ngram_lm, postings, runs, setjoin, syncmers, toxicity, unitdedup


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    learned = labels.where(~C.crc_split("doc_id", 3, 1))
    found = toxicity.score_toxicity(docs, toxicity.learn(learned, docs))
    return found.select("doc_id", C.crc_split("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(C.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"), "sampled")


OP2_SQL = f"""WITH {mixing.ipf_sql()}
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, round(CASE WHEN u < probability THEN {mixing.RATE} * ratio / probability ELSE 0.0 END, 6) AS weight, u < probability AS sampled FROM mixed"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(C.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP3_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
 e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
 i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i.c >= 90 * (x.n + y.n - i.c)),
 r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY 1, 2"""


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(C.table(spark, sf_dir, "documents"))


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(C.table(spark, sf_dir, "documents"), ~C.crc_split("doc_id", 5, 1))
    return scored.select("doc_id", C.crc_split("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.round("dice", 6).alias("dice"), "n_units")


OP6_SQL = f"SELECT doc_id, licence, round(dice, 6) AS dice, n_units FROM ({licences.licence_sql()}) f"


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(C.table(spark, sf_dir, "pages"))


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = unitdedup.dedup_units(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("cut", lambda c: F.concat_ws("-", c["first"].cast("string"), c["last"].cast("string"))), ",")
    return cut.select("doc_id", F.size("cut").cast("bigint").alias("n_removed"), spans.alias("removed"), "text")


OP9_SQL = f"""WITH u AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '(?s:.*?)(?:[\\p{{L}}\\p{{N}}][.?!][^\\p{{L}}\\p{{N}}_\\s!]*\\s+|\\n+|$)') AS us FROM documents),
 x AS MATERIALIZED (SELECT doc_id, i, us[i] AS unit, coalesce(list_sum([length(us[j]) for j in range(1, i)]), 0)::BIGINT AS a FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM u) y),
 d AS MATERIALIZED (SELECT doc_id, i, unit, a, regexp_extract_all(lower(unit), '[\\p{{L}}\\p{{N}}]+') AS w FROM x),
 k AS MATERIALIZED (SELECT *, len(w) >= {unitdedup.MIN_WORDS} AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, a) > 1 AS gone FROM d),
 g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(a || '-' || (a + length(unit)), ',' ORDER BY a) FILTER (gone), '') AS removed, coalesce(string_agg(unit, '' ORDER BY a) FILTER (NOT gone), '') AS text FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(g.text, documents.text) AS text FROM documents LEFT JOIN g USING (doc_id)"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    sample = langid.labelled_sample(docs.where(~C.crc_split("doc_id", 4, 2)))
    found = langid.identify(docs, sample, keep=["doc_id"])
    return found.select("doc_id", C.crc_split("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def runs_query(docs: DataFrame) -> DataFrame:
    found = runs.periodic_runs(docs, altered=True)
    first = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", F.try_element_at(first, F.lit(1)))
    return best.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_query(C.table(spark, sf_dir, "documents"))


def shifted(rows: DataFrame) -> DataFrame:
    """Labels of every seventh vector moved on by one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(shifted(C.table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP12_SQL = f"""WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {negatives.POSITIVES}),
 n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
   row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}"""


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest_vectors(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mix_sources, op3_ngram_jaccard_join, op4_closed_syncmers, op5_deleted_interpolation, op6_licence_scan, op7_decontaminate, op8_main_text, op9_unit_dedup, op10_language_id, op11_periodic_runs, op12_hard_negatives, op13_posting_lists)}
SQL = {"op2_mix_sources": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op6_licence_scan": OP6_SQL, "op9_unit_dedup": OP9_SQL, "op12_hard_negatives": OP12_SQL}
