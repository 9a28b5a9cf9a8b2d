"""Mixing of sources by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by cell (source, lang, topic). Raking scales the cells in turn to the target totals of each
source, language and topic until all three fit. A cell's ratio of raked to present tokens says how strongly its
documents are wanted: each is drawn with probability min(1, rate * ratio), by a hash of its id; where the
ratio asks for more than all documents, the drawn ones carry the rest as a weight above 1, so that weighted
tokens of the sample fit the targets.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from . import common as C

MARGINS = ("source", "lang", "topic")
#: Targets are shares in proportion to tokens ** FLATTEN; RATE is the expected share of tokens kept.
FLATTEN, RATE, ROUNDS = 0.5, 0.5, 12
#: Classes into which the documents of a cell are dealt for the join with its ratio.
SALTS = 32


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The topic where the table has none: the form of the text (empty, table, capitals, short, medium, long)."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    capitals = F.length(text) - F.length(F.translate(text, C.UPPER, ""))
    return (F.when(n_tokens == 0, "empty").when(bars * 4 > n_tokens, "table").when(capitals * 2 > F.length(text), "capitals")
            .when(n_tokens < 200, "short").when(n_tokens < 1000, "medium").otherwise("long"))


def _fit(cells: DataFrame, margin: str) -> DataFrame:
    """Cells scaled so that each level of one margin has its target share of all tokens; empty levels stay."""
    total = F.sum("w").over(Window.partitionBy(margin))
    return cells.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"t_{margin}") / total).otherwise(F.col("w")))


def rake(cells: DataFrame, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """Cells (source, lang, topic, n) with w, the raked share of all tokens. Null levels are levels of their own."""
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.pow(F.sum("n").cast("double"), F.lit(flatten)).alias("_s"))
        whole = own.agg(F.sum("_s")).first()[0] or 1.0
        level = own.select(F.col(m).alias("_m"), (F.col("_s") / whole).alias(f"t_{m}"))
        cells = cells.join(level, cells[m].eqNullSafe(level["_m"])).drop("_m")
    cells = cut_lineage(cells.withColumn("w", F.col("n").cast("double")))
    for i in range(rounds):
        for m in MARGINS:
            cells = _fit(cells, m)
        if i % 4 == 3:
            cells = cut_lineage(cells)
    return cells.select(*MARGINS, "n", "w")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None, rate: float = RATE, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """All columns of ``docs`` with topic, n_tokens, probability, weight (0 where not drawn) and sampled.

    ``docs`` has source and lang; columns named like a result column are replaced. A null or empty text has no
    token; its cell, if it has no token at all, keeps the plain rate. A null id is drawn as the empty text
    would be. Repeated rows share their fate. An empty table gives an empty result.
    """
    new = ("topic", "n_tokens", "probability", "weight", "sampled")
    names = [c for c in docs.columns if c not in new]
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    d = docs.select(*names, tokens.alias("n_tokens"))
    d = d.withColumn("topic", topic if topic is not None else topic_of(F.coalesce(F.col(text), F.lit("")), F.col("n_tokens")))
    cells = rake(cut_lineage(d.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n"))), rounds, flatten)
    whole = cells.agg(F.sum("n")).first()[0] or 0
    ratio = F.when(F.col("n") > 0, F.col("w") * float(whole) / F.col("n")).otherwise(1.0)
    dealt = cells.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], ratio.alias("_ratio"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    d = d.withColumn("_k", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"))
    on = [d[m].eqNullSafe(dealt[f"_{m}"]) for m in MARGINS] + [d["_k"] == dealt["_salt"]]
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = d.join(dealt, on).withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("_ratio"))).withColumn("sampled", chance < F.col("probability"))
    weight = F.when(F.col("sampled"), F.lit(rate) * F.col("_ratio") / F.col("probability")).otherwise(0.0)
    return drawn.select(*names, "topic", "n_tokens", "probability", weight.alias("weight"), "sampled")


def ipf_sql(docs: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB common table expressions for ``mix_sources`` over ``docs``; the last is ``mixed``."""
    capitals = f"length(t) - length(translate(t, '{C.UPPER}', ''))"
    out = [f"""toks AS MATERIALIZED (SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {docs})""",
           f"""topics AS MATERIALIZED (SELECT *, CASE WHEN n_tokens = 0 THEN 'empty' WHEN (length(t) - length(replace(t, '|', ''))) * 4 > n_tokens THEN 'table' WHEN ({capitals}) * 2 > length(t) THEN 'capitals'
             WHEN n_tokens < 200 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM toks)""",
           "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS n FROM topics GROUP BY ALL)"]
    for m in MARGINS:
        out.append(f"s_{m} AS (SELECT {m}, pow(sum(n)::DOUBLE, {FLATTEN}) AS s FROM cells GROUP BY 1)")
    shares = ", ".join(f"(SELECT max(s) FROM s_{m} WHERE s_{m}.{m} IS NOT DISTINCT FROM cells.{m}) / (SELECT sum(s) FROM s_{m}) AS t_{m}" for m in MARGINS)
    out.append(f"w0 AS MATERIALIZED (SELECT *, {shares}, n::DOUBLE AS w FROM cells)")
    i = 0
    for _ in range(rounds):
        for m in MARGINS:
            i += 1
            out.append(f"w{i} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * t_{m} / sum(w) OVER (PARTITION BY {m}) ELSE w END AS w FROM w{i - 1})")
    out.append(f"ratios AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN w * (SELECT sum(n) FROM cells) / n ELSE 1.0 END AS ratio FROM w{i})")
    out.append(f"""mixed AS (SELECT d.* EXCLUDE (t), r.ratio, least(1.0, {RATE} * r.ratio) AS probability, ('0x' || substr(md5('mix-' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r} AS u
      FROM topics d JOIN ratios r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic IS NOT DISTINCT FROM r.topic)""")
    return ",\n".join(out)
