"""Building blocks that stay parallel when one key owns a large share of the rows.

* ``top_k``        row_number <= k; Spark keeps k rows per key *before* the shuffle.
* ``group_stats``  group aggregates joined back: partial aggregation replaces a
                   whole-partition window, and AQE splits the hot key in the join.
* ``carry``        running max / sum / previous row over (key, time): windows run
                   inside time chunks, and one small row per chunk carries the
                   state across chunks, so a hot key is spread over its chunks.
* ``islands``      gaps-and-islands on top of ``carry``.
* ``fold_sorted``  an order-dependent fold streamed over sorted partitions; it
                   holds the fold's own state, never a whole group.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group; ``order`` must end in a unique key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """``df`` plus per-group aggregates. Keys must not be null."""
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, by)


def carry(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    width: float,
    *,
    max_before: dict[str, Column] | None = None,
    sum_upto: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
) -> DataFrame:
    """Running values in (keys, order). ``order[0]`` is numeric time, the last order column unique.

    ``max_before``: maximum over strictly earlier rows. ``sum_upto``: sum over
    earlier rows and this one. ``lag``: value on the previous row. A chunk is
    ``floor(order[0] / width)``; only one row per (key, chunk) crosses chunks.
    """
    max_before, sum_upto, lag = max_before or {}, sum_upto or {}, lag or {}
    part = [*keys, "__chunk"]
    d = df.withColumn("__chunk", F.floor(order[0] / F.lit(width)).cast("long"))
    for i, o in enumerate(order):
        d = d.withColumn(f"__o{i}", o)
    for n, c in {**max_before, **sum_upto, **lag}.items():
        d = d.withColumn(f"__v_{n}", c)
    o_cols = [F.col(f"__o{i}") for i in range(len(order))]
    w = Window.partitionBy(*part).orderBy(*o_cols)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aggs = []
    for n in max_before:
        aggs.append(F.max(f"__v_{n}").alias(f"__c_{n}"))
    for n in sum_upto:
        aggs.append(F.sum(f"__v_{n}").alias(f"__c_{n}"))
    for n in lag:
        aggs.append(F.max_by(F.struct(F.col(f"__v_{n}").alias("v")), F.struct(*o_cols)).alias(f"__c_{n}"))
    chunks = d.groupBy(*part).agg(*aggs)
    cw = Window.partitionBy(*keys).orderBy("__chunk")
    cb = cw.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *part,
        *[F.max(f"__c_{n}").over(cb).alias(f"__p_{n}") for n in max_before],
        *[F.sum(f"__c_{n}").over(cb).alias(f"__p_{n}") for n in sum_upto],
        *[F.lag(f"__c_{n}").over(cw).alias(f"__p_{n}") for n in lag],
    )
    inner = {}
    for n in max_before:
        inner[f"__i_{n}"] = F.max(f"__v_{n}").over(before)
    for n in sum_upto:
        inner[f"__i_{n}"] = F.sum(f"__v_{n}").over(upto)
    for n in lag:
        inner[f"__i_{n}"] = F.lag(F.struct(F.col(f"__v_{n}").alias("v"))).over(w)
    d = d.withColumns(inner).join(chunks, part)
    out = {}
    for n in max_before:
        i, p = F.col(f"__i_{n}"), F.col(f"__p_{n}")
        out[n] = F.when(i.isNull(), p).when(p.isNull(), i).when(i >= p, i).otherwise(p)
    for n in sum_upto:
        out[n] = F.coalesce(F.col(f"__i_{n}"), F.lit(0)) + F.coalesce(F.col(f"__p_{n}"), F.lit(0))
    for n in lag:
        out[n] = F.coalesce(F.col(f"__i_{n}"), F.col(f"__p_{n}"))["v"]
    names = [c for c in df.columns if c not in out]
    return d.select(*names, *[c.alias(n) for n, c in out.items()])


def number_rows(df: DataFrame, keys: list[str], order: list[Column], width: float, name: str = "idx") -> DataFrame:
    """Dense 0-based index per key."""
    d = carry(df, keys, order, width, sum_upto={name: F.lit(1).cast("long")})
    return d.withColumn(name, F.col(name) - 1)


def islands(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    gap: float,
    tie: list[str],
    width: float,
    name: str = "island",
    cut: Column | None = None,
) -> DataFrame:
    """Island number per key: a new island opens when the gap to everything earlier exceeds ``gap``.

    ``cut`` adds a further reason to open an island; it may use ``__prev_end``.
    """
    order = [F.col(start), F.col(end), *[F.col(t) for t in tie]]
    d = carry(df, keys, order, width, max_before={"__prev_end": F.col(end)})
    opens = F.col("__prev_end").isNull() | (F.col(start) - F.col("__prev_end") > gap)
    if cut is not None:
        opens = opens | cut
    d = carry(d, keys, order, width, sum_upto={name: opens.cast("long")})
    return d.drop("__prev_end")


def fold_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    fold: Callable[[Iterator[dict]], Iterable[dict]],
    schema: str,
) -> DataFrame:
    """Run ``fold`` over the rows of each key in ``order``, streaming.

    ``fold`` receives row dicts one at a time and yields output dicts; key values
    are filled in when the fold leaves them out.
    """
    d = df
    for i, o in enumerate(order):
        d = d.withColumn(f"__o{i}", o)
    out_type = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(out_type)
    names = out_type.fieldNames()

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())

        def results():
            for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
                fixed = dict(zip(keys, key))
                for item in fold(group):
                    yield {n: item.get(n, fixed.get(n)) for n in names}

        stream = results()
        while chunk := list(islice(stream, 4096)):
            yield pa.RecordBatch.from_pylist(chunk, schema=arrow_schema)

    o_names = [f"__o{i}" for i in range(len(order))]
    return d.repartition(*keys).sortWithinPartitions(*keys, *o_names).mapInArrow(run, out_type)
