"""Exact percentiles by radix selection, and a mergeable sketch of bounded size."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

DIGIT = 16                # bits that one pass settles
DIGITS = 64 // DIGIT      # passes over the rows
MASK = (1 << DIGIT) - 1
NAN = int(np.float64("nan").view(np.int64) ^ np.int64(-(1 << 63)))  # the key of NaN, which Arrow would take for a null


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Doubles as 64 bits whose unsigned order is the order of the values, NaN last; -0.0 counts as 0.0."""
    v = x.to_numpy(dtype=np.float64) + 0.0
    bits = np.where(np.isnan(v), np.float64("nan"), v).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))))


@F.pandas_udf(DoubleType())
def _value(k: pd.Series) -> pd.Series:
    """The double of an ordered key."""
    bits = k.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(-(1 << 63)), ~bits).view(np.float64))


def _same(left: DataFrame, right: DataFrame, names: list[str], renamed: list[str]) -> Column:
    """Equality of group keys, null equal to null."""
    cond = F.lit(True)
    for a, b in zip(names, renamed):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def _digit(i: int) -> Column:
    """Digit ``i`` of a key, the highest first."""
    return F.shiftrightunsigned("__k", 64 - DIGIT * (i + 1)).bitwiseAND(F.lit(MASK).cast("long"))


def percentiles(rows: DataFrame, by: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles ``{name: p}`` of each group, with ``n`` values and their ``mean``.

    A value is found digit by digit: a pass counts one digit of the values that share the digits
    found so far, so a group never holds more than ``2 ** DIGIT`` counts for each of its wanted ranks,
    however many distinct values it has, and counts are merged before the shuffle. There are
    ``DIGITS`` passes over the rows; all but the first keep only rows that still share a prefix.
    Null values do not count (a group of nulls has null percentiles), NaN is the largest value,
    null group keys are a group, an empty table gives no rows.
    """
    names = list(probs)
    d = rows.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__x")).select(*by, _ordered("__x").alias("__k"))
    # ranks on both sides of each percentile, from 0
    ends = [(2 * i + j, side((F.col("__t") - 1) * F.lit(float(probs[n])))) for i, n in enumerate(names) for j, side in enumerate((F.floor, F.ceil))]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for i, r in ends])

    def narrowed(hist: DataFrame, within: list[str], prefix: Column) -> DataFrame:
        """Counts of digits to the prefixes that hold a wanted rank, each rank counted from its prefix's first value."""
        w = Window.partitionBy(*within).orderBy("__d")
        low = F.col("__c") - F.col("__n")
        h = hist.withColumn("__c", F.sum("__n").over(w)).withColumn(
            "__q", F.filter("__q", lambda q: (q["r"] >= low) & (q["r"] < F.col("__c"))))
        return h.where(F.size("__q") > 0).select(*by, prefix.alias("__p"), F.transform("__q", lambda q: F.struct(q["i"].alias("i"), (q["r"] - low).alias("r"))).alias("__q"))

    hist = d.groupBy(*by, _digit(0).alias("__d")).agg(F.count("*").alias("__n"))
    hist = hist.withColumn("__t", F.sum("__n").over(Window.partitionBy(*by))).withColumn("__q", ranks)
    wanted = narrowed(hist, by, F.col("__d"))
    renamed = [f"__b{i}" for i in range(len(by))]
    for i in range(1, DIGITS):
        want = wanted.select(*[F.col(a).alias(b) for a, b in zip(by, renamed)], "__p", "__q")
        near = d.join(want, _same(d, want, by, renamed) & (F.shiftrightunsigned(d["__k"], 64 - DIGIT * i) == want["__p"]))
        hist = near.groupBy(*by, "__p", "__q", _digit(i).alias("__d")).agg(F.count("*").alias("__n"))
        wanted = narrowed(hist, [*by, "__p"], F.shiftleft("__p", DIGIT).bitwiseOR(F.col("__d")))
    value = F.when(F.col("__p") == NAN, F.lit(float("nan"))).otherwise(_value("__p"))
    found = wanted.select(*by, value.alias("__v"), F.explode("__q.i").alias("__i"))
    found = found.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(f"__v{i}") for i, _ in ends])
    found = found.select(*[F.col(a).alias(b) for a, b in zip(by, renamed)], *[f"__v{i}" for i, _ in ends])

    stats = rows.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"))
    out = stats.join(found, _same(stats, found, by, renamed), "left")

    def between(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__v{2 * i}"), F.col(f"__v{2 * i + 1}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return out.select(*by, "n", *[between(i, probs[n]).alias(n) for i, n in enumerate(names)], "mean")


# --- sketch -------------------------------------------------------------------------------------

def sketch_bucket(x, error: float) -> Column:
    """Bucket of a positive value: bounds grow by (1 + error) / (1 - error). Zero and less share a bucket below all others."""
    c = F.col(x) if isinstance(x, str) else x
    step = math.log((1 + error) / (1 - error))
    return F.when(c > 0, F.ceil(F.ln(c) / F.lit(step)).cast("long")).when(c <= 0, F.lit(-(1 << 40)).cast("long"))


def sketch_quantile(counts, p: float, error: float) -> Column:
    """Value at rank floor(p * (n - 1)) of ``counts`` (array of bucket, n), within the relative ``error``."""
    c = F.array_sort(F.col(counts) if isinstance(counts, str) else counts)
    gamma = (1 + error) / (1 - error)
    total = F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    rank = F.floor((total - 1) * F.lit(float(p))).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bucket"))
    hit = F.aggregate(c, start, lambda acc, x: F.struct(
        (acc["seen"] + x["n"]).alias("seen"), F.when(acc["bucket"].isNull() & (acc["seen"] + x["n"] > rank), x["bucket"]).otherwise(acc["bucket"]).alias("bucket")))["bucket"]
    return F.when(hit == -(1 << 40), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), hit.cast("double")) * F.lit(2 / (gamma + 1)))
