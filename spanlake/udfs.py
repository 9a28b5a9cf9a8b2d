"""Extension points: encoders, detectors, rerankers, the splitting table function."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from .operators.transcript import LONG_MS, punctuation_spans


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a text model: signed feature hashing of words, unit length.

    Where the words cancel out, or a text is white space, the whole text counts as one word; only an empty text has no direction.
    """
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
            if text and not out[i].any():
                h = zlib.crc32(text.encode())
                out[i, h % dim] = 1.0 if h & 0x10000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Column function text -> array<float>. ``load`` builds the model once per task, not per batch."""
    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(list(model(s.tolist())), index=s.index)

    return encode


def semantic_arrays(chunks: DataFrame, key: list[str], encode, enabled: bool = True, by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Vectors for eligible, non-blank chunks only; the others keep null and has_embedding = false.

    Each video (``by``) has its own status: disabled, empty (nothing eligible), unavailable (no encoder) or complete.
    """
    if not enabled:
        return chunks.withColumns({"embedding": F.lit(None).cast("array<float>"), "has_embedding": F.lit(False), "semantic_status": F.lit("disabled")})
    ok = F.col("semantic_eligible") & (F.trim("text") != "")
    vec = chunks.where(ok).select(*key, (F.lit(None).cast("array<float>") if encode is None else encode("text")).alias("embedding"))
    d = chunks.join(vec, key, "left").withColumn("has_embedding", F.col("embedding").isNotNull())
    per = chunks.groupBy(*by).agg(F.count_if(ok).alias("__ok"))
    out = d.join(per, list(by)).withColumn("semantic_status", F.when(F.col("__ok") > 0, F.lit("unavailable") if encode is None else F.lit("complete")).otherwise("empty"))
    return out.drop("__ok")


DETECTIONS = "array<struct<text:string,score:double,left:double,top:double,right:double,bottom:double>>"


#: Bytes of content whose boxes are held at once.
DETECT_BYTES = 1_000_000


def detect(files: DataFrame, key: list[str], load: Callable[[], Callable[[bytes], list[dict]]], content: str = "content") -> DataFrame:
    """Run a detector over binary rows: one array of boxes per row."""
    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)

    def run(batches):
        model = load()
        for pdf in batches:
            part = np.cumsum([len(b) if b is not None else 0 for b in pdf[content]]) // DETECT_BYTES
            for _, d in pdf.groupby(part, sort=False):
                yield pd.DataFrame({**{k: d[k] for k in key}, "boxes": [model(b) for b in d[content]]})

    return files.select(*key, content).mapInPandas(run, f"{kinds}, boxes {DETECTIONS}")


def reranker_udf(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """Column function (query, evidence) -> probability; null stands for a failed call."""
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, e in batches:
            yield pd.Series(model(q.tolist(), e.tolist()), index=q.index, dtype="float64")

    return score


@F.pandas_udf(ArrayType(DoubleType()))
def vec_mean(v: pd.Series) -> list:
    """Mean vector as a user aggregate, for groups already small; large groups use ``vector_mean``."""
    return np.mean(np.stack(v.to_numpy()), axis=0, dtype=np.float64).tolist()


@udtf(returnType=StructType().add("idx", IntegerType()).add("start_ms", LongType()).add("end_ms", LongType()).add("text", StringType()))
class SplitItem:
    """One long transcript item to its punctuation pieces (a short one passes unchanged)."""

    def eval(self, text: str, start_ms: int, end_ms: int, max_ms: int = LONG_MS):
        duration = end_ms - start_ms
        spans = punctuation_spans(text, duration) if duration > max_ms else []
        if not spans:
            yield 0, start_ms, end_ms, text
            return
        n = max(1, len(text))
        for i, (a, b) in enumerate(spans):
            if text[a:b].strip():
                s, e = start_ms + round(duration * a / n), start_ms + round(duration * b / n)
                yield i, s, max(s, e), text[a:b].strip()


def register_split_udtf(spark: SparkSession) -> None:
    spark.udtf.register("split_item", SplitItem)
