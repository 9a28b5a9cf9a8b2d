"""Removal of repeated lines and sentences.

A text is cut into units: lines, and within a line sentences. A unit's digest is that of its words, lower-cased,
without punctuation. Of all units with one digest the occurrence in the smallest document id, and there the
first, is kept; every other is cut out of its text. Offsets count code points of the original text.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Units of fewer words are left alone: single words and names repeat in any honest text.
MIN_WORDS = 4
#: A unit ends after a line break, or after white space that follows a letter or digit and one of . ? ! (and marks other than !).
_END = re.compile(r"[^\W_][.?!][^\w\s!]*\s+|\n+")
_WORDS = re.compile(r"[^\W_]+")


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every unit; they cover the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def _digests(text: str, least: int):
    """(number, start, end, digest) of the units of at least ``least`` words."""
    for i, (a, b) in enumerate(unit_spans(text)):
        words = _WORDS.findall(text[a:b].lower())
        if len(words) >= least:
            yield i, a, b, hashlib.md5(" ".join(words).encode()).digest()


def _units(least: int):
    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                docs, starts, ends, digests = [], [], [], []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for _, a, b, h in _digests(t, least):
                        docs.append(d)
                        starts.append(a)
                        ends.append(b)
                        digests.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["digest", "doc_id", "first", "last"])
    return run


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first, last, keeper): every unit to be cut, with the document that keeps it.

    Rows with a null id or text have no units. Rows that share an id rank alike; their equal units at equal
    places count as one occurrence.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    units = d.mapInArrow(_units(least), "digest binary, doc_id bigint, first bigint, last bigint")
    kept = (units.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"), F.min_by("first", F.struct("doc_id", "first")).alias("at"))
            .where("n > 1").drop("n"))
    return units.join(kept, "digest").where("doc_id <> keeper OR first <> at").select("doc_id", "first", "last", "keeper")


def _cut(text, spans):
    """The text without the spans, and what remains of it as spans."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def _rebuilt(name: str):
    def run(batches):
        for batch in batches:
            spans = batch.column("cut").to_pylist()
            texts = [_cut(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(batch.column(name).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == name else c for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)
    return run


SPANS = "array<struct<first:bigint,last:bigint,keeper:bigint>>"


def dedup_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with each text rid of its repeated units, and ``cut``: the original spans cut out.

    ``cut`` is an array of (first, last, keeper), empty where nothing was cut; a column of that name is replaced.
    Null texts and rows with a null id stay as they are. Ids are taken to be unique: rows that share one are cut
    by the same spans.
    """
    names = [c for c in docs.columns if c != "cut"]
    cut = (repeated_units(docs, doc_id, text, least).distinct().groupBy(F.col("doc_id").alias("_id"))
           .agg(F.array_sort(F.collect_list(F.struct("first", "last", "keeper"))).alias("cut")))
    both = docs.select(*names).join(cut, F.col(doc_id).cast("bigint") == F.col("_id"), "left").select(*names, F.coalesce("cut", F.expr(f"CAST(array() AS {SPANS})")).alias("cut"))
    return both.mapInArrow(_rebuilt(text), both.schema)
