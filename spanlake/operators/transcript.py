"""Transcript operators: record parsing, splitting, speech sessions, retrieval chunks."""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from ..functions.text import extract_tags, merge_labels, normalize_search_text, normalize_text, quality_of, strip, with_normalized
from ..functions.vector import let
from ..session import cut_lineage
from .skew import carry, fold_sorted, islands, number_rows
from .windows import adjacent_duplicates, longest_unpunctuated_span

# Sentence-ending and pausing punctuation, and the lengths (ms) at which each may split.
STRONG = ".!?。！？"
SOFT = ",;:，；、："
STRONG_MS, SOFT_MS, WORD_GAP_MS, LONG_MS = 1500, 8000, 1500, 12000


def _boundary(mark: str, span_ms: float) -> str | None:
    if mark and mark in STRONG and span_ms >= STRONG_MS:
        return "strong_punctuation"
    if mark and mark in SOFT and span_ms >= SOFT_MS:
        return "soft_punctuation_after_8s"
    return None


def _timed(c: str) -> bool:
    return c.isalnum() or c == "_" or "㐀" <= c <= "鿿"


# --- splitting long items ---------------------------------------------------------------------

def punctuation_spans(text: str, duration_ms: int) -> list[tuple[int, int]]:
    """Character spans of a long item, cut after punctuation, time being spread evenly over characters."""
    per_char, cuts = duration_ms / max(1, len(text)), [0]
    for i, c in enumerate(text, 1):
        if _boundary(c, per_char * (i - cuts[-1])):
            cuts.append(i)
    if len(cuts) == 1:
        return []
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


@F.pandas_udf(ArrayType(StructType().add("l", IntegerType()).add("r", IntegerType())))
def _spans(text: pd.Series, duration: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"l": a, "r": b} for a, b in punctuation_spans(t, d)] for t, d in zip(text, duration)])


def split_safe_punctuation(items: DataFrame, max_ms: int = LONG_MS) -> DataFrame:
    """Items longer than ``max_ms`` cut at punctuation; one without a usable mark stays whole and is flagged.

    Adds ``piece`` and ``split``: none, kept_whole or punctuation_linear_time.
    """
    dur = F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1), F.length("text"))
    d = items.withColumn("__s", _spans(F.when(dur > max_ms, F.col("text")), dur))
    d = d.withColumn("__p", F.explode_outer("__s")).withColumn("piece", F.coalesce("__p.l", F.lit(0)))
    start = F.col("start_ms") + F.bround(dur * F.col("__p.l") / n).cast("long")
    end = F.col("start_ms") + F.bround(dur * F.col("__p.r") / n).cast("long")
    cut = F.col("__p").isNotNull()
    d = d.withColumns({
        "split": F.when(cut, "punctuation_linear_time").when(dur > max_ms, "kept_whole").otherwise("none"),
        "__start": F.when(cut, start).otherwise(F.col("start_ms")), "__end": F.when(cut, F.greatest(start, end)).otherwise(F.col("end_ms")),
        "__text": F.when(cut, strip(F.substring("text", F.col("__p.l") + 1, F.col("__p.r") - F.col("__p.l")))).otherwise(F.col("text"))})
    keep = [c for c in items.columns if c not in ("start_ms", "end_ms", "text")]
    return d.where(~cut | (F.col("__text") != "")).select(*keep, "piece", "split", F.col("__start").alias("start_ms"), F.col("__end").alias("end_ms"), F.col("__text").alias("text"))


def char_pieces(text: str, pairs: list[tuple[int, int]]) -> list[dict]:
    """Pieces of a text whose letters carry time pairs, cut at punctuation; none when too few are timed."""
    timed = sum(map(_timed, text))
    if not pairs or (timed >= 8 and len(pairs) < int(timed * 0.4)):
        return []
    pieces, buffer, start, end, used = [], "", None, None, 0

    def close(reason):
        body = buffer.strip()
        if body and start is not None and end >= start:
            pieces.append({"start_ms": start, "end_ms": end, "text": body, "reason": reason})

    for c in text:
        if c.isspace():
            buffer += " " if buffer and buffer[-1] != " " else ""
            continue
        if _timed(c) and used < len(pairs):
            a, b = pairs[used]
            used += 1
            start, end, buffer = (a if start is None else start), max(a, b), buffer + c
        elif buffer:
            buffer += c
        reason = _boundary(c, end - start) if start is not None else None
        if reason:
            close(reason)
            buffer, start, end = "", None, None
    close("end")
    return pieces


def align(text: str, tokens) -> list[tuple[int, int]] | None:
    spans, at = [], 0
    for raw in tokens:
        token = (raw or "").strip()
        i = text.find(token, at) if token else -1
        if i < 0:
            return None
        at = i + len(token)
        spans.append((i, at))
    return spans


def word_pieces(text: str, words: list[str], pairs: list[tuple[int, int]]) -> list[dict]:
    """Pieces of a text whose words carry time pairs, cut at punctuation and at pauses between words."""
    spans = align(text, words) if words and len(words) == len(pairs) else None
    if not spans:
        return []
    # the text between a word's start and the next word's start, punctuation included
    edges = [a for a, _ in spans] + [len(text)]
    pieces, first = [], 0

    def close(last, reason):
        body = text[edges[first]:edges[last + 1]].strip()
        if body and pairs[last][1] >= pairs[first][0]:
            pieces.append({"start_ms": pairs[first][0], "end_ms": pairs[last][1], "text": body, "reason": reason})

    for i, (a, b) in enumerate(pairs):
        if i > first and a - pairs[i - 1][1] > WORD_GAP_MS:
            close(i - 1, "word_gap")
            first = i
        reason = _boundary(text[edges[i]:edges[i + 1]].rstrip()[-1:], b - pairs[first][0])
        if reason:
            close(i, reason)
            first = i + 1
    if first < len(words):
        close(len(words) - 1, "end")
    return pieces


PIECES = ArrayType(StructType().add("start_ms", LongType()).add("end_ms", LongType()).add("text", StringType()).add("reason", StringType()))


def _pairs(ts):
    return [] if ts is None else [(int(p[0]), int(p[1])) for p in ts if p is not None and len(p) >= 2 and p[0] is not None and p[1] is not None]


@F.pandas_udf(PIECES)
def char_split(text: pd.Series, stamps: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else char_pieces(t, _pairs(s)) for t, s in zip(text, stamps)])


@F.pandas_udf(PIECES)
def word_split(text: pd.Series, words: pd.Series, stamps: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or w is None else word_pieces(t, list(w), _pairs(s)) for t, w, s in zip(text, words, stamps)])


def _split_with(records: DataFrame, key: list[str], pieces) -> DataFrame:
    d = records.withColumn("__t", extract_tags("text"))
    return d.select(*key, F.col("__t.emotion").alias("emotion"), F.col("__t.audio_event").alias("audio_event"), F.posexplode(pieces).alias("item_id", "p")).select(
        *key, "item_id", "emotion", "audio_event", "p.*")


def split_char_timestamps(records: DataFrame, key: list[str]) -> DataFrame:
    """``records``: key, text (tags allowed), timestamp array<array<bigint>>, one pair per letter."""
    return _split_with(records, key, char_split(extract_tags("text")["text"], "timestamp"))


def split_word_timestamps(records: DataFrame, key: list[str]) -> DataFrame:
    """``records``: key, text, words array<string>, timestamp, one pair per word."""
    return _split_with(records, key, word_split(extract_tags("text")["text"], "words", "timestamp"))


# --- engine records ---------------------------------------------------------------------------

RECORD_SCHEMA = ("sentence_info array<struct<start:bigint,start_ms:bigint,end:bigint,end_ms:bigint,text:string,sentence:string>>,"
                 "text string, words array<string>, timestamp array<array<bigint>>, start bigint, start_ms bigint, end bigint, end_ms bigint")


def read_asr_records(records: DataFrame, key: list[str], split_text: bool = True) -> DataFrame:
    """Items of raw engine records (columns of ``RECORD_SCHEMA``).

    Sentences when the record has them; else pieces by word or letter times; else the whole text.
    ``source`` and ``mismatch`` tell which way each item took.
    """
    d = records.withColumn("__tags", extract_tags(strip(F.coalesce("text", F.lit(""))))).withColumn("__raw", strip(F.coalesce("text", F.lit(""))))
    stamps = F.filter(F.coalesce("timestamp", F.array().cast("array<array<bigint>>")), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    d = d.withColumn("__ts", stamps)
    aligned = F.coalesce((F.size("words") == F.size("__ts")) & (F.size("__ts") > 0), F.lit(False))
    letters = F.length(F.regexp_replace("__raw", r"[^\p{L}\p{N}_]", ""))
    mismatch = (F.size("__ts") > 0) & ~aligned & (letters >= 8) & (F.size("__ts") < F.floor(letters * 0.4))
    d = d.withColumns({"__aligned": aligned, "mismatch": mismatch, "__sent": F.coalesce(F.size("sentence_info") > 0, F.lit(False))})
    # letter times are tried only where word times gave nothing
    by_word = word_split(F.when(~F.col("__sent") & F.col("__aligned") & F.lit(split_text), F.col("__tags.text")), "words", "__ts")
    d = d.withColumn("__w", by_word)
    none = F.coalesce(F.size("__w"), F.lit(0)) <= 0
    usable = ~F.col("__sent") & ~F.col("mismatch") & (F.size("__ts") > 0) & none
    d = d.withColumn("__c", char_split(F.when(usable & F.lit(split_text), F.col("__tags.text")), "__ts"))
    has_word, has_char = ~none, F.coalesce(F.size("__c"), F.lit(0)) > 0

    def item(start, end, text, source):
        return F.struct(start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), text.alias("text"), F.lit(source).alias("source"))

    zero = F.lit(0).cast("bigint")

    def or_start(end, start):
        return F.coalesce(F.nullif(end, zero), start)

    sentences = F.transform("sentence_info", lambda s: let(F.coalesce(s["start"], s["start_ms"], zero), lambda a: item(
        a, or_start(F.coalesce(s["end"], s["end_ms"], a), a), F.coalesce(s["text"], s["sentence"], F.lit("")), "sentence")))
    whole_ts = F.array(item(F.get("__ts", F.lit(0))[0], F.element_at("__ts", -1)[1], F.col("__raw"), "timestamp"))
    first = F.coalesce("start", "start_ms", zero)
    fallback = F.array(item(first, or_start(F.coalesce("end", "end_ms", first), first), F.col("__raw"), "text"))
    rows = (F.when(F.col("__sent"), sentences)
            .when(has_word, F.transform("__w", lambda p: item(p["start_ms"], p["end_ms"], p["text"], "word_split")))
            .when(has_char, F.transform("__c", lambda p: item(p["start_ms"], p["end_ms"], p["text"], "char_split")))
            .when(usable, whole_ts).when(F.col("__raw") != "", fallback))
    out = d.select(*key, "mismatch", F.col("__tags").alias("rec"), F.posexplode(rows).alias("item_id", "i"))
    out = out.withColumn("t", extract_tags("i.text"))
    split = F.col("i.source").isin("word_split", "char_split")
    return out.select(*key, "item_id", F.col("i.start_ms").alias("start_ms"), F.col("i.end_ms").alias("end_ms"), F.col("t.text").alias("text"), F.col("i.source").alias("source"),
                      F.when(split, F.col("rec.emotion")).otherwise(F.col("t.emotion")).alias("emotion"),
                      F.when(split, F.col("rec.audio_event")).otherwise(F.col("t.audio_event")).alias("audio_event"), "mismatch"
                      ).where("text <> '' AND end_ms >= start_ms")


# --- word rows and speech sessions --------------------------------------------------------------

def split_words_by_gap(words: DataFrame, keys: list[str], max_s: float = 12.0, soft_s: float = 8.0, gap_s: float = 1.5, width: float = 600.0) -> DataFrame:
    """Word rows (keys, word_idx, start_time, end_time, word) to chunks: cut at pauses, punctuation, and at the hard limit.

    ``keys`` include the decode segment; words come in ``word_idx`` order.
    """
    def fold(rows):
        parts, start, end, first = [], None, None, None
        for r in rows:
            if not r["word"]:
                continue
            if end is not None and r["start_time"] - end > gap_s:
                yield {"first_word": first, "start_time": start, "end_time": max(start, end), "words": parts}
                parts, start = [], None
            if start is None:
                start, first = r["start_time"], r["word_idx"]
            end = max(r["start_time"], r["end_time"])
            parts.append(r["word"])
            span, mark = end - start, r["word"][-1]
            if (mark in STRONG and span >= 1.5) or (mark in SOFT and span >= soft_s) or span >= max_s:
                yield {"first_word": first, "start_time": start, "end_time": max(start, end), "words": parts}
                parts, start, end = [], None, None
        if parts:
            yield {"first_word": first, "start_time": start, "end_time": max(start, end), "words": parts}

    kinds = ", ".join(f"{k} {words.schema[k].dataType.simpleString()}" for k in keys)
    w = words.withColumn("word", strip("word")).select(*keys, "word_idx", "start_time", "end_time", "word")
    c = fold_sorted(w, keys, [F.col("word_idx")], fold, f"{kinds}, first_word bigint, start_time double, end_time double, words array<string>")
    text = F.regexp_replace(F.array_join("words", " "), r"(?U)\s+([.,!?;:，。！？；：、])", "$1")
    return c.select(*keys, "first_word", "start_time", "end_time", strip(text).alias("text"))


def gap_sessions_capped(df: DataFrame, keys: list[str], gap: float, cap: float, tie: str, width: float = 3600.0, start: str = "start", end: str = "end") -> DataFrame:
    """Speech intervals merged while the pause is at most ``gap`` and the whole at most ``cap``."""
    d = islands(df.select(*keys, tie, F.col(start).alias("start"), F.col(end).alias("end")), keys, "start", "end", gap, [tie], width)

    def fold(rows):
        s = e = None
        n = 0
        for r in rows:
            if s is not None and max(0.0, r["start"] - e) <= gap and r["end"] - s <= cap:
                e, n = r["end"], n + 1
                continue
            if s is not None:
                yield {"start": s, "end": e, "intervals": n}
            s, e, n = r["start"], r["end"], 1
        yield {"start": s, "end": e, "intervals": n}

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return fold_sorted(d, [*keys, "island"], [F.col("start"), F.col("end"), F.col(tie)], fold, f"{kinds}, start double, end double, intervals long")


def session_stats(sessions: DataFrame, intervals: DataFrame, keys: list[str], cap: float) -> DataFrame:
    s = sessions.groupBy(*keys).agg(F.count("*").alias("groups"), F.sum(F.col("end") - F.col("start")).alias("group_seconds"),
                                    F.count_if(F.col("end") - F.col("start") > cap).alias("over_cap"))
    i = intervals.groupBy(*keys).agg(F.count("*").alias("speech_intervals"), F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("speech_seconds"))
    return s.join(i, keys)


# --- retrieval chunks ---------------------------------------------------------------------------

def _chunk_fold(normal_gap, short_gap, bucket_gap, target_ms, max_ms, max_chars, short_chars, bucket_ms):
    def fits(c, r):
        if c["unit"] is not None and r["unit_id"] is not None and c["unit"] != r["unit_id"]:
            return False
        span, gap = max(c["end"], r["end_ms"]) - c["start"], max(0, r["start_ms"] - c["end"])
        if c["chars"] + r["chars"] > max_chars or span > max_ms or c["closed"]:
            return False
        if c["chars"] <= short_chars or r["chars"] <= short_chars:
            return gap <= short_gap
        same_bucket = c["start"] // bucket_ms == r["start_ms"] // bucket_ms
        return gap <= normal_gap or (same_bucket and span <= target_ms and gap <= bucket_gap)

    def fold(rows):
        c = None
        for r in rows:
            if c is None or not fits(c, r):
                c = {"head": r["item_id"], "start": r["start_ms"], "end": r["end_ms"], "chars": 0, "unit": r["unit_id"]}
            c["end"], c["chars"], c["closed"] = max(c["end"], r["end_ms"]), c["chars"] + r["chars"], r["closed"]
            yield {"item_id": r["item_id"], "head": c["head"]}

    return fold


def build_chunks(items: DataFrame, keys: list[str] | None = None, normal_gap: int = 500, short_gap: int = 1000, max_ms: int = 12000,
                 max_chars: int = 180, bucket_ms: int = 5000, target_ms: int = 8000, short_chars: int = 8, width: float = 600_000.0) -> DataFrame:
    """Transcript items folded into retrieval chunks.

    A pause above ``short_gap`` and a sentence end always separate chunks, so items are cut there
    first; the fold only assigns each item the head of its chunk, from lengths and times. Texts,
    labels, flags and eligibility are put together by an aggregation afterwards.
    """
    keys = keys or ["video_id"]
    cols = dict(unit_id="bigint", emotion="string", audio_event="string")
    for c, t in cols.items():
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast(t))
    d = with_normalized(items).where("__n <> ''").withColumns({"text": F.col("__n"), "end_ms": F.greatest("start_ms", "end_ms")})
    order = [F.col("start_ms"), F.col("end_ms"), F.col("item_id")]
    # lengths and times only: this narrow table is read several times below, the texts are not
    e = cut_lineage(d.select(*keys, "item_id", "start_ms", "end_ms", F.length("__c").cast("long").alias("chars"), F.col("text").rlike("[.!?。！？]$").alias("closed"), "unit_id"))
    e = carry(e, keys, order, width,
              max_before={"__pe": F.col("end_ms")}, lag={"__pc": F.col("closed")})
    opens = F.col("__pe").isNull() | F.col("__pc") | (F.col("start_ms") - F.col("__pe") > max(normal_gap, short_gap))
    e = carry(e, keys, order, width, sum_upto={"island": opens.cast("long")})
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)
    fold = _chunk_fold(normal_gap, short_gap, short_gap, target_ms, max_ms, max_chars, short_chars, bucket_ms)
    heads = fold_sorted(e, [*keys, "island"], order, fold, f"{kinds}, item_id long, head long")
    d = d.join(heads, [*keys, "item_id"])
    g = d.groupBy(*keys, "head").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "item_id", "text", "emotion", "audio_event", "unit_id"))).alias("__i"))
    cjk = "[㐀-鿿]"

    def glue(a, b):
        tight = (a.rlike(f"{cjk}$") & b.rlike(f"^{cjk}")) | a.rlike("[,;，；、:：]$")
        return F.when(a == "", b).when(tight, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))

    g = g.select(*keys, "start_ms", "end_ms", F.aggregate(F.transform("__i", lambda x: x["text"]), F.lit(""), glue).alias("text"),
                 F.transform("__i", lambda x: x["item_id"]).alias("source_item_ids"),
                 merge_labels(F.array_join(F.transform("__i", lambda x: F.coalesce(x["emotion"], F.lit(""))), "|")).alias("emotion"),
                 merge_labels(F.array_join(F.transform("__i", lambda x: F.coalesce(x["audio_event"], F.lit(""))), "|")).alias("audio_event"),
                 F.col("__i")[0]["unit_id"].alias("unit_id"))
    g = number_rows(g, keys, [F.col("start_ms"), F.col("end_ms"), F.col("source_item_ids")[0]], width, "chunk_id")
    dur = F.col("end_ms") - F.col("start_ms")
    g = with_normalized(g).withColumn("__q", quality_of("__n", "__c", dur))
    flags = F.array_compact(F.array(
        F.when(~F.col("text").rlike(r"[.!?。！？]\s*$"), "non_terminal_boundary"), F.when(dur > 12000, "long_chunk"),
        F.when(~F.col("__q.eligible"), F.concat(F.lit("embedding_ineligible:"), F.col("__q.reason")))))
    return g.select(*keys, "chunk_id", "start_ms", "end_ms", "text", "source_item_ids", "emotion", "audio_event", "unit_id",
                    F.col("__q.eligible").alias("semantic_eligible"), F.col("__q.reason").alias("semantic_reason"), flags.alias("quality_flags"))


def chunk_stats(items: DataFrame, chunks: DataFrame, keys: list[str] | None = None, width: float = 600_000.0) -> DataFrame:
    """Counters of one chunk build."""
    keys = keys or ["video_id"]
    i = items.withColumn("__n", normalize_text("text")).groupBy(*keys).agg(
        F.count("*").alias("raw_items"), F.count_if(F.col("__n") != "").alias("normalized_items"), F.count_if(F.col("__n") == "").alias("dropped_empty_items"))
    c = carry(chunks, keys, [F.col("start_ms"), F.col("chunk_id")], width, lag={"__pu": F.col("unit_id")})
    has = lambda flag: F.count_if(F.exists("quality_flags", lambda x: x.startswith(flag)))
    g = c.groupBy(*keys).agg(
        F.count("*").alias("retrieval_chunks"), F.count_if(F.col("__pu") != F.col("unit_id")).alias("cross_unit_merge_blocks"),
        has("long_chunk").alias("long_chunks"), has("non_terminal").alias("low_boundary_chunks"), has("embedding_ineligible").alias("semantic_ineligible_chunks"))
    j = i.join(g, keys, "left").fillna(0)
    return j.withColumn("merged_items", F.col("normalized_items") - F.col("retrieval_chunks"))


# --- choosing between two decodes ----------------------------------------------------------------

@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def fallback_acceptance(primary: DataFrame, fallback: DataFrame, windows: DataFrame, by: list[str], tie: str = "row_id") -> DataFrame:
    """Should a window's second transcript replace its first? With the reason.

    ``primary`` / ``fallback``: by, row_id, start_time, end_time, text; ``windows``: by, w_start, w_end.
    A window is one decode unit of at most some seconds, so its text is short.
    """
    def side(df, name):
        text = F.array_sort(F.collect_list(F.struct("start_time", tie, "text")))
        g = df.groupBy(*by).agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit("")))).alias(f"{name}_chars"),
                                F.array_join(F.transform(text, lambda r: r["text"]), " ").alias(f"{name}_text"))
        s = longest_unpunctuated_span(df, by, tie).withColumnRenamed("span", f"{name}_span")
        a = adjacent_duplicates(df, by, tie).withColumnRenamed("duplicates", f"{name}_dup")
        return g.join(s, by).join(a, by)

    bounds = fallback.join(windows, by).groupBy(*by).agg(F.bool_or(
        (F.col("start_time") < F.col("w_start") - 0.1) | (F.col("end_time") > F.col("w_end") + 0.1) | (F.col("end_time") < F.col("start_time"))).alias("outside"))
    d = windows.join(side(primary, "p"), by, "left").join(side(fallback, "f"), by, "left").join(bounds, by, "left")
    d = d.withColumns({"__pt": normalize_search_text(F.coalesce("p_text", F.lit(""))), "__ft": normalize_search_text(F.coalesce("f_text", F.lit("")))})
    d = d.withColumn("__sim", similarity("__pt", "__ft"))
    zero = F.lit(0)
    pc, fc = F.coalesce("p_chars", zero), F.coalesce("f_chars", zero)
    reason = (F.when(F.col("f_chars").isNull(), "empty_fallback").when(F.col("outside"), "timestamp_out_of_window")
              .when((pc > 0) & (fc < F.floor(pc * 0.5)), "text_coverage_drop")
              .when((F.col("__pt") != "") & (F.col("__ft") != "") & (F.col("__sim") < 0.35), "text_content_mismatch")
              .when(F.col("f_span") >= F.coalesce("p_span", F.lit(0.0)) - 0.25, "no_boundary_improvement")
              .when(F.col("f_dup") > F.coalesce("p_dup", zero) + 1, "repetition_regression").otherwise("improved_unpunctuated_span"))
    return d.select(*by, reason.alias("reason")).withColumn("accepted", F.col("reason") == "improved_unpunctuated_span")
