"""Text columns: normalisation, quality, tokens, labels. JVM expressions, with an
Arrow UDF only for the rows whose characters Spark's built-ins cannot normalise."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .vector import let

# Traditional -> simplified characters that must fold alike.
TRADITIONAL = "臺灣這裏裡詞對書講語國門們會學畫時間後發與為說個體電腦車風頭乾淨"
SIMPLIFIED = "台湾这里里词对书讲语国门们会学画时间后发与为说个体电脑车风头干净"

# Hesitation sounds, and words that carry no searchable meaning.
FILLER = "嗯+|啊+|呃+|额+|哦+|噢+|唉+|诶+|em+|uh+|um+"
LOW_INFO = (
    "对", "是", "好", "好的", "行", "嗯嗯", "ok", "okay", "yes", "no", "and", "but", "because", "if", "then",
    "well", "still", "imean", "但是", "所以", "因为", "如果", "然后", "而且", "不过",
)

# Recording tags and the label each one stands for (itself).
EMOTION_TAGS = ("neutral", "happy", "sad", "angry", "fearful", "disgusted", "surprised")
EVENT_TAGS = ("speech", "bgm", "music", "laughter", "applause", "cry", "sneeze", "breath", "cough", "sing", "noise", "silence")

# Characters that NFKC or case folding may change; a row without any never reaches Python.
# (Classes of one or two ranges: Java scans those an order of magnitude faster than longer unions.)
_UNSTABLE = r"[\u0080-¿Ā-\x{10FFFF}]"
CJK = r"[㐀-鿿]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def nfkc(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.coalesce(_nfkc(F.when(t.rlike(_UNSTABLE), t)), t)


def casefold(text) -> Column:
    t = _c(text)
    return F.coalesce(_casefold(F.when(t.rlike(_UNSTABLE), t)), F.replace(F.lower(t), F.lit("ß"), F.lit("ss")))


def strip(text) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def normalize_text(text) -> Column:
    """NFKC, traditional folded to simplified, repeated leading fillers removed, spaces collapsed."""
    t = strip(nfkc(text))
    t = F.when(t.rlike("[一-鿿]"), F.translate(t, TRADITIONAL, SIMPLIFIED)).otherwise(t)
    # fillers go only when something else follows them; the atomic group keeps the match from giving any back
    t = F.regexp_replace(t, rf"(?iU)^(?>(?:(?:{FILLER})[，,、。.!?\s]*){{2,}})(?=[\s\S]*\S)", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def search_form(normalized) -> Column:
    """Casefolded letters and digits only, of text already normalised."""
    return F.regexp_replace(casefold(normalized), r"[^\p{L}\p{N}]+", "")


def normalize_search_text(text) -> Column:
    return search_form(normalize_text(text))


def clean_ocr_text(text) -> Column:
    return strip(F.regexp_replace(nfkc(text), r"(?U)\s+", " "))


def quality_of(normalized, compact, duration_ms=None) -> Column:
    """struct(eligible, reason) from the normalised text and its search form."""
    n, c = _c(normalized), _c(compact)
    rest = c
    for word in sorted(LOW_INFO, key=lambda w: -len(w)):
        rest = F.replace(rest, F.lit(word), F.lit(""))
    rest = F.regexp_replace(rest, f"(?i)(?:{FILLER})", "")
    cjk = F.length(F.regexp_replace(c, r"[^一-鿿]+", ""))
    latin = F.length(F.regexp_replace(c, r"\P{Alnum}+", ""))
    words = F.regexp_count(n, F.lit(r"(?i)[a-z0-9]+(?:['’][a-z0-9]+)*"))
    reason = (F.when(c == "", "empty")
              .when(c.isin(*LOW_INFO) | c.rlike(f"(?i)^(?:{FILLER})$") | (rest == ""), "filler")
              .when(cjk + latin < 2, "too_short"))
    if duration_ms is not None:
        d = _c(duration_ms)
        reason = reason.when((d >= 0) & (d < 500) & ((cjk >= 8) | (words >= 6) | (cjk + words >= 8)), "impossible_text_rate")
    return let(reason.otherwise("ok"), lambda r: F.struct((r == "ok").alias("eligible"), r.alias("reason")))


def with_normalized(df, text: str = "text", normalized: str = "__n", compact: str = "__c"):
    """Adds the normalised text and its search form as columns, each computed once per row."""
    return df.withColumn(normalized, normalize_text(text)).withColumn(compact, search_form(normalized))


def semantic_eligible(df, text: str = "text", duration_ms=None, out: str = "quality"):
    """Adds struct(eligible, reason)."""
    d = with_normalized(df, text)
    return d.withColumn(out, quality_of("__n", "__c", duration_ms)).drop("__n", "__c")


def truncate_text_utf8(text, chars: int = 2000, max_bytes: int = 5000) -> Column:
    """At most ``chars`` characters, then at most ``max_bytes`` UTF-8 bytes on a character boundary."""
    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.encode()[:max_bytes].decode(errors="ignore"))

    head = F.substring(_c(text), 1, chars)
    return F.coalesce(cut(F.when(F.octet_length(head) > max_bytes, head)), head)


def join_text_cjk(left, right) -> Column:
    """Join two fragments: no space between CJK characters or after soft punctuation, else one."""
    a, b = F.regexp_replace(_c(left), r"(?U)\s+$", ""), F.regexp_replace(_c(right), r"(?U)^\s+", "")
    tight = (a.rlike(f"{CJK}$") & b.rlike(f"^{CJK}")) | a.rlike("[,;，；、:：]$")
    return F.when(a == "", b).when(b == "", a).when(tight, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def merge_labels(*labels) -> Column:
    """Distinct lower-case labels of several 'a|b' lists, in order."""
    parts = F.split(F.concat_ws("|", *[_c(x) for x in labels]), r"\|")
    clean = F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_join(F.array_distinct(clean), "|")


def extract_tags(text) -> Column:
    """struct(text, emotion, audio_event) from '<|tag|>' marks."""
    t = _c(text)
    keys = F.transform(F.regexp_extract_all(t, F.lit(r"<\|([^|<>]+)\|>"), F.lit(1)),
                       lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""))

    def pick(known):
        return F.array_join(F.array_distinct(F.filter(keys, lambda k: k.isin(*known))), "|")

    bare = strip(F.regexp_replace(t, r"<\|([^|<>]+)\|>", ""))
    return F.struct(bare.alias("text"), pick(EMOTION_TAGS).alias("emotion"), pick(EVENT_TAGS).alias("audio_event"))


def tokenize(text) -> Column:
    """Search tokens: letter-digit runs, and overlapping character pairs inside CJK runs."""
    t = F.lower(_c(text))
    words = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def pieces(run):
        n = F.length(run)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^{CJK}") & (n > 1), pairs).otherwise(F.array(run))

    def split_word(w):
        return F.flatten(F.transform(F.regexp_extract_all(w, F.lit(f"({CJK}+|[^\\u3400-\\u9fff]+)"), F.lit(1)), pieces))

    return F.when(t.rlike(CJK), F.flatten(F.transform(words, split_word))).otherwise(words)


def joined_tokens(text) -> Column:
    """The tokens of :func:`tokenize` with one space between them, null if there is none. One string is a third of an array's way to Python."""
    t = F.lower(_c(text))
    joined = F.when(t.rlike(CJK), F.array_join(tokenize(text), " ")).otherwise(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")))
    return F.nullif(joined, F.lit(""))


def contains_any(text, terms) -> Column:
    """Casefolded: does the text contain any of the terms?"""
    folded = casefold(text)
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(folded, F.lit(term.casefold()))
    return out


# Language codes that go to the Chinese speech engine.
CHINESE_CODES = ("zh", "zh-cn", "zh-tw", "cmn", "yue", "chinese")


def route_by_language(engine, requested, detected, probability) -> Column:
    """struct(engine, decode_language, route, reason): which speech engine decodes a recording."""
    eng = F.lower(F.replace(_c(engine), F.lit("_"), F.lit("-")))
    req, det = F.coalesce(_c(requested), F.lit("")), F.coalesce(_c(detected), F.lit(""))
    auto = eng == "auto"
    auto_lang = (req == "") | (F.lower(req) == "auto")

    def chinese(c):
        return F.lower(F.trim(c)).isin(*CHINESE_CODES)

    probed = F.when(chinese(det), "funasr").otherwise("faster-whisper")
    chosen = (F.when(~auto, eng).when(auto_lang, probed).when(chinese(req), "funasr").otherwise("faster-whisper"))
    route = (F.when(~auto, "")
             .when(auto_lang, F.concat(F.lit("auto:probe="), F.when(det == "", "unknown").otherwise(det), F.lit("->"), probed))
             .when(chinese(req), "auto:explicit-zh->funasr")
             .otherwise(F.concat(F.lit("auto:explicit-"), req, F.lit("->faster-whisper"))))
    reason = (F.when(~auto, "")
              .when(auto_lang, F.concat(F.lit("auto language probe probability="), F.format_string("%.3f", F.coalesce(_c(probability), F.lit(0.0)))))
              .when(chinese(req), "explicit Chinese ASR language").otherwise("explicit non-Chinese ASR language"))
    lang = F.when(auto & auto_lang & (det != ""), det).otherwise(req)
    return F.struct(chosen.alias("engine"), lang.alias("decode_language"), route.alias("route"), reason.alias("reason"))


def align_tokens(text, tokens) -> Column:
    """array<struct<s,e>> of each token's place in the text, left to right; null when one is missing."""
    t = _c(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc, raw):
        tok = F.trim(raw)
        pos = F.call_function("locate", tok, t, acc["at"] + 1)
        ok = acc["ok"] & (tok != "") & (pos > 0)
        end = pos - 1 + F.length(tok)
        return F.struct(
            F.when(ok, end).otherwise(acc["at"]).alias("at"), ok.alias("ok"),
            F.when(ok, F.concat(acc["spans"], F.array(F.struct((pos - 1).alias("s"), end.alias("e"))))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(_c(tokens), zero, step, lambda a: F.when(a["ok"], a["spans"]))


def snippet(prefix: str, text, score, name: str) -> Column:
    """Short display line: the first 100 characters and the score."""
    return F.concat(F.lit(f"[{prefix}] "), F.substring(_c(text), 1, 100), F.lit(f" · {name}="), F.format_string("%.3f", _c(score)))


def evidence_text(details, limit: int = 2000) -> Column:
    """Distinct non-empty details in order, one per line, at most ``limit`` characters."""
    kept = F.array_distinct(F.filter(_c(details), lambda x: x.isNotNull() & (x != "")))
    return F.substring(F.array_join(kept, "\n"), 1, limit)


def char_profile(normalized) -> dict[str, Column]:
    n = _c(normalized)
    return {
        "cjk_chars": F.length(F.regexp_replace(n, r"[^一-鿿]+", "")),
        "latin_chars": F.length(F.regexp_replace(n, r"\P{Alpha}+", "")),
        "digit_chars": F.length(F.regexp_replace(n, "[^0-9]+", "")),
    }
