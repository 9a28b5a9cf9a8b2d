"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text. A new text
is parsed greedily into the longest phrases the automaton accepts; a language that matches needs few phrases.
Symbols are the UTF-8 bytes of lower-cased letters, so that no alphabet is too large. With n learned symbols a phrase costs log2(n) bits (a pointer into the text), so a language's rate is
phrases * log2(n) / symbols, and the lowest rate wins (ties: the first name).
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common as C

#: Bounds of the labelled sample: texts for each language, and symbols taken from each.
SAMPLE_TEXTS, SAMPLE_CHARS = 32, 512
#: Symbols after which a phrase ends in any case, so that the pieces of a text can be parsed side by side.
PIECE = 256
#: Bytes of text that are parsed at once; working arrays take some hundred times as much.
SLICE = 500_000
#: Sharpness of the score.
SHARP = 6.0
SPACE, STRANGE, FIRST = 0, 1, 2


def labelled_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[tuple[str, list[str]]]:
    """At most ``texts`` excerpts of ``chars`` characters for each language, from all rows of (text, lang).

    Texts are dealt by hash into ``texts`` classes for each language; the smallest hash of a class stays, a
    partial minimum that no frequent language slows. The excerpt begins at a hashed place.
    """
    h = F.xxhash64("text")
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    best = (docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
            .select("lang", F.pmod(h, F.lit(texts)).alias("slot"), F.struct(h.alias("h"), F.substring("text", at, F.lit(chars)).alias("t")).alias("s"))
            .groupBy("lang", "slot").agg(F.min("s").alias("s")))
    found: dict[str, list] = {}
    for r in best.select("lang", "s.h", "s.t").collect():
        found.setdefault(r[0], []).append((r[1], r[2]))
    return [(lang, [t for _, t in sorted(found[lang])]) for lang in sorted(found)]


class Automaton:
    """Suffix automaton over lists of symbols; texts are joined by a symbol of their own."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] != length[p] + 1:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = twin
                    q = twin
                link[cur] = q
            last = cur


class Parser:
    """Cross-parsing of many texts at once against the automata of all languages."""

    def __init__(self, sample: list[tuple[str, list[str]]]):
        self.langs = [lang for lang, _ in sample]
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        self.codes = np.full(256, STRANGE, np.uint8)
        self.codes[ord(" ")] = SPACE
        known = sorted({b for _, texts in sample for t in texts for ch in set(t.lower()) if ch.isalpha() for b in ch.encode()})
        self.codes[known] = FIRST + np.arange(len(known))
        self.width = FIRST + len(known) + 1
        self.pad = self.width - 1
        self.tables, self.bits = [], []
        for _, texts in sample:
            joined: list[int] = []
            for t in texts:
                joined += [*self._symbols([t])[0].tolist(), self.pad]
            self.tables.append(self._table(Automaton(joined).next))
            self.bits.append(math.log2(max(2, len(joined))))

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols with runs of non-letters as one space, offsets of each text's, and whether it has letters."""
        low = [t.lower() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
        points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        solid = self.letter[points]
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        keep[off[:-1][np.diff(off) > 0]] = True
        places = np.concatenate([[0], np.cumsum(solid)])
        lettered = places[off[1:]] > places[off[:-1]]
        points = np.where(solid, points, ord(" "))[keep]
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        end = np.concatenate([[0], np.cumsum(size)])
        return self.codes[np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)], end[np.concatenate([[0], np.cumsum(keep)])[off]], lettered

    def _table(self, moves: list[dict[int, int]]) -> np.ndarray:
        """Row starts of the next state times two, plus one where a phrase begins; the last state is outside any phrase."""
        out, w = len(moves), self.width
        t = np.empty((out + 1, w), np.int32)
        restart = np.full(w, out * w * 2 + 1, np.int32)
        for c, to in moves[0].items():
            restart[c] = to * w * 2 + 1
        t[:] = restart
        for s, row in enumerate(moves):
            for c, to in row.items():
                t[s, c] = to * w * 2
        t[:, STRANGE] = out * w * 2 + 1
        t[:, self.pad] = np.arange(out + 1) * w * 2
        return t.ravel()

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol for each text and language, and whether the text has letters."""
        sym, off, lettered = self._symbols(texts)
        n = np.diff(off)
        pieces = -(-n // PIECE)
        first = np.concatenate([[0], np.cumsum(pieces)])
        place = np.arange(len(sym)) - np.repeat(off[:-1], n)
        board = np.full((PIECE, first[-1]), self.pad, np.uint8)
        board[place % PIECE, np.repeat(first[:-1], n) + place // PIECE] = sym
        rates = np.full((len(texts), len(self.langs)), np.inf)
        for j, t in enumerate(self.tables):
            state = np.full(first[-1], len(t) - self.width, np.int32)
            phrases = np.zeros(first[-1], np.int32)
            for row in board:
                state += row
                state = t[state]
                phrases += state & 1
                state >>= 1
            total = np.concatenate([[0], np.cumsum(phrases)])
            rates[:, j] = (total[first[1:]] - total[first[:-1]]) * self.bits[j] / np.maximum(n, 1)
        return rates, lettered


_PARSERS: dict[int, Parser] = {}


def _parser(sample) -> Parser:
    key = hash(str(sample))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(sample)
    return _PARSERS[key]


def _scored(sample, name: str):
    def run(batches):
        parser = _parser(sample)
        for batch in batches:
            for part in C.slices(batch, name, SLICE):
                texts = [t or "" for t in part.column(name).to_pylist()]
                langs, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if parser.langs:
                    rates, lettered = parser.rates(texts)
                    best = rates.argmin(1)
                    low = rates.min(1)
                    p = np.exp2(-SHARP * (rates - low[:, None]))
                    score = np.where(lettered, 1 / p.sum(1), 0.0)
                    rate = np.where(lettered, low, 0.0)
                    langs = [parser.langs[b] if x else "und" for b, x in zip(best, lettered)]
                rest = [part.column(i) for i, c in enumerate(part.schema.names)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], [*part.schema.names, "lang_pred", "score", "rate"])
    return run


def identify(docs: DataFrame, sample: list[tuple[str, list[str]]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score and rate (bits per symbol; low is sure).

    A null, empty or letterless text gives `und`, score 0 and rate 0, as does every text when nothing was
    learned. Columns of ``docs`` outside ``keep`` are dropped; one named like a result column is replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "rate")]
    src = docs.select(*names, *([] if text in names else [text]))
    schema = StructType([*src.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rate", DoubleType())])
    return src.mapInArrow(_scored(sample, text), schema).select(*names, "lang_pred", "score", "rate")


def keep_known(docs: DataFrame, sample: list[tuple[str, list[str]]], most: float = 12.0) -> DataFrame:
    """The documents in a learned language: less those without letters and those that even the best language
    parses at more than ``most`` bits per symbol (phrases of little over one letter: no text of any of them).
    """
    cols = docs.columns
    found = identify(docs.select(*cols), sample)
    return found.where(F.col("lang_pred") != "und").where(F.col("rate") <= most).select(*cols)
