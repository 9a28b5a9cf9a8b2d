"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score by their surroundings (nearest block element, whether in a
link, whether inside the page's article element), tags cost; weights are log-odds of lying inside the article of
pages that mark one up (article or main elements: the labelled pages). One scan finds the contiguous region with
the highest sum. Of its words those are dropped that stand in elements which are never article text (menus,
forms, adverts, notices, comments and so on). Names (class, id) never mark html, body or main, nor an element that
is or holds the page's first article; parts of names (has-sidebar) mark no article either and, on pages without
one, no element that holds the larger part of the words.
"""
from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common as C

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
# Elements of HTML by their kind, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form button fieldset dialog menu head".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disqus footer gdpr login
 masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip
 social sponsor sponsored subscribe teaser toolbar widget widgets""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSED_BY_BLOCK = frozenset(("p",))
#: Bounds of a learned weight; the cost of a tag never learned about; the score of a word in surroundings never seen.
MOST, TAG_COST, TAG_LEAST, PLAIN, LINKED = 4.0, -0.3, -0.05, 1.0, -1.5


#: How surely an element is furniture: by a part of a class or id, by a whole one, by its kind or role.
PART, WHOLE, KIND = 1, 2, 3


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    if name in FURNITURE or name == "header" and not in_article:
        return KIND
    sure = 0
    for key, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        key = key.lower()
        if key in ("class", "id"):
            parts = set(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
            names = NAMES | {"header"} if not in_article and not parts & {"article", "entry", "post"} else NAMES
            if parts & names:
                sure = max(sure, WHOLE if names.intersection(value.split()) else PART)
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return KIND
    if name in ("html", "body", "main") or name == "article" and sure == PART:
        return 0
    return sure


def _marked(elements: list[list], hard: list[bool], first: int) -> list[bool]:
    """Whether each element (parent, sureness, words), parents first, is furniture or inside it; ``hard`` those by kind, ``first`` the first article or -1."""
    words = [0 if h else n for h, (_, _, n) in zip(hard, elements)]
    whole = sum(words)
    for e in range(len(elements) - 1, -1, -1):
        if elements[e][0] >= 0:
            words[elements[e][0]] += words[e]
    around = set()
    while first >= 0:
        around.add(first)
        first = elements[first][0]
    bad, within = [], []
    article = max(around, default=-1)
    for e, (parent, sure, _) in enumerate(elements):
        within.append(parent >= 0 and (parent == article or within[parent]))
        part = 2 * words[e] <= (words[parent] if within[e] else whole) or bool(around) and not within[e]
        named = sure in (PART, WHOLE) and e not in around and (sure == WHOLE or part)
        bad.append(sure == KIND or named or parent >= 0 and bad[parent])
    return bad


def tokens(page: str) -> list[tuple]:
    """(tag name, surroundings, inside furniture, breaks) for a tag, (None, surroundings, furniture, text) for text between tags."""
    out: list[tuple] = []
    stack: list[tuple[str, int]] = []  # open elements, and their places among all
    elements: list[list] = []  # parent, sureness of being furniture, words
    hard: list[bool] = []  # whether an element is furniture by its kind, or inside such
    first = -1
    open_articles = links = 0

    def pop():
        nonlocal open_articles, links
        name, _ = stack.pop()
        open_articles -= name in ("article", "main")
        links -= name == "a"

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name:
            name = name.lower()
            out.append((name, "+in" if open_articles else "", stack[-1][1] if stack else -1, name not in INLINE))
            if m[2]:
                if any(n == name for n, _ in stack):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name not in INLINE:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] not in INLINE:
                        if stack[depth][0] in CLOSED_BY_BLOCK or name == stack[depth][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                            while len(stack) > depth:
                                pop()
                        break
            if name not in VOID and not m[4].endswith("/"):
                parent = stack[-1][1] if stack else -1
                elements.append([parent, _furniture(name, m[4], open_articles > 0), 0])
                hard.append(elements[-1][1] == KIND or parent >= 0 and hard[parent])
                stack.append((name, len(elements) - 1))
                if first < 0 and name in ("article", "main") and not hard[-1]:
                    first = len(elements) - 1
                open_articles += name in ("article", "main")
                links += name == "a"
            continue
        text = m[0]
        if text[0] == "<" and len(text) > 1:
            if m[1]:
                out.append((m[1].lower(), "+in" if open_articles else "", stack[-1][1] if stack else -1, True))
            continue
        block = next((n for n, _ in reversed(stack) if n not in INLINE), "")
        at = stack[-1][1] if stack else -1
        if at >= 0:
            elements[at][2] += len(text.split())
        out.append((None, f"{block}{'+a' if links else ''}{'+in' if open_articles else ''}", at, text))
    bad = _marked(elements, hard, first)
    return [(n, w, at >= 0 and bad[at], t) for n, w, at, t in out]


def _classes(page: str):
    """(class, words or tags, inside) of every token; pages without an article element say nothing."""
    items = tokens(page)
    if not any(s.endswith("+in") for n, s, _, _ in items if n is None):
        return
    for name, where, bad, text in items:
        inside = where.endswith("+in") and not bad
        if name is None:
            n = len(text.split())
            if n:
                yield ("!" if bad else "") + where.removesuffix("+in"), n, inside
        elif name not in ("article", "main"):
            yield "<" + name, 1, inside


def _counted(batches):
    for batch in batches:
        found: dict[str, list[int]] = {}
        for page in batch.column("html").to_pylist():
            for c, n, inside in _classes(page):
                found.setdefault(c[:40], [0, 0])[inside] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[0] for x in found.values()], pa.int64())], ["class", "inside", "outside"])


#: Classes of surroundings kept, the most frequent first: far above the number of HTML elements, so only junk names are left out.
CLASSES = 2_000


def learn_weights(pages: DataFrame, name: str = "html") -> dict[str, float]:
    """Log-odds of lying inside the article for each class of words and tags; a tag's are never above TAG_LEAST."""
    rows = (pages.select(F.col(name).alias("html")).where("html IS NOT NULL").mapInArrow(_counted, "class string, inside bigint, outside bigint")
            .groupBy("class").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy(F.desc(F.col("i") + F.col("o")), "class").limit(CLASSES).collect())
    out = {}
    for c, i, o in rows:
        odds = float(np.clip(np.log((i + 1) / (o + 1)), -MOST, MOST))
        out[c] = min(TAG_LEAST, odds / 4) if c[0:1] == "<" else min(odds, -PLAIN) if c[0:1] == "!" else odds
    return out


def _score(where: str, marked: bool, weights: dict[str, float]) -> float:
    plain = where.removesuffix("+in")
    if marked and where.endswith("+in"):
        return MOST if "+a" not in plain else PLAIN  # the label itself, where a page has it
    if marked:
        return -MOST
    return weights.get(plain, LINKED if "+a" in plain else PLAIN)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region; empty if no region scores above zero."""
    if not page:
        return ""
    items = tokens(page)
    marked = any(n is None and s.endswith("+in") and not bad and t.strip() for n, s, bad, t in items)
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, (name, where, bad, text) in enumerate(items):
        if marked and bad and where.endswith("+in"):
            pass  # furniture inside the article: the output has none of it, and it parts nothing
        elif name is None:
            n = len(text.split())
            total += n * (weights.get("!" + where.removesuffix("+in"), -MOST) if bad else _score(where, marked, weights)) if n else 0
        else:
            total += weights.get("<" + name, TAG_COST)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    blocks, piece = [], []
    for name, _, bad, text in items[span[0]:span[1]]:
        if name is None:
            if not bad:
                piece.append(text)
        elif text:
            blocks.append("".join(piece))
            piece = []
    blocks.append("".join(piece))
    done = [" ".join(html.unescape(b).split()) for b in blocks]
    return " ".join(b for b in done if b)


def _extracted(name: str, weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(name).to_pylist()]
            rest = [c for n, c in zip(batch.schema.names, batch.columns) if n != name]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(n for n in batch.schema.names if n != name), "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, name: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with text and n_chars (code points) for each row of ``pages``.

    Null, empty and tagless pages: the first two give an empty text, the last all its words. Repeated rows give
    equal rows; other columns play no part; without labelled pages the fixed weights decide.
    """
    weights = learn_weights(pages, name)
    src = pages.select(*keep, name)
    schema = StructType([*pages.select(*keep).schema, StructField("text", StringType()), StructField("n_chars", LongType())])
    return src.mapInArrow(_extracted(name, weights), schema)
