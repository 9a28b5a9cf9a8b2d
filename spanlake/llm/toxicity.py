"""Toxicity by a counterfactual-regularised logistic classifier.

Features are words and word beginnings (so inflected forms share weight), each with its count and its density. Labelled texts that mention an identity
term are paired with copies in which it is swapped for others of its group and for a neutral word; the fit
penalises the square of the change in score between the pair, so that weight cannot rest on who is mentioned.
"""
from __future__ import annotations

from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C

# Groups of identity terms that are swapped for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
)
NEUTRAL = "person"
#: Bound of the labelled sample for each class, and number of features.
SAMPLE, FEATURES = 6_000, 1_000
#: Documents of the sample that a feature must occur in; strengths of the penalties; beginnings taken as features.
LEAST, RIDGE, COUNTERFACTUAL = 3, 3e-4, 1.0
HEADS = (4, 5, 6)
_APART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


def _features(word: bytes) -> list[bytes]:
    return [b"=" + word[:40], *(word[:n] for n in HEADS if len(word) >= n)]


def _swaps(groups) -> dict[bytes, list[bytes]]:
    return {t.encode(): [o.encode() for o in g if o != t] + [NEUTRAL.encode()] for g in groups for t in g}


def _counted(batches):
    for batch in batches:
        found: dict[bytes, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for f in {f for w in set(words_of(text)) for f in _features(w)}:
                found.setdefault(f, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[0] for x in found.values()], pa.int64())], ["feature", "pos", "neg"])


def _values(count: float, n_words: int) -> tuple[float, float]:
    """A feature's two values: its count, and its occurrences in 200 words, both damped."""
    return log1p(count), log1p(200 * count / max(50, n_words))


class Model:
    """Two weights by feature (of count and density); the bias follows the share of toxic texts among all that are labelled."""

    def __init__(self, weights: dict[bytes, tuple[float, float]], bias: float):
        self.weights, self.bias = weights, bias
        self.begins = {f.lstrip(b"=")[:3] for f in weights} if all(len(f.lstrip(b"=")) >= 3 for f in weights) else None

    def score(self, text: str | None) -> float:
        counts: dict[bytes, int] = {}
        begins = self.begins
        words = words_of(text)
        for w in words if begins is None else [w for w in words if w[:3] in begins]:
            for f in _features(w):
                if f in self.weights:
                    counts[f] = counts.get(f, 0) + 1
        z = self.bias
        for f, n in counts.items():
            (a, b), (x, y) = self.weights[f], _values(n, len(words))
            z += a * x + b * y
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _vectors(names: list[bytes], groups):
    """Rows (label, places, values) of the sample's texts, and with label -1 the changes that swapped identity terms make."""
    index = {f: i for i, f in enumerate(names)}
    swaps = _swaps(groups)

    def values(words):
        counts: dict[int, int] = {}
        for w in words:
            for f in _features(w):
                if f in index:
                    counts[index[f]] = counts.get(index[f], 0) + 1
        out = {}
        for i, n in counts.items():
            out[i], out[i + len(names)] = _values(n, len(words))
        return out

    def run(batches):
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = words_of(text)
                own = values(words)
                rows.append((toxic, list(own), list(own.values())))
                named = [w for w in words if w in swaps]
                for k in range(max((len(swaps[w]) for w in named), default=0)):
                    other = values([swaps[w][k % len(swaps[w])] if w in swaps else w for w in words])
                    change = {i: other.get(i, 0.0) - own.get(i, 0.0) for i in {*own, *other}}
                    change = {i: x for i, x in change.items() if x}
                    if change:
                        rows.append((-1, list(change), list(change.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())))], ["toxic", "at", "x"])
    return run


def fit(rows: list[tuple], n: int, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, places, values); label -1 marks a counterfactual change of score to be kept small.

    Texts are a dense matrix, which the sample bounds; changes, several for each text that names an identity term,
    touch a few features each and stay lists of places and values.
    """
    own = [r for r in rows if r[0] >= 0]
    changes = [r for r in rows if r[0] < 0]
    x = np.zeros((len(own), n + 1), np.float32)
    for i, (_, at, v) in enumerate(own):
        x[i, at] = v
    x[:, n] = 1
    place = np.concatenate([np.empty(0, np.int32), *[np.asarray(at, np.int32) for _, at, _ in changes]])
    value = np.concatenate([np.empty(0, np.float32), *[np.asarray(v, np.float32) for _, _, v in changes]])
    change = np.repeat(np.arange(len(changes)), [len(at) for _, at, _ in changes])
    y = np.array([r[0] for r in own], np.float32)
    w, m, v = (np.zeros(n + 1, np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / max(1, len(y))
        g[:n] += ridge * w[:n]
        if changes:
            moved = np.bincount(change, value * w[place], len(changes))
            g[:n] += counterfactual * np.bincount(place, value * moved[change], n) / len(changes)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:n], float(w[n])


def learn(labelled: DataFrame, docs: DataFrame, groups=IDENTITY, sample: int = SAMPLE, features: int = FEATURES, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from ``labelled`` (doc_id, toxic 0 or 1) and the texts of ``docs``.

    About ``sample`` rows of each class, drawn by a hash of the id, are used, all if there are fewer; copies of a
    text count once. With one class only, the score is that class's share for every text (0 without labels).
    """
    one = labelled.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {int(k): n for k, n in one.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = 1.0 if 1 in sizes else 0.0
        return Model({}, 40.0 if share else -40.0)
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    drawn = one.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < rate * 1_000_000)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    rows = C.cut(rows)
    n = {int(k): c for k, c in rows.groupBy("toxic").count().collect()}
    n = {k: n.get(k, 0) for k in (0, 1)}
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    z = (F.log(pos / (n[1] + 1)) - F.log(neg / (n[0] + 1))) / F.sqrt(1 / pos + 1 / neg)
    chosen = (rows.mapInArrow(_counted, "feature binary, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .where(F.col("pos") + F.col("neg") >= LEAST).where(F.length("feature") > 3).orderBy(F.desc(F.abs(z)), "feature").limit(features))
    names = [bytes(r[0]) for r in chosen.select("feature").collect()]
    vectors = [tuple(r) for r in rows.mapInArrow(_vectors(names, groups), "toxic int, at array<int>, x array<double>").collect()]
    weights, bias = fit(vectors, 2 * len(names), counterfactual=counterfactual)
    bias += np.log(sizes[1] / sizes[0]) - np.log(max(1, n[1]) / max(1, n[0]))  # the sample has the classes in other shares
    return Model({f: (float(a), float(b)) for f, a, b in zip(names, weights, weights[len(names):])}, float(bias))


def _scored(model: Model, name: str):
    def run(batches):
        for batch in batches:
            for part in C.slices(batch, name):
                score = [model.score(t) for t in part.column(name).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])
    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score (0 to 1) for each row; a null or empty text has the score of no evidence."""
    src = docs.select(*keep, text)
    return src.mapInArrow(_scored(model, text), StructType([*src.schema, StructField("score", DoubleType())])).select(*keep, "score")
