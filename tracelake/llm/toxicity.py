"""Toxicity by gradient-boosted trees over dense features of the whole text.

Features: densities and maxima of a learned lexicon (words, and stems of four to six characters),
the same for words behind obfuscation (digits and signs for letters, stretched letters), how close
second-person words stand to lexicon words, capitals, punctuation and obfuscation rates.  The trees'
output is calibrated by isotonic regression on rows that neither the lexicon nor the trees have seen.

Training takes at most `most` labelled rows of each label, in hashed order, in three parts by hash:
the lexicon is counted on one, the trees are grown on a second and calibrated on the third.

Cases: a null or empty text has all-zero features and gets the score of such texts; very long texts
are taken whole; a null label isn't learned from; a document labelled twice counts as toxic if one
label says so; null and repeated doc_ids are scored row by row; with fewer than two labels to learn
from every score is 0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import batch, give_back, held_out, slices, texts_of

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu toi te ton ta tes vous votre vos tú ti "
    "usted ustedes vosotros tuyo".encode().split()
)
PLAIN = bytes.maketrans(b"013457@$!+|", b"oieastasitl")
TRIM = b".,;:!?\"'()[]{}<>-_*~"
NEAR = 5
SECOND, CAPS, MASKED, HIDDEN, STRETCHED = 16, 32, 64, 128, 256
LEVELS = 15


def forms(word: bytes) -> list[bytes]:
    """Lexicon keys of a lower-case word: itself and its stems."""
    text = word.decode("utf-8", "ignore")
    return [word, *[b"^" + text[:n].encode() for n in (4, 5, 6) if len(text) > n]]


def unmask(word: bytes) -> tuple[bytes, bool]:
    """The word without obfuscation, and whether there was any."""
    core = word.strip(b".,;:?\"'()")
    inner = core[1:-1]
    hidden = any(c in b"013457@$!+|*_.-#" for c in inner) and not core.isdigit() and core[:1].isalpha() | (core[:1] in b"@$")
    if not hidden:
        return word, False
    out = core.translate(PLAIN, b"*_.-#")
    return out, out != core


class Lexicon(dict):
    """Original word -> strength (0 to LEVELS) and flags, worked out once per word."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def strength(self, word: bytes) -> int:
        best = max((self.weights.get(f, 0.0) for f in forms(word)), default=0.0)
        return min(LEVELS, int(best * 2))

    def __missing__(self, word: bytes) -> int:
        low = word.lower()
        bare = low.strip(TRIM)
        code = self.strength(bare)
        if bare in SECOND_PERSON:
            code |= SECOND
        if len(bare) > 2 and word.isupper():
            code |= CAPS
        clear, masked = unmask(low)
        if masked:
            code |= MASKED
            if hit := self.strength(clear):
                code = max(code & 15, hit) | (code & ~15) | HIDDEN
        if any(bare[i] == bare[i + 1] == bare[i + 2] for i in range(len(bare) - 2)):
            code |= STRETCHED
            short = bytes(c for i, c in enumerate(bare) if not i or bare[i - 1] != c)
            if not code & 15 and (hit := self.strength(short)):
                code |= hit | HIDDEN
        if len(self) < 300_000:
            self[word] = code
        return code


FEATURES = (
    "hit_rate hits strong_hits strongest strength_rate distinct_levels hidden_hits second_rate second_near "
    "caps_rate caps_words exclaim_rate punct_rate digit_rate masked_rate stretched_rate log_words"
).split()
PUNCT = np.array([chr(i) in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" for i in range(256)])


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.array(list(map(lexicon.__getitem__, words)), np.int64)
    power = codes & 15
    hits = np.flatnonzero(power)
    second = codes & SECOND > 0
    near = 0
    if len(hits):
        before = np.append(0, np.cumsum(second))
        near = int((before[np.minimum(hits + NEAR + 1, n)] > before[np.maximum(hits - NEAR, 0)]).sum())
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    letters = max(1, int(chars[65:91].sum() + chars[97:123].sum()))
    return [
        len(hits) / n, len(hits), int((power >= 8).sum()), int(power.max()), float(power.sum()) / n,
        len(np.unique(power[hits])), int((codes & HIDDEN > 0).sum()), float(second.mean()), near,
        chars[65:91].sum() / letters, float((codes & CAPS > 0).mean()), chars[33] / n,
        chars[PUNCT].sum() / size, chars[48:58].sum() / size, float((codes & MASKED > 0).mean()),
        float((codes & STRETCHED > 0).mean()), math.log1p(n),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, grown on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        b = self.binned(x)
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, y - p, p * (1 - p), depth)
            tree[2][:] *= rate
            self.trees.append(tree)
            f += tree[2][leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    @staticmethod
    def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float = 1.0, least: int = 4):
        """Split feature and bin by node (feature -1: none), leaf values, and each row's leaf."""
        feature, at = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
        node = np.zeros(len(b), np.int64)
        for k in range(len(feature)):
            rows = np.flatnonzero(node == k)
            best, gs, hs = 1e-3, g[rows].sum(), h[rows].sum()
            for c in range(b.shape[1] if len(rows) >= 2 * least else 0):
                col = b[rows, c]
                n = int(col.max()) + 1
                if n < 2:
                    continue
                gl, hl = np.cumsum(np.bincount(col, g[rows], n))[:-1], np.cumsum(np.bincount(col, h[rows], n))[:-1]
                nl = np.cumsum(np.bincount(col, minlength=n))[:-1]
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                if gain.max() > best:
                    best, feature[k], at[k] = gain.max(), c, gain.argmax()
            right = b[rows, feature[k]] > at[k] if feature[k] >= 0 else np.zeros(len(rows), bool)
            node[rows] = 2 * k + 1 + right
        leaf = node - len(feature)
        gl, hl = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
        return (feature, at, gl / (hl + l2)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, at, value in self.trees:
            node = np.zeros(len(b), np.int64)
            while node[0] < len(feature):
                c = feature[node]
                node = 2 * node + 1 + ((c >= 0) & (b[rows, c] > at[node]))
            f += value[node - len(feature)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit, by pooling adjacent violators."""
    at, which = np.unique(x, return_inverse=True)  # equal places have one value
    blocks: list[list[float]] = []
    for a, total, n in zip(at.tolist(), np.bincount(which, y).tolist(), np.bincount(which).tolist()):
        blocks.append([total, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = np.array([k for b in blocks for k in ((b[2], b[0] / b[1]), (b[3], b[0] / b[1]))])
    return knots[:, 0], knots[:, 1]


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: Lexicon, trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0) if len(x) else np.empty(0)


def _count(rows: DataFrame) -> tuple[dict[bytes, float], list]:
    """Log odds of the lexicon's words and stems, from the documents of part 0."""
    schema = pa.schema([("form", pa.binary()), ("bad", pa.int64()), ("good", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, most=4 << 20):
                counts = (Counter(), Counter())
                for text, y in zip(texts_of(piece.column("text")), piece.column("y").to_pylist()):
                    words = {w.strip(TRIM) for w in text.lower().split()}
                    counts[y].update({f for w in words if w for f in forms(w)})
                keys = list(counts[1] | counts[0])
                yield batch(schema, [keys, [counts[1][k] for k in keys], [counts[0][k] for k in keys]])

    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good + 1.0))
    sums = rows.select("text", "y").mapInArrow(run, "form binary, bad long, good long")
    sums = sums.groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    least = max(2, bad // 150)
    found = sums.where(F.col("bad") >= least).withColumn("odds", odds).where("odds > 2").orderBy(F.desc("odds"), "form").limit(4000)
    return {bytes(r.form): r.odds for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Model | None:
    """Learn from at most `most` labelled ids of each label that are not held out, from one row (that of the least text)
    of each, however often an id repeats."""
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64("doc_id", F.lit(6))
    some = [named.where(F.col("y") == y).orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col("doc_id").alias("id"), "y")
    part = F.pmod(F.xxhash64("doc_id", F.lit(61)), F.lit(4))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "y", part.cast("int").alias("part"), "text")
    lexicon = Lexicon(_count(rows.where("part < 2")))
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("part", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                x = [features(t, lexicon) for t in texts_of(piece.column("text"))]
                yield batch(schema, [piece.column("doc_id"), piece.column("y"), piece.column("part"), x])

    seen = rows.where("part >= 2").mapInArrow(run, "doc_id long, y int, part int, x array<double>").collect()
    seen.sort(key=lambda r: (r.doc_id, r.x))
    if len({r.y for r in seen}) < 2:
        return None
    x, y, last = np.array([r.x for r in seen]), np.array([r.y for r in seen], float), np.array([r.part for r in seen]) == 3
    grow = ~last if 0 < y[~last].sum() < (~last).sum() else np.ones(len(y), bool)
    trees = Trees(x[grow], y[grow])
    fold = last if 0 < y[last].sum() < last.sum() else np.ones(len(y), bool)
    del seen, rows
    give_back()
    return Model(lexicon, trees, isotonic(trees.margin(x[fold]), y[fold]))


def scored(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                score = _scores(piece, model)
                yield batch(schema, [piece.column("doc_id"), piece.column("held_out"), score, (score >= threshold).astype(np.int32)])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of which the score is below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                yield piece.filter(pa.array(_scores(piece, model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _scores(piece: pa.RecordBatch, model: Model | None) -> np.ndarray:
    texts = list(texts_of(piece.column("text")))
    return model.score(texts) if model else np.zeros(len(texts))
