"""Language identification by string kernels.

Kernel: the texts' sets of byte n-grams of one to three bytes (the blended spectrum, by presence),
their intersection over the geometric mean of their sizes.  Landmark texts give the Nyström map
K(x, L) K(L, L)^(-1/2), on which kernel ridge regression is fitted one-versus-rest.  A batch is scored
by two matrix products: presences with landmarks, and kernels with weights.

Training takes at most `per_lang` documents of each language, in hashed order.

Cases: a null text, or one without a letter, is `und` with score 0; very long texts are taken whole;
null languages are not learned from; null and repeated doc_ids are predicted row by row; with no
language to learn all are `und`; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import batch, held_out, slices, texts_of

CELLS = 1 << 15
LETTER = regex.compile(r"\p{L}")
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _c in range(97, 123):
    FOLD[_c] = FOLD[_c - 32] = _c


def grams(data: bytes) -> np.ndarray:
    """Cells of the n-grams that are present, ascending; all but letters count as spaces."""
    b = FOLD[np.frombuffer(data, np.uint8)].astype(np.uint32)
    mark = np.zeros(CELLS, bool)
    for n in (1, 2, 3):
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ b[i : len(b) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            mark[h >> np.uint32(17)] = True
    return np.flatnonzero(mark)


class Model:
    """Landmarks, weights and languages."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], per_class: int = 24, ridge: float = 0.01):
        self.langs = sorted(set(langs))
        marks = [i for c in self.langs for i in [j for j, y in enumerate(langs) if y == c][:per_class]]
        self.cells = np.unique(np.concatenate([sets[i] for i in marks]))
        self.column = np.full(CELLS, -1)
        self.column[self.cells] = np.arange(len(self.cells))
        self.sizes = np.sqrt([max(1, len(sets[i])) for i in marks])
        self.landmarks = self.presence([sets[i] for i in marks]).T.copy()
        kernel = self.kernel([sets[i] for i in marks])
        values, vectors = np.linalg.eigh(kernel.astype(np.float64))
        values = np.maximum(values, 1e-6 * values.max())
        root = vectors / np.sqrt(values) @ vectors.T
        phi = np.concatenate([self.kernel(sets[i : i + 64]) @ root for i in range(0, len(sets), 64)])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        self.weights = root @ np.linalg.solve(phi.T @ phi + ridge * len(sets) / len(marks) * np.eye(len(marks)), phi.T @ y)

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.cells)), np.float32)
        for row, s in zip(out, sets):
            at = self.column[s]
            row[at[at >= 0]] = 1
        return out

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        norm = np.sqrt([max(1, len(s)) for s in sets])
        return self.presence(sets) @ self.landmarks / norm[:, None] / self.sizes

    def predict(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and its softmax."""
        margin = 4 * (self.kernel(sets) @ self.weights)
        e = np.exp(margin - margin.max(1, keepdims=True))
        best = margin.argmax(1)
        return best, e[np.arange(len(best)), best] / e.sum(1)


def fit(docs: DataFrame, per_lang: int = 300) -> Model | None:
    """Learn from at most `per_lang` rows of each language that are not held out: those of the least hashes of id and
    text.  Rows that are equal in id, lang and text are learned once."""
    known = docs.where(~held_out("doc_id")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = known.select("lang", F.xxhash64("doc_id", "text", F.lit(7)).alias("h")).distinct().withColumn("u", F.col("h") / 2.0**64 + 0.5)
    # hashes up to twice the share that is wanted, and the least one: a language's rows are ranked when they are few
    shares = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least"))
    shares = shares.select(F.col("lang").alias("of"), F.greatest("least", (2.0 * per_lang + 100) / F.col("n")).alias("upto"))
    rows = rows.join(shares, (F.col("lang") == F.col("of")) & (F.col("u") <= F.col("upto")))
    order = Window.partitionBy("lang").orderBy("h")
    some = rows.select("lang", "h").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang)
    some = some.select(F.col("lang").alias("y"), F.col("h").alias("of"))
    rows = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit(7))).join(F.broadcast(some), (F.col("h") == F.col("of")) & (F.col("lang") == F.col("y")))
    rows = rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                sets = [grams(t).astype("<u2").tobytes() for t in texts_of(piece.column("text"))]
                yield batch(schema, [piece.column("doc_id"), piece.column("lang"), sets])

    found = rows.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, cells binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lang, r.cells))
    sets = [np.frombuffer(r.cells, "<u2").astype(np.int64) for r in found]
    some_set = [(s, r.lang) for s, r in zip(sets, found) if len(s)]
    return Model([s for s, _ in some_set], [y for _, y in some_set]) if some_set else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, most=1 << 20):
                texts = list(texts_of(piece.column("text")))
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                at = [i for i, t in enumerate(texts) if t and LETTER.search(t.decode())]
                for j in range(0, len(at) if model else 0, 64):
                    part = at[j : j + 64]
                    for i, k, s in zip(part, *model.predict([grams(texts[i]) for i in part])):
                        lang[i], score[i] = model.langs[k], float(s)
                yield batch(schema, [piece.column("doc_id"), piece.column("held_out"), lang, score])

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
