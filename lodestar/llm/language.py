"""Language ID: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Character n-grams of the lower-cased text (every run of non-letters is one space) are hashed to
buckets; a document is the mean of its buckets' embeddings, and a linear softmax turns the mean
into a language. Both layers are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows (`per_language` of each language, SAMPLE in all; the only bounds). The temperature and the rejection
threshold come from a part of the sample that training does not see.

As the model is linear, embeddings and weights fold into one table of logits by bucket, so that
prediction is a lookup and a mean over the whole text.

Defined results: a null text, or one without letters, is `und` with score 0 and is rejected; null
labels and null ids are never learned from; an empty or unlabelled table gives `und` everywhere;
repeated rows each give their own row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced, tidied

BUCKET_BITS = 15
SAMPLE = 100_000  # most rows drawn in all
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str | None) -> np.ndarray:
    """Bucket of every 2-, 3- and 4-gram of the whole text; empty if it has no letters."""
    if not text:
        return np.empty(0, np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    c = np.where(is_letter, c, 32)
    c = c[is_letter | np.r_[True, is_letter[:-1]]]  # of a run of spaces the first stays
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    out, h = [], c
    for n in (2, 3, 4):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


@dataclass
class Model:
    """languages; logits[bucket, language]; temperature; scores under threshold are rejected."""

    languages: list[str]
    logits: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if not len(g) or not self.languages:
            return "und", 0.0
        if len(g) < 1 << BUCKET_BITS:
            z = self.logits[g].mean(axis=0, dtype=np.float64)
        else:  # a long text's buckets are counted, not looked up one by one
            z = np.bincount(g, minlength=len(self.logits)) @ self.logits.astype(np.float64) / len(g)
        z = z / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(rows: list[tuple[str, str]], dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7, false_rejects: float = 0.001, rejects_below: float = 0.6) -> Model:
    """Fit on (text, language) rows; every fifth row of each language is kept for calibration.

    Rejection: the score under which `false_rejects` of the rightly predicted calibration rows fall,
    but never over `rejects_below`, so that clean text of a known language stays.
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    fit, held = [], []
    for text, lang in rows:
        g = grams(text)
        if len(g):
            seen[lang] = seen.get(lang, 0) + 1
            ids, n = np.unique(g, return_counts=True)
            (held if seen[lang] % 5 == 0 else fit).append((ids, (n / n.sum()).astype(np.float32), languages.index(lang)))
    e = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, x, y = fit[i]
            lr = rate * (1 - done / steps)
            done += 1
            rows_e = e[ids]
            h = x @ rows_e
            z = h @ w
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            # each bucket's share of the mean is small, so its embedding moves by the mean's gradient times the share, scaled up
            e[ids] = rows_e - lr * 20 * np.outer(x, back)
    logits = e @ w
    z = np.stack([x @ logits[ids] for ids, x, _ in held]) if held else np.zeros((0, len(languages)))
    y = np.array([k for *_, k in held], int)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60) if held else ():
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        nll = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())
        best = min(best, (nll, float(t)))
    t = best[1]
    threshold = 0.0
    if held:
        s = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        right = np.sort(s.max(axis=1)[s.argmax(axis=1) == y])
        threshold = min(rejects_below, float(right[int(false_rejects * len(right))])) if len(right) else 0.0
    return Model(languages, logits.astype(np.float32), t, threshold)


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> Model:
    """Train on at most about per_language labelled rows of each language, drawn by a hash of the id.

    In all at most SAMPLE rows are drawn: with many languages fewer of each, and of more than SAMPLE
    languages the most frequent ones.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = usable.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    per_language = max(1, min(per_language, SAMPLE // max(1, len(counts))))
    drawn = []
    draw = (F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).cast("double")
    if counts:
        share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))))
        picked = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), draw.alias("u"))
        picked = picked.where(F.col("u") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
        drawn = picked.orderBy("u", "id").limit(min(SAMPLE, 2 * per_language * len(counts))).collect()
    return train([(r["text"], r["lang"]) for r in drawn])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, held_out, lang_pred, score (0 to 1) and rejected."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            said = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x[0] for x in said], pa.string()), pa.array([round(x[1], 6) for x in said], pa.float64()), pa.array([x[0] == "und" or x[1] < model.threshold for x in said], pa.bool_())],
                names=[id_col, "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select(id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(tidied(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, same columns, without the rows that the model rejects."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, column=at):
            said = [model.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != "und" and p >= model.threshold for lang, p in said], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
