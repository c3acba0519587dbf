"""Toxicity by non-negative positive-unlabelled learning (operator 9).

Linear classifiers over hashed words (presence in the text) are trained with numpy on confirmed toxic texts and texts
whose label is not looked at. The risk of the unlabelled part is corrected by the class prior and held at zero or above:
prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-)). The prior is the share of toxic rows among the training labels.
Training takes at most POSITIVE confirmed and UNLABELLED other texts, by hash order; scoring takes every whole text.
Null and empty texts have no words and get the score of the bias. Without any toxic training row every score is 0.
Repeated rows get the same score. A document without id is never trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, chunks, session

#: Bounds of the training sample, the number of hashed features, and of classifiers whose scores are averaged.
POSITIVE, UNLABELLED, BITS, MODELS = 4000, 8000, 18, 3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray:
    """Sorted hashed words of a text."""
    mask = (1 << BITS) - 1
    return np.array(sorted({zlib.crc32(w.encode()) & mask for w in set(_WORD.findall(text.lower()))}), np.int32)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list, list, float]:
    """Features of confirmed toxic and of unlabelled training texts, and the class prior."""
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "text")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("doc_id"))
    share = marks.agg(F.avg("toxic"), F.count("*")).first()
    chosen = lambda rows, n, seed: rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    sure = chosen(marks.where("toxic = 1").select("doc_id"), POSITIVE, 1).withColumn("sure", F.lit(True))
    other = chosen(train.select("doc_id").distinct(), UNLABELLED, 2).withColumn("sure", F.lit(False))
    both = F.broadcast(sure.unionByName(other))  # at most POSITIVE + UNLABELLED ids
    rows = train.join(both, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sure"), pa.array(found, pa.binary())], ["sure", "words"])

    got: dict[bool, list] = {True: [], False: []}
    for r in sorted(rows.mapInArrow(run, "sure boolean, words binary").collect(), key=lambda r: (r["sure"], bytes(r["words"]))):
        got[r["sure"]].append(np.frombuffer(r["words"], np.int32))
    return got[True], got[False], float(share[0] or 0.0)


def matrix(rows: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each entry whose feature is in the sorted list columns."""
    lengths = [len(r) for r in rows]
    row, word = np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows) if rows else np.zeros(0, np.int32)
    at = np.searchsorted(columns, word)
    ok = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == word)
    return row[ok], at[ok]


def train(sure: list, other: list, prior: float, seed: int, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of all hashed words, then the bias."""
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[-1] = -20.0
    if not sure or not other or prior <= 0:
        return weights
    rng = np.random.default_rng(seed)
    df_sure = np.bincount(np.concatenate(sure), minlength=1 << BITS)
    df_other = np.bincount(np.concatenate(other), minlength=1 << BITS)
    least = max(3, 0.01 * len(sure))
    columns = np.flatnonzero((df_sure >= least) | (df_other >= 0.01 * len(other)))
    if not len(columns):
        return weights
    # The features start at the log of how much likelier a word is in toxic texts where that is beyond chance.
    p, u = (df_sure[columns] + 1) / (len(sure) + 2), (df_other[columns] + 1) / (len(other) + 2)
    sigma = np.sqrt((1 - p) / (p * len(sure)) + (1 - u) / (u * len(other)))
    z = np.log(p / u) / sigma
    columns = columns[np.abs(z) > 5] if (np.abs(z) > 5).any() else columns
    k = len(columns)
    w, b = np.zeros(k), np.log(prior / (1 - prior))
    (ps, pc), (us, uc) = matrix(sure, columns), matrix(other, columns)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        pick_p, pick_u = rng.random(len(sure)) < 0.8, rng.random(len(other)) < 0.8
        fp, fu = b + np.bincount(ps, w[pc], len(sure)), b + np.bincount(us, w[uc], len(other))
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -40, 40))), 1 / (1 + np.exp(-np.clip(fu, -40, 40)))
        n_p, n_u = max(1, pick_p.sum()), max(1, pick_u.sum())
        soft = lambda f: np.logaddexp(0, f)
        negative = (soft(fu) * pick_u).sum() / n_u - prior * (soft(fp) * pick_p).sum() / n_p
        # d/df of the logistic losses: l(+) has s - 1, l(-) has s
        g_pos = prior * (sp - 1) * pick_p / n_p
        g_neg_u, g_neg_p = su * pick_u / n_u, -prior * sp * pick_p / n_p
        if negative >= 0:
            gp, gu = g_pos + g_neg_p, g_neg_u
        else:  # the corrected risk has gone below zero: step back on it
            gp, gu = -g_neg_p, -g_neg_u
        grad = np.concatenate([np.bincount(pc, gp[ps], k) + np.bincount(uc, gu[us], k) + 1e-5 * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * 3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[columns], weights[-1] = w, b
    return weights


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted. The weights have a fixed size and are broadcast."""
    sure, other, prior = sample(docs, labels)
    models = [train(sure, other, prior, seed) for seed in range(MODELS)]
    shared = session(docs).sparkContext.broadcast(np.stack(models))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    here = by_bytes(docs).select(*(f"`{c}`" for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in chunks(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                at = features(text or "")
                f = weights[:, at].sum(axis=1, dtype=np.float64) + weights[:, -1]
                scores.append(float((1 / (1 + np.exp(-np.clip(f, -40, 40)))).mean()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, "score"])

    out = here.mapInArrow(run, T.StructType([*here.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumn("held_out", held_out("doc_id")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
