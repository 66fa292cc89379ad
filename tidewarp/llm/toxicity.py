"""Toxicity by non-negative positive-unlabelled learning (operator 10).

Confirmed toxic texts are the positives. The unlabelled texts are a sample of all documents outside the
held-out fold, whether they have a label or not; no label of theirs is looked at. The class prior is a
parameter; left out, it is estimated as the toxic share among the training fold's labelled rows, the one
use of labels that say not toxic. A linear model over word and word-start features is trained with numpy on

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

whose second term, the corrected risk of the negatives, is not let below zero: a step that finds it there
climbs out of it instead.

Features are counted by Spark over the sample; the at most ``most`` ones that tell positives from unlabelled
texts best are used, in either direction, if their shares differ by SIGMAS standard errors. The fit sees at
most ``positives`` and ``unlabelled`` rows, the least by md5 of the id. They reach the driver as the numbers
of the used features that they have, 2 * most bytes a row at most, however long the texts are (8 kB, so
120 MB in all at the defaults, and 10 MB in practice).

Rows in the held-out fold (crc32 of the id as text modulo ``folds`` equal to ``held``) give neither labels
nor texts. Labels, language, source and id are no inputs of a score. Scoring covers every whole text, of any
length; a word counts once.

Defined cases: null text is empty and scores as the model's bias. A null label says nothing; of several
labels of an id, toxic wins. Null ids are never held out, have no label and are not sampled. Without
positives every score is 0. Repeated rows get equal scores, and are sampled together. An empty table gives
an empty result. Extra columns are ignored; ``keep`` keeps them, but one named like the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from .common import cut, drop_others, table

WORD = re.compile(r"\w+")
STARTS = (3, 4, 5)
CACHE = 150_000


def features(word: str) -> list[int]:
    """Hashes of a word and of its first characters."""
    out = [xxhash.xxh32_intdigest(word.encode("utf-8", "replace"))]
    return out + [xxhash.xxh32_intdigest(f"{word[:n]}*".encode("utf-8", "replace")) for n in STARTS if len(word) >= n]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    prior: float = 0.0
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        found: set[int] = set()
        for word in words(text):
            ids = self.cache.get(word)
            if ids is None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                ids = self.cache[word] = tuple(f for f in features(word) if f in self.weights)
            if ids:
                found.update(ids)
        value = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


def in_fold(key: Column, folds: int, held: int) -> Column:
    """Whether a row is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == held, F.lit(False))


def _hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_others("toxicity")
    cache: dict[str, list[int]] = {}
    for batch in source:
        out = []
        for text in batch.column(1).to_pylist():
            found: set[int] = set()
            for word in words(text or ""):
                own = cache.get(word)
                if own is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    own = cache[word] = features(word)
                found.update(own)
            out.append(np.sort(np.fromiter(found, np.uint32, len(found))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["positive", "features"])


def _counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, positives, unlabelled) of a batch of rows (positive, features)."""
    for batch in source:
        sides = [np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x, p in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if p is which)]) for which in (True, False)]
        found, at = np.unique(np.concatenate(sides), return_inverse=True)
        columns = [np.bincount(x, minlength=len(found)) for x in (at[: len(sides[0])], at[len(sides[0]) :])]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *(pa.array(c.astype(np.int64)) for c in columns)], names=["feature", "pos", "unl"])


def _numbered(chosen: np.ndarray):
    """(positive, used): the places in chosen of a row's features, 16 bits each."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = [np.searchsorted(chosen, np.intersect1d(np.frombuffer(x, np.uint32), chosen, assume_unique=True)).astype(np.uint16).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["positive", "used"])

    return run


#: Standard errors by which a used feature's shares differ at least.
SIGMAS = 4.0


def select_features(sample: DataFrame, n_pos: int, n_unl: int, least: int, most: int) -> np.ndarray:
    """The at most ``most`` features of rows (positive, features), found ``least`` times at least, by their divergence, sorted."""
    counts = sample.mapInArrow(_counts, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    p, q = (F.col("pos") + 0.5) / (n_pos + 1), (F.col("unl") + 0.5) / (n_unl + 1)
    pool = (F.col("pos") + F.col("unl") + 1) / (n_pos + n_unl + 2)
    error = F.sqrt(pool * (1 - pool) * (1 / n_pos + 1 / max(1, n_unl)))
    good = counts.where((F.col("pos") + F.col("unl") >= least) & (F.abs(p - q) > SIGMAS * error))
    best = good.select("feature", ((p - q) * F.log(p / q)).alias("gain")).orderBy(F.desc("gain"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.uint32))


class _Rows:
    """Binary rows of feature places, with row sums by weight and column sums by row value."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, x_p: _Rows, x_u: _Rows, prior: float) -> tuple[float, float, np.ndarray]:
    """(positives' risk, corrected risk of the negatives, direction of descent) at weights w, the last of which is the bias.

    The direction is the gradient of their sum, or where the corrected risk is negative, the negated gradient
    of that alone.
    """
    z_p, z_u = x_p.dot(w[:-1]) + w[-1], x_u.dot(w[:-1]) + w[-1]
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    positive = prior * float(np.mean(np.logaddexp(0, -z_p)))
    corrected = float(np.mean(np.logaddexp(0, z_u)) if x_u.n else 0.0) - prior * float(np.mean(np.logaddexp(0, z_p)))
    down_p, down_u = -prior * s_p / x_p.n, s_u / max(1, x_u.n)
    g_p, g_u = (prior * (s_p - 1) / x_p.n + down_p, down_u) if corrected >= 0 else (-down_p, -down_u)
    return positive, corrected, np.append(x_p.back(g_p) + x_u.back(g_u), g_p.sum() + g_u.sum())


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], chosen: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """A linear model over rows of places in the chosen features, by Adam on the non-negative risk with logistic loss."""
    if not pos or not prior > 0 or not len(chosen):
        return Model(0.0, {}, prior)
    prior = min(prior, 0.999)
    x_p, x_u = _Rows(pos, len(chosen)), _Rows(unl, len(chosen))
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = risk(w, x_p, x_u, prior)[2]
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(w[-1]), {int(f): float(x) for f, x in zip(chosen, w[:-1], strict=True)}, prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        folds: int = 3, held: int = 1, positives: int = 5000, unlabelled: int = 10_000, most: int = 4096, least: int = 4, prior: float | None = None) -> Model:
    """A model from labelled positives and unlabelled documents of the training fold."""
    spark = ship(docs).sparkSession
    train = ~in_fold(F.col("id"), folds, held)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(train).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    if not counts[1]:
        return Model(0.0, {}, 0.0)
    order = F.md5(F.col("id").cast("string").cast("binary"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("id").isNotNull() & train)
    chosen = known.where("toxic = 1").orderBy(order).limit(positives).select("id", F.lit(True).alias("positive"))
    chosen = chosen.unionByName(texts.select("id").orderBy(order, "id").limit(unlabelled).distinct().select("id", F.lit(False).alias("positive")))
    # At most positives + unlabelled ids: a bounded table to broadcast.
    ids = spark.createDataFrame(chosen.toPandas().astype({"id": "int64", "positive": bool}), "id long, positive boolean")
    sample = cut(texts.join(F.broadcast(ids), "id").select("positive", "text").mapInArrow(_hashed, "positive boolean, features binary"), "toxicity-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos:
        return Model(0.0, {}, 0.0)
    used = select_features(sample, n_pos, n_unl, min(least, max(1, n_pos // 4)), most)
    both: dict[bool, list[bytes]] = {True: [], False: []}
    for r in sample.mapInArrow(_numbered(used), "positive boolean, used binary").toLocalIterator():
        both[r["positive"]].append(bytes(r["used"]))
    pos, unl = ([np.frombuffer(x, np.uint16) for x in sorted(both[k])] for k in (True, False))
    return fit_nnpu(pos, unl, used, counts[1] / counts[0] if prior is None else prior)


#: The column that score() adds with keep.
SCORE = "__tw_score"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score), or with keep all columns of docs and SCORE."""
    spark = ship(docs).sparkSession
    shared = spark.sparkContext.broadcast((model.bias, model.weights, model.prior))
    docs = docs.drop(SCORE) if keep else docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    at = docs.columns.index(text_col) if keep else 1

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("toxicity")
        own = Model(*shared.value)
        for batch in source:
            scores = pa.array([own.score(x or "") for x in batch.column(at).to_pylist()], pa.float64())
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, SCORE])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    if keep:
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))
    return docs.mapInArrow(run, "id long, score double")


THRESHOLD = 0.7


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
