"""Quality by regularised quadratic discriminant analysis (operator 12).

1. One pass over the texts counts document statistics (STATISTICS): words, distinct and unique words, repeats,
   classes of characters, lines, compressed size. From here on a document is some 20 numbers; no text is
   read or shuffled again.
2. Statistics become features: log sizes, and log odds of shares. A share of few items is drawn to the
   training fold's own overall share by STRENGTH items, so short texts don't land in the tails.
3. Each class has a mean and a covariance over all its labelled rows of the training fold, from sums of
   features and of their products that map tasks make and Spark adds up; nothing is sampled.
4. The covariances are shrunk to a multiple of the identity (features are scaled to unit variance first) by
   the oracle approximating share, at least ``least``. Each is kept as the inverse of its Cholesky factor,
   made once, so a score is two matrix products: the difference of the classes' log densities (half the
   Mahalanobis distances and the log determinants) plus the log odds of the classes, through a logistic.

Rows in the held-out fold (crc32 of the id as text modulo ``folds`` equal to ``held``) give no labels. Labels,
language, source and id are no inputs of a score.

Defined cases: null text is empty, and an empty text has a score like any other. A null label says nothing; of
several labels of an id the least counts. Null ids are never held out and have no label. With fewer than two
labelled rows in a class, every score is the share of label 1 (with one row of each class added). Repeated rows
get equal scores. Texts of any length are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import as_bytes, cut, table
from .toxicity import in_fold

#: Classes of characters: names and the ASCII characters in each.
CHARACTERS = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "small": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "blanks": b" \t\n\x0b\x0c\r",
    "stops": b".!?",
    "pauses": b",;:",
    "quotes": b"\"'()-",
}
STATISTICS = ("bytes", "chars", "words", "distinct", "once", "commonest", "again", "lines", "distinct_lines", "short_lines", "packed", *CHARACTERS, "symbols", "controls")
#: (part, whole): the shares that are features.
SHARES = (
    ("distinct", "words"), ("once", "words"), ("commonest", "words"), ("again", "words"), ("distinct_lines", "lines"), ("short_lines", "lines"), ("packed", "bytes"),
    ("capitals", "chars"), ("small", "chars"), ("digits", "chars"), ("blanks", "chars"), ("stops", "words"), ("pauses", "words"), ("quotes", "chars"), ("symbols", "chars"), ("controls", "chars"),
)
#: log1p of these, and of the mean length of words and lines.
SIZES = ("words", "lines")
WIDTH = len(SHARES) + len(SIZES) + 2
#: A share of n items is drawn to the overall share by so many.
STRENGTH = 20.0
#: A line of fewer bytes is short.
SHORT = 40

_CLASS = np.full(256, len(CHARACTERS), np.int64)
for _i, _set in enumerate(CHARACTERS.values()):
    _CLASS[list(_set)] = _i
_CLASS[:32] = np.where(_CLASS[:32] == len(CHARACTERS), len(CHARACTERS) + 1, _CLASS[:32])
_CLASS[127] = len(CHARACTERS) + 1
_CLASS[128:] = len(CHARACTERS) + 2


def statistics(text: bytes) -> list[int]:
    """The STATISTICS of a text in UTF-8."""
    found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, found, len(CHARACTERS) + 3).astype(np.int64)
    words, lines = text.split(), text.split(b"\n")
    counts = Counter(words)
    sizes = list(counts.values())
    return [
        len(text), len(text) - int(found[0x80:0xC0].sum()), len(words), len(sizes), sizes.count(1), max(sizes, default=0), sum(map(eq, words, words[1:])),
        len(lines), len(set(lines)), sum(len(x) < SHORT for x in lines), min(len(text), len(zlib.compress(text, 1))), *classes[: len(CHARACTERS) + 2].tolist(),
    ]


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        rows = np.array([statistics(t) for t in as_bytes(batch.column(1))], np.int64).reshape(batch.num_rows, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], names=["id", *STATISTICS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *STATISTICS) for each row, as text went through once."""
    rows = ship(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return cut(rows.mapInArrow(_counted, "id long, " + ", ".join(f"{s} long" for s in STATISTICS)), "quality-statistics")


def features(counts: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Rows of features from rows of STATISTICS and the overall shares."""
    column = dict(zip(STATISTICS, counts.T.astype(float), strict=True))
    out = []
    for (part, whole), share in zip(SHARES, overall, strict=True):
        p = (column[part] + STRENGTH * share) / (column[whole] + STRENGTH)
        p = np.clip(p, 1e-6, 1 - 1e-6)  # a part may be all of the whole, and commas more than the words
        out.append(np.log(p / (1 - p)))
    out += [np.log1p(column[s]) for s in SIZES]
    out += [np.log1p((column["chars"] - column["blanks"]) / np.maximum(1, column["words"])), np.log1p(column["chars"] / np.maximum(1, column["lines"]))]
    return np.stack(out, axis=1)


@dataclass
class Discriminant:
    """A class: its mean, the inverse of its covariance's Cholesky factor, and the log determinant of that covariance."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Discriminant:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant that all classes share."""
        return -0.5 * (((x - self.mean) @ self.inverse.T) ** 2).sum(axis=1) - 0.5 * self.log_det


@dataclass
class Quality:
    overall: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Discriminant, Discriminant] | None
    log_odds: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(counts), 1 / (1 + np.exp(-self.log_odds)))
        x = (features(counts, self.overall) - self.centre) / self.scale
        odds = self.classes[1].log_density(x) - self.classes[0].log_density(x) + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def shrunk(covariance: np.ndarray, n: float, least: float) -> np.ndarray:
    """The covariance of n rows drawn to a multiple of the identity by the oracle approximating share, at least ``least``."""
    d = len(covariance)
    trace, squares = float(np.trace(covariance)), float((covariance**2).sum())
    below = (n + 1 - 2 / d) * (squares - trace**2 / d)
    share = min(1.0, max(least, ((1 - 2 / d) * squares + trace**2) / below)) if below > 0 else 1.0
    return (1 - share) * covariance + share * max(trace / d, 1e-6) * np.eye(d)


def discriminants(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], overall: np.ndarray, least: float) -> Quality:
    """A model from each class' (rows, sum of features, sum of products of features)."""
    counts = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
    log_odds = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    if min(counts) < 2:
        return Quality(overall, np.zeros(WIDTH), np.ones(WIDTH), None, log_odds)
    n = sum(counts)
    centre = (sums[0][1] + sums[1][1]) / n
    spread = np.sqrt(np.maximum(0, np.diag(sums[0][2] + sums[1][2]) / n - centre**2))
    scale = np.where(spread > 1e-6, spread, 1.0)
    classes = []
    for k in (0, 1):
        rows, total, products = sums[k]
        mean = total / rows
        covariance = (products / rows - np.outer(mean, mean)) / np.outer(scale, scale)
        classes.append(Discriminant.of((mean - centre) / scale, shrunk((covariance + covariance.T) / 2, rows, least)))
    return Quality(overall, centre, scale, (classes[0], classes[1]), log_odds)


def _moments(overall: np.ndarray):
    """(class, at, value): a task's number of rows (at = 0), sums and products of features, by class."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for batch in source:
            label = np.array(batch.column(0).to_pylist(), np.int64)
            x = features(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, len(STATISTICS) + 1)], axis=1), overall)
            for k in (0, 1):
                own = x[label == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        if sums[:, 0].any():
            places = np.tile(np.arange(sums.shape[1]), 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1])), pa.array(places), pa.array(sums.ravel())], names=["class", "at", "value"])

    return run


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 4, held: int = 2, least: float = 0.02) -> Quality:
    """A model from the labelled rows of document_statistics() outside the held-out fold, all of them."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(F.col("id").isNotNull() & ~in_fold(F.col("id"), folds, held)).groupBy("id").agg(F.min("label").alias("label"))
    rows = cut(stats.join(known, "id").select("label", *STATISTICS), "quality-labelled")
    totals = rows.agg(*(F.sum(F.col(s).cast("double")).alias(s) for s in STATISTICS)).first()
    overall = np.array([min(1.0, (totals[part] or 0.0) / max(1.0, totals[whole] or 0.0)) for part, whole in SHARES])
    found = rows.mapInArrow(_moments(overall), "class long, at long, value double").groupBy("class", "at").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for r in found.collect():  # two rows a moment, whatever the input
        sums[r["class"], r["at"]] = r["value"]
    return discriminants({k: (s[0], s[1 : 1 + WIDTH], s[1 + WIDTH :].reshape(WIDTH, WIDTH)) for k, s in enumerate(sums)}, overall, least)


def score(stats: DataFrame, model: Quality) -> DataFrame:
    """(id, score) for rows of document_statistics()."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            counts = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, len(STATISTICS) + 1)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(counts))], names=["id", "score"])

    return ship(stats).mapInArrow(run, "id long, score double")


THRESHOLD = 0.7


def op12_quality_discriminant(spark, sf_dir: str) -> DataFrame:
    stats = document_statistics(table(spark, sf_dir, "documents"))
    scored = score(stats, fit(stats, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
