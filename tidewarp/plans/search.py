"""Candidate search by successive halving, for all series and candidates at once.

Candidates are rows of a table. A rung is one Spark job over the pairs of a series and a candidate that are still in the
race: each trains on a stretch of the series that ends before the held-out rows, twice as long as in the rung
before (the last rung has all rows), and is scored on the held-out rows. Each series keeps the better half of its own candidates.
So most candidates are dropped after little work, and a series' winner is the best of those that saw all of it.

Defined cases: ties go to the alias that comes first. A series with too few rows for a candidate in a rung drops
that candidate there, if others have a score; series that no candidate can be trained on are not in the result.
Rows with a null target are left out. A candidate that fails or forecasts what is no number has no score.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from ..functions.tables import written
from ..models.registry import make
from ..operators.slices import Slices
from ..series import SeriesSpec, wall_seconds
from .configs import PipelineConfigs

#: Errors of forecasts by name; less is better.
ERRORS = {
    "mae": lambda y, f: float(np.mean(np.abs(y - f))),
    "mse": lambda y, f: float(np.mean((y - f) ** 2)),
    "wmape": lambda y, f: float(np.sum(np.abs(y - f)) / np.sum(np.abs(y))) if np.any(y) else float("nan"),
}


def candidate_table(df: DataFrame, configs: PipelineConfigs, lags: int, seed: int = 0) -> DataFrame:
    """(model, name, params): a row a candidate; params as JSON."""
    rows = [(alias, name, json.dumps({"lags": lags, "seed": seed} | options["init_configs"] | options["fit_configs"])) for alias, name, options in configs.entries]
    for _, name, params in rows:
        if getattr(make(name, **json.loads(params)), "wide_inputs", False):
            raise ValueError(f"{name} looks at more than a series' values; search it by a leaderboard")
    return df.sparkSession.createDataFrame(rows, "model string, name string, params string")


def _trained(keys: list[str], valid_rows: int, metric: str):
    """One pair's score: trained on the rows before the held-out ones, of which those of the rung are there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        first = pdf.iloc[0]
        y, days = pdf["__y"].to_numpy(np.float64), pdf["__w"].to_numpy(np.int64) / 86400
        score = None
        model = make(first["name"], **json.loads(first["params"]))
        n = len(y) - valid_rows
        if n > model.lags:
            try:
                state = model.fit_values(y[:n], days[:n])
                f = np.asarray(model.predict_values(state, y[n - model.lags : n], days[n:]), np.float64)
                found = ERRORS[metric](y[n:], f)
                score = found if np.isfinite(found) else None
            except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                score = None
        return pd.DataFrame([{k: first[k] for k in keys} | {"model": first["model"], "train_rows": n, "score": score}])

    return run


def halving(df: DataFrame, spec: SeriesSpec, configs: PipelineConfigs, lags: int, valid_rows: int | None = None, rungs: int = 3, metric: str = "mae", seed: int = 0) -> DataFrame:
    """(keys, rung, model, train_rows, score, rank, kept): every rung's scores; the winner of a series has rank 1 in the last rung."""
    if rungs < 1 or metric not in ERRORS:
        raise ValueError(f"rungs must be positive and the metric one of {sorted(ERRORS)}")
    keys, held = list(spec.keys), valid_rows or lags
    kind = df.schema[spec.time].dataType
    known = ship(df).where(F.col(spec.target).isNotNull())
    rows = Slices.of(known.select(*keys, spec.time, spec.target), spec).numbered("__rn", "__n")
    rows = rows.select(*keys, "__rn", "__n", F.col(spec.target).cast("double").alias("__y"), wall_seconds(F.col(spec.time), kind).alias("__w"))
    racing, out = F.broadcast(candidate_table(df, configs, lags, seed)), None
    scored = T.StructType([*[rows.schema[k] for k in keys], T.StructField("model", T.StringType()), T.StructField("train_rows", T.IntegerType()), T.StructField("score", T.DoubleType())])
    for rung in range(rungs):
        stretch = F.floor((F.col("__n") - held) / F.lit(1 << (rungs - 1 - rung))) + held
        pairs = rows.where(F.col("__rn") >= F.col("__n") - stretch)
        # The first rung pairs each series with all candidates, which are few and broadcast; later ones with its own survivors.
        pairs = pairs.crossJoin(racing) if out is None or not keys else pairs.join(racing, keys)
        found = pairs.groupBy(*keys, "model").applyInPandas(_trained(keys, held, metric), scored).where("score IS NOT NULL")
        over = Window.partitionBy(*keys)
        found = found.withColumn("rank", F.row_number().over(over.orderBy("score", "model"))).withColumn("__of", F.count(F.lit(1)).over(over))
        last = rung == rungs - 1
        kept = F.col("rank") == 1 if last else F.col("rank") <= F.ceil(F.col("__of") / 2)
        found = written(found.select(*keys, F.lit(rung).alias("rung"), "model", "train_rows", "score", "rank", kept.alias("kept")), "rung")
        out = found if out is None else out.unionByName(found)
        racing = found.where("kept").select(*keys, "model").join(F.broadcast(candidate_table(df, configs, lags, seed)), "model")
        racing = racing if keys else F.broadcast(racing)
    return out


def best(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model, score): each series' winner in the last rung that it took part in."""
    over = Window.partitionBy(*keys).orderBy(F.desc("rung"), "rank")
    return found.withColumn("__k", F.row_number().over(over)).where("__k = 1").select(*keys, "model", "score")
