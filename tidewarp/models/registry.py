"""Model names, presets and construction."""

from __future__ import annotations

import inspect

from . import linear, nets, trees
from .base import Forecaster

MODELS: dict[str, type[Forecaster]] = {
    c.name: c
    for c in (
        linear.AutoArima, linear.Additive, linear.DLinear, linear.NLinear, trees.CatBoost, trees.LightGBM, trees.XGBoost, trees.RandomForest, trees.WideGBRT, trees.MultiOutput,
        trees.MultiStep, trees.Chain, nets.NBeats, nets.NHits, nets.TCN, nets.TFT, nets.GAU, nets.StackingRNN, nets.Time2Vec, nets.Transformer, nets.TiDE, nets.PatchRNN,
    )
}
#: Models beside the registered names.
OTHERS: dict[str, type[Forecaster]] = {c.name: c for c in (linear.Naive, nets.ITransformer)}

#: Fixed presets.
PRESETS: dict[str, tuple[str, ...]] = {
    "light": ("d_linear", "lightgbm", "multi_step_model", "n_hits", "n_linear", "random_forest", "regressor_chain", "tcn", "xgboost"),
    "nn": ("d_linear", "gau", "n_beats", "n_hits", "n_linear", "patch_rnn", "stacking_rnn", "tcn", "tft", "tide", "time2vec", "transformer"),
    "ml": ("catboost", "lightgbm", "multi_output_model", "multi_step_model", "random_forest", "wide_gbrt", "xgboost"),
    "all": tuple(sorted(MODELS)),
}


def accepted(kind: type, params: dict) -> dict:
    """Only the parameters that a class takes."""
    return {k: v for k, v in params.items() if k in inspect.signature(kind).parameters}


def make(name: str, **params) -> Forecaster:
    kind = MODELS.get(name) or OTHERS.get(name)
    if kind is None:
        raise KeyError(f"no model named {name}; there are {sorted(MODELS)}")
    return kind(**accepted(kind, params))


def checked(name: str, options: dict) -> dict:
    """options, if the model has a parameter for each of them."""
    kind = MODELS.get(name) or OTHERS[name]
    if unknown := set(options) - set(accepted(kind, options)):
        raise KeyError(f"{name} has no parameters {sorted(unknown)}")
    return options


def model_names(include: str | list | tuple | None, exclude: list | tuple | None = None) -> list[str]:
    """Names in training order: a preset, names or classes (None: all), without duplicates or excluded ones, sorted."""
    if include is None:
        include = "all"
    found = PRESETS[include] if isinstance(include, str) and include in PRESETS else [include] if isinstance(include, str | type) else include
    names = [x if isinstance(x, str) else x.name for x in found]
    unknown = sorted(set(names) - set(MODELS) - set(OTHERS))
    if unknown:
        raise KeyError(f"no model named {unknown}")
    return sorted(set(names) - {x if isinstance(x, str) else x.name for x in exclude or ()})
