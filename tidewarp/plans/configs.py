"""Which models a pipeline trains, under what alias and with what parameters.

All parameters of a model have one name wherever they are used: init_configs and fit_configs set them for
training, fit_configs coming first, and predict_configs replace them while forecasting (as freq and
include_history of the additive model do). Options that the model doesn't have are an error.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from itertools import product

from ..models.registry import MODELS, OTHERS, checked

STEPS = ("init_configs", "fit_configs", "predict_configs")


@dataclass
class PipelineConfigs:
    """A list of (name[, alias], {init_configs, fit_configs, predict_configs}). Aliases default to name_1, name_2, ..."""

    configs: list[tuple]
    entries: list[tuple[str, str, dict]] = field(default_factory=list, init=False)

    def __post_init__(self):
        seen: dict[str, int] = {}
        for item in self.configs:
            if not isinstance(item, tuple) or len(item) not in (2, 3) or not isinstance(item[-1], dict):
                raise ValueError("a config is (name, options) or (name, alias, options)")
            name, options = item[0], copy.deepcopy(item[-1])
            if name not in MODELS and name not in OTHERS:
                raise KeyError(f"no model named {name}")
            if unknown := set(options) - set(STEPS):
                raise KeyError(f"unknown options {sorted(unknown)}")
            for step in ("fit_configs", "predict_configs"):
                checked(name, options.get(step, {}))
            seen[name] = seen.get(name, 0) + 1
            alias = item[1] if len(item) == 3 else f"{name}_{seen[name]}"
            if any(alias == x[0] for x in self.entries):
                raise ValueError(f"alias {alias} is used twice")
            self.entries.append((alias, name, {k: options.get(k, {}) for k in STEPS}))

    @classmethod
    def grid(cls, name: str, options: dict[str, list], step: str = "init_configs") -> PipelineConfigs:
        """A model once for each combination of the values of its parameters; aliases tell them, so the leaderboard is a parameter search."""
        checked(name, options)
        names = list(options)
        alias = lambda values: "--".join([name, *(f"{k}-{v}" for k, v in zip(names, values, strict=True))])
        return cls([(name, alias(values), {step: dict(zip(names, values, strict=True))}) for values in product(*options.values())])

    def get_configs(self, alias: str) -> dict:
        for a, _, options in self.entries:
            if a == alias:
                return copy.deepcopy(options)
        raise KeyError(alias)
