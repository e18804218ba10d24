"""Nested settings: dotted access, overrides, presets."""

from __future__ import annotations

import copy
import json
import warnings
from dataclasses import dataclass
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # settings can be JSON, which is YAML too
    yaml = None

# The documented settings of the models, splits and metrics.
DEFAULTS: dict[str, Any] = {
    "data": {
        "dir": "data", "customers": "g_dim_customers.csv", "products": "g_dim_products.csv", "sales": "g_fact_sales.csv",
        "customer_report": "Customer_report_cleaned_data.csv", "product_report": "Product_report_cleaned_data.csv", "sample_size": 1.0,
    },
    "split": {"strategy": "time", "test_size": 0.2, "min_ratings": 5, "random_state": 42, "holdout_timestamp": None, "strata": None},
    "models": {
        "base": {"top_k": 10},
        "content_based": {"max_features": 100, "min_df": 0.01, "max_df": 0.95, "similarity": "cosine"},
        "neighborhood": {"user_based": True, "k": 30, "min_k": 1, "similarity": "cosine"},
        "matrix_factorization": {"n_factors": 50, "n_epochs": 20, "reg": 0.02, "seed": 42},
        "hybrid": {"weights": {"content": 0.3, "collaborative": 0.7}},
        "cold_start": {"min_interactions": 5, "diversity_weight": 0.3, "fields": ["age_group", "country", "gender", "marital_status"]},
        "popularity": {"consider_ratings": True},
    },
    "evaluation": {"k_values": [5, 10, 20], "metrics": ["precision", "recall", "ndcg", "hit_rate", "map", "mrr", "diversity", "novelty"], "relevance_threshold": 3.5},
    "output": {"dir": "results"},
}
#: Smaller settings for a share of the customers.
PRESETS: dict[str, dict[str, Any]] = {
    f"{share}%": {
        "data": {"sample_size": share / 100},
        "models": {"neighborhood": {"k": k}, "matrix_factorization": {"n_factors": factors, "n_epochs": epochs}},
    }
    for share, k, factors, epochs in ((10, 10, 20, 10), (25, 20, 30, 15), (50, 25, 40, 20), (100, 30, 50, 20))
}


# Other names of settings, as they are found in files, and their places here.
ALIASES = {
    "data.dataset_dir": "data.dir", "data.random_seed": "split.random_state",
    **{f"data.paths.{name}": f"data.{name}" for name in ("customers", "products", "sales", "customer_report", "product_report")},
    "models.content_based.tfidf.max_features": "models.content_based.max_features", "models.content_based.tfidf.min_df": "models.content_based.min_df",
    "models.content_based.tfidf.max_df": "models.content_based.max_df", "models.content_based.similarity_metric": "models.content_based.similarity",
    "models.collaborative.neighborhood.user_based": "models.neighborhood.user_based", "models.collaborative.neighborhood.k_neighbors": "models.neighborhood.k",
    "models.collaborative.neighborhood.min_k": "models.neighborhood.min_k", "models.collaborative.neighborhood.sim_options.name": "models.neighborhood.similarity",
    "models.collaborative.matrix_fact.n_factors": "models.matrix_factorization.n_factors", "models.collaborative.matrix_fact.n_epochs": "models.matrix_factorization.n_epochs",
    "models.collaborative.matrix_fact.lr_all": "models.matrix_factorization.lr", "models.collaborative.matrix_fact.reg_all": "models.matrix_factorization.reg",
    "models.collaborative.matrix_fact.biased": "models.matrix_factorization.biased", "models.cold_start.demographic_fields": "models.cold_start.fields",
    "models.hybrid.weights.content_based": "models.hybrid.weights.content", "experiment.output_dir": "output.dir",
}
#: Settings that have no default but are read, and groups whose names are free.
KNOWN = {"data.encoding", "models.matrix_factorization.solver", "models.matrix_factorization.lr", "models.matrix_factorization.biased", "models.matrix_factorization.blocks", "models.neighborhood.min_similarity"}
FREE = ("models.hybrid.weights.",)


def leaves(settings: dict, above: str = "") -> dict[str, Any]:
    """Values by dotted path; an empty dictionary is a value."""
    out: dict[str, Any] = {}
    for key, value in settings.items():
        path = f"{above}{key}"
        out |= leaves(value, f"{path}.") if isinstance(value, dict) and value else {path: value}
    return out


def placed(values: dict) -> dict:
    """Settings under the names used here; those that nothing reads are kept where they are, with a warning that names them."""
    out: dict[str, Any] = {}
    known, ignored = leaves(DEFAULTS), []
    for path, value in leaves(values).items():
        own = ALIASES.get(path, path)
        if own not in known and own not in KNOWN and not own.startswith(FREE):
            ignored.append(path)
        *parents, last = own.split(".")
        at = out
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value
    if ignored:
        warnings.warn(f"settings that nothing reads: {', '.join(sorted(ignored))}", stacklevel=3)
    return out


def nested(settings: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path, or ``default``."""
    for part in path.split("."):
        if not isinstance(settings, dict) or part not in settings:
            return default
        settings = settings[part]
    return settings


def merged(base: dict, over: dict) -> dict:
    """A deep copy of ``base`` in which the values of ``over`` win; dictionaries are merged."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


class Config:
    """Settings over ``DEFAULTS``."""

    def __init__(self, values: dict | None = None):
        self.values = merged(DEFAULTS, placed(values or {}))

    @classmethod
    def load(cls, path: str) -> Config:
        """Settings of a YAML or JSON file over the defaults. Raises where the file is missing."""
        text = Path(path).read_text(encoding="utf-8")
        return cls((yaml.safe_load(text) if yaml else json.loads(text)) or {})

    @classmethod
    def preset(cls, name: str) -> Config:
        return cls(PRESETS[name])

    def get(self, path: str, default: Any = None) -> Any:
        return nested(self.values, path, default)

    def set(self, path: str, value: Any) -> None:
        """Sets a dotted path; missing levels are made."""
        *parents, last = path.split(".")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def save(self, path: str) -> None:
        text = yaml.safe_dump(self.values, sort_keys=False) if yaml else json.dumps(self.values, indent=2)
        Path(path).write_text(text, encoding="utf-8")


@dataclass(frozen=True)
class SplitOptions:
    """How interactions are split."""

    strategy: str = "time"
    test_size: float = 0.2
    min_ratings: int = 5
    random_state: int = 42
    holdout_timestamp: str | None = None
    strata: str | None = None

    @classmethod
    def of(cls, config: Config) -> SplitOptions:
        return cls(**{f: config.get(f"split.{f}", getattr(cls, f)) for f in cls.__dataclass_fields__})
